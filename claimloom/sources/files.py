"""Scans and sinks: records, documents, tables in archives and sheets, page markers, manifests."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# scans ------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line, blank lines skipped; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a file, with its ``path``."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def map_rows(frame: DataFrame, column: str, key: str = "sid") -> DataFrame:
    """A row for each entry of a map column: its key and its value's fields, beside the other columns."""
    rest = [c for c in frame.columns if c != column]
    return frame.select(*rest, F.explode(column).alias(key, "_v")).select(*rest, key, "_v.*")


def with_page(frame: DataFrame, path: str = "path") -> DataFrame:
    """``volume_id`` and ``page`` from names like ``vol1/0047.json``."""
    named = r"(vol[0-9]+)[/_]0*([0-9]+)\.[A-Za-z]+$"
    return frame.withColumns({"volume_id": F.regexp_extract(path, named, 1), "page": F.regexp_extract(path, named, 2).cast("int")})


def read_csv_strict(spark: SparkSession, path: str, schema: str, unique: list[str] | None = None, separator: str = ",") -> DataFrame:
    """CSV whose header must be the schema's names in order; cells that do not cast fail, repeated keys are refused."""
    options = {"header": True, "enforceSchema": False, "mode": "FAILFAST", "sep": separator, "encoding": "UTF-8"}
    frame = spark.read.schema(schema).options(**options).csv(path)
    if unique:
        twice = frame.groupBy(*unique).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{path}: repeated {unique}: {twice[0].asDict()}")
    return frame


def read_zip_members(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """``archive, member, line`` of the text members of ZIP files, unpacked in the tasks."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(n for n in archive.namelist() if n.endswith(suffix)):
                        with archive.open(member) as lines:
                            texts = [x.decode("utf-8").rstrip("\r\n") for x in lines]
                        texts = [x for x in texts if x.strip()]
                        yield pa.RecordBatch.from_arrays([pa.array([v] * len(texts)) for v in (name, member)] + [pa.array(texts, pa.string())], names=["archive", "member", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line string")


def read_zip_matrix(spark: SparkSession, path: str, suffix: str = ".npy") -> DataFrame:
    """``archive, member, index, embedding`` of the matrix members of ZIP files, read in the tasks."""
    import numpy as np

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(n for n in archive.namelist() if n.endswith(suffix)):
                        with archive.open(member) as stream:
                            matrix = np.load(io.BytesIO(stream.read()), allow_pickle=False).astype(np.float32)
                        for at in range(0, len(matrix), 4096):
                            part = matrix[at : at + 4096]
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([member] * len(part)), pa.array(np.arange(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float32()))], names=["archive", "member", "index", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, index long, embedding array<float>")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``index, embedding`` of ``.npy`` float matrices; row numbers follow the files' own order."""
    import numpy as np

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                matrix = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for at in range(0, len(matrix), 4096):
                    part = matrix[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float32()))], names=["index", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "index long, embedding array<float>")


def read_word_vectors(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``token, embedding`` of a (gzipped) word-vector text for the ``wanted(token)``; lines and widths must match the header."""
    lines = spark.read.text(path).where("value <> ''").withColumn("parts", F.split(F.rtrim("value"), " "))
    header = lines.where(F.size("parts") == 2).limit(1).collect()
    rows = lines.where(F.size("parts") > 2).select(F.element_at("parts", 1).alias("token"), F.slice("parts", 2, 1 << 30).cast("array<float>").alias("embedding"))
    if header:
        count, width = int(header[0].parts[0]), int(header[0].parts[1])
        found = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if tuple(found) != (count, width, width):
            raise ValueError(f"{path}: header says {count} x {width}, found {tuple(found)}")
    return rows.join(wanted.select("token").distinct(), "token", "left_semi")


def scan_markdown(lines: DataFrame) -> DataFrame:
    """Rows of Markdown notes by shape: ``kind`` pair (``- **91%** — a ↔ b``), term (``- **E01 Label**: text``), cells."""
    pair, term = r"^- \*\*([0-9.]+)%\*\* — (.+?) ↔ (.+)$", r"^- \*\*([ER][0-9]+) ([^*]+)\*\*: (.+)$"
    v = F.col("value")
    cells = F.transform(F.split(F.regexp_replace(v, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    extract = lambda p: F.array(*[F.regexp_extract(v, p, k) for k in (1, 2, 3)])
    is_cells = v.rlike(r"^\s*\|.*\|\s*$") & ~v.rlike(r"^[\s|:-]+$")
    row = F.when(v.rlike(pair), F.struct(F.lit("pair").alias("kind"), extract(pair).alias("fields"))).when(v.rlike(term), F.struct(F.lit("term").alias("kind"), extract(term).alias("fields")))
    return lines.select(row.otherwise(F.when(is_cells, F.struct(F.lit("cells").alias("kind"), cells.alias("fields")))).alias("r")).where("r is not null").select("r.*")


def split_marked_volume(texts: DataFrame, text: str = "value") -> DataFrame:
    """``book, page, body, back_matter`` of texts with ``[[BOOK=… PAGE=dddd]]`` marks; all pages from the first index page on are back matter."""
    mark = r"\[\[BOOK=([^\]]*?) PAGE=([0-9]+)\]\]"
    books, pages = F.regexp_extract_all(text, F.lit(mark), F.lit(1)), F.regexp_extract_all(text, F.lit(mark), F.lit(2))
    bodies = F.slice(F.split(text, mark), 2, 1 << 30)
    rows = texts.select(F.explode(F.arrays_zip(books.alias("book"), pages.alias("page"), bodies.alias("body"))).alias("p"))
    rows = rows.select("p.book", F.col("p.page").cast("int").alias("page"), F.trim("p.body").alias("body"))
    index = F.col("body").rlike(r"(?i)^\s*index\b").cast("int")
    w = Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("back_matter", F.max(index).over(w) == 1)


#: What a symbol of a word holds.
SYMBOL = ("text", "brk", "x0", "y0", "x1", "y1")


def visual_lines(symbols: DataFrame) -> DataFrame:
    """OCR lines from ``page, block, paragraph, word, position, text, brk, x0, y0, x1, y1`` symbols.

    LINE_BREAK and EOL_SURE_SPACE end a line; SPACE and SURE_SPACE are blanks.
    """
    listed = F.array_sort(F.collect_list(F.struct("position", *SYMBOL)))
    words = symbols.groupBy("page", "block", "paragraph", "word").agg(listed.alias("_s"))
    return word_lines(words.select("page", "block", "paragraph", "word", *(F.col("_s")[c].alias(c) for c in SYMBOL)))


def word_lines(words: DataFrame) -> DataFrame:
    """``visual_lines`` of words as OCR gives them: ``page, block, paragraph, word`` and arrays ``text, brk, x0, y0, x1, y1``, an entry a symbol.

    A word is cut behind its line ends into pieces (most are one), and only pieces are sorted,
    numbered and joined: symbols stay in the row of their word.
    """
    ending = lambda b: F.coalesce(b.isin("LINE_BREAK", "EOL_SURE_SPACE"), F.lit(False))
    # by position in one pass: a lookup by number within a lambda may make the array anew each time
    ends = F.array_compact(F.transform("brk", lambda b, k: F.when(ending(b), k + 1)))
    cut_at = words.where(F.size("text") > 0).withColumn("_cuts", F.array_union(ends, F.array(F.size("text"))))
    pieces = cut_at.select("*", F.posexplode("_cuts").alias("_piece", "_upto")).withColumn("_from", F.coalesce(F.get("_cuts", F.col("_piece") - 1), F.lit(0)))
    part = lambda c: F.slice(c, F.col("_from") + 1, F.col("_upto") - F.col("_from"))
    shown = F.zip_with(part("text"), part("brk"), lambda t, b: F.when(b.isin("SPACE", "SURE_SPACE"), F.concat(t, F.lit(" "))).otherwise(t))
    boxes = [F.array_min(part(c)).alias(c) for c in ("x0", "y0")] + [F.array_max(part(c)).alias(c) for c in ("x1", "y1")]
    pieces = pieces.select("page", "block", "paragraph", "word", "_piece", F.array_join(shown, "").alias("text"), *boxes, ending(F.get("brk", F.col("_upto") - 1)).cast("int").alias("_ends"))
    w = Window.partitionBy("page").orderBy("block", "paragraph", "word", "_piece")
    rows = pieces.withColumn("line", F.coalesce(F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct("block", "paragraph", "word", "_piece", "text")))
    return rows.groupBy("page", "line").agg(F.array_join(listed["text"], "").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of XLSX files by name (else the first): the first row names the columns, cells are strings.

    Files come through Spark's file systems and are opened in the tasks; only the header row
    reaches the driver.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = sheet_rows(io.BytesIO(content), sheet)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["row", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, cells array<string>")
    names = rows.where("row = 0").select("cells").first()[0]
    return rows.where("row > 0").select(*(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)))


class SheetSource(DataSource):
    """``spark.read.format("sheet")``: a local XLSX file's sheet by option ``sheet``, else the first; see ``read_sheet`` for shared ones."""

    @classmethod
    def name(cls):
        return "sheet"

    def schema(self):
        return StructType([StructField(n, StringType()) for n in sheet_rows(self.options["path"], self.options.get("sheet"))[0]])

    def reader(self, schema):
        return SheetReader(self.options["path"], len(schema), self.options.get("sheet"))


class SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int, sheet: str | None):
        self.path, self.width, self.sheet = path, width, sheet

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        for row in sheet_rows(partition.value, self.sheet)[1:]:
            yield tuple([*row, *[None] * self.width][: self.width])


def _sheet_member(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The archive member of a sheet by its name, by way of the workbook's relations; the first sheet without one."""
    if sheet is None:
        return min(n for n in book.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml"))
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for entry in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if entry.tag.endswith("}sheet") and entry.get("name") == sheet:
            relation = next(v for k, v in entry.attrib.items() if k.endswith("}id"))
            return "xl/" + targets[relation].removeprefix("/xl/")
    raise KeyError(f"no sheet {sheet!r}")


def sheet_rows(path, sheet: str | None = None) -> list[list]:
    """Cells of a sheet: shared and inline strings, booleans, numbers as written; gaps are None."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        cells_of = ElementTree.fromstring(book.read(_sheet_member(book, sheet)))
    out = []
    for row in cells_of.iter(f"{ns}row"):
        cells: list = []
        for cell in row.iter(f"{ns}c"):
            letters = [c for c in cell.get("r", "") if c.isalpha()]
            at = 0
            for c in letters:
                at = at * 26 + ord(c) - 64
            value, kind = cell.find(f"{ns}v"), cell.get("t")
            text = "".join(t.text or "" for t in cell.iter(f"{ns}t")) if kind == "inlineStr" else None if value is None else value.text
            text = shared[int(text)] if kind == "s" and text is not None else {"1": "true", "0": "false"}.get(text, text) if kind == "b" else text
            cells += [None] * (max(at, len(cells) + 1) - len(cells) - 1) + [text]
        out.append(cells)
    return out


# sinks ------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_staged(frame: DataFrame, path: str, check=None, form: str = "parquet") -> None:
    """Write beside the target, let ``check(frame)`` object, then rename; an existing target is refused.

    Goes through Spark's file systems alone, so it works on any shared store.
    """
    spark = frame.sparkSession
    fs, target = _files(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    frame.write.format(form).save(staging)
    try:
        if check is not None:
            check(spark.read.format(form).schema(frame.schema).load(staging))
    except Exception:
        fs.delete(_files(spark, staging)[1], True)
        raise
    if not fs.rename(_files(spark, staging)[1], target):
        raise OSError(f"cannot rename to {path}")


def write_csv(frame: DataFrame, path: str, columns: list[str], gzipped: bool = False, mark: bool = False) -> None:
    """CSV with a header and the columns in this order; ``mark`` begins each file with a byte order mark."""
    rows = frame.select(*columns)
    if mark:
        rows = rows.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    rows.write.option("header", True).option("compression", "gzip" if gzipped else "none").csv(path)


def write_jsonl(frame: DataFrame, path: str) -> None:
    """The job's commit is what makes it atomic; an existing path is refused."""
    frame.write.mode("errorifexists").json(path)


def quads(frame: DataFrame, graph: str, subject: str, columns: dict[str, str], base: str = "urn:claim:") -> DataFrame:
    """N-Quads of a table: one statement for each non-null value of ``columns`` (column -> predicate)."""
    escape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), escape(F.col(c)).alias("o")) for c, p in columns.items()]))
    rows = frame.select(F.col(subject).cast("string").alias("s"), pairs.alias("x")).where("x.o is not null")
    return rows.select(F.format_string(f'<{base}%s> <{base}%s> "%s" <{base}{graph}> .', "s", "x.p", "x.o").alias("value"))


#: Bytes of JSON that an artifact may have.
ARTIFACT_BYTES = 64 << 20


def artifact(frame: DataFrame, most: int = ARTIFACT_BYTES) -> dict:
    """A small frame as compact JSON lines, their deterministic gzip and both hashes; one of over ``most`` bytes is refused before it is collected."""
    lines = frame.select(F.to_json(F.struct(*frame.columns)).alias("value"))
    size = lines.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"{size} bytes do not fit an artifact of {most}")
    plain = "\n".join(r.value for r in lines.collect()).encode()
    packed = gzip.compress(plain, 9, mtime=0)
    return {"plain": plain, "gzip": packed, "sha256": hashlib.sha256(plain).hexdigest(), "gzip_sha256": hashlib.sha256(packed).hexdigest()}


def manifest(spark: SparkSession, paths: list[str], root: str = "") -> DataFrame:
    """``path, bytes, sha256`` of each input file; paths are those below ``root``, so that a moved folder compares equal."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    end = F.locate(root, F.col("path")) + len(root) if root else F.lit(1)
    below = F.regexp_replace(F.substr(F.col("path"), end, F.length("path")), "^/+", "") if root else F.col("path")
    return files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_manifest(expected: DataFrame, found: DataFrame) -> None:
    """Raise when a hash differs, or a file is missing or new; files are told apart by their whole paths."""
    both = expected.select(F.col("path").alias("f"), F.col("sha256").alias("a")).join(found.select(F.col("path").alias("f"), F.col("sha256").alias("b")), "f", "full")
    bad = both.where(~F.col("a").eqNullSafe(F.col("b"))).orderBy("f").limit(5).collect()
    if bad:
        raise ValueError(f"inputs changed: {[r.f for r in bad]}")


def latest_attempts(frame: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def parsed(frame: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text as columns, with ``ok`` false where it does not parse."""
    value = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    return frame.withColumn("ok", F.try_parse_json(column).isNotNull()).withColumn("_v", value).select("*", "_v.*").drop("_v")


def compact_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
