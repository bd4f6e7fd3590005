"""Dense ``.npy`` matrices on a shared store: scanned by byte ranges, written by tasks in parts."""

from __future__ import annotations

import io
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a partition of a scan.
ROWS = 1 << 16
#: Rows of a batch that goes to Spark.
BATCH = 1 << 12


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the place in it of a path or URI."""
    where = urlparse(path)
    return (fs.LocalFileSystem(), where.path) if where.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    store, place = _store(path)
    if store.get_file_info(place).type == fs.FileType.File:
        return [place]
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File and i.path.endswith(".npy"))


def header(stream) -> tuple[tuple[int, int], np.dtype, int]:
    """Rows and columns, the kind of number and where the numbers begin; other shapes and orders are refused."""
    start = io.BytesIO(stream.read(1 << 16))
    version = np.lib.format.read_magic(start)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(start)
    if len(shape) != 2 or fortran or kind.kind != "f":
        raise ValueError(f"not a matrix of floats in row order: {shape}, {kind}")
    return shape, kind, start.tell()


class Rows(InputPartition):
    def __init__(self, file: str, kind: str, width: int, offset: int, n: int, index: int):
        self.file, self.kind, self.width, self.offset, self.n, self.index = file, kind, width, offset, n, index


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        store, _ = _store(self.path)
        out, index, widths = [], 0, set()
        for file in _files(self.path):
            with store.open_input_file(file) as stream:
                (n, width), kind, offset = header(stream)
                if stream.size() != offset + n * width * kind.itemsize:
                    raise ValueError(f"{file}: {stream.size()} bytes do not hold {n} x {width}")
            widths.add(width)
            out += [Rows(file, kind.str, width, offset + at * width * kind.itemsize, min(self.rows, n - at), index + at) for at in range(0, n, self.rows)]
            index += n
        if len(widths) > 1:
            raise ValueError(f"{self.path}: widths {sorted(widths)}")
        return out or [Rows("", "<f4", 0, 0, 0, 0)]

    def read(self, partition):
        if not partition.n:
            return
        kind = np.dtype(partition.kind)
        with _store(self.path)[0].open_input_file(partition.file) as stream:
            stream.seek(partition.offset)
            for at in range(0, partition.n, BATCH):
                n = min(BATCH, partition.n - at)
                values = np.frombuffer(stream.read(n * partition.width * kind.itemsize), kind).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, partition.width), pa.int32()), pa.array(values)) if partition.width else pa.array([[]] * n, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + partition.index + at), lists], names=["index", "embedding"])


class MatrixSource(DataSource):
    """``spark.read.format("npy")``: ``index, embedding`` of a matrix file, or of a folder's files in the order of their names.

    Each partition reads its own byte range, of ``rows`` rows at most; only headers are read before.
    """

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "index long, embedding array<float>"

    def reader(self, schema):
        return MatrixReader(self.options["path"], int(self.options.get("rows", ROWS)))


def scan_matrix(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy").option("rows", str(rows)).load(path)


def write_matrix(rows: DataFrame, path: str, parts: int) -> None:
    """``rows(index, embedding)``, numbered from 0 without gaps, as a folder of ``.npy`` files; a part is ``index`` over an equal share.

    Tasks write their parts under names of their own and move them into place, so a repeated
    task replaces its part whole.
    """
    n, low, high, width = rows.agg(F.count("*"), F.min("index"), F.max("index"), F.max(F.size("embedding"))).first()
    if n and (low, high) != (0, n - 1):
        raise ValueError(f"{n} rows are numbered from {low} to {high}")
    share = max(1, -(-n // parts))

    def save(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        store, place = _store(path)
        store.create_dir(place, recursive=True)
        packed = io.BytesIO()
        matrix = np.zeros((table.num_rows, width), np.float32)
        for k, x in enumerate(table.column("embedding").to_pylist()):
            if len(x) != width:
                raise ValueError(f"row {table.column('index')[k]} has {len(x)} of {width} entries")
            matrix[k] = x
        np.save(packed, matrix)
        name = f"{place}/part-{key[0].as_py():06d}.npy"
        part = f"{name}.{np.random.default_rng().integers(1 << 62)}"
        with store.open_output_stream(part) as out:
            out.write(packed.getvalue())
        store.move(part, name)
        return pa.table({"part": [key[0].as_py()], "rows": [table.num_rows]}, schema=pa.schema([("part", pa.int64()), ("rows", pa.int64())]))

    parted = rows.select(F.col("index").cast("long"), F.col("embedding").cast("array<float>"), F.expr(f"cast(index div {share} as bigint)").alias("part"))
    saved = parted.groupBy("part").applyInArrow(save, "part long, rows long").agg(F.sum("rows")).first()[0] or 0
    if saved != n:
        raise RuntimeError(f"{saved} of {n} rows were saved")


def aligned(matrix: DataFrame, records: DataFrame, index: str = "index") -> DataFrame:
    """``records`` with the ``embedding`` of the matrix's row of their ``index``; raises unless rows and records match one to one."""
    numbered = records.groupBy(index).agg(F.count("*").alias("_n"))
    met = matrix.select(F.col("index").alias(index), F.lit(True).alias("_m")).join(numbered, index, "full")
    lost, extra, twice = met.agg(F.count_if(F.col("_m").isNull()), F.count_if(F.col("_n").isNull()), F.count_if(F.col("_n") > 1)).first()
    if lost or extra or twice:
        raise ValueError(f"{lost} records without a row, {extra} rows without a record, {twice} numbers given twice")
    return records.join(matrix.withColumnRenamed("index", index), index)
