"""Where a quoted text stands on a page: a ladder of modes from a hint line outward, and spans of quotations with a gap."""

from __future__ import annotations

import bisect
import re

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from claimloom.model import table
from claimloom.registry import query

#: Marks of words left out within a quotation (fixed value).
GAP = re.compile(r"\s*(?:\.\.\.+|…)\s*")
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _hits(text: str, needle: str, mode: str) -> list[tuple[int, int]]:
    """All places, overlapping ones too, in order."""
    if mode == "exact":
        pattern = re.escape(needle)
    elif mode == "normalized":
        pattern = r"\s+".join(map(re.escape, needle.split()))
    else:
        pattern = r"\s*".join(map(re.escape, "".join(needle.split())))
    if not pattern:
        return []
    found = re.finditer(f"(?=({pattern}))", text, 0 if mode == "exact" else re.I)
    return [m.span(1) for m in found]


def place(text: str, needle: str, hint: int | None, occurrence: int, after: int = 0) -> tuple[list[tuple[int, int]], str] | None:
    """The spans of a quotation and the mode that found it.

    The ladder: exactly on the hint line (``line``), on the line nearest to it (``near``, the
    later of two), anywhere exactly (``page``, over line ends too), with case and blanks
    folded (``normalized``), without any white space (``compact``). Of several places the
    ``occurrence``-th (from 1) counts within the line; beyond lines it is the
    ``occurrence``-th from the hint line's start on and then from the page's top. Without a
    hint, lines are passed over. A quotation with a gap is two spans: its first part by the
    ladder, its last part at the first place behind that.
    """
    if not text or not needle or not needle.strip():
        return None
    parts = [p for p in GAP.split(needle) if p.strip()]
    if len(parts) > 1:
        head = place(text, parts[0], hint, occurrence, after)
        if head is None:
            return None
        for mode in ("exact", "normalized", "compact"):
            tail = next((s for s in _hits(text, parts[-1], mode) if s[0] >= head[0][0][1]), None)
            if tail:
                return [head[0][0], tail], "ellipsis"
        return None
    starts, nth = _line_starts(text), max(1, occurrence or 1)
    exact = [s for s in _hits(text, needle, "exact") if s[0] >= after]
    origin = 0
    if hint is not None and 1 <= hint <= len(starts):
        origin = starts[hint - 1]
        of_line: dict[int, list] = {}
        for s in exact:
            line = bisect.bisect_right(starts, s[0])
            if line == bisect.bisect_right(starts, s[1] - 1):
                of_line.setdefault(line, []).append(s)
        for line in sorted(of_line, key=lambda k: (abs(k - hint), -k)):
            if len(of_line[line]) >= nth:
                return [of_line[line][nth - 1]], "line" if line == hint else "near"
    for mode, found in (("page", exact), ("normalized", None), ("compact", None)):
        found = [s for s in _hits(text, needle, mode) if s[0] >= after] if found is None else found
        if len(found) >= nth:
            turned = [s for s in found if s[0] >= origin] + [s for s in found if s[0] < origin]
            return [turned[nth - 1]], mode
    return None


# pickled in runs of 100 rows: an Arrow batch would hold 10,000 whole texts of any length in a worker
@F.udf(StructType([StructField("spans", SPANS), StructField("mode", StringType())]), useArrow=False)
def located(text, needle, hint, occurrence):
    """``place`` for each row; spans end exclusively, in characters. Nothing found, null or blank: nulls."""
    found = place(text, needle, hint, 1 if occurrence is None else occurrence)
    return (None, None) if found is None else found


@query("x13_located")
def x13(spark, d):
    """From each text's middle line a stretch, quoted as it stands, in capitals, without blanks or with a gap; the hint is one line off for every third."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.split("text", "\n").alias("lines"))
    docs = docs.withColumn("k", F.floor(F.size("lines") / 2).cast("int")).withColumn("line", F.trim(F.get("lines", F.col("k"))))
    part = F.substring("line", 1, 40)
    quoted = F.when(F.col("doc_id") % 4 == 0, part).when(F.col("doc_id") % 4 == 1, F.upper(part)).when(F.col("doc_id") % 4 == 2, F.replace(part, F.lit(" "), F.lit(""))).otherwise(F.concat(F.substring("line", 1, 12), F.lit(" … "), F.right("line", F.lit(12))))
    hint = F.col("k") + 1 + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return docs.select("doc_id", located("text", quoted, hint, F.lit(1)).alias("m")).select("doc_id", F.transform("m.spans", lambda s: s["start"]).alias("starts"), F.transform("m.spans", lambda s: s["end"]).alias("ends"), "m.mode")
