"""Text functions as columns; Python only where Spark has no equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def search_key(c: Column) -> Column:
    """Lower case, ``_`` and ``-`` as blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "_-", "  "), r"\s+", " "))


def tag_key(c: Column) -> Column:
    """Lower case, runs of ``_ - /`` as a blank, other marks dropped, white space collapsed."""
    spaced = F.regexp_replace(F.lower(c), r"[_\-/]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def label_tokens(c: Column) -> Column:
    """Runs of letters, digits and marks in lower case."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]+", " ")), " "), "")


def token_ngrams(tokens: Column, size: int) -> Column:
    """Blank-joined runs of ``size`` tokens, in order."""
    zipped = F.arrays_zip(*[F.slice(tokens, k + 1, 1 << 30).alias(f"t{k}") for k in range(size)])
    whole = F.slice(zipped, 1, F.greatest(F.size(tokens) - (size - 1), F.lit(0)))
    return F.transform(whole, lambda x: F.concat_ws(" ", *[x[f"t{k}"] for k in range(size)]))


def char_grams(c: Column, size: int = 3) -> Column:
    """Distinct character runs of ``size``; shorter texts are one gram of their own."""
    chars = F.split(c, "")
    runs = chars
    for k in range(1, size):  # side by side, so a long text is passed over once a place and not once a gram
        runs = F.zip_with(runs, F.slice(chars, k + 1, 1 << 30), lambda x, y: F.concat(x, y))
    many = F.slice(runs, 1, F.greatest(F.length(c) - (size - 1), F.lit(0)))
    return F.when(F.length(c) >= size, F.array_distinct(many)).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column, of=F.least) -> Column:
    """Shared members over the smaller (or, with ``F.greatest``, larger) set."""
    base = of(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(base > 0, F.size(F.array_intersect(a, b)) / base).otherwise(F.lit(0.0))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def utf16_offset(text: Column, code_point: Column) -> Column:
    """UTF-16 units before the ``code_point``-th character."""
    return utf16_length(F.substr(text, F.lit(1), code_point))


def naive_singular(c: Column) -> Column:
    return F.when(c.rlike("ies$"), F.regexp_replace(c, "ies$", "y")).when(c.rlike("(ss|us|is)$"), c).when(c.rlike("(ch|sh|x|z)es$"), F.regexp_replace(c, "es$", "")).when(c.rlike("s$"), F.regexp_replace(c, "s$", "")).otherwise(c)


def sentences(text: Column) -> Column:
    """Pieces after a full stop, question or exclamation mark and white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def pseudo_words(text: Column) -> Column:
    """The larger of the word count and a sixth of the other characters, for scripts without blanks."""
    solid = F.regexp_replace(text, r"\s+", "")
    return F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.floor(F.length(solid) / 6).cast("int"))


def script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{InMyanmar}"), "my").otherwise("en")


def content_key(c: Column, prefix: str = "e_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 32))


def loose_number(c: Column) -> Column:
    """A number written with Burmese digits or look-alike letters; other letters give null."""
    plain = F.translate(F.trim(c), "၀၁၂၃၄၅၆၇၈၉Ooဝ", "0123456789000")
    return F.when(plain.rlike("^[0-9]+$"), F.try_to_number(plain, F.lit("9" * 18)).cast("long"))


def safe_name(c: Column, most: int = 60) -> Column:
    return F.left(F.regexp_replace(F.trim(c), r"[^\w.-]+", "_"), F.lit(most))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def without_marks(values: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def repaired_mojibake(values: pd.Series) -> pd.Series:
    """Text whose UTF-8 was read as cp1252, read again; anything else unchanged."""

    def fix(v):
        try:
            return v.encode("cp1252").decode("utf-8")
        except (UnicodeError, AttributeError):
            return v

    return values.map(fix)


#: Letters with marks up to U+024F and what they are without them, and letters that become several.
_MARKED = {c: unicodedata.normalize("NFKD", c)[0] for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFKD", c)[0] != c and ord(unicodedata.normalize("NFKD", c)[0]) < 128}
_SEVERAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "’": "'", "‘": "'"}


def transliterated(c: Column) -> Column:
    """Camel case split, Latin letters without marks, possessives and digit commas gone, ``&`` as ``and``, other marks as blanks, lower case."""
    out = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    for letter, plain in _SEVERAL.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.translate(out, "".join(_MARKED), "".join(_MARKED.values()))
    out = F.regexp_replace(out, r"\b([A-Za-z]+)'s\b", "$1")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"(?<=[0-9]),(?=[0-9])", "")
    return F.trim(F.regexp_replace(F.lower(out), "[^a-z0-9]+", " "))


def compatible_tokens(c: Column) -> Column:
    """Tokens of letters and digits after NFKC and case folding."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{N}]+", " ")), " "), "")


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit a position."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & at.get(c, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def _ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _common_length(a, b) / (len(a) + len(b))


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    return 100.0 if both and (x <= y or y <= x) else max(_ratio(both, one), _ratio(both, two), _ratio(one, two)) if both else _ratio(one, two)


def _pairwise(function):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


#: Similarities from 0 to 100 by insertions and deletions.
indel_ratio = _pairwise(_ratio)
token_sort_ratio = _pairwise(lambda a, b: _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
token_set_ratio = _pairwise(_token_set)
