"""Vector algebra over array columns, in doubles, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), lambda s: F.when(s > 0, F.sqrt(s)).otherwise(F.lit(1.0)))
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x.cast("double") / n)


def scaled_concat(*parts: tuple[Column, float]) -> Column:
    """Unit vectors side by side, each by the root of its weight, so dots are weighted means of dots."""
    return F.flatten(F.array(*[F.transform(unit(v), lambda x: x * F.lit(w**0.5)) for v, w in parts]))


def residual(v: Column, base: Column) -> Column:
    """``v`` less its projection on the unit vector ``base``."""
    return F.zip_with(v, F.zip_with(base, F.array_repeat(dot(v, base), F.size(base)), lambda x, d: x.cast("double") * d), lambda x, y: x.cast("double") - y)


def centroids(rows: DataFrame, keys: list[str], vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """Weighted mean vector of each group with its size and cohesion (length of the mean of units).

    Components are added up one by one with partial sums before the shuffle; no group is
    gathered, however large.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    parts = rows.select(*keys, w.alias("_w"), F.posexplode(unit(F.col(vector))).alias("_pos", "_x"))
    sums = parts.groupBy(*keys, "_pos").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"), F.sum("_w").alias("_n"), F.count("*").alias("n"))
    mean = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", (F.col("_s") / F.col("_n")).alias("m")))).alias("v"), F.max("n").alias("n"))
    return mean.select(*keys, "n", F.col("v.m").alias("mean"), norm(F.col("v.m")).alias("cohesion"))
