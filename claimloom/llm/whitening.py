"""Operator 11: whitening of embeddings from an exact integer scatter.

Entries become whole numbers. Each task subtracts a shift from its distinct vectors and sums
them and their cross-products without rounding: matrix products of limbs so small that
64-bit floats hold every sum, put together as integers of any size. From n, the sums S and
the cross-products the matrix n·XᵀX - SSᵀ follows exactly; only then it becomes floats, and
``eigh`` takes it apart.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.plans.lineage import checkpoint_dir, delete_folder

SCALE = 256
COMPONENTS = 4
#: Bits of a limb, and rows of a product of limbs: sums stay under 2^53.
LIMB, ROWS = 20, 1 << 12
#: Entries of such a product at most.
CELLS = 1 << 20
#: Bits of the parts in which partial sums travel, and how many such parts hold any of them.
PART, PARTS = 31, 8
#: Widest vectors: the driver holds a matrix of this many rows and columns.
WIDEST = 4096


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: floor(scale * c) of each entry; null vectors and those with null or non-finite entries go."""
    value = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    x = F.transform(value, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.where(value.isNotNull() & F.coalesce(F.forall(value, finite), F.lit(False))).select(F.col("vec_id").cast("long"), x.alias("x"))


def _matrix(lists, width: int) -> np.ndarray:
    """Arrow lists as rows; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _limbs(rows: np.ndarray) -> list[np.ndarray]:
    """Signed limbs, the least first: ``rows`` is the sum of limb k times 2^(LIMB * k)."""
    out = []
    while True:
        low = ((rows + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1) if rows.dtype == object or np.abs(rows).max(initial=0) >= 1 << LIMB - 1 else rows
        out.append(low.astype(np.float64))
        rows = (rows - low) >> LIMB
        if not np.any(rows):
            return out


def _steps(n: int, width: int) -> range:
    """Where the parts of ``n`` rows begin that are worked off together."""
    return range(0, n, max(1, min(ROWS, CELLS // max(1, width))))


def exact_sums(rows: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products, as integers of any size, of ``rows`` less ``shift``."""
    width = rows.shape[1]
    sums, products = np.zeros(width, object), np.zeros((width, width), object)
    steps = _steps(len(rows), width)
    for at in steps:
        part = rows[at : at + steps.step]
        near = max(abs(int(part.min())), abs(int(part.max()))) < 1 << 61 and max(map(abs, map(int, shift))) < 1 << 61 if part.size else True
        limbs = _limbs(part - shift if near else part.astype(object) - shift.astype(object))
        for i, a in enumerate(limbs):
            sums += a.sum(0).astype(np.int64).astype(object) << LIMB * i
            for j, b in enumerate(limbs):
                products += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return sums, products


def _parts(value: int) -> list[int]:
    """The number in ``PARTS`` parts of ``PART`` bits, the last one signed; parts of many numbers add up as longs."""
    low = [(value >> PART * k) & ((1 << PART) - 1) for k in range(PARTS - 1)]
    return [*low, value >> PART * (PARTS - 1)]


def scatter(fit: DataFrame, width: int, shift: np.ndarray, column: str = "x") -> tuple[int, list[int], list[list[int]]]:
    """The number of rows, and the exact sums and cross-products of ``column`` less ``shift``.

    Each task sends one row for each pair of entries; the driver gets their sums, at most
    ``width * (width + 3) / 2 + 1`` rows however long the table is.
    """
    names = [f"p{k}" for k in range(PARTS)]

    def add(batches):
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            more = exact_sums(_matrix(batch.column(0), width), shift)
            n, sums, products = n + batch.num_rows, sums + more[0], products + more[1]
        i, j = np.triu_indices(width)
        cells = [(-1, -1, n), *((-1, k, v) for k, v in enumerate(sums)), *zip(i.tolist(), j.tolist(), products[i, j], strict=True)]
        columns = [[c[0] for c in cells], [c[1] for c in cells], *zip(*(_parts(int(c[2])) for c in cells), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", *names])

    cells = fit.select(column).mapInArrow(add, "i long, j long, " + ", ".join(f"{p} long" for p in names))
    total, sums, products = 0, [0] * width, [[0] * width for _ in range(width)]
    for r in cells.groupBy("i", "j").agg(*(F.sum(p).alias(p) for p in names)).collect():
        value = sum(int(r[p]) << PART * k for k, p in enumerate(names))
        if r.j < 0:
            total = value
        elif r.i < 0:
            sums[r.j] = value
        else:
            products[r.i][r.j] = products[r.j][r.i] = value
    return total, sums, products


@dataclass
class Whitening:
    """The fitted map: ``(x - S/n)`` on the first components, over the roots of their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray  # width x components
    values: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """n·x - S, exactly: 64-bit integers where they hold it, else integers of any size."""
        top = max(abs(int(rows.min())), abs(int(rows.max()))) if rows.size else 0
        if self.n * top + max(map(abs, self.sums), default=0) < 1 << 62:
            return self.n * rows - np.array(self.sums, np.int64)
        return self.n * rows.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """One column a component; a component without variance has NaN."""
        x = centred.astype(np.float64) if centred.dtype != object else np.array([[v / self.n for v in row] for row in centred], np.float64).reshape(centred.shape) * self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (x / self.n) @ self.axes / np.sqrt(np.maximum(self.values, 0))
        return np.where(self.values > 0, out, np.nan)


def fit_whitening(n: int, sums: list[int], products: list[list[int]], shift: list[int], components: int = COMPONENTS) -> Whitening:
    """The map from exact sums over shifted rows; ``n·XᵀX - SSᵀ`` does not change with the shift."""
    width = len(sums)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    covariance = np.array([[cell / (n * n) for cell in row] for row in scatter], np.float64).reshape(width, width)
    values, axes = np.linalg.eigh(covariance)
    k = min(components, width)
    trace = sum(scatter[i][i] for i in range(width)) / (n * n)
    values, axes = values[::-1][:k].copy(), axes[:, ::-1][:, :k].copy()
    values[values <= trace * width * np.finfo(np.float64).eps] = 0.0  # no variance but rounding
    return Whitening(n, [s + n * int(t) for s, t in zip(sums, shift, strict=True)], axes, values, trace)


def _applied(rows: DataFrame, model: Whitening, column: str, keep: list[str], deviation: bool) -> DataFrame:
    width, k = model.width, len(model.values)
    most = (1 << 63) - 1

    def apply(batches):
        for batch in batches:
            steps = _steps(batch.num_rows, width)
            for at in steps:
                part = batch.slice(at, steps.step)
                centred = model.centred(_matrix(part.column(len(keep)), width))
                w = model.whitened(centred)
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(w[:, c], from_pandas=True) for c in range(k)]
                if deviation:
                    top = max(abs(int(centred.min())), abs(int(centred.max()))) if centred.size else 0
                    exact = (centred if top * top * width <= most else centred.astype(object)) ** 2
                    arrays.append(pa.array([v if v <= most else None for v in exact.sum(1).tolist()], pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f"w{c}" for c in range(k)), *(["deviation"] if deviation else [])])

    shape = ", ".join([*(f"{c} long" for c in keep), *(f"w{c} double" for c in range(k)), *(["deviation long"] if deviation else [])])
    return rows.select(*keep, column).mapInArrow(apply, shape)


def identity_error(fit: DataFrame, model: Whitening, column: str = "x") -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity; null without a component of some variance."""
    live = [c for c in range(len(model.values)) if model.values[c] > 0]
    if not live:
        return None
    pairs = [(a, b) for a in live for b in live if a <= b]
    found = _applied(fit, model, column, [], False).agg(*(F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    Rows whose ``embedding`` is null or holds null or non-finite entries go. The fit list is
    each distinct vector once, so copies of any number weigh as one; they are combined
    before the shuffle. Rows of one id, or of a null id, are each whitened. Shorter vectors
    count as ending in zeros; there are no more components than entries. A component without
    variance (one distinct vector, say) has a null ``whitened`` and no part in
    ``identity_error``, and where no component has any, that and ``explained`` are null. A
    ``deviation`` beyond 64 bits is null. Other columns, whatever their names, are not read.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale)
    home = f"{checkpoint_dir(spark)}/whitening-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(home)
    fit = spark.read.parquet(home)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = fit.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        delete_folder(spark, home)
        return spark.createDataFrame([], shape)
    if width > WIDEST:
        raise ValueError(f"vectors of {width} entries; at most {WIDEST}")
    any_row = fit.select("x").first()[0]  # near the others, if they are far from 0; the result does not depend on it
    shift = np.array([min(max(v, -(1 << 60)), 1 << 60) for v in [*any_row, *[0] * (width - len(any_row))]], np.int64)
    model = fit_whitening(*scatter(fit, width, shift), shift.tolist(), components)
    error = identity_error(fit, model)
    delete_folder(spark, home)
    k = len(model.values)
    explained = [float(v / model.trace) if model.trace else None for v in model.values]
    each = F.explode(F.array(*(F.struct(F.lit(c + 1).alias("component"), F.col(f"w{c}").alias("whitened"), F.lit(explained[c]).cast("double").alias("explained")) for c in range(k)))).alias("c")
    out = _applied(rows, model, "x", ["vec_id"], True).select("vec_id", "deviation", each)
    return out.select("vec_id", F.col("c.component").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
