"""Operator 7: a quality classifier as a sparse rule ensemble, compiled into column expressions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit may see; the smallest hashes of their ids are taken.
SAMPLE = 20_000
TREES, DEPTH, MIN_LEAF = 24, 3, 20
PENALTY = 0.002


def statistics() -> dict[str, F.Column]:
    """The statistics of ``text`` as columns; all are 0 for a null or empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.split(text, "\n")
    n_chars, n_words = F.length(text), F.size(words)
    per = lambda count, whole: F.when(whole > 0, count / whole).otherwise(F.lit(0.0)).cast("double")
    single = lambda mark: n_chars - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return {
        "n_words": n_words.cast("double"),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "word_length": per(n_chars, n_words),
        "upper": per(F.regexp_count(text, F.lit("[A-Z]")), n_chars),
        "symbols": per(F.regexp_count(text, F.lit("[#*$%&|<>]")), n_chars),
        "digits": per(F.regexp_count(text, F.lit("[0-9]")), n_chars),
        "exclamations": per(single("!"), n_words),
        "stops": per(single("."), n_words),
        "commas": per(single(","), n_words),
        "lines": per(F.size(lines), n_words),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
    }


def with_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each row."""
    return documents.select("doc_id", *(column.alias(f"s_{name}") for name, column in statistics().items()))


def _grow(x, residual, rows, depth, columns, path, rules):
    """Split by the best drop in squared error; every node's path from the root becomes a rule."""
    if path:
        rules.append(tuple(path))
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return
    best, y = (1e-9, None, None), residual[rows]
    for c in columns:
        order = np.argsort(x[rows, c], kind="stable")
        value, run = x[rows, c][order], np.cumsum(y[order])
        n = np.arange(1, len(rows))
        ok = (value[1:] > value[:-1]) & (n >= MIN_LEAF) & (len(rows) - n >= MIN_LEAF)
        gain = np.where(ok, run[:-1] ** 2 / n + (run[-1] - run[:-1]) ** 2 / (len(rows) - n) - run[-1] ** 2 / len(rows), 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], c, float((value[k] + value[k + 1]) / 2))
    if best[1] is None:
        return
    low = x[rows, best[1]] <= best[2]
    _grow(x, residual, rows[low], depth - 1, columns, [*path, (best[1], "<=", best[2])], rules)
    _grow(x, residual, rows[~low], depth - 1, columns, [*path, (best[1], ">", best[2])], rules)


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, sign, cut in rule:
        out &= x[:, c] <= cut if sign == "<=" else x[:, c] > cut
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[tuple]:
    """Distinct conjunctions from boosted trees, each grown on half the rows and most columns."""
    rng, rules, score = np.random.default_rng(seed), [], np.zeros(len(y))
    for _ in range(TREES):
        residual, fresh = y - 1 / (1 + np.exp(-score)), []
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        columns = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False))
        _grow(x, residual, rows, DEPTH, columns, [], fresh)
        for rule in fresh:
            if len(rule) == DEPTH:
                holds = _holds(x, rule)
                score += holds * 0.5 * residual[holds].mean() * 4 if holds.any() else 0
        rules += fresh
    return list(dict.fromkeys(rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the classes weigh the same."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    full = np.column_stack([z, np.ones(len(z))])
    rate = 4.0 / (np.linalg.norm(full * np.sqrt(weight)[:, None], 2) ** 2 + 1e-12)
    w, v, t = np.zeros(full.shape[1]), np.zeros(full.shape[1]), 1.0
    for _ in range(steps):
        g = full.T @ (weight * (1 / (1 + np.exp(-np.clip(full @ v, -30, 30))) - y))
        new = v - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> dict:
    """``{"intercept", "rules": [[weight, [[column, sign, cut], ...]], ...]}``; without two classes, the intercept alone."""
    if len(set(y.tolist())) < 2:
        return {"intercept": 0.0 if not len(y) else (4.0 if y[0] else -4.0), "rules": []}
    rules = tree_rules(x, y)
    z = np.column_stack([_holds(x, r) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    weights, intercept = lasso_logistic(z, y)
    return {"intercept": intercept, "rules": [[float(w), [[names[c], s, cut] for c, s, cut in r]] for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6]}


def compile_rules(model: dict, prefix: str = "s_") -> F.Column:
    """The ensemble's probability as one column over the statistics."""
    total = F.lit(float(model["intercept"]))
    for weight, rule in model["rules"]:
        holds = F.lit(True)
        for name, sign, at in rule:
            column = F.col(prefix + name)
            holds = holds & (column <= F.lit(at) if sign == "<=" else column > F.lit(at))
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def fit_from_labels(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled documents, those whose ids hash lowest.

    Ids with two different labels are left out; null labels and ids do not count.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y2"))
    known = known.where("y = _y2").select(F.col("doc_id").alias("_id"), "y")
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    own = documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    names = list(statistics())
    rows = own.select("doc_id", "y", *(c.alias(f"s_{n}") for n, c in statistics().items())).orderBy("doc_id", *(f"s_{n}" for n in names)).toPandas()
    return fit_rules(rows[[f"s_{n}" for n in names]].to_numpy(float).reshape(-1, len(names)), rows["y"].to_numpy(float), names)


def score_quality(documents: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score, predicted`` for each row, all in column expressions.

    Null and empty texts have all statistics 0 and the score that follows; repeated rows
    and null ids keep a row each; extra columns are not looked at.
    """
    scored = with_statistics(documents).select("doc_id", compile_rules(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id, modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def model_text(model: dict) -> str:
    return json.dumps(model, indent=1)
