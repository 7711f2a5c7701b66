"""Logistic models under grouped cross-validation: quadratic and additive score models, and nested linear probes.

A task (one model, cohort and label) is bounded: the manifest caps the sites of a
tail, so the rows of a task fit one worker (``MOST_ROWS``; more raise).  Tasks and
outer folds are groups of one ``applyInPandas``, so they run in parallel and none
of them reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import statistics as S

#: The searched inverse penalties: fixed values.
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
#: Rows of one task that a worker takes at most.
MOST_ROWS = 200_000


def scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column; a constant one keeps its scale."""
    sd = x.std(0)
    return x.mean(0), np.where(sd > 0, sd, 1.0)


def quadratic(x: np.ndarray) -> np.ndarray:
    """The columns, their squares and their products, without a constant."""
    i, j = np.triu_indices(x.shape[1])
    return np.column_stack([x, x[:, i] * x[:, j]])


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float, start: np.ndarray | None = None, rounds: int = 3000, tolerance: float = 1e-6) -> np.ndarray:
    """Weights, the intercept last, that minimise |w|^2 / 2 + c * (sum of log losses), by L-BFGS; not converging raises."""
    sign = np.where(y == 1, 1.0, -1.0)

    def loss(w):
        z = sign * (x @ w[:-1] + w[-1])
        pull = -c * sign * np.exp(-np.logaddexp(0, z))
        return w[:-1] @ w[:-1] / 2 + c * np.logaddexp(0, -z).sum(), np.append(x.T @ pull + w[:-1], pull.sum())

    w = np.zeros(x.shape[1] + 1) if start is None else start.copy()
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    goal = tolerance * max(1.0, c * len(y))
    for _ in range(rounds):
        if np.abs(g).max() <= goal:
            return w
        d, kept = -g, []
        for s, t in reversed(past):
            a = (s @ d) / (s @ t)
            kept.append(a)
            d = d - a * t
        if past:
            s, t = past[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t), a in zip(past, reversed(kept)):
            d = d + s * (a - (t @ d) / (s @ t))
        step = 1.0 if past else 1.0 / max(1.0, np.abs(g).sum())
        while True:
            nf, ng = loss(w + step * d)
            if nf <= f + 1e-4 * step * (g @ d) or step < 1e-12:
                break
            step /= 2
        if step < 1e-12:
            return w  # no descent is left within the numbers' precision
        s, t = step * d, ng - g
        if s @ t > 1e-12 * (t @ t):
            past = [*past[-9:], (s, t)]
        w, f, g = w + s, nf, ng
    raise ValueError(f"not_converged: {rounds} rounds at c={c}")


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -(x @ w[:-1] + w[-1])))


def auroc(y: np.ndarray, p: np.ndarray) -> float:
    """Ties count one half."""
    _, at, n = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    pos = y == 1
    k = int(pos.sum())
    return float((rank[pos].sum() - k * (k + 1) / 2) / (k * (len(y) - k)))


def group_folds(groups: Sequence, folds: int) -> np.ndarray:
    """A fold for each row: whole groups, the largest first, into the fold with the fewest rows."""
    names, at, n = np.unique(np.asarray(groups), return_inverse=True, return_counts=True)
    if len(names) < folds:
        raise ValueError(f"too_few_groups: {len(names)} for {folds} folds")
    load, of = np.zeros(folds), np.zeros(len(names), int)
    for i in np.argsort(n)[::-1]:
        of[i] = int(load.argmin())
        load[of[i]] += n[i]
    return of[at]


def search(x: np.ndarray, y: np.ndarray, groups: Sequence, folds: int = 3, warm: bool = True) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights refitted on all rows, the penalty with the best mean AUROC (the first of equals), and the table penalty by fold.

    Columns are scaled by each training part; along a fold's path a fit starts
    from the last one if ``warm``.
    """
    fold = group_folds(groups, folds)
    table = np.zeros((len(PENALTIES), folds))
    for k in range(folds):
        train, test = fold != k, fold == k
        mean, sd = scale(x[train])
        w = None
        for i, c in enumerate(PENALTIES):
            w = fit_logistic((x[train] - mean) / sd, y[train], c, w if warm else None)
            table[i, k] = auroc(y[test], probability(w, (x[test] - mean) / sd))
    c = PENALTIES[int(table.mean(1).argmax())]
    mean, sd = scale(x)
    w = fit_logistic((x - mean) / sd, y, c)
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum()), c, table


def _vectors(frame: pd.DataFrame, column: str) -> np.ndarray:
    x = np.stack(frame[column].to_numpy()).astype(float)
    if not np.isfinite(x).all():
        raise ValueError("vector_not_finite")
    return x


def out_of_fold(rows: DataFrame, tasks: Sequence[str], row: str, label: str, vector: str, outer: str, group: str, inner: int = 3, expand: bool = False) -> DataFrame:
    """tasks, row, label, outer, probability, penalty of every row: each outer fold by a model searched on the other folds.

    ``group`` (a chromosome) must lie in one outer fold; ``expand`` adds squares
    and products (the quadratic model).  A fold without both labels raises.
    """
    split = rows.groupBy(*tasks, group).agg(F.count_distinct(outer).alias("n")).where("n > 1").limit(5).collect()
    if split:
        raise ValueError(f"group_in_two_folds: {[r[group] for r in split]}")
    held = rows.select(*tasks, F.col(outer).alias("__held")).distinct()
    each = rows.select(*tasks, row, label, vector, outer, group).join(held, list(tasks)) if tasks else rows.select(row, label, vector, outer, group).crossJoin(held)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*tasks, row, label, outer]) + ", probability double, penalty double"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MOST_ROWS:
            raise ValueError(f"task_too_large: {len(frame)}")
        frame = frame.sort_values(row, kind="stable")
        x, y = _vectors(frame, vector), frame[label].to_numpy()
        x = quadratic(x) if expand else x
        test = (frame[outer] == frame["__held"]).to_numpy()
        w, c, _ = search(x[~test], y[~test], frame[group].to_numpy()[~test], inner)
        return frame.loc[test, [*tasks, row, label, outer]].assign(probability=probability(w, x[test]), penalty=c)

    return each.groupBy(*tasks, "__held").applyInPandas(one, schema)


def complete_cases(rows: DataFrame, columns: Sequence[str], name: str = "vector") -> DataFrame:
    """Rows whose columns are all finite numbers, with these as one vector."""
    from ..functions.columns import all_finite

    return rows.where(all_finite(columns)).withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))


def fold_table(predictions: DataFrame, tasks: Sequence[str], label: str, outer: str, baseline: str | None = None) -> DataFrame:
    """tasks, fold, sites, positives, auroc and average precision; with a ``baseline`` score its own and the differences."""
    keys = [*tasks, outer]
    out = predictions.groupBy(*keys).agg(F.count("*").alias("sites"), F.sum(label).alias("positives")).join(S.roc_and_precision(predictions, keys, "probability", label), keys)
    if baseline is None:
        return out
    zero = S.roc_and_precision(predictions, keys, baseline, label).withColumnsRenamed({m: f"zero_shot_{m}" for m in ("auroc", "average_precision")})
    out = out.join(zero, keys)
    return out.withColumns({f"{m}_delta": F.col(m) - F.col(f"zero_shot_{m}") for m in ("auroc", "average_precision")})
