"""Exact, tie-aware statistics as grouped aggregates and windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import rank_globally


def roc_and_precision(df: DataFrame, groups: Sequence[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """``auroc`` (ties count one half) and ``average_precision`` (ties are one threshold) of each group.

    Rows collapse to one for each distinct score before any window, so ties and
    repeated scores are combined map-side.  Null scores or labels do not count;
    a group with one class only has null measures.
    """
    w = weight if weight is not None else F.lit(1)
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = known.groupBy(*groups, F.col(score).alias("__s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("double").alias("__p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).cast("double").alias("__q"))
    keys = list(groups) or [F.lit(0)]
    down = Window.partitionBy(*keys).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("__tp", F.sum("__p").over(down)).withColumn("__fp", F.sum("__q").over(down))
    total = per.groupBy(*groups).agg(
        F.sum("__p").alias("__P"), F.sum("__q").alias("__N"),
        F.sum(F.col("__q") * (F.col("__tp") - F.col("__p") / 2)).alias("__area"), F.sum(F.try_divide(F.col("__p") * F.col("__tp"), F.col("__tp") + F.col("__fp"))).alias("__ap"),
    )
    both = (F.col("__P") > 0) & (F.col("__N") > 0)
    return total.select(*groups, F.when(both, F.col("__area") / (F.col("__P") * F.col("__N"))).alias("auroc"), F.when(F.col("__P") > 0, F.col("__ap") / F.col("__P")).alias("average_precision"))


def average_rank(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """``name``: the mean rank, from 1, of the rows that share a value."""
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    same = Window.partitionBy(*groups, value) if groups else Window.partitionBy(value)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(same) - 1) / 2)


def correlations(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """``pearson`` and ``spearman`` over rows where both are known."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(known, groups, x, "__rx"), groups, y, "__ry")
    return ranked.groupBy(*groups).agg(F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))


def quantile_nearest(df: DataFrame, groups: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """The value at rank round(q * (n - 1)) of each group (no interpolation)."""
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ranked = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count("*").over(w))
    return ranked.where(F.col("__r") == F.floor(F.lit(q) * (F.col("__n") - 1) + 0.5)).select(*groups, F.col(value).alias(name))


def quantile_bins(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """``name``: 1 to ``bins``, by break points at the linear quantiles; a value on a break belongs below it."""
    cuts = df.agg(F.percentile(value, [i / bins for i in range(1, bins)]).alias("__cuts"))
    out = df.join(F.broadcast(cuts))
    return out.withColumn(name, F.when(F.col(value).isNotNull(), 1 + F.size(F.filter("__cuts", lambda c: c < F.col(value))))).drop("__cuts")


def binned_rates(df: DataFrame, x: str, y: str, label: str, bins: int = 5) -> DataFrame:
    """Mean label by quantile bin of x (rows, column ``bin``) and of y (columns ``q1`` to ``q<bins>``)."""
    both = quantile_bins(quantile_bins(df, x, bins, "__x"), y, bins, "__y")
    out = both.groupBy(F.col("__x").alias("bin")).pivot("__y", list(range(1, bins + 1))).agg(F.avg(label))
    return out.withColumnsRenamed({str(i): f"q{i}" for i in range(1, bins + 1)})


#: Counts (32 bits) that a task of a bootstrap holds at once, and draws that it takes from its stream at once.
CELLS, TAKEN = 1 << 25, 1 << 20


def _cluster_codes(df: DataFrame, cluster: str) -> DataFrame:
    """<cluster>, __code: dense codes of the known clusters, from 0, in their order."""
    return rank_globally(df.select(cluster).where(F.col(cluster).isNotNull()).distinct(), [F.col(cluster)]).withColumnRenamed("__rank", "__code")


def _multiplicities(spark: SparkSession, n: int, jobs: int, draws: int, seed: int) -> DataFrame:
    """__first, __code, __counts: how often ``n`` codes are taken by the draws from ``__first`` on; rows of zeros are left out.

    A row holds as many draws as fit ``CELLS`` counts over all codes.  If one
    draw does not fit, ranges of codes are tasks of their own, each of which
    follows its job's whole stream.
    """
    block = max(1, min(draws, CELLS // max(1, n)))
    width = max(1, CELLS)
    tasks = jobs * max(1, -(-n // width))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                job, low = task % jobs, task // jobs * width
                size, rng = min(width, n - low), np.random.RandomState(seed + job)
                for first in range(0, draws if n else 0, block):
                    counts = np.zeros((min(block, draws - first), size), np.int32)
                    for one in counts:
                        for done in range(0, n, TAKEN):
                            taken = rng.randint(n, size=min(TAKEN, n - done)) - low
                            np.add.at(one, taken[(taken >= 0) & (taken < size)], np.int32(1))
                    step = max(1, (1 << 18) // len(counts))
                    for at in range(0, size, step):
                        some = counts[:, at : at + step].T
                        hit = np.flatnonzero(some.any(1))
                        ends = np.arange(0, (len(hit) + 1) * len(counts), len(counts), dtype=np.int32)
                        arrays = [pa.array(np.full(len(hit), job * draws + first)), pa.array(low + at + hit), pa.ListArray.from_arrays(ends, some[hit].ravel())]
                        yield pa.RecordBatch.from_arrays(arrays, ["__first", "__code", "__counts"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(count, "__first long, __code long, __counts array<int>")


def _weighted_by_draw(coded: DataFrame, n: int, jobs: int, draws: int, seed: int) -> DataFrame:
    """draw, the columns of ``coded`` but for ``__code``, and ``__m``: each row for each draw that takes its code.

    Spark judges the table of counts by the few rows that its tasks start from
    and would broadcast it at any size, hence the hint.  Counts meet the rows
    packed, and are unpacked after the join.
    """
    met = coded.join(_multiplicities(coded.sparkSession, n, jobs, draws, seed).hint("merge"), "__code")
    kept = [c for c in coded.columns if c != "__code"]
    return met.select("__first", *kept, F.posexplode("__counts").alias("__i", "__m")).where(F.col("__m") > 0).select((F.col("__first") + F.col("__i")).alias("draw"), *kept, F.col("__m").cast("long").alias("__m"))


def bootstrap_weights(df: DataFrame, cluster: str, jobs: int = 8, draws: int = 100, seed: int = 42) -> DataFrame:
    """draw, <cluster>, __m: how often each draw takes a cluster; clusters that a draw misses have no row.

    Clusters get dense codes in their order.  Job ``j`` makes ``draws`` draws in
    turn from NumPy's ``RandomState(seed + j)``, each of as many clusters as
    there are, with replacement; draws are numbered through all jobs.
    """
    codes = _cluster_codes(df, cluster)
    return _weighted_by_draw(codes, codes.count(), jobs, draws, seed).select("draw", cluster, "__m")


def cluster_bootstrap(df: DataFrame, cluster: str, scores: Sequence[str] | str, label: str, jobs: int = 8, draws: int = 100, seed: int = 42, groups: Sequence[str] = ()) -> DataFrame:
    """draw, groups, model, auroc, average_precision of each score column under resampling of whole clusters.

    All scores share a draw's multiplicities, so that differences are paired;
    every row inherits its cluster's.
    """
    names = [scores] if isinstance(scores, str) else list(scores)
    long = df.select(cluster, label, *groups, F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).cast("double").alias("__score")) for n in names])).alias("__e")).select(cluster, label, *groups, "__e.*")
    codes = _cluster_codes(df, cluster)
    rows = _weighted_by_draw(long.join(codes, cluster).drop(cluster), codes.count(), jobs, draws, seed)
    return roc_and_precision(rows, ["draw", *groups, "model"], "__score", label, F.col("__m"))


def paired_differences(metrics: DataFrame, reference: str, others: Sequence[str], keys: Sequence[str] = ("draw",)) -> DataFrame:
    """keys, model, and for either measure the difference to ``reference`` in the same draw, plain and in percent of it."""
    measures = ("auroc", "average_precision")
    base = metrics.where(F.col("model") == reference).select(*keys, *[F.col(m).alias(f"__{m}") for m in measures])
    out = metrics.where(F.col("model").isin(list(others))).join(base, list(keys))
    return out.select(*keys, "model", *[x for m in measures for x in ((F.col(m) - F.col(f"__{m}")).alias(m), F.try_divide(100 * (F.col(m) - F.col(f"__{m}")), F.col(f"__{m}")).alias(f"{m}_pct"))])


def percentile_interval(df: DataFrame, groups: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """``low``, ``mid`` and ``high``: the median and the interval of a level, linearly interpolated."""
    q = F.percentile(value, [(1 - level) / 2, 0.5, (1 + level) / 2])
    return df.groupBy(*groups).agg(q.alias("__q")).select(*groups, *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(("low", "mid", "high"))])


def summarize_folds(folds: DataFrame, groups: Sequence[str], size: str, metrics: Sequence[str]) -> DataFrame:
    """Folds, summed size, and mean and sample deviation of each metric over the folds."""
    return folds.groupBy(*groups).agg(F.count("*").alias("folds"), F.sum(size).alias(size), *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))])


def negative_z(df: DataFrame, score: str, label: str, name: str) -> DataFrame:
    """``name``: the score, in deviations from the mean of the rows with label 0."""
    one = df.where(F.col(label) == 0).agg(F.avg(score).alias("__mean"), F.stddev_samp(score).alias("__sd"))
    return df.crossJoin(F.broadcast(one)).withColumn(name, F.try_divide(F.col(score) - F.col("__mean"), F.col("__sd"))).drop("__mean", "__sd")


def tails(df: DataFrame, value: str, name: str = "tail") -> DataFrame:
    """Rows at or below the nearest first quartile (``low``, which wins ties) or at or above the third (``high``)."""
    cuts = quantile_nearest(df, [], value, 0.25, "__low").crossJoin(quantile_nearest(df, [], value, 0.75, "__high"))
    kind = F.when(F.col(value) <= F.col("__low"), "low").when(F.col(value) >= F.col("__high"), "high")
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, kind).drop("__low", "__high").where(F.col(name).isNotNull())


def weighted_means(rows: DataFrame, keys: Sequence[str], values: str, weight: str) -> DataFrame:
    """keys and ``values``: the mean, normalised by weight, of each place of an array column."""
    flat = rows.select(*keys, weight, F.posexplode(values).alias("__i", "__v"))
    one = flat.groupBy(*keys, "__i").agg(F.try_divide(F.sum(F.col("__v") * F.col(weight)), F.sum(F.when(F.col("__v").isNotNull(), F.col(weight)))).alias("__v"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda x: x["__v"]).alias(values))


def chromosome_folds(counts: list[tuple[str, int, int]], folds: int = 5) -> dict[str, int]:
    """Greedy fold of each chromosome: largest first, into the fold where the squared loads of both cohorts grow least.

    Sizes are shares of each cohort's total, so both cohorts weigh equally.
    """
    sizes = {name: np.array([a, b], float) for name, a, b in counts}
    total = np.maximum(sum(sizes.values(), np.zeros(2)), 1)
    share = {name: n / total for name, n in sizes.items()}
    load = np.zeros((folds, 2))
    out: dict[str, int] = {}
    for name in sorted(share, key=lambda x: (-share[x].sum(), len(x), x)):
        grow = ((load + share[name]) ** 2 - load**2).sum(1)
        out[name] = int(grow.argmin())
        load[out[name]] += share[name]
    return out


def largest_remainder(counts: dict[str, int], cap: int) -> dict[str, int]:
    """Quotas in proportion to counts that add up to ``cap``; remainders go to the largest fractions, then by name."""
    total = sum(counts.values())
    if total <= cap:
        return dict(counts)
    exact = {k: cap * v / total for k, v in counts.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: cap - sum(out.values())]:
        out[k] += 1
    return out


def sample_tail(df: DataFrame, chromosome: str, site: str, cap: int, seed: int) -> DataFrame:
    """All rows if at most ``cap``, else a seeded choice within each chromosome's quota; sorted by site."""
    counts = {r[0]: r[1] for r in df.groupBy(chromosome).count().collect()}
    if sum(counts.values()) <= cap:
        return df.orderBy(site)
    quota, rng = largest_remainder(counts, cap), np.random.default_rng(seed)
    chosen = [(c, int(i)) for c in sorted(counts) for i in rng.choice(counts[c], size=quota[c], replace=False)]
    picked = df.sparkSession.createDataFrame(chosen, f"{chromosome} string, __r int")
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(chromosome).orderBy(site)) - 1)
    return ranked.join(picked, [chromosome, "__r"], "left_semi").drop("__r").orderBy(site)


def correlation_matrix(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """x, y, r: Pearson's correlation of every x with every y, over rows that know both, in one pass."""
    pairs = [(x, y) for x in xs for y in ys]
    one = df.agg(*[F.corr(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)])).alias("e")).select("e.*")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n: rows in ``bins`` equal parts of [low, high]; the upper end belongs to the last part."""
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) * bins / (high - low))).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
