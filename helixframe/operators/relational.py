"""Relational helpers whose order, null and tie rules are fixed by contract.

All are generic over column names and give the same rows for any input order and
partition count.  Working columns start with two underscores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nulls_last(name: str, descending: bool = False) -> Column:
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``, which must be total for a fixed result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def arg_max(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """The row of the largest ``value`` for each key; ties go to the smallest ``tie``; null values lose.

    A partial aggregate, so a hot key is combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(F.col(value).isNull(), -F.col(value), *tie)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")


def first_non_null(name: str, order: str) -> Column:
    """Aggregate: the first value that is not null, in the order of a column."""
    return F.expr(f"min_by(`{name}`, `{order}`) FILTER (WHERE `{name}` IS NOT NULL)").alias(name)


def distinct_with_null(name: str) -> Column:
    """Aggregate: distinct values, null being one of them."""
    return F.count_distinct(name) + F.coalesce(F.max(F.col(name).isNull().cast("long")), F.lit(0))


def assert_unique(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """``df`` unchanged; ValueError "code: examples" if a key repeats."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").orderBy(*keys).limit(5).collect()
    if bad:
        raise ValueError(f"{code}: " + "; ".join(",".join(str(r[k]) for k in keys) for r in bad))
    return df


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "m:1") -> DataFrame:
    """An equi join that first checks the cardinality (``1:1``, ``1:m``, ``m:1`` or ``m:m``)."""
    a, b = validate.split(":")
    if a == "1":
        assert_unique(left, on, "duplicate_left_key")
    if b == "1":
        assert_unique(right, on, "duplicate_right_key")
    return left.join(right, list(on), how)


def key_set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with column ``side``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it (null if none).

    One shuffle: both sides are stacked and the last right row is carried
    forward.  Of right rows at one position the largest values win.
    """
    carried = F.struct(right_at, *values)
    r = right.where(F.col(right_at).isNotNull()).groupBy(by, right_at).agg(F.max(F.struct(*values)).alias("__v")).select(by, right_at, "__v.*")
    low = left.select(F.col(by), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(r.select(carried.alias("x")).schema["x"].dataType).alias("__right"))
    up = r.select(F.col(by), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(low.schema["__left"].dataType).alias("__left"), carried.alias("__right"))
    w = Window.partitionBy(by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = low.unionByName(up).withColumn("__hit", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    ok = F.col("__at").isNotNull() & F.col(by).isNotNull()
    return found.select("__left.*", *[F.when(ok, F.col(f"__hit.{c}")).alias(c) for c in [right_at, *values]])


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """All (point, interval) pairs with the same key and start <= at < end, by bins of ``width``.

    Each interval goes to the bins that it touches, so the join has an equality
    and never compares all pairs.
    """
    binned = intervals.where(F.col(end) > F.col(start)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    p = points.withColumn("__bin", F.floor(F.col(at) / width))
    return p.join(binned, [key, "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def overlapping(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """All pairs of overlapping half-open intervals, with ``overlap`` bases; each pair once."""
    (s1, e1), (s2, e2) = a_span, b_span
    spread = lambda df, s, e: df.where(F.col(e) > F.col(s)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    both = spread(a, s1, e1).join(spread(b, s2, e2), [key, "__bin"]).where((F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1)))
    both = both.where(F.col("__bin") == F.floor(F.greatest(s1, s2) / width))
    return both.withColumn("overlap", F.least(e1, e2) - F.greatest(s1, s2)).drop("__bin")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching half-open intervals of each key."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.where(F.col(end) > F.col(start)).withColumn("__new", (F.coalesce(before < F.col(start), F.lit(True))).cast("int"))
    islands = islands.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def coalescing_union(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all frames, one for each key: every column's first value that is not null, in frame order."""
    stacked = None
    for k, df in enumerate(frames):
        df = df.withColumn("__order", F.lit(k))
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in keys and c != "__order"]
    return stacked.groupBy(*keys).agg(*[first_non_null(c, "__order") for c in rest])


def replicate(df: DataFrame, column: str, label: str = "all") -> DataFrame:
    """Every row in its own class and in the class ``label``, in one pass."""
    return df.withColumn(column, F.explode(F.array(F.lit(label), F.col(column))))


def shard_contiguous(df: DataFrame, key: str, order: Sequence[Column], shards: int) -> DataFrame:
    """``shard`` of every row: distinct keys, in order, cut at n * i // shards."""
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("__o"))
    ranked = rank_globally(firsts, [F.col("__o"), F.col(key)])
    n = ranked.agg(F.count("*")).first()[0]
    shard = F.floor(((F.col("__rank") + 1) * shards - 1) / max(1, n)).cast("int")
    return df.join(ranked.select(key, shard.alias("shard")), key)


def rank_globally(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """``__rank``, from 0, in a total order, without gathering all rows in one task.

    Rows are range-partitioned and numbered in their partition; partition sizes
    (one row a partition) give the offsets.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    part = part.persist()
    sizes = part.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__low"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).select("__part", "__before", "__low")
    return part.join(F.broadcast(offsets), "__part").withColumn("__rank", F.col("__before") + F.col("__id") - F.col("__low")).drop("__part", "__id", "__low", "__before")


def stratified_sample(df: DataFrame, key: str, stratum: str, fraction: float, seed: int) -> DataFrame:
    """Rows of floor(fraction * n) distinct keys of each stratum, chosen by a seeded hash of the key."""
    keys = df.select(stratum, key).distinct()
    w = Window.partitionBy(stratum)
    ranked = keys.withColumn("__r", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), key), key))).withColumn("__n", F.count("*").over(w))
    return df.join(ranked.where(F.col("__r") <= F.floor(F.col("__n") * fraction)).select(stratum, key), [stratum, key], "left_semi")


def asof_bounded(left: DataFrame, right: DataFrame, by: str, at: str, start: str, end: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last interval that starts at or before it, if it ends after it."""
    out = asof_backward(left, right, by, at, start, [end, *values])
    inside = F.col(at) < F.col(end)
    return out.select(*left.columns, *[F.when(inside, F.col(v)).alias(v) for v in values])


def first_offenders(df: DataFrame, bad: Column, keys: Sequence[str], code: str, shown: int = 5) -> DataFrame:
    """``df``, if no row is bad; else an error with the code, the count and the first offenders by key."""
    found = df.where(bad)
    n = found.count()
    if n:
        some = [tuple(r) for r in found.select(*keys).orderBy(*keys).limit(shown).collect()]
        raise ValueError(f"{code}: {n}: {some}")
    return df


def conflict_to_null(df: DataFrame, keys: Sequence[str], values: Sequence[str], sets: Sequence[str] = ()) -> DataFrame:
    """One row for each key: a value if all rows that know it agree, else null; arrays of ``sets`` as sorted unions."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return df.groupBy(*keys).agg(*[one(c) for c in values], *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets])


def hstack(a: DataFrame, b: DataFrame, order_a: Sequence[Column], order_b: Sequence[Column]) -> DataFrame:
    """Rows of two frames side by side by position in their own orders; unequal lengths raise."""
    if a.count() != b.count():
        raise ValueError("length_mismatch")
    return rank_globally(a, order_a).join(rank_globally(b, order_b), "__rank").drop("__rank")


def every_nth(df: DataFrame, order: Sequence[Column], n: int, i: int = 0) -> DataFrame:
    """Rows i, i + n, i + 2n, ... of an order."""
    return rank_globally(df, order).where(F.col("__rank") % n == i).drop("__rank")


def shard_modulo(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``shard``: the place of a row's key among the distinct keys, modulo; all rows of a key stay together."""
    ranked = rank_globally(df.select(key).distinct(), [F.col(key)])
    return df.join(ranked.select(key, (F.col("__rank") % shards).cast("int").alias("shard")), key)


def batches(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """``batch``, from 0: consecutive rows of an order, ``size`` at a time."""
    return rank_globally(df, order).withColumn("batch", F.floor(F.col("__rank") / size)).drop("__rank")


def check_shards(df: DataFrame, shard: str, key: str, shards: int) -> DataFrame:
    """``df``, if every shard has rows and no key is in two of them or twice in one."""
    seen = {r[0] for r in df.select(shard).distinct().limit(shards + 1).collect()}
    if seen != set(range(shards)):
        raise ValueError(f"incomplete_shards: {sorted(set(range(shards)) - seen)}")
    return assert_unique(df, [key], "duplicate_in_shards")


def split(df: DataFrame, kept: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and all others (null counts as not met)."""
    ok = F.coalesce(kept, F.lit(False))
    return df.where(ok), df.where(~ok)


def parts_by(df: DataFrame, column: str, limit: int = 1000) -> dict[object, DataFrame]:
    """A frame for each value of a column; more than ``limit`` values raise."""
    values = sorted((r[0] for r in df.select(column).distinct().limit(limit + 1).collect()), key=lambda v: (v is None, v))
    if len(values) > limit:
        raise ValueError(f"too_many_parts: over {limit}")
    return {v: df.where(F.col(column).eqNullSafe(F.lit(v))) for v in values}


def suffixed_join(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_right", how: str = "inner") -> DataFrame:
    """A join whose clashing right columns get a suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), list(on), how)


def pair_differences(values: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str], name: str, value: str) -> DataFrame:
    """keys, x, y, d: for each pair of names the second value minus the first, at equal keys."""
    table = F.broadcast(values.sparkSession.createDataFrame(list(pairs), "x string, y string"))
    first = values.select(*keys, F.col(name).alias("x"), F.col(value).alias("__a"))
    second = values.select(*keys, F.col(name).alias("y"), F.col(value).alias("__b"))
    return first.join(table, "x").join(second, [*keys, "y"]).select(*keys, "x", "y", (F.col("__b") - F.col("__a")).alias("d"))


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows (of each group), chosen by a seeded hash of their keys, so in any order of rows the same ones."""
    dice = [F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]]
    if not by:
        return df.orderBy(*dice).limit(n)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*dice))).where(F.col("__r") <= n).drop("__r")
