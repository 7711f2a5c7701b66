"""Sharding by sampled splitters; DataFrame functions only.

Law ``bytes``: all shards have nearly equal bytes.  Rows are ordered by a 64-bit
key whose high bits hash the text and whose low bits hash doc_id and the row's
number, so that equal texts lie side by side and a huge group of them, fully
equal rows too, can still be cut.

1. A sample of keys, drawn with chance in proportion to a row's size, is sorted;
   its quantiles are the boundaries of ``RANGES`` ranges of nearly equal bytes.
2. Every range is counted exactly.  An overfull one (more rows than
   ``ROWS_A_RANGE``) is subdivided at the quantiles of a second sample, of its
   own rows, each with the same chance; so many short texts, or many copies of
   one, are cut into slices of nearly equal counts wherever their keys lie.
3. Bytes and rows before each slice come from prefix sums over the slices; in a
   slice, rows are numbered in key order.  A row's place on the line of all
   bytes gives its shard, its place among all rows gives its slot.

The first sample (``SAMPLES`` keys, in expectation) and one row for each range and
shard reach the driver; the slices' boundaries stay in a table of one row a
range.  Null text has size 1; null doc_id and repeated rows are rows like any
other; a very long text is one row, and may outweigh a shard; an empty table has
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, read, text_of

SHARDS = 8
RANGES = 256
#: Expected number of sampled keys.
SAMPLES = 8 * RANGES
#: A range of more rows is subdivided, with so many sampled keys for each slice.
ROWS_A_RANGE = 200_000
KEYS_A_SLICE = 16


def _narrow(docs: DataFrame) -> DataFrame:
    raw = F.encode(text_of(), "utf-8")
    high = F.expr("shiftleft(shiftright(xxhash64(coalesce(text, '')), 24), 24)")
    return docs.select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        high.alias("__high"), F.monotonically_increasing_id().alias("__row"),
    )


def _dice(seed: int):
    """A number from 0 to 1, drawn for each row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__key", "__row"), 11) / F.lit(float(1 << 53))


def boundaries(rows: DataFrame, total: int, ranges: int = RANGES, samples: int = SAMPLES) -> list[int]:
    """Quantiles of a size-weighted sample of keys: the inner boundaries of the ranges."""
    keys = sorted(r[0] for r in rows.where(_dice(11) < F.col("size") * (samples / max(1, total))).select("__key").collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def place(docs: DataFrame) -> tuple[DataFrame, list[tuple], int]:
    """Every row with its __range and __slice; bytes and rows before each range; all bytes."""
    rows = cut(_narrow(docs))  # the rows' numbers are fixed from here on
    rows = rows.withColumn("__key", F.col("__high").bitwiseOR(F.expr("shiftrightunsigned(xxhash64(3, doc_id, __row), 40)"))).drop("__high")
    total = rows.agg(F.sum("size")).first()[0] or 0
    inner = boundaries(rows, total)
    edges = F.array(*[F.lit(k) for k in inner]) if inner else F.array().cast("array<bigint>")
    placed = rows.withColumn("__range", F.size(F.filter(edges, lambda b: b <= F.col("__key"))))
    counts = {r["__range"]: (r["n"], r["b"]) for r in placed.groupBy("__range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    # Each range: bytes and rows before it, and the chance of its rows in the second sample.
    before, at = [], (0, 0)
    for i in range(len(inner) + 1):
        n, b = counts.get(i, (0, 0))
        before.append((at[0], at[1], min(1.0, KEYS_A_SLICE / ROWS_A_RANGE) if n > ROWS_A_RANGE else 0.0))
        at = (at[0] + b, at[1] + n)
    placed = placed.withColumn("__slice", F.lit(0))
    if any(x[2] for x in before):
        drawn = placed.where(_dice(12) < F.element_at(F.array(*[F.lit(x[2]) for x in before]), F.col("__range") + 1)).groupBy("__range").agg(F.array_sort(F.collect_list("__key")).alias("__keys"))
        # Every KEYS_A_SLICE-th key of the sample ends a slice.
        edges = drawn.select(F.col("__range").alias("__e"), F.filter("__keys", lambda k, i: i % KEYS_A_SLICE == KEYS_A_SLICE - 1).alias("__edges"))
        cut_at = F.size(F.filter("__edges", lambda b: b <= F.col("__key")))
        placed = placed.join(F.broadcast(edges) if at[1] * 8 <= BROADCAST_BYTES * ROWS_A_RANGE else edges, F.col("__range") == F.col("__e"), "left")
        placed = placed.withColumn("__slice", F.coalesce(F.when(F.col("__edges").isNotNull(), cut_at), F.lit(0))).drop("__e", "__edges")
    return placed, before, total


def by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; shards hold equal bytes to within one row."""
    placed, before, total = place(docs)
    column = lambda k: F.element_at(F.array(*[F.lit(x[k]).cast("bigint") for x in before]), F.col("__range") + 1)
    slices = placed.groupBy("__range", "__slice").agg(F.sum("size").alias("__b"), F.count("*").alias("__n"))
    prior = Window.partitionBy("__range").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("__range").alias("__r"), F.col("__slice").alias("__s"), F.coalesce(F.sum("__b").over(prior), F.lit(0)).alias("__b0"), F.coalesce(F.sum("__n").over(prior), F.lit(0)).alias("__n0"))
    inside = Window.partitionBy("__range", "__slice").orderBy("__key", "__row").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("__bytes", F.sum("size").over(inside)).withColumn("__nth", F.count("*").over(inside))
    numbered = numbered.join(slices, (F.col("__range") == F.col("__r")) & (F.col("__slice") == F.col("__s")))
    # The middle of a row on the line of all bytes, in halves of a byte.
    middle = 2 * (column(0) + F.col("__b0") + F.col("__bytes")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(max(1, 2 * total))).cast("int"))
    lined = cut(numbered.select("doc_id", "size", "text_crc32", shard.alias("shard"), (column(1) + F.col("__n0") + F.col("__nth") - 1).alias("__place")))
    first = {r["shard"]: r["p"] for r in lined.groupBy("shard").agg(F.min("__place").alias("p")).collect()}
    start = F.element_at(F.array(*[F.lit(int(first.get(i, 0))).cast("long") for i in range(shards)]), F.col("shard") + 1)
    return lined.select("doc_id", "size", "text_crc32", "shard", (F.col("__place") - start).alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    out = by_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
