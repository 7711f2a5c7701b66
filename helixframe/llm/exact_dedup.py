"""Exact dedup by two passes over a counting Bloom filter; DataFrame functions only.

Pass 1 counts, saturating at two, the filter cells that the rows' hashes fall
into; cells that were hit twice form a bitmap.  Pass 2 tests every row against
the bitmap.  Only rows whose cells were all hit twice may be repeated; they
alone are shuffled and grouped by SHA-256.  The others pass straight through.
A false suspicion costs a shuffled row and never changes the result.

Texts are equal when they are identical after deleting every space and every
character from U+0009 to U+000D; null counts as empty.  Of equal texts the row
with the most code points in the original text stays, then the smallest doc_id
(nulls last), then any one of fully equal rows.  A very long text is hashed where
it is read; an empty table gives no rows; other columns may bear any name.

A row of copies is never gathered in one task: cell counts and group winners are
partial aggregates, and rows of large groups meet their winner in a broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, read, small, text_of

#: Filter cells a row, for each of the two hashes.
CELLS_PER_ROW = 8
#: A group of more than one row in so many is joined by broadcast; there are at most so many.
HOT = 4096
_PAGE = 32768  # bits of a bitmap page, fixed by Spark's bitmap functions


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_of(name), r"[\x20\x09-\x0D]+", "")


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, code points, SHA-256 of the normalised text, and a number for the row."""
    return docs.select(
        "doc_id", F.length(text_of()).alias("__len"), F.unhex(F.sha2(F.encode(normalised(), "utf-8"), 256)).alias("__sha"), F.monotonically_increasing_id().alias("__row")
    )


def _cells(sha: Column, cells: int) -> list[Column]:
    """The two filter cells of a row, from separate hashes."""
    return [F.pmod(F.xxhash64(sha), F.lit(cells)), F.pmod(F.xxhash64(F.lit(17), sha), F.lit(cells))]


def suspicious(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with a column __maybe: false only if no other row has the same __sha."""
    cells = 1 << max(10, math.ceil(math.log2(max(1, n * CELLS_PER_ROW))))
    out = rows
    flag = F.lit(True)
    for k in range(2):
        cell = _cells(F.col("__sha"), cells)[k]
        twice = rows.groupBy(cell.alias("__cell")).agg(F.count("*").alias("__n")).where("__n >= 2")
        if cells // 8 <= BROADCAST_BYTES // 2:
            # The whole bitmap is within the bound whatever the rows are.
            pages = twice.groupBy(F.expr("bitmap_bucket_number(__cell)").alias(f"__page{k}")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__cell))").alias(f"__bits{k}"))
            out = out.withColumn("__cell", cell).withColumn(f"__page{k}", F.expr("bitmap_bucket_number(__cell)")).join(F.broadcast(pages), f"__page{k}", "left")
            byte = f"cast(conv(hex(substring(__bits{k}, cast(bitmap_bit_position(__cell) div 8 as int) + 1, 1)), 16, 10) as int)"
            hit = F.expr(f"coalesce(shiftright({byte}, cast(bitmap_bit_position(__cell) % 8 as int)) & 1, 0) = 1")
            out = out.withColumn(f"__hit{k}", hit).drop("__cell", f"__page{k}", f"__bits{k}")
        else:
            # Beyond the bound rows meet the cells in a shuffle; hot cells are split.
            marked = twice.select(F.col("__cell").alias(f"__cell{k}"), F.lit(True).alias(f"__two{k}"))
            out = out.withColumn(f"__cell{k}", cell).join(marked, f"__cell{k}", "left").withColumn(f"__hit{k}", F.coalesce(F.col(f"__two{k}"), F.lit(False))).drop(f"__cell{k}", f"__two{k}")
        flag = flag & F.col(f"__hit{k}")
    return out.withColumn("__maybe", flag).drop("__hit0", "__hit1")


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, __row, __sha, keep_id, group_size, kept of every row of ``docs``."""
    rows = cut(_narrow(docs))
    n = rows.count()
    tested = cut(suspicious(rows, n))
    alone = tested.where("not __maybe").select("doc_id", "__row", "__sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = tested.where("__maybe")
    best = F.struct(-F.col("__len"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    won = maybe.groupBy("__sha").agg(F.min(best).alias("__best"), F.count("*").alias("group_size"))
    won = cut(won.select("__sha", "group_size", F.col("__best.doc_id").alias("keep_id"), F.col("__best.__row").alias("__keep_row")))
    out = alone
    # Groups of at least a 1 / HOT of all rows, at most HOT by count, are broadcast; so no shuffled key is hot.
    hot = F.col("group_size") * HOT >= n
    for some, side in ((F.broadcast(won.where(hot)), maybe), (won.where(~hot), maybe.join(F.broadcast(won.where(hot)), "__sha", "left_anti"))):
        out = out.unionByName(side.join(some, "__sha").select("doc_id", "__row", "__sha", "keep_id", "group_size", (F.col("__row") == F.col("__keep_row")).alias("kept")))
    return out


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decide(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("__sha")).alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept.

    Texts are not shuffled: rows are dropped where they are read, by the
    (doc_id, SHA-256) of the rows that go if their list is within the broadcast
    bound, else by a join.  Fully equal rows, which no key tells apart, are
    first made one by a partial aggregate.
    """
    # Rows travel as one struct, so that no column's name can clash with a working one.
    marked = docs.select(F.struct("*").alias("__d"), F.col("doc_id").alias("__id"), F.unhex(F.sha2(F.encode(normalised(), "utf-8"), 256)).alias("__sha2"), F.length(text_of()).alias("__len2"))
    decided = cut(decide(docs))
    gone = cut(decided.where("not kept").select(F.col("doc_id").alias("__g_id"), F.col("__sha").alias("__g_sha")).distinct())
    # A (doc_id, sha) that both stays and goes belongs to repeated rows.
    both = decided.where("kept").join(gone, F.col("doc_id").eqNullSafe(F.col("__g_id")) & (F.col("__sha") == F.col("__g_sha")), "left_semi").select(F.col("doc_id").alias("__b_id"), F.col("__sha").alias("__b_sha"))
    both = cut(both)
    on = lambda i, s: F.col("__id").eqNullSafe(F.col(i)) & (F.col("__sha2") == F.col(s))
    out = marked.join(small(gone, 96), on("__g_id", "__g_sha"), "left_anti").select("__d.*")
    if both.isEmpty():
        return out
    again = marked.join(small(both, 96), on("__b_id", "__b_sha"), "left_semi")
    again = again.groupBy("__id", "__sha2").agg(F.max_by("__d", F.struct("__len2", F.xxhash64("__d"))).alias("__d"))
    return out.unionByName(again.select("__d.*"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER w = 1 AS kept, s AS text_sha256
FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""
