"""Benchmark decontamination by a hash set of test n-grams; DataFrame functions only.

Words are the runs of characters other than ASCII punctuation, white space and
controls, with A-Z lower-cased.  A window is ``N`` consecutive words of an item;
an item of fewer words, but not none, is one window.

1. The items' windows become a table of distinct (length, 64-bit hash, words).
   It is broadcast if its counted rows are within the bound, else shuffled.
2. Every document hashes its windows of each length that occurs among the items:
   hashes of 2, 4 and 8 words are composed from halves, so a window costs a few
   hash calls and no slice.  One row for each window meets the table; only hits
   are kept, beside one row for each document.
3. Documents with hits are read again and every hit's words are compared.
4. Hits of a text give its hit words (the union of the windows) and its items.

Steps 2 and 3 use (xxhash64 of text, length of text) as the key of a text; equal
texts have equal results, so repeated rows and ids need no care.  Null text has
no words; a null item text has no window.  A very long text is one row of arrays
until its windows are rows.  Without documents there are no rows, without items
no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, read, small, text_of

N = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(name: str = "text") -> Column:
    """The words of a text column."""
    return F.filter(F.split(F.translate(text_of(name), _UPPER, _LOWER), _GAP), lambda w: w != "")


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def with_hashes(df: DataFrame, lengths: list[int], source: str = "__words") -> DataFrame:
    """``df`` with __h{L} for each length: hashes of all windows of L words, by start."""
    df = df.withColumn("__w1", F.transform(source, lambda w: F.xxhash64(w)))
    have = {1: "__w1"}

    def add(length: int) -> None:
        nonlocal df
        if length in have:
            return
        a = 1 << (length.bit_length() - 1)
        a = a // 2 if a == length else a
        add(a)
        add(length - a)
        # Windows of ``length`` words: as many as a window start leaves room for.
        n = F.greatest(F.lit(0), F.size(source) - (length - 1))
        df = df.withColumn(f"__w{length}", _pairs(F.slice(have[a], F.lit(1), n), F.slice(have[length - a], F.lit(a + 1), n)))
        have[length] = f"__w{length}"

    for length in sorted(lengths):
        add(length)
    return df


def item_windows(items: DataFrame, n: int = N) -> DataFrame:
    """Distinct (__len, __hash, __gram) with __items, the item_ids that have the window."""
    own = items.select("item_id", words().alias("__words")).where(F.size("__words") > 0)
    length = F.least(F.lit(n), F.size("__words"))
    own = own.withColumn("__len", length).select("item_id", "__len", F.explode(F.transform(F.sequence(F.lit(1), F.size("__words") - length + 1), lambda i: F.slice("__words", i, length))).alias("__gram"))
    parts: DataFrame | None = None
    own = cut(own)
    for size in sorted(r[0] for r in own.select("__len").distinct().collect()):
        some = with_hashes(own.where(F.col("__len") == size), [size], "__gram").select("item_id", "__len", "__gram", F.element_at(f"__w{size}", 1).alias("__hash"))
        parts = some if parts is None else parts.unionByName(some)
    if parts is None:
        parts = own.select("item_id", "__len", "__gram", F.lit(0).cast("long").alias("__hash"))
    return cut(parts.distinct())


def _key(name: str = "text") -> list[Column]:
    return [F.xxhash64(text_of(name)).alias("__t1"), F.length(text_of(name)).alias("__t2")]


def scan(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """doc_id, __t1, __t2, n_words, n_hit, hits, items of every row.

    hits: array of (start, length), in words, ordered; items: sorted item_ids as
    strings.  Both are null for a clean document.
    """
    grams = item_windows(items, n)
    lengths = sorted(r[0] for r in grams.select("__len").distinct().collect())
    known = small(cut(grams.groupBy("__len", "__hash").agg(F.lit(True).alias("__known"))), 64)
    own = with_hashes(docs.select("doc_id", *_key(), words().alias("__words")), lengths)
    # One row for the document (start -1), then one for each window of each length.
    head = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).alias("l"), F.lit(0).cast("long").alias("h")))
    run = lambda k: F.transform(f"__w{k}", lambda h, i: F.struct(i.alias("s"), F.lit(k).alias("l"), h.alias("h")))
    runs = [run(k) for k in lengths]
    rows = own.select("doc_id", "__t1", "__t2", F.size("__words").cast("long").alias("n_words"), F.explode(F.concat(head, *runs)).alias("__x"))
    rows = rows.select("doc_id", "__t1", "__t2", "n_words", F.col("__x.s").alias("__s"), F.col("__x.l").alias("__l"), F.col("__x.h").alias("__h"))
    rows = rows.join(known, (F.col("__l") == F.col("__len")) & (F.col("__h") == F.col("__hash")), "left").where("__s < 0 or __known")
    found = cut(rows.select("doc_id", "__t1", "__t2", "n_words", "__s", "__l", "__h"))
    heads = found.where("__s < 0").select("doc_id", "__t1", "__t2", "n_words")
    hits = found.where("__s >= 0").select("__t1", "__t2", "__s", "__l", "__h").distinct()
    spots = cut(hits.groupBy("__t1", "__t2").agg(F.collect_list(F.struct("__s", "__l", "__h")).alias("__spots")))
    # Verify: compare the words themselves, once for each distinct text.
    texts = docs.select(*_key(), "text").join(small(spots.select("__t1", "__t2"), 32), ["__t1", "__t2"], "left_semi")
    texts = texts.groupBy("__t1", "__t2").agg(F.first("text").alias("text")).join(spots, ["__t1", "__t2"])
    # A table, so that a text is split once and not again for each of its hits.
    seen = cut(texts.select("__t1", "__t2", words().alias("__words"), "__spots"))
    seen = seen.withColumn("__x", F.transform("__spots", lambda x: F.struct(x["__s"].alias("s"), x["__l"].alias("l"), x["__h"].alias("h"), F.slice("__words", x["__s"] + 1, x["__l"]).alias("g"))))
    seen = seen.select("__t1", "__t2", F.explode("__x").alias("__x")).select("__t1", "__t2", "__x.*")
    by_gram = cut(grams.groupBy("__len", "__hash", "__gram").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("__items")))
    width = by_gram.agg(F.sum(64 + F.aggregate("__gram", F.lit(0), lambda a, w: a + F.octet_length(w) + 16) + F.aggregate("__items", F.lit(0), lambda a, w: a + F.octet_length(w) + 16))).first()[0]
    true = seen.join(F.broadcast(by_gram) if (width or 0) <= BROADCAST_BYTES else by_gram, (F.col("l") == F.col("__len")) & (F.col("h") == F.col("__hash")) & (F.col("g") == F.col("__gram")))
    result = true.groupBy("__t1", "__t2").agg(F.array_sort(F.collect_set(F.struct("s", "l"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("items"))
    ahead = F.aggregate(
        "hits", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["s"] + x["l"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["s"] + x["l"] - F.greatest(a["end"], x["s"]))).alias("n")),
    )
    result = cut(result.select("__t1", "__t2", "hits", "items", ahead["n"].alias("n_hit")))
    width = result.agg(F.sum(96 + 16 * F.size("hits") + F.aggregate("items", F.lit(0), lambda a, w: a + F.octet_length(w) + 16))).first()[0]
    return heads.join(F.broadcast(result) if (width or 0) <= BROADCAST_BYTES else result, ["__t1", "__t2"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns kept."""
    bad = cut(scan(docs, items, n).where("n_hit > 0").select("__t1", "__t2").distinct())
    # Rows travel as one struct, so that no column's name can clash with a working one.
    marked = docs.select(F.struct("*").alias("__d"), *_key())
    return marked.join(small(bad, 32), ["__t1", "__t2"], "left_anti").select("__d.*")


_WORDS_SQL = "list_filter(string_split_regex(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_HITS_SQL = f"""
w AS MATERIALIZED (SELECT doc_id, {_WORDS_SQL} AS ws FROM {{docs}}),
b AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
g AS MATERIALIZED (SELECT DISTINCT item_id, least({N}, len(ws)) AS l, ws[i : i + least({N}, len(ws)) - 1] AS gram
  FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least({N}, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
f AS (SELECT DISTINCT gram[1] AS word FROM g),
p AS (SELECT doc_id, ws, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w WHERE len(ws) > 0)),
h AS MATERIALIZED (SELECT DISTINCT p.doc_id, p.i, g.l, g.item_id FROM p JOIN f ON p.word = f.word
  JOIN g ON g.gram = p.ws[p.i : p.i + g.l - 1] AND g.gram[1] = p.word)
"""
ORACLE_SQL = (
    "WITH "
    + _HITS_SQL.format(docs="documents")
    + """,
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(generate_series(0, l - 1)) AS k FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
)
