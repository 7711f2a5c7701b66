"""Substring dedup with difference-cover anchors.

A window is ``L`` consecutive words.  A perfect difference cover D modulo V has,
for any two positions p and q, a shift below V that takes both to residues in D.
So two equal windows share an aligned anchor: a run of ``L - V + 1`` words that
starts, in both, at a cover position inside the window.  Only 5 of 21 positions
are cover positions.

0. All windows of a text that occurs twice are repeated; one row of equal texts
   speaks for all of them in what follows.
1. Anchors of every document are hashed; hashes that occur twice are found by a
   partial aggregate.
2. Documents learn which of their blocks (of V positions) hold repeated anchors.
   Every window that can contain one is a candidate; this loses none.
3. Candidates are extended: the hash (96 bits) of the whole window is counted in
   the same way.  Windows that occur twice, in one document or in two, are
   removed; windows are judged on the input.

No pair of documents is ever formed: a passage with a thousand copies costs a
thousand rows.  Rows of one hash meet only in partial aggregates and in joins
whose hot keys Spark splits.  Documents keep their texts where they are read;
what is joined to them is broadcast if its counted rows fit the bound.

Words are maximal runs of characters other than space and U+0009 to U+000D,
unchanged.  Null text has no words.  A document is known by a 64-bit hash of
doc_id and text; fully equal rows repeat each other and get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, pieces, read, small, text_of

L = 35
V = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = L - V + 1
_MEMO = 200_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str) -> list[bytes]:
    """bytes.split() parts at exactly space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` words, doubling from halves; order matters."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    level, size = mix(h + np.uint64(seed)), 1
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                part = level[done : done + len(h) - length + 1]
                out = part if out is None else mix(out * _MULT + part)
                done += size
            if done == length:
                return out
            level = mix(level[: len(level) - size] * _MULT + level[size:])
            size *= 2


def cover_positions(n: int) -> np.ndarray:
    """Starts of anchors in a document of n words."""
    p = np.arange(max(0, n - ANCHOR + 1))
    return p[np.isin(p % V, COVER)]


def anchors(h: np.ndarray) -> np.ndarray:
    """Hashes of a document's anchors, by position; anchor i starts in block i // len(COVER)."""
    return windows(h, ANCHOR)[cover_positions(len(h))] if len(h) >= L else np.empty(0, np.uint64)


def candidates(n: int, blocks: np.ndarray) -> np.ndarray:
    """Starts of windows that can contain an anchor of the blocks (positions b*V .. b*V+V-1)."""
    mark = np.zeros(n + 2 * V + 2, np.int32)
    lo = np.maximum(0, blocks * V - (V - 1))
    np.add.at(mark, lo, 1)
    np.add.at(mark, blocks * V + V, -1)
    return np.flatnonzero(np.cumsum(mark)[: max(0, n - L + 1)] > 0)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().alias("__text"), F.xxhash64("doc_id", text_of()).alias("__k"))


def _with_copies(docs: DataFrame) -> DataFrame:
    """``_docs`` with __d: 0 for a text that occurs once, 1 for one row of equal texts, 2 for the other rows.

    Every window of a text that occurs twice is repeated, so only one row of
    equal texts has to be compared with other documents.
    """
    pair = [F.xxhash64("__text").alias("__x1"), F.xxhash64(F.lit(7), "__text").alias("__x2")]
    own = _docs(docs)
    many = cut(own.select(*pair, "__k").groupBy("__x1", "__x2").agg(F.count("*").alias("__m"), F.min("__k").alias("__first")).where("__m >= 2"))
    kind = F.when(F.col("__first").isNull(), 0).when(F.col("__first") == F.col("__k"), 1).otherwise(2)
    return own.select("*", *pair).join(small(many, 64), ["__x1", "__x2"], "left").select("doc_id", "__text", "__k", kind.alias("__d"))


def repeated_blocks(docs: DataFrame) -> DataFrame:
    """__k, __blocks: for each text that is to be compared and has repeated anchors, their blocks."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for batch in batches:
            for lo, hi in pieces(batch["__text"], 500):
                part = batch.iloc[lo:hi]
                yield pd.DataFrame({"__k": part["__k"], "__hs": [anchors(known.of(split_words(t))).view(np.int64) for t in part["__text"].tolist()]})

    own = cut(docs.where("__d < 2").select("__k", "__text").mapInPandas(emit, "__k long, __hs array<long>").withColumn("__row", F.monotonically_increasing_id()))
    twice = own.select(F.explode("__hs").alias("__h")).groupBy("__h").agg(F.count("*").alias("__n")).where("__n >= 2").select("__h")
    rows = own.select("__row", F.posexplode("__hs").alias("__i", "__h")).select("__row", "__h", F.floor(F.col("__i") / len(COVER)).cast("int").alias("__b"))
    met = rows.join(twice, "__h", "left_semi").groupBy("__row").agg(F.collect_list("__b").alias("__blocks"))
    out = cut(own.select("__row", "__k").join(met, "__row").select("__k", "__blocks"))
    drop(own)
    return out


def repeated_windows(docs: DataFrame) -> DataFrame:
    """__k, __starts: for each text that occurs once and has removed words, the first words of its repeated windows."""
    blocks = repeated_blocks(docs)
    near = docs.where("__d < 2").select("__k", "__text", "__d").join(_bounded(blocks, "__blocks"), "__k")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for batch in batches:
            for lo, hi in pieces(batch["__text"], 200):
                out = []
                for k, text, d, b in batch.iloc[lo:hi][["__k", "__text", "__d", "__blocks"]].itertuples(index=False, name=None):
                    h = known.of(split_words(text))
                    p = candidates(len(h), np.unique(np.asarray(b, np.int64)))
                    if not len(p):
                        continue
                    w1, w2 = windows(h, L)[p], windows(h, L, 1)[p]
                    # Windows that repeat in the document are known; one of each still counts for others.
                    _, first, back, count = np.unique(w1, return_index=True, return_inverse=True, return_counts=True)
                    twice = count[back] > 1
                    once = np.sort(first)
                    open_ = ~twice[once] if d == 0 else np.zeros(len(once), bool)
                    out.append((k, w1[once].view(np.int64), (w2[once] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.where(open_, p[once], -1).astype(np.int32), p[twice].astype(np.int32) if d == 0 else np.empty(0, np.int32)))
                if out:
                    yield pd.DataFrame(out, columns=["__k", "__h1", "__h2", "__p", "__sure"])

    own = cut(near.mapInPandas(extend, "__k long, __h1 array<long>, __h2 array<int>, __p array<int>, __sure array<int>").withColumn("__row", F.monotonically_increasing_id()))
    flat = own.select("__row", F.explode(F.arrays_zip("__h1", "__h2", "__p")).alias("x")).select("__row", "x.*")
    twice = flat.groupBy("__h1", "__h2").agg(F.count("*").alias("__n")).where("__n >= 2").select("__h1", "__h2")
    met = flat.where("__p >= 0").join(twice, ["__h1", "__h2"], "left_semi").groupBy("__row").agg(F.collect_list("__p").alias("__met"))
    both = F.concat(F.coalesce("__met", F.array().cast("array<int>")), "__sure")
    out = cut(own.select("__row", "__k", "__sure").join(met, "__row", "left").select("__k", both.alias("__starts")).where(F.size("__starts") > 0))
    drop(own, blocks)
    return out


def _bounded(table: DataFrame, arrays: str) -> DataFrame:
    """A table of (key, int array), broadcast if its counted values fit the bound."""
    rows, values = table.agg(F.count("*"), F.sum(F.size(arrays))).first()
    return small(table, max(1, -(-(64 * rows + 4 * (values or 0)) // max(1, rows))))


def runs(starts: np.ndarray) -> np.ndarray:
    """Begin and end, in turn, of the word ranges that windows at the starts cover."""
    p = np.unique(starts)
    new = np.flatnonzero(np.diff(p) > L) + 1
    return np.column_stack([p[np.concatenate([[0], new])], p[np.concatenate([new - 1, [len(p) - 1]])] + L]).ravel()


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the kept words, joined by one space) of every row."""
    marked = _with_copies(docs)
    starts = repeated_windows(marked)

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"__k": batch["__k"], "__runs": [runs(np.asarray(p, np.int32)) for p in batch["__starts"].tolist()]})

    ranges = cut(starts.mapInPandas(shorten, "__k long, __runs array<int>"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string"

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, d, ranges_ in zip(batch["__text"].tolist(), batch["__d"].tolist(), batch["__runs"].tolist()):
                words = split_words(text)
                n = len(words)
                if d and n >= L:
                    words = []
                elif ranges_ is not None and len(ranges_):
                    for a, b in zip(reversed(ranges_[::2].tolist()), reversed(ranges_[1::2].tolist())):
                        del words[a:b]
                out.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
            frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    return marked.join(_bounded(ranges, "__runs"), "__k", "left").select("doc_id", "__text", "__d", "__runs").mapInPandas(keep, schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) by counting every window; for tests."""
    words = [split_words(t or "") for t in texts]
    count: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - L + 1):
            count[tuple(w[i : i + L])] = count.get(tuple(w[i : i + L]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - L + 1):
            if count[tuple(w[i : i + L])] > 1:
                gone.update(range(i, i + L))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
