"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct 4-word shingles (with fewer words the whole
sequence is one).  Two documents link when 100 |A & B| >= 85 |A | B|.

Bounds.  Let s be the smaller set's size.  Linked sets differ in at most
delta = floor(s * 15 / 85) shingles, as |A | B| <= s / 0.85.

Sketch.  Every shingle XORs its hash into one of m cells, chosen by the hash.  A
shingle that only one of two sets has changes one cell, so the number of
differing cells is at most the symmetric difference.  A second sketch of single
parity bits, of which a shingle flips one, has a Hamming distance that is a lower
bound of the symmetric difference too; it sorts out pairs before they are verified.

Pigeonhole join.  Sizes fall into bands of ratio 1.2; a pair is sought in the
band of its smaller set, where m = delta(band) + 1 + t, so at least 1 + t cells
are equal.  Cells are ordered by their number of shingles, then by value; equal
cells have equal places in that order.  A document leaves out its first t cells
and sends the other delta + 1 as join keys: of 1 + t equal cells the last is sent
by both sides.  t is chosen so that cells of no or one shingle, which are equal
by chance, are usually among those left out.

Verification.  Sets with equal hashes are one class.  In each bucket of equal
keys every class is first compared with the bucket's smallest class; that links
groups of near copies without forming their pairs.  Buckets whose classes are
then still in different components are compared in blocks of bounded size, by
parity bits, in two rounds: first every block sends the forest of the closest
pairs between its components, fewer than it has rows; what is then still apart
forms groups, in each block the sets that some chain of allowed pairs connects,
and a task that reads the sets of one group finds all of its links and sends a
forest of them.  So no link between components is lost, pairs inside a known
component are never formed, and every step sends at most one row for each row
that it reads.

Edge cases: null text and text without words give the empty set, size 0, linked
with nothing.  component_id is the smallest doc_id reachable, itself included;
documents with a null doc_id take part and have the component of the others.
Repeated rows and ties are rows of one class; a very long text is one set, whose
block holds the fewer other sets.  An empty table gives no rows; other columns of
``docs`` are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, free_shuffles, give_back, pieces, read, small, text_of
from .substring_dedup import Hashes, mix, windows

#: Similarity in percent, and words a shingle.
PERCENT, N = 85, 4
RATIO = 1.2
#: Classes in a block of a bucket, and shingles in all of its sets.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Rows that a worker compares at once, if no block has more.
FRAME = 2048
#: The keys are matched in slices of their hash, so that only one slice's shuffle is on disk at a time.
SLICES = 2
SLICE_BITS = SLICES.bit_length() - 1


class Bands:
    """Size bands, with the cells of each."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self._slack: dict[int, int] = {}
        self.high = [1]
        while self.high[-1] < 1 << 40:
            self.high.append(max(self.high[-1] + 1, int(self.high[-1] * RATIO)))
        self.high_array = np.array(self.high)

    def delta(self, smaller: int) -> int:
        return smaller * (100 - self.percent) // self.percent

    def slack(self, band: int) -> int:
        """Cells that a document leaves out: as many as have under two shingles, by expectation and some more."""
        if band not in self._slack:
            d, least = self.delta(self.high[band]), self.high[band - 1] + 1 if band else 1
            t = 0
            while t < d:
                load = least / (d + 1 + t)
                weak = (d + 1 + t) * math.exp(-load) * (1 + load)
                if t >= weak + math.sqrt(weak):
                    break
                t += 1
            self._slack[band] = t
        return self._slack[band]

    def cells(self, band: int) -> int:
        return self.delta(self.high[band]) + 1 + self.slack(band)

    def of(self, size: int) -> list[int]:
        """The bands in which a set of a size can have partners: its own, and lower ones that reach it."""
        own = int(np.searchsorted(self.high_array, size))
        out = [own]
        for b in range(own - 1, -1, -1):
            if self.high[b] * 100 < size * self.percent:
                break
            out.append(b)
        return out


def shingles(words: list[bytes], known: Hashes, n: int = N) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(known.of(words), min(n, len(words)), seed=min(n, len(words))))


def sketch(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (XOR of the 64-bit hashes that fall into each), and shingles in each."""
    cell = (mix(s + np.uint64(0x51ED270B)) >> np.uint64(20)) % np.uint64(m)
    order = np.argsort(cell, kind="stable")
    sizes = np.bincount(cell.astype(np.int64), minlength=m)
    cells = np.zeros(m, np.uint64)
    full = np.flatnonzero(sizes)
    cells[full] = np.bitwise_xor.reduceat(s[order], (np.cumsum(sizes) - sizes)[full])
    return cells, sizes


def join_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys of a set: in each of its bands the delta + 1 cells of the most shingles."""
    keys = []
    for b in bands.of(len(s)):
        cells, sizes = sketch(s, bands.cells(b))
        send = np.lexsort((cells, sizes))[bands.slack(b) :].astype(np.uint64)
        keys.append(mix(cells[send] + mix(send * np.uint64(4) + np.uint64(b) * np.uint64(1 << 40))))
    return np.concatenate(keys)


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Parity bits, one to two for each shingle (256 at least, a power of two); every shingle flips one."""
    words = 1 << max(2, (len(s) - 1).bit_length() - 6)
    bits = np.zeros(words, np.uint64)
    r = mix(s + np.uint64(99))
    np.bitwise_xor.at(bits, (r >> np.uint64(6)) % np.uint64(words), np.uint64(1) << (r & np.uint64(63)))
    return bits


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parity bits at a shorter length: the XOR of both halves is the sketch of half the length."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


class Folded:
    """The parity bits of several sets, of different lengths, folded on demand."""

    def __init__(self, bits: list[bytes]):
        self.words = np.array([len(b) // 8 for b in bits], np.int64)
        self.rank = np.zeros(len(bits), np.int64)
        self.at: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.rank[own] = np.arange(len(own))
            self.at[w, w] = np.frombuffer(b"".join([bits[i] for i in own]), np.uint64).reshape(len(own), w)

    def rows(self, which: np.ndarray, words: int, to: int) -> np.ndarray:
        """Sets ``which``, all of length ``words``, folded ``to`` another."""
        if (words, to) not in self.at:
            self.at[words, to] = fold(self.at[words, words], to)
        return self.at[words, to][self.rank[which]]


def apart(x: Folded, i: np.ndarray, y: Folded, j: np.ndarray) -> np.ndarray:
    """Differing parity bits of sets x[i] and y[j], at the shorter length of each two."""
    out = np.zeros(len(i), np.int64)
    p, q = x.words[i], y.words[j]
    both = p << 32 | q
    for uv in np.unique(both).tolist():
        at, u, v = np.flatnonzero(both == uv), uv >> 32, uv & 0xFFFFFFFF
        to = min(u, v)
        out[at] = np.bitwise_count(x.rows(i[at], u, to) ^ y.rows(j[at], v, to)).sum(1)
    return out


def split_lower(text: str) -> list[bytes]:
    """Words with A-Z lower-cased: bytes.lower() and bytes.split() are ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def sets(docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """doc_id, __n (set size), __s (64-bit hash of the set, null if empty), __bits (parity bits), __k0, __k1, ... (join keys of its cells, by slice)."""
    bands = Bands(percent)
    slices = [f"__k{i}" for i in range(SLICES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for batch in batches:
            for lo, hi in pieces(batch["__text"], 500):
                part = batch.iloc[lo:hi]
                rows: list[tuple] = []
                for text in part["__text"].tolist():
                    s = shingles(split_lower(text), known, n)
                    if not len(s):
                        rows.append((0, None, None, *[[]] * SLICES))
                        continue
                    keys = join_keys(s, bands)
                    at = keys >> np.uint64(64 - SLICE_BITS)
                    rows.append((len(s), int(mix(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(7))) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]), parity_bits(s).tobytes(), *[keys[at == i].view(np.int64) for i in range(SLICES)]))
                out = pd.DataFrame(rows, columns=["__n", "__s", "__bits", *slices])
                out["__s"] = out["__s"].astype("Int64")
                out.insert(0, "__x", part["__x"].to_numpy())
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out
        known.clear()
        give_back()

    return docs.select("doc_id", F.xxhash64(text_of()).alias("__x"), text_of().alias("__text")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __x long, __n long, __s long, __bits binary, " + ", ".join(f"{c} array<long>" for c in slices))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(a) + len(b) - len(np.unique(np.concatenate([a, b])))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _contents(docs: DataFrame, classes: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """__s, __set (sorted shingle hashes) of the classes, from one text of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for batch in batches:
            for lo, hi in pieces(batch["__text"], 500):
                part = batch.iloc[lo:hi]
                yield pd.DataFrame({"__s": part["__s"], "__set": [shingles(split_lower(t), known, n).view(np.int64) for t in part["__text"].tolist()]})
        known.clear()
        give_back()

    own = members.join(small(classes, 32), "__s", "left_semi").groupBy("__s", "doc_id", "__x").agg(F.count("*").alias("__m"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__x", "__m"))
    wanted = cut(own.groupBy("__s").agg(best.alias("__o")).select("__s", F.col("__o.doc_id").alias("__id"), F.col("__o.__x").alias("__ox"), F.col("__o.__m").alias("__m")))
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("__x"), text_of().alias("__text"))

    def read_of(rows: DataFrame) -> DataFrame:
        return texts.join(small(rows, 64), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__x") == F.col("__ox"))).select("__s", "__text")

    out = read_of(wanted.where("__m = 1"))
    again = wanted.where("__m > 1")
    if not again.isEmpty():  # rows that repeat doc_id and text
        out = out.unionAll(read_of(again).dropDuplicates(["__s"]))
    return out.mapInPandas(run, "__s long, __set array<long>")


def _near(apart, x, y, percent: int):
    """Whether sets of sizes x and y that differ in at least ``apart`` shingles can be linked."""
    return (100 + percent) * apart <= (100 - percent) * (x + y)


def _verify(pairs: DataFrame, sketches: DataFrame | None, docs: DataFrame, members: DataFrame, percent: int, n: int) -> DataFrame:
    """The linked pairs (a, b) of candidate pairs: parity bits, if given, sort out most, the sets of the others decide."""

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = np.arange(len(batch))
                far = apart(Folded(batch["__x"].tolist()), at, Folded(batch["__y"].tolist()), at)
                yield batch.loc[_near(far, batch["__m"].to_numpy(), batch["__n"].to_numpy(), percent), ["a", "b"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [_linked(x, y, percent) for x, y in zip(batch["__x"].tolist(), batch["__y"].tolist())]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    def side(table: DataFrame, key: str, what: str, to: str, *more) -> DataFrame:
        return table.select(F.col("__s").alias(key), F.col(what).alias(to), *more)

    sifted = pairs
    if sketches is not None:
        size = F.col("__size")
        both = pairs.join(side(sketches, "a", "__bits", "__x", size.alias("__m")), "a").join(side(sketches, "b", "__bits", "__y", size.alias("__n")), "b")
        sifted = cut(both.select("a", "b", "__x", "__y", "__m", "__n").mapInPandas(sift, "a long, b long"))
    free_shuffles(docs.sparkSession)
    classes = cut(sifted.select(F.col("a").alias("__s")).unionAll(sifted.select("b")).distinct())
    contents = cut(_contents(docs, classes, members, n))
    out = sifted.join(side(contents, "a", "__set", "__x"), "a").join(side(contents, "b", "__set", "__y"), "b")
    out = cut(out.select("a", "b", "__x", "__y").mapInPandas(run, "a long, b long"))
    drop(classes, contents)
    if sketches is not None:
        drop(sifted)
    return out


def components(edges: DataFrame) -> DataFrame:
    """__s, __c of every vertex of the edges (a, b): __c is the smallest vertex of its component.

    Large-star and small-star steps alternate until nothing changes: each is one
    aggregate of the edges, and their number grows with the logarithm of a
    component's size.  A vertex with many neighbours costs one row a neighbour.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        step = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        size = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before:
            break
        now, before = step, size
    return now.select(F.col("u").alias("__s"), F.col("v").alias("__c")).unionAll(now.select("v", "v").distinct())


class Forest:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            twice = self.up[self.up]
            if (twice == self.up).all():
                return twice
            self.up = twice

    def join(self, i: int, j: int) -> bool:
        """Join two sets; False if they were one."""
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        up[max(i, j)] = min(i, j)
        return bool(i != j)


def _allowed(frame: pd.DataFrame, group: np.ndarray, percent: int, skip) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (k, j) of rows of one block, but of different components, that the parity bits allow, and their differing bits.

    ``skip`` (k, j) tells the pairs that need no look any more.
    """
    c, o, p, q, size = (frame[x].to_numpy() for x in ("__c", "__o", "__p", "__q", "__size"))
    bits = Folded(frame["__bits"].tolist())
    for d in range(1, len(frame)):  # rows at distance d of one block
        k = np.flatnonzero(group[d:] == group[:-d])
        if not len(k):
            break
        # In a pair of blocks, what both rows of one block are to each other is the business of that block.
        k = k[(c[k] != c[k + d]) & ((p[k] == q[k]) | (o[k] != o[k + d]))]
        k = k[100 * np.minimum(size[k], size[k + d]) >= percent * np.maximum(size[k], size[k + d])]
        k = k[~skip(k, k + d)]
        far = apart(bits, k, bits, k + d)
        near = _near(far, size[k], size[k + d], percent)
        yield k[near], k[near] + d, far[near]


def closest(frame: pd.DataFrame, group: np.ndarray, percent: int) -> pd.DataFrame:
    """A forest of the closest allowed pairs between the components of each block: __a, __b."""
    _, label = np.unique(np.stack([group, frame["__c"].to_numpy()]), axis=1, return_inverse=True)
    forest, label = Forest(int(label.max()) + 1), label.ravel()
    k, j, far = np.concatenate([np.empty((3, 0), np.int64), *map(np.stack, _allowed(frame, group, percent, lambda k, j: np.zeros(len(k), bool)))], axis=1)
    order = np.lexsort((j, k, far))
    k, j = k[order], j[order]
    chosen = []
    while True:
        # Every component takes its closest pair with another one, until none is left.
        at = forest.roots()[label]
        open_ = np.flatnonzero(at[k] != at[j])
        k, j = k[open_], j[open_]
        if not len(k):
            break
        first = np.unique(np.concatenate([np.unique(at[k], return_index=True)[1], np.unique(at[j], return_index=True)[1]]))
        chosen += [(x, y) for x, y in zip(k[first].tolist(), j[first].tolist()) if forest.join(label[x], label[y])]
    s = frame["__s"].to_numpy()
    x, y = np.array(chosen, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"__a": s[x], "__b": s[y]})


def gather(frame: pd.DataFrame, group: np.ndarray, percent: int) -> pd.DataFrame:
    """The classes of each block that chains of allowed pairs connect: __a, the same for all of a chain, and __b, a class."""
    forest = Forest(len(frame))
    at = forest.roots()
    for k, j, _ in _allowed(frame, group, percent, lambda k, j: at[k] == at[j]):
        for x, y in zip(k.tolist(), j.tolist()):
            forest.join(x, y)
        at = forest.roots()
    s = frame["__s"].to_numpy()
    _, back, count = np.unique(at, return_inverse=True, return_counts=True)
    mine = np.flatnonzero(count[back] > 1)
    # The chain's name comes from its classes alone, so equal chains of several blocks are one.
    name = np.zeros(len(count), np.uint64)
    np.bitwise_xor.at(name, back[mine], mix(s[mine].view(np.uint64) + np.uint64(21)))
    return pd.DataFrame({"__a": name[back[mine]].view(np.int64), "__b": s[mine]})


def _frames(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole blocks (rows of equal ``by``, which lie side by side), with the number of each row's block."""
    held = None

    def cuts(frame, whole):
        ids = frame[by].to_numpy()
        group = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(1))])
        edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), *[len(frame)] * whole]
        lo = 0
        for i in range(1, len(edge)):
            if edge[i] - lo >= FRAME or i == len(edge) - 1:
                yield frame.iloc[lo : edge[i]], group[lo : edge[i]]
                lo = edge[i]
        yield frame.iloc[lo:], None

    for batch in batches:
        if not len(batch):
            continue
        for part, group in cuts(batch if held is None else pd.concat([held, batch], ignore_index=True), False):
            if group is None:
                held = part.reset_index(drop=True)
            else:
                yield part.reset_index(drop=True), group
    if held is not None and len(held):
        for part, group in cuts(held, True):
            if group is not None and len(part):
                yield part.reset_index(drop=True), group


def _blocks(rows: list[DataFrame], comps: DataFrame, sketches: DataFrame, percent: int, what) -> DataFrame:
    """__a, __b: what ``closest`` or ``gather`` says of the buckets with several components, in blocks of BLOCK classes or pairs of such."""
    info = cut(sketches.select("__s", "__size").join(small(comps, 32), "__s", "left").select("__s", "__size", F.coalesce("__c", "__s").alias("__c")))
    tagged = [part.join(small(info, 48), "__s") for part in rows]
    same = (F.count("*").alias("__m"), F.bit_xor(F.xxhash64("__s")).alias("__f1"), F.sum(F.xxhash64("__s", F.lit(5)).cast("decimal(38,0)")).alias("__f2"))
    mixed = None
    for part in tagged:
        own = part.groupBy("__key").agg(*same, F.sum("__size").alias("__all"), F.min("__c").alias("__lo"), F.max("__c").alias("__hi")).where("__m >= 3 and __lo <> __hi")
        mixed = own if mixed is None else mixed.unionAll(own)
    # Near copies share many cells: of buckets with the same classes one is enough.
    mixed = cut(mixed.groupBy("__m", "__f1", "__f2").agg(F.min("__key").alias("__key"), F.first("__all").alias("__all")).select("__key", "__m", "__all"))
    free_shuffles(sketches.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in _frames(batches, ["__key", "__p", "__q"]):
            yield what(frame, group, percent)
        give_back()

    open_ = reduce(DataFrame.unionAll, [part.join(small(mixed, 48), "__key") for part in tagged])
    wide = F.greatest(F.ceil(F.col("__m") / BLOCK), F.ceil(F.col("__all") / BLOCK_SHINGLES)).cast("int")
    open_ = open_.withColumn("__w", wide).withColumn("__o", F.pmod(F.xxhash64("__s", F.lit(3)), F.col("__w")).cast("int"))
    dealt = open_.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__w") - 1)))
    dealt = dealt.select("__key", F.least("__o", "__i").alias("__p"), F.greatest("__o", "__i").alias("__q"), "__o", "__s", "__c", "__size")
    grouped = dealt.join(sketches.select("__s", "__bits"), "__s").repartition("__key", "__p", "__q").sortWithinPartitions("__key", "__p", "__q")
    out = cut(grouped.mapInPandas(run, "__a long, __b long").distinct())
    free_shuffles(sketches.sparkSession)
    drop(mixed, info)
    return out


def forest_of(sets_: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of all links of some sets: overlaps are counted as products of their columns of shared shingles."""
    n, size = len(sets_), np.array([len(x) for x in sets_], np.int64)
    _, column, count = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, step = np.zeros((n, n), np.float32), max(64, (1 << 21) // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((n, step), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    forest = Forest(n)
    pairs = np.argwhere(np.triu(100 * both >= percent * (size[:, None] + size - both), 1))
    return [(i, j) for i, j in pairs.tolist() if forest.join(i, j)]


def _link_groups(groups: DataFrame, docs: DataFrame, members: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each group (__a its name, __b a class)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in _frames(batches, ["__a"]):
            s, sets_, found = frame["__b"].to_numpy(), frame["__set"].tolist(), []
            edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(s)]
            for lo, hi in zip(edge, edge[1:]):
                found += [(s[lo + i], s[lo + j]) for i, j in forest_of(sets_[lo:hi], percent)]
            yield pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])
        give_back()

    classes = cut(groups.select(F.col("__b").alias("__s")).distinct())
    contents = cut(_contents(docs, classes, members, n))
    dealt = groups.join(contents.withColumnRenamed("__s", "__b"), "__b").select("__a", "__b", "__set").repartition("__a").sortWithinPartitions("__a")
    out = cut(dealt.mapInPandas(run, "a long, b long").distinct())
    drop(classes, contents)
    return out


def link(docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; __x (hash of its text), __class (its component, null without words), __size (the component's rows, null if one)."""
    own = cut(sets(docs, percent, n))
    members = cut(own.select("doc_id", "__x", "__n", "__s", "__bits"))
    # One document speaks for its class: the copies' keys are left out where their class is known to be repeated.
    many = cut(members.where("__s is not null").groupBy("__s").agg(F.count("*").alias("__m"), F.min("doc_id").alias("__first")).where("__m >= 2"))
    speak = own.where("__s is not null").join(small(many, 48), "__s", "left").where(F.col("__m").isNull() | F.col("doc_id").eqNullSafe(F.col("__first")) | F.col("__first").isNull())
    parts = []
    for i in range(SLICES):
        keyed = speak.select("__s", F.explode(f"__k{i}").alias("__key"))
        # A table, so that the shuffle of the slice's keys is freed before the join makes its own.
        twice = cut(keyed.groupBy("__key").agg(F.count("*").alias("__m")).where("__m >= 2").select("__key"))
        free_shuffles(docs.sparkSession)
        parts.append(cut(keyed.join(twice, "__key", "left_semi").distinct()))
        drop(twice)
    drop(own)
    rows = reduce(DataFrame.unionAll, parts)
    hub = rows.groupBy("__key").agg(F.min("__s").alias("b"))
    pairs = cut(rows.join(hub, "__key").where("__s <> b").select(F.col("__s").alias("a"), "b").distinct())
    involved = cut(pairs.select(F.col("a").alias("__s")).unionAll(pairs.select("b")).distinct())
    free_shuffles(docs.sparkSession)
    sketches = cut(members.join(small(involved, 32), "__s", "left_semi").select("__s", F.col("__n").alias("__size"), "__bits").dropDuplicates(["__s"]))
    edges = _verify(pairs, sketches, docs, members, percent, n)
    drop(pairs, involved)
    comps = cut(components(edges))
    # Classes still apart: first forests of the closest pairs, then whole groups of what these did not link.
    more = _blocks(parts, comps, sketches, percent, closest)
    if not more.isEmpty():
        edges = cut(edges.unionAll(_verify(more.select(F.col("__a").alias("a"), F.col("__b").alias("b")), None, docs, members, percent, n)))
        comps = cut(components(edges))
        groups = _blocks(parts, comps, sketches, percent, gather)
        if not groups.isEmpty():
            comps = cut(components(edges.unionAll(_link_groups(groups, docs, members, percent, n))))
        drop(groups)
    drop(more)
    drop(rows, sketches)
    labelled = members.join(small(comps, 32), "__s", "left").withColumn("__c", F.coalesce("__c", "__s"))
    smallest = cut(labelled.where("__c is not null").groupBy("__c").agg(F.min("doc_id").alias("__least"), F.count("*").alias("__size")).where("__size >= 2"))
    out = labelled.join(small(smallest, 48), "__c", "left")
    return out.select("doc_id", F.col("__n").alias("n_shingles"), F.col("__c").alias("__class"), F.coalesce("__least", "doc_id").alias("component_id"), "__x", "__size")


def near_dedup(docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """The rows of ``docs`` that stay, one for each component, all columns kept: the row of the smallest doc_id.

    A null doc_id comes last; rows of one doc_id are told apart by the hash of
    their text.  Rows are dropped where they are read, so texts are not shuffled.
    Documents without words stay.
    """
    linked = cut(link(docs, percent, n).select("doc_id", "__x", "__class", "__size"))
    groups = linked.where("__size >= 2")
    best = cut(groups.groupBy("__class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__x").alias("x"))).alias("__b")))
    stays = F.col("doc_id").eqNullSafe(F.col("__b.id")) & (F.col("__x") == F.col("__b.x"))
    marked = groups.join(small(best, 48), "__class").groupBy(F.col("doc_id").alias("__g"), F.col("__x").alias("__gx"), stays.alias("__stays")).agg(F.count("*").alias("__m"))
    marked = cut(marked.where("not __stays or __m >= 2"))
    gone, again = marked.where("not __stays").select("__g", "__gx"), marked.where("__stays").select("__g", "__gx")
    own = docs.select(F.struct("*").alias("__d"), F.col("doc_id").alias("__id"), F.xxhash64(text_of()).alias("__x"))
    same = F.col("__id").eqNullSafe(F.col("__g")) & (F.col("__x") == F.col("__gx"))
    out = own.join(small(gone, 48), same, "left_anti")
    if again.isEmpty():
        return out.select("__d.*")
    # Rows that repeat the doc_id and the text that stay: one of them, chosen by content.
    held = own.join(small(again, 48), same, "left_semi")
    one = held.groupBy("__id", "__x").agg(F.min_by("__d", F.xxhash64("__d")).alias("__d"))
    rest = out.join(small(again, 48), same, "left_anti")
    return rest.select("__d.*").unionByName(one.select("__d.*"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def brute_force(texts: list[str | None], ids: list[int], percent: int = PERCENT, n: int = N) -> list[tuple[int, int]]:
    """(n_shingles, component_id) by comparing all pairs of real shingle sets; for tests."""
    own = []
    for t in texts:
        w = split_lower(t or "")
        own.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where: dict[tuple, list[int]] = {}
    for i, s in enumerate(own):
        shared: dict[int, int] = {}
        for g in s:
            for j in where.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            where[g].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(own[j]) - both):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(len(s), least[find(i)]) for i, s in enumerate(own)]
