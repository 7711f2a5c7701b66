"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece is encoded by encoding its halves and joining them.  Joining re-encodes
a window around the seam and doubles the window until the tokens outside are
provably right: a sequence of tokens is the encoding of its bytes if every
adjacent pair (a, b) encodes to [a, b] again.  (Were the whole sequence encoded
otherwise, consider its first merge across one of these seams.  All merges
before it lie inside tokens, so encoding just the two tokens beside that seam
would make the same merges in the same order, and cross it too.)  So only the
two seams of the window need a look.  Token sequences under this join are a
monoid with the empty sequence as its unit; decoding is the homomorphism back to
bytes, concatenated up a tree.

Each match of the tokenizer's pattern is encoded separately, without special
tokens.  Null text is empty and has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, read, text_of

#: Pieces up to so many bytes are encoded by plain merging.
LEAF = 8
_MEMO = 400_000


#: The pattern that byte-level tokenizers of this family share; only for it is there a faster equivalent.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NARROW = 0x250


def _narrow_finder():
    """Matches of GPT_PATTERN in texts of code points under _NARROW, by the standard library's faster engine.

    The classes are spelt out as ranges, and the alternatives, whose first
    characters differ, stand in order of frequency.
    """

    def ranges(cls: str) -> str:
        test = regex.compile(cls).match
        inside = [c for c in range(_NARROW) if test(chr(c))]
        return "".join(f"\\u{c:04x}" for c in inside)

    letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall


class _Memo(dict):
    """Packed ids of pieces, made on first use."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece):
        ids = self[piece] = self.make(piece)
        return ids


class Codec:
    """Encoder and decoder of one vocabulary: ``ranks`` maps token bytes to ids, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.find = regex.compile(pattern).findall
        self.tokens = {i: b for b, i in ranks.items()}
        if max(self.tokens, default=-1) < 2 * len(ranks):  # ids without large gaps: a list is faster
            self.tokens = [self.tokens.get(i) for i in range(max(self.tokens, default=-1) + 1)]
        self._narrow = _narrow_finder() if pattern == GPT_PATTERN else None
        self._wide = re.compile(f"[^\\u0000-\\u{_NARROW - 1:04x}]").search
        self._pieces = _Memo(self.piece)
        self._pairs: dict[tuple[int, int], list[int]] = {}
        self._leaves: dict[bytes, list[int]] = {}

    def _merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        if len(piece) > 64:
            return self._merge_long(piece)
        get, none = self.ranks.get, len(self.ranks) + (1 << 40)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [whole := parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + whole, none)
            if at < len(pairs):
                pairs[at] = get(whole + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap: n log n for windows that had to grow."""
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(piece[i : end[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[j]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def _pair(self, a: int, b: int) -> list[int]:
        """The encoding of the bytes of two tokens; remembered, as few pairs are frequent."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > _MEMO:
                self._pairs.clear()
            known = self._pairs[a, b] = self._merge(self.tokens[a] + self.tokens[b])
        return known

    def _stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their bytes."""
        return len(e := self._pair(a, b)) == 2 and e[0] == a

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right:
            return left or right
        window, k = self._pair(left[-1], right[0]), 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            if (not i or self._stable(left[i - 1], window[0])) and (j == len(right) or self._stable(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2
            window = self._merge(b"".join([self.tokens[t] for t in left[max(0, len(left) - k) :] + right[:k]]))

    def tree(self, piece: bytes) -> list[int]:
        """The encoding of a piece, by halves."""
        if len(piece) <= LEAF:
            known = self._leaves.get(piece)
            if known is None:
                if len(self._leaves) > _MEMO:
                    self._leaves.clear()
                known = self._leaves[piece] = self._merge(piece)
            return known
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = array("I", [whole] if whole is not None else self.tree(raw))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        memo = self._pieces
        if len(memo) > _MEMO:
            memo.clear()
        find = self._narrow if self._narrow and not self._wide(text) else self.find
        return b"".join(map(memo.__getitem__, find(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids, concatenated up a tree of slices."""
        numbers = array("I")
        numbers.frombytes(ids)
        level = [b"".join(map(self.tokens.__getitem__, numbers[k : k + 4096])) for k in range(0, len(numbers), 4096)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


def load(path: str, pattern: str) -> Codec:
    """A codec from a file of lines "base64 token, id"."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def default_codec() -> tuple[str, str]:
    """Vocabulary file and pattern of the public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def shipped(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """A broadcast of (ranks, pattern): the driver reads the vocabulary (under 1 MB), executors need no file."""
    own = default_codec()
    codec = load(path or own[0], pattern or own[1])
    mark = hashlib.sha256(repr((codec.pattern, sorted(codec.ranks.items()))).encode()).hexdigest()
    return spark.sparkContext.broadcast((codec.ranks, codec.pattern, mark))


_codec: dict[str, Codec] = {}


def _here(shared) -> Codec:
    """This worker's codec of a broadcast vocabulary, kept between tasks."""
    ranks, pattern, mark = shared.value
    if mark not in _codec:
        _codec.clear()
        _codec[mark] = Codec(ranks, pattern)
    return _codec[mark]


def transcode(docs: DataFrame, shared, ids: bool = True) -> DataFrame:
    """All columns of ``docs`` with text replaced by its decoding, and ``token_ids`` array<int> (if ``ids``)."""
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + (", token_ids array<int>" if ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _here(shared)
        for batch in batches:
            for lo in range(0, len(batch), 200):  # the ids of a whole batch would take several times its texts
                out = batch.iloc[lo : lo + 200][names].copy()
                texts = out["text"].tolist()
                packed = [codec.encode(t or "") for t in texts]
                out["text"] = [None if t is None else codec.decode(p).decode("utf-8", "surrogatepass") for t, p in zip(texts, packed)]
                if ids:
                    out["token_ids"] = pd.Series([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], index=out.index, dtype=object)
                yield out
        give_back()

    return docs.mapInPandas(run, fields)


def digest(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _here(shared)
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for t in batch["__text"].tolist():
                packed = codec.encode(t)
                rows.append((len(packed) // 4, sha(packed).hexdigest(), sha(codec.decode(packed)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", text_of().alias("__text")).mapInPandas(run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"), shipped(spark))


def round_trip(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n_tokens, and the text as the decoder gives it back, with the documents' other columns."""
    out = transcode(docs, shared)
    return out.withColumn("n_tokens", F.size("token_ids").cast("long")).drop("token_ids")
