"""Toxic spans by a linear-chain conditional random field over word tokens.

Labelled tokens: a token of a training document labelled toxic is positive if
its word, or its first letters, occur clearly more often in toxic than in clean
training documents; all tokens of clean documents are negative.  The field's
features of a token are the word itself, its first four and five letters, so that
unseen inflections are covered, and the words before and after it.
Forward-backward marginals give every token's probability; document scores are a
logistic function of their sum, their density and their largest value; offending
offsets are the tokens whose marginal is at least 0.5, adjacent ones merged.

Edge cases: null text is empty; a text without word tokens gets the score of a
document without evidence; without any training label every score is 0.  A very
long text is one sequence, scored whole, in a batch of its own.  Repeated rows are
scored each, alike; an empty table gives no rows; ``score`` reads doc_id and text
only and ``reject`` hands all columns on, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import give_back, held_out, labelled_sample, pieces, read, text_of

WORD = re.compile(r"\w+")
#: The model is fitted on at most so many labelled rows of either label.
SAMPLE_PER_CLASS = 800
DIMS = 1 << 18
#: The rule for token labels, chosen by folds of the training rows.
RATIO, TIMES = 12.0, 3
_MEMO = 400_000
_DOCS = 1000


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    keys = [f"w{word}", f"q{word[:4]}", f"r{word[:5]}"]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % DIMS for k in keys]


def beside(word: str) -> list[int]:
    """Hashed features that a lower-cased word gives the token after it, and the token before it."""
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % DIMS for k in (f"<{word}", f">{word}")]


def _lay(docs: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All tokens one after another, the end of each document in them, and first tokens."""
    words, ends = [w for d in docs for w in d], np.cumsum([len(d) for d in docs], dtype=np.int64)
    starts = np.zeros(len(words), bool)
    first = ends - np.array([len(d) for d in docs], np.int64)
    starts[first[first < ends]] = True
    return words, ends, starts


def _emit(own: np.ndarray, after: np.ndarray, before: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weights of tokens from those of their own words, and those that their words give the token after and before."""
    e, inner = own.copy(), np.flatnonzero(~starts)
    e[inner] += after[inner - 1]
    e[inner - 1] += before[inner]
    return e


def _keys(word: str) -> tuple[str, ...]:
    return (word, f"{word[:4]}*", f"{word[:5]}*") if len(word) >= 5 else (word,)


def _suspicious(docs: list[list[str]], y: np.ndarray, ratio: float = RATIO, times: int = TIMES) -> set[str]:
    """Words and prefixes that mark toxic documents, chosen to explain each document ``times`` times.

    Candidates are ``ratio`` times likelier in toxic than in clean documents (each
    distinct text counts once).  Copies of one toxic document share all of its
    rare words; so candidates are taken greedily, by the number of documents that
    hold a new word of theirs and have under ``times`` explained words so far,
    until the best explains under max(3, 0.4 %) documents.
    """
    texts = list({(tuple(sorted(set(words))), int(label)): None for words, label in zip(docs, y)})
    seen, where = (Counter(), Counter()), {}
    for i, (words, label) in enumerate(texts):
        seen[label].update({k for w in words for k in _keys(w)})
        if label:
            for w in words:
                for k in _keys(w):
                    where.setdefault(k, []).append((i, w))
    n1 = max(1, sum(label for _, label in texts))
    n0 = max(1, len(texts) - n1)
    least = max(3, n1 / 250)
    rank = lambda k: k.endswith("*") * (7 - len(k))  # noqa: E731  at equal gain the most specific wins
    heap = [(-c, rank(k), k) for k, c in seen[1].items() if c >= least and (c + 0.5) / n1 > ratio * (seen[0][k] + 0.5) / n0]
    heapq.heapify(heap)
    explained: dict[int, set[str]] = {}
    chosen: set[str] = set()
    while heap:
        *_, k = heapq.heappop(heap)
        gain = len({i for i, w in where[k] if len(e := explained.get(i, ())) < times and w not in e})
        if gain < least:
            continue
        if heap and gain < -heap[0][0]:
            heapq.heappush(heap, (-gain, rank(k), k))
            continue
        chosen.add(k)
        for i, w in where[k]:
            explained.setdefault(i, set()).add(w)
    return chosen


class Model:
    """Weights of a fitted tagger; plain arrays, so it can be sent to the workers."""

    def __init__(self, weights, A, pi, score):
        self.weights, self.A, self.pi, self.score = weights, A, pi, score
        self._memo: dict[str, int] = {}
        self._known = np.empty((0, 3))

    def __getstate__(self):
        return (self.weights, self.A, self.pi, self.score)

    def __setstate__(self, state):
        self.__init__(*state)

    def _of(self, words: list[str]) -> np.ndarray:
        """Weights of every word: its own, and those that it gives the tokens after and before it."""
        if len(self._memo) > _MEMO:
            self._memo.clear()
            self._known = np.empty((0, 3))
        new = list(set(words).difference(self._memo))
        if new:
            self._memo.update(zip(new, range(len(self._memo), len(self._memo) + len(new))))
            own = self.weights[np.array([features(w) for w in new])].sum(1)
            self._known = np.concatenate([self._known, np.column_stack([own, self.weights[np.array([beside(w) for w in new])]])])
        return self._known[np.fromiter(map(self._memo.__getitem__, words), np.int64, len(words))]

    def marginals(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens, and the end of each document in them."""
        words, ends, starts = _lay(docs)
        e = _emit(*self._of(words).T, starts)
        return crf.forward_backward(e, starts, self.A, self.pi)[2], ends

    def scores(self, p: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return crf.apply_logistic(self.score, evidence(p, ends))


def evidence(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Document features: log of the summed marginals, largest marginal, density."""
    first = np.concatenate([[0], ends[:-1]]).astype(int)
    sizes, total = ends - first, np.concatenate([[0.0], np.cumsum(p)])
    summed = total[ends] - total[first]
    most = np.zeros(len(ends))
    full = np.flatnonzero(sizes)
    if len(full):
        most[full] = np.maximum.reduceat(p, first[full])
    return np.column_stack([np.log1p(summed), most, summed / np.maximum(1, sizes)])


def fit(rows: list[tuple[str, int]], ratio: float = RATIO, times: int = TIMES, chain: bool = True) -> Model | None:
    """A tagger from (text, 0 or 1) rows; None without rows of both labels.

    ``chain`` False drops the transitions after the fit, to show what they add.
    """
    y = np.array([label for _, label in rows], int)
    if not len(y) or y.min() == y.max():
        return None
    docs = [WORD.findall(text.lower()) for text, _ in rows]
    bad = _suspicious(docs, y, ratio, times)
    words, ends, starts = _lay(docs)
    vocabulary = {w: i for i, w in enumerate(sorted(set(words)))}
    table = np.array([features(w) for w in vocabulary], int).reshape(-1, 3)
    sides = np.array([beside(w) for w in vocabulary], int).reshape(-1, 2)
    hit = np.array([not bad.isdisjoint(_keys(w)) for w in vocabulary], bool)
    ids = np.fromiter(map(vocabulary.__getitem__, words), int, len(words))
    tags = (hit[ids] & np.repeat(y == 1, np.diff(ends, prepend=0))).astype(int)
    inner = np.flatnonzero(~starts)

    def emit(w):
        return _emit(w[table].sum(1)[ids], w[sides[:, 0]][ids], w[sides[:, 1]][ids], starts)

    def grad(d):
        own, after, before = (np.bincount(i, x, len(table)) for i, x in ((ids, d), (ids[inner - 1], d[inner]), (ids[inner], d[inner - 1])))
        at = np.concatenate([table.ravel(), sides.T.ravel()])
        return np.bincount(at, np.concatenate([np.repeat(own, 3), after, before]), DIMS)

    w, A, pi = crf.fit(emit, grad, DIMS, tags, starts, rounds=24, l2=1e-7)
    if not chain:
        A = np.ones((2, 2))
    model = Model(w, A, pi, np.zeros(4))
    p, ends = model.marginals(docs)
    model.score = crf.logistic(evidence(p, ends), y)
    return model


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Offsets, in code points, of runs of tokens with a marginal of at least 0.5."""
    out: list[dict] = []
    hit = p >= 0.5
    if not hit.any():
        return out
    low = text.lower()
    at = [m.span() for m in WORD.finditer(low)]
    if len(low) != len(text):  # a few letters become several when lower-cased: count back to the text's own places
        home = [i for i, c in enumerate(text) for _ in c.lower()]
        # A capital sigma lower-cases by its place, always to one letter, so lengths agree.
        at = [(home[a], home[b - 1] + 1) for a, b in at]
    for i in np.flatnonzero(hit).tolist():
        if out and i and hit[i - 1]:
            out[-1] |= {"end": at[i][1], "p": max(out[-1]["p"], float(p[i]))}
        else:
            out.append({"start": at[i][0], "end": at[i][1], "p": float(p[i])})
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, spans of every row; ``spans`` has start, end (code points, end exclusive) and p."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,p:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi in pieces(batch["__text"], _DOCS):
                part = batch.iloc[lo:hi]
                if model is None:
                    yield pd.DataFrame({"doc_id": part["doc_id"], "score": 0.0, "spans": [[] for _ in range(len(part))]})
                    continue
                texts = part["__text"].tolist()
                p, ends = model.marginals([WORD.findall(t.lower()) for t in texts])
                cuts = np.split(p, ends[:-1]) if len(ends) else []
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": model.scores(p, ends), "spans": [_spans(t, q) for t, q in zip(texts, cuts)]})
        give_back()

    return docs.select("doc_id", text_of().alias("__text")).mapInPandas(run, schema)


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    return fit(labelled_sample(docs, labels, "toxic", per_class, F.max))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_on(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))).alias("spans"),
    )


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold; all columns, texts unchanged."""
    names = docs.columns
    out = docs.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi in pieces(batch["text"], _DOCS):
                part = batch.iloc[lo:hi]
                if model is not None:
                    p, ends = model.marginals([WORD.findall((t or "").lower()) for t in part["text"].tolist()])
                    part = part[model.scores(p, ends) < threshold]
                yield part[names]
        give_back()

    return docs.mapInPandas(run, out)
