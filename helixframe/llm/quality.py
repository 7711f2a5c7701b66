"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features describe the line itself and its two
neighbours.  Training lines carry their document's label.  A document's quality
is the length-weighted mean of the lines' forward-backward marginals, put on the
scale of the labels by a logistic function that is fitted with the field.

Edge cases: null text is empty and has one empty line; without labels of both
kinds every score is 0.5.  A very long text is one sequence, scored whole, in a
batch of its own.  Repeated rows are scored each, alike; an empty table gives no
rows; only doc_id and text are read, whatever the other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import held_out, labelled_sample, pieces, read, text_of

#: The model is fitted on at most so many labelled rows of either label.
SAMPLE_PER_CLASS = 800
_DOCS = 1000
_SENTENCE = re.compile(rb"[.!?]+")


def _classes() -> np.ndarray:
    """Per byte: letter, upper-case letter, digit, white space, bar or tabular mark, other symbol."""
    table = np.zeros((6, 256), np.float32)
    for b in range(256):
        c = chr(b)
        letter = b >= 128 or c.isalpha()
        table[0, b] = letter
        table[1, b] = b < 128 and c.isupper()
        table[2, b] = c.isdigit() and b < 128
        table[3, b] = b in b" \t\r\x0b\x0c\n"
        table[4, b] = c in "|\t<>{}[]\\/_=~^`"
        table[5, b] = b < 128 and not letter and not c.isalnum() and b not in b" \t\r\x0b\x0c\n.,"
    return table


_TABLE = _classes()
WIDTH = 18


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines (lines, WIDTH), their weights, and first lines of documents."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    per_doc = [r.split(b"\n") for r in raw]
    lines = [x for d in per_doc for x in d]
    counts = np.array([len(d) for d in per_doc], int)
    starts = np.zeros(len(lines), bool)
    starts[np.cumsum(counts) - counts] = True
    sizes = np.array([len(x) for x in lines], int)
    flat = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    share = np.stack([np.add.reduceat(row[flat], first) for row in _TABLE], 1)
    share[:, 3] -= 1  # the line break itself
    share /= np.maximum(1, sizes)[:, None]
    rest = np.zeros((len(lines), 12))
    where: dict[bytes, int] = {}
    i = 0
    for d in per_doc:
        where.clear()
        for x in d:
            where[x] = where.get(x, 0) + 1
        for x in d:
            words = x.split()
            n = len(words)
            if n:
                distinct = len(set(words))
                pairs = len(set(zip(words, words[1:])))
                head = words[0][:1]
                rest[i] = (
                    distinct / n, pairs / max(1, n - 1), np.log1p(n), min(sizes[i] / n, 40.0) / 10, n == 1, n < 4, where[x] > 1,
                    len(_SENTENCE.findall(x)) / n, x.isupper(), head.isalpha() and head.isupper(), x.count(b"!!") / n, len(min(words, key=len)) / 10,
                )
            i += 1
    out = np.column_stack([share, rest])
    return out, np.maximum(1.0, sizes.astype(float)), starts


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own features, then those of the previous and the next line of the same document (0 where there is none), and their absence."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    ends = np.ones(len(x), bool)
    if len(x):
        ends[:-1] = starts[1:]
        before[1:] = x[:-1]
        after[:-1] = x[1:]
        before[starts], after[ends] = 0, 0
    return np.column_stack([x, before, after, starts, ends])


class Model:
    def __init__(self, mean, scale, w, A, pi, score):
        self.mean, self.scale, self.w, self.A, self.pi, self.score = mean, scale, w, A, pi, score

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of being good, weights, first lines."""
        x, weight, starts = line_features(texts)
        x = (with_neighbours(x, starts) - self.mean) / self.scale
        e = x @ self.w[:-1] + self.w[-1]
        return crf.forward_backward(e, starts, self.A, self.pi)[2], weight, starts

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return crf.apply_logistic(self.score, aggregate(*self.lines(texts)))


def aggregate(p: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each document, as a share and as log-odds."""
    first = np.flatnonzero(starts)
    q = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.column_stack([q, np.log(q / (1 - q))])


def fit(rows: list[tuple[str, int]]) -> Model | None:
    y = np.array([label for _, label in rows], int)
    if not len(y) or y.min() == y.max():
        return None
    texts = [t for t, _ in rows]
    x, weight, starts = line_features(texts)
    x = with_neighbours(x, starts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    tags = y[np.cumsum(starts) - 1]
    emit = lambda w: x @ w[:-1] + w[-1]
    grad = lambda d: np.append(d @ x, d.sum())
    w, A, pi = crf.fit(emit, grad, x.shape[1] + 1, tags, starts, rounds=150, rate=0.1, l2=1e-4)
    model = Model(mean, scale, w, A, pi, np.zeros(3))
    model.score = crf.logistic(aggregate(*model.lines(texts)), y, l2=0.05)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, bad_lines (numbers, from 0, of lines with a marginal under one half) of every row."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, bad_lines array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi in pieces(batch["__text"], _DOCS):
                part = batch.iloc[lo:hi]
                if model is None:
                    yield pd.DataFrame({"doc_id": part["doc_id"], "score": 0.5, "bad_lines": [[] for _ in range(len(part))]})
                    continue
                p, weight, starts = model.lines(part["__text"].tolist())
                cuts = np.split(p, np.flatnonzero(starts)[1:])
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": crf.apply_logistic(model.score, aggregate(p, weight, starts)), "bad_lines": [np.flatnonzero(c < 0.5).astype(np.int32) for c in cuts]})

    return docs.select("doc_id", text_of().alias("__text")).mapInPandas(run, schema)


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    return fit(labelled_sample(docs, labels, "quality", per_class, F.min))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_on(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("bad_lines").alias("n_bad_lines"))
