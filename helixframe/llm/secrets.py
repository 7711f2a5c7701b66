"""Secret scans: fixed rules, and character Markov models for strings without a rule.

Two first-order Markov models, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a candidate string is a secret
if its mean log-likelihood ratio per character exceeds a threshold that the same
samples give.  Candidates are runs of at least 20 characters of
``[A-Za-z0-9+/_=-]`` with a letter and a digit, or with both cases after the
first letter; what a span of a fixed rule covers is cut out of a run first.
Where a whole run is no secret, its sub-runs from separator to separator are
candidates too: the one whose ratios exceed the threshold by the largest sum
is a secret, then the best ones on both sides of it.

Offsets are code points of the whole text, end exclusive.  Null text is empty.
Spans of one start are ordered as the kinds are listed.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, text_of

KINDS = ("assign", "access", "hex", "random")
#: Ordinary identifiers come from at most so many documents.
SAMPLE_DOCS = 400

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORD = re.compile(r"[A-Za-z]{3,}")
#: A part of a run between separators, with the padding that ends a key.
_PART = re.compile(r"[A-Za-z0-9]+(?:={1,2}(?![A-Za-z0-9=]))?")
LEAST = 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules' matches, ordered."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of hexadecimal digits is matched whole, so its length can be asked for at once.
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


class Model:
    """Log-likelihood ratio of random strings against identifiers, by pairs of characters."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold

    def score(self, text: str) -> float:
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
        return float(self.ratio[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def inner(self, s: str) -> list[tuple[int, int]]:
        """Sub-runs of a run, from separator to separator, that are secrets; in no order."""
        parts = [m.span() for m in _PART.finditer(s)]
        if not parts:
            return []
        starts, ends = np.array(parts, np.int64).T
        codes = np.frombuffer(s.encode("ascii"), np.uint8)
        total = np.concatenate([[0.0], np.cumsum(self.ratio[codes[:-1], codes[1:]] - self.threshold)])
        out, todo = [], [(0, len(starts))]
        while todo:
            lo, hi = todo.pop()
            if hi <= lo or ends[hi - 1] - starts[lo] < LEAST:
                continue
            # For each last part, the best first part at least LEAST characters before its end.
            begin, end = starts[lo:hi], ends[lo:hi]
            upto = np.searchsorted(begin, end - LEAST, "right") - 1
            least = np.minimum.accumulate(total[begin])
            gain = np.where(upto >= 0, total[end - 1] - least[np.maximum(upto, 0)], -np.inf)
            j = int(gain.argmax())
            if gain[j] <= 0:
                continue
            i = int(total[begin[: upto[j] + 1]].argmin())
            if _mixed(s[begin[i] : end[j]]):
                out.append((int(begin[i]), int(end[j])))
            todo += [(lo, lo + i), (lo + j + 1, hi)]
        return out

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for m in _CANDIDATE.finditer(text):
            for start, end in _uncovered(*m.span(), base):
                s = text[start:end]
                if end - start < LEAST or not _mixed(s):
                    continue
                if self.score(s) > self.threshold:
                    out.append((start, 3, end))
                else:
                    out += sorted((start + a, 3, start + b) for a, b in self.inner(s))
        return out


def _mixed(s: str) -> bool:
    """A letter and a digit, or both cases after the first letter."""
    return bool(re.search("[A-Za-z]", s) and (re.search("[0-9]", s) or (re.search("[A-Z]", s[1:]) and re.search("[a-z]", s))))


def _uncovered(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of [start, end) that no span of ``base``, ordered by start, covers."""
    out, at = [], start
    for a, _, b in base:
        if a >= end:
            break
        if b > at:
            if a > at:
                out.append((at, a))
            at = b
    return [*out, (at, end)] if at < end else out


def random_samples(n: int = 1500, seed: int = 5) -> list[str]:
    """Labelled random strings over the alphabets that keys are written in."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = (digits + "abcdef", upper + digits, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_")
    dice = random.Random(seed)
    return ["".join(dice.choices(alphabets[i % len(alphabets)], k=dice.randint(20, 64))) for i in range(n)]


def identifier_samples(texts: list[str], n: int = 3000, seed: int = 6) -> list[str]:
    """Labelled ordinary identifiers: words of texts, joined as programs and paths join them."""
    words = sorted({w for t in texts for w in _WORD.findall(t)}) or ["value", "name", "index"]
    dice = random.Random(seed)
    out = []
    for i in range(n):
        some = [dice.choice(words) for _ in range(dice.randint(2, 5))]
        joined = ("_".join(some), "-".join(some), "".join(w.capitalize() for w in some), "/".join(some), "_".join(some).upper())[i % 5]
        out.append(joined + (str(dice.randint(0, 2030)) if i % 3 == 0 else ""))
    return out


def fit(randoms: list[str], identifiers: list[str]) -> Model:
    """Both Markov models, with a threshold midway between the samples' near extremes."""

    def logs(samples: list[str]) -> np.ndarray:
        counts = np.full((128, 128), 0.1)
        for s in samples:
            c = np.frombuffer(s.encode("ascii"), np.uint8)
            np.add.at(counts, (c[:-1], c[1:]), 1)
        return np.log(counts / counts.sum(1, keepdims=True))

    model = Model(logs(randoms) - logs(identifiers), 0.0)
    low = np.quantile([model.score(s) for s in randoms], 0.01)
    high = np.quantile([model.score(s) for s in identifiers], 0.999)
    model.threshold = float((low + high) / 2)
    return model


def fit_on(docs: DataFrame, limit: int = SAMPLE_DOCS) -> Model:
    """A model whose identifiers come from the ``limit`` documents of the lowest hashes.

    Hashes are chosen first, then only these documents are read; of equal ones
    the first counts.
    """
    key = F.xxhash64("doc_id", "text")
    lowest = [r[0] for r in docs.where(F.col("text").isNotNull()).select(key.alias("k")).distinct().orderBy("k").limit(limit).collect()]
    rows = docs.where(F.col("text").isNotNull() & key.isin(lowest)).groupBy(key.alias("k")).agg(F.first("text").alias("text")).collect() if lowest else []
    return fit(random_samples(), identifier_samples([r["text"] for r in rows]))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and found: array of (kind, start, end, base) of every row."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:int,end:int,base:boolean>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["__text"].tolist():
                base = base_spans(text)
                found.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < 3} for a, k, b in sorted(base + model.spans(text, base))])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "found": found})

    return docs.select("doc_id", text_of().alias("__text")).mapInPandas(run, schema)


def mask(text: str, model: Model, mark: str = "<secret>") -> str:
    """The text with every span, overlapping ones merged, replaced by ``mark``."""
    base = base_spans(text)
    out, at = [], 0
    for a, _, b in sorted(base + model.spans(text, base)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(found, only_base: bool):
    kept = F.filter(found, lambda x: x["base"]) if only_base else found
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    return scan(docs, fit_on(docs)).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(found, True), 256).alias("base_sha256"), _joined(found, False).alias("spans"),
    )
