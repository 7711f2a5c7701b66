"""A corpus pipeline of five operators of ``helixframe.llm``.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; ``run`` writes it as Parquet and reads it again.
"""

from __future__ import annotations

from helixframe.llm import bpe, decontamination, exact_dedup, jaccard_join, toxicity
from helixframe.llm.common import cut, read


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score reaches the threshold go."""
    return toxicity.reject(docs, toxicity.fit_on(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark, docs, sf_dir):
    """Of equal texts one row stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents linked by shingles (five words, similarity 0.8 or more) the smallest doc_id stays."""
    return jaccard_join.near_dedup(docs, percent=80, n=5)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark, docs, sf_dir):
    """Token ids of every text, and the text as the ids decode."""
    return bpe.transcode(docs, bpe.shipped(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: The first stage scores with a model that is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
