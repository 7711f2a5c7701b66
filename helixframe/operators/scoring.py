"""Model scorers as Arrow batches: a factory makes the model once a task, rows go to it in batches of a size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_batches(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], keep: Sequence[str], schema: str, batch: int = 64, by_length: str | None = None) -> DataFrame:
    """``keep`` columns beside what the model says of each row, as columns of ``schema``.

    ``factory`` runs in the worker and returns a function of a frame that gives
    one row for each of its rows, in order; another number raises.  With
    ``by_length`` the rows of a frame are sorted by a text's length first, so
    that batches pad little.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            if not len(frame):
                continue
            model = model or factory()
            if by_length:
                frame = frame.iloc[frame[by_length].str.len().fillna(0).argsort(kind="stable")]
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch].reset_index(drop=True)
                said = model(part).reset_index(drop=True)
                if len(said) != len(part):
                    raise ValueError(f"score_count_mismatch: {len(said)} for {len(part)}")
                yield pd.concat([part[list(keep)], said], axis=1)

    return df.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], schema]))


def both_strands(df: DataFrame, sequence: str, target: str) -> DataFrame:
    """Each row twice, ``strand`` + and -: the sequence and its reverse complement, with the target's place in it."""
    from ..functions.columns import reverse_complement

    back = F.struct(F.lit("-").alias("strand"), reverse_complement(sequence).alias("s"), (F.length(sequence) - 1 - F.col(target)).alias("t"))
    two = F.array(F.struct(F.lit("+").alias("strand"), F.col(sequence).alias("s"), F.col(target).alias("t")), back)
    out = df.withColumn("__two", F.explode(two))
    return out.withColumns({"strand": F.col("__two.strand"), sequence: F.col("__two.s"), target: F.col("__two.t")}).drop("__two")


def likelihood_ratio(log_ref: Column, log_alt: Column) -> Column:
    """Higher for a worse alternate: log(ref) - log(alt)."""
    return log_ref - log_alt


def mean_log_likelihood(logs: Column) -> Column:
    """Mean of the known log probabilities of a sequence's places; null without any."""
    known = F.filter(logs, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def log_softmax(logits: Column) -> Column:
    from ..functions.columns import log_sum_exp

    return F.transform(logits, lambda x: x - log_sum_exp(logits))


def tokens(sequence: Column, ids: dict[str, int], unknown: int, cls: int | None = None, eos: int | None = None, mask: int | None = None, target: Column | None = None) -> Column:
    """Ids of a sequence's letters, with marks for its true ends and a mask at ``target`` (from 0)."""
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    one = F.transform(F.filter(F.split(sequence, ""), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(unknown)))
    if mask is not None and target is not None:
        one = F.transform(one, lambda x, i: F.when(i == target, F.lit(mask)).otherwise(x))
    parts = [*([F.array(F.lit(cls))] if cls is not None else []), one, *([F.array(F.lit(eos))] if eos is not None else [])]
    return F.concat(*parts)
