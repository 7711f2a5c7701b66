"""Writers: single-file tables in a fixed order, FASTA, and verification after writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, order: Sequence[Column | str] = (), null: str = "", header: bool = True, single: bool = True) -> None:
    """Gzip TSV in a fixed row order; a folder with one file (an interchange format), or many sorted ones."""
    out = df.orderBy(*order) if order else df
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").csv(path, sep="\t", header=header, nullValue=null, emptyValue="", compression="gzip", quote="")


def vep_input(df: DataFrame) -> DataFrame:
    """Columns of a headerless VEP input: chromosome without chr, one-based start, end, REF/ALT, +, variant."""
    return df.select(F.regexp_replace("chromosome", "^chr", "").alias("chromosome"), (F.col("start") + 1).alias("start"), "end", F.concat("ref", F.lit("/"), "alt").alias("allele"), F.lit("+").alias("strand"), "variant")


def fasta_lines(df: DataFrame, width: int = 80) -> DataFrame:
    """One text value a record, sequences wrapped."""
    wrapped = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.select("id", F.concat(F.lit(">"), "id", F.lit("\n"), wrapped).alias("value"))


def shard_name(index: int, shards: int) -> str:
    return f"shard-{index:05d}-of-{shards:05d}.tsv.gz"


def verify_written(written: DataFrame, expected: DataFrame) -> None:
    """ValueError unless both have the same columns and rows, with multiplicity."""
    if written.columns != expected.columns:
        raise ValueError(f"schema_mismatch: {written.columns}")
    left, right = written.exceptAll(expected).limit(5).collect(), expected.exceptAll(written).limit(5).collect()
    if left or right:
        raise ValueError(f"value_mismatch: {left} {right}")


def write_fasta(df: DataFrame, path: str, width: int = 80, compression: str | None = None) -> None:
    """A folder with one FASTA file, records in the order of their ids."""
    fasta_lines(df, width).orderBy("id").select("value").coalesce(1).write.mode("overwrite").text(path, compression=compression)


def write_rsids(df: DataFrame, path: str) -> None:
    """Only the variants named by rs numbers, one a line, without header."""
    write_tsv(df.where(F.col("variant").rlike("^rs[0-9]+$")).select("variant").distinct(), path, ["variant"], header=False)


def write_scores(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> int:
    """A score table of exactly ``columns``; gives the number of rows.  Scores that are not finite raise before anything is written."""
    from ..functions.columns import finite
    from ..operators.relational import first_offenders

    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing_columns: {missing}")
    doubles = [c for c in columns if df.schema[c].dataType.typeName() in ("double", "float")]
    bad = F.lit(False)
    for c in doubles:
        bad = bad | (F.col(c).isNotNull() & ~finite(F.col(c)))
    out = first_offenders(df.select(*columns), bad, list(order), "score_not_finite")
    write_tsv(out, path, order)
    return out.count()


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Side tables as Parquet, one folder a name; all plans are analysed before the first is written."""
    plans = [(name, df, df.schema) for name, df in tables.items()]
    for name, df, _ in plans:
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")


def verify_order(written: DataFrame, order: Sequence[str]) -> None:
    """ValueError if a one-file table is not in the order of its keys."""
    from pyspark.sql import Window

    key = F.struct(*order)
    one = written.select(key.alias("k"), F.monotonically_increasing_id().alias("i"))
    lagged = one.select(F.lag("k").over(Window.orderBy("i")).alias("before"), "k").where(F.col("before") > F.col("k")).limit(1).collect()
    if lagged:
        raise ValueError(f"key_order_mismatch: {lagged[0]['k']}")
