"""Domain operators over variants, transcripts and sequence windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational as R

#: Consequences whose rows transcript selection removes, and those outside transcripts: fixed values.
OUTSIDE = ("upstream_gene_variant", "downstream_gene_variant", "intergenic_variant")


def select_transcripts(vep: DataFrame, removed: list[str], coding: str = "protein_coding", noncoding: str = "lncRNA", targets: DataFrame | None = None) -> DataFrame:
    """One row for each (variant, gene): rows with any removed consequence go, variants of exactly one
    of the two biotypes stay, and MANE, canonical, support level and feature decide, nulls last."""
    terms = F.split("consequence", ",")
    kept = vep.where(F.size(F.array_intersect(terms, F.array(*[F.lit(x) for x in removed]))) == 0)
    if targets is not None:
        kept = kept.join(targets.select("variant", F.col("target_gene").alias("gene")), ["variant", "gene"])
    flags = kept.groupBy("variant").agg(F.bool_or(F.col("biotype") == coding).alias("__c"), F.bool_or(F.col("biotype") == noncoding).alias("__n")).where(F.coalesce("__c", F.lit(False)) != F.coalesce("__n", F.lit(False)))
    kept = kept.join(flags.select("variant"), "variant", "left_semi").where(F.col("biotype").isin(coding, noncoding))
    tsl = F.expr("try_cast(nullif(regexp_extract(tsl, '^([0-9]+)', 1), '') as int)")
    order = [F.col("mane").isNull(), F.coalesce(F.col("canonical") != "YES", F.lit(True)), tsl.asc_nulls_last(), F.col("feature").asc_nulls_last()]
    return R.keep_first(kept, ["variant", "gene"], order)


#: Frequencies that annotation outside transcripts keeps: fixed names.
FREQUENCIES = ("gnomade_af", "gnomadg_af", "max_af", "max_af_pops")


def select_outside(vep: DataFrame, allowed: tuple[str, ...] = OUTSIDE) -> DataFrame:
    """Variants whose every consequence, in every row, is allowed; consequences as a sorted union; no gene.

    Of each frequency column that ``vep`` has, the first known value by
    consequence counts.  A row without consequence rules its variant out.
    """
    terms = F.split("consequence", ",")
    ok = F.coalesce(F.size(F.array_except(terms, F.array(*[F.lit(x) for x in allowed]))) == 0, F.lit(False))
    own = [c for c in FREQUENCIES if c in vep.columns]
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("consequence").alias("o"), F.col(c).alias("v")))).alias(f"__{c}") for c in own]
    out = vep.groupBy("variant").agg(F.bool_and(ok).alias("__ok"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(terms)))).alias("__t"), *firsts)
    return out.where("__ok").select("variant", F.lit(None).cast("string").alias("gene"), F.array_join("__t", ",").alias("consequence"), *[F.col(f"__{c}.v").alias(c) for c in own])


def downsample(df: DataFrame, negatives: list[str], fraction: float, seed: int, outside_transcripts: bool = False) -> DataFrame:
    """All rows with a known other label, and those of a seeded share of the negative variants.

    Each biotype is a stratum, and a negative row stays if its variant was
    chosen in any; outside transcripts all variants are one stratum, and every
    row of a variant that is positive or chosen stays.  Elsewhere rows without
    a label go.
    """
    low = df.where(F.col("label").isin(negatives))
    positive = df.where(~F.col("label").isin(negatives))
    stratum = F.lit("") if outside_transcripts else F.coalesce("biotype", F.lit(""))
    chosen = R.stratified_sample(low.select("variant", stratum.alias("__b")), "variant", "__b", fraction, seed).select("variant")
    if outside_transcripts:
        return df.join(chosen.unionAll(positive.select("variant")).distinct(), "variant", "left_semi")
    return positive.unionByName(low.join(chosen.distinct(), "variant", "left_semi"))


def centered_window(at: Column, contig: Column, width: int) -> dict[str, Column]:
    """Start, target offset and both paddings of a window around a position; it may leave the contig."""
    start = at - width // 2
    return {"window_start": start, "target": F.lit(width // 2), "left_pad": F.greatest(F.lit(0), -start), "right_pad": F.greatest(F.lit(0), start + width - contig)}


def gene_window(at: Column, gene_start: Column, gene_end: Column, width: int, margin: int, contig: Column, same_contig: Column | None = None) -> tuple[Column, Column]:
    """Start and kind of a window that holds the whole gene, and the margin around the variant.

    The centered window if it does; else, shifted as little as can be, one
    inside the contig; ``gene_too_long`` without any; ``missing_gene_span``
    without a gene.  A gene on another contig (``same_contig`` false) raises.
    """
    centered = at - width // 2
    holds = (centered <= gene_start) & (gene_end <= centered + width) & (centered <= at - margin) & (at + 1 + margin <= centered + width)
    low = F.greatest(gene_end - width, at + 1 + margin - width, F.lit(0))
    high = F.least(gene_start, at - margin, contig - width)
    kind = (
        F.when(gene_start.isNull(), "missing_gene_span").when(holds, "centered_full_gene")
        .when(low > high, "gene_too_long").otherwise("shifted_full_gene")
    )
    if same_contig is not None:
        kind = F.when(gene_start.isNotNull() & ~same_contig, F.raise_error(F.lit("gene_contig_mismatch")).cast("string")).otherwise(kind)
    return F.when(kind == "centered_full_gene", centered).when(kind == "shifted_full_gene", F.least(F.greatest(centered, low), high)), kind


def extract_window(sequence: Column, start: Column, width: int) -> Column:
    """A slice of a contig, padded with N outside it."""
    left, right = F.greatest(F.lit(0), -start), F.greatest(F.lit(0), start + width - F.length(sequence))
    body = F.substring(sequence, F.greatest(start, F.lit(0)) + 1, F.greatest(F.lit(0), F.lit(width) - left - right))
    return F.concat(F.repeat(F.lit("N"), left), body, F.repeat(F.lit("N"), right))


def tile_starts(length: Column, width: int) -> Column:
    """Starts of protein windows: tiles from both ends that overlap by at least half, and one in the middle if the two sides would not."""
    ov = (width + 1) // 2
    st = max(1, width - ov)
    n = F.ceil((length - width) / (2 * st)).cast("int")
    both = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(i * st, length - width - i * st)))
    last = (n - 1) * st
    middle = F.when(last + width - (length - width - last) < ov, F.array(F.floor((length - width) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(length <= width, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(F.concat(both, middle))))


def edge_weight(offset: Column, start: Column, size: Column, length: Column, width: int) -> Column:
    """Sigmoid weight of a place (from 0) in a window of ``size`` places at ``start``.

    Only the outer quarters fall, and only at edges that are not sequence ends;
    a window shorter than ``width`` has weight 1 everywhere.
    """
    taper, scale = round(((width + 1) // 2) / 2), 20.0 * width / 1022.0
    if taper == 0:
        return F.lit(1.0)
    rising = 1 / (1 + F.exp(-(offset - taper / 2) / scale))
    falling = 1 / (1 + F.exp((offset - (width - taper) - taper / 2) / scale))
    inner = F.when((start > 0) & (offset < taper), rising).when((start + size < length) & (offset >= width - taper), falling).otherwise(1.0)
    return F.when(size < width, 1.0).otherwise(inner)


def splice_track(lengths: Column) -> Column:
    """1 at the last base of every exon, else 0, over the spliced transcript."""
    ends = F.transform(lengths, lambda x, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda a, v: a + v.cast("int")) - 1)
    total = F.aggregate(lengths, F.lit(0), lambda a, v: a + v.cast("int"))
    return F.transform(F.sequence(F.lit(0), total - 1), lambda p: F.array_contains(ends, p).cast("int"))


def codon_track(length: Column, low: Column, high: Column) -> Column:
    """1 at every third base of the coding range [low, high)."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda p: ((p >= low) & (p < high) & ((p - low) % 3 == 0)).cast("int"))


def coverage(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows, rows with a value, and their share, by group."""
    return rows.groupBy(group).agg(F.count("*").alias("rows"), F.count(value).alias("covered")).withColumn("share", F.col("covered") / F.col("rows"))
