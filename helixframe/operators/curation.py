"""Curation of variants, collation of several curated datasets, and annotation joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import genomics as G
from . import relational as R

#: Columns that a table of selected variants has to have: fixed names.
SELECTED = ("variant", "chromosome", "start", "end", "ref", "alt", "pip", "label")
#: Consequences whose rows transcript selection removes: fixed values.
REMOVED = ("intergenic_variant", "intron_variant", "upstream_gene_variant", "downstream_gene_variant")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, if it has the columns; else an error that names those missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing_columns: {missing}")
    return df


def chromosome_number(c: Column) -> Column:
    """The number of ``chr1`` to ``chr<n>``; null for any other name."""
    return F.nullif(F.regexp_extract(c, r"^chr(\d+)$", 1), F.lit("")).try_cast("int")


def genomic_order() -> list[Column]:
    """By chromosome number, start, variant and gene, nulls first."""
    return [chromosome_number(F.col("chromosome")).asc(), F.col("start").asc(), F.col("variant").asc(), F.col("gene").asc()]


def strongest_association(selected: DataFrame) -> DataFrame:
    """One row for each variant: the highest pip, nulls last, then the first target gene."""
    return R.keep_first(selected, ["variant"], [R.nulls_last("pip", True), R.nulls_last("target_gene")])


def curate(selected: DataFrame, vep: DataFrame, region: str = "transcribed", has_target_genes: bool = False, negatives: Sequence[str] = ("low_pip",), fraction: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """All annotated variants in genomic order, and the same with negatives down-sampled.

    Transcribed: one row a variant and gene; with target genes only their own
    gene.  Outside transcripts: one row a variant, its strongest association.
    """
    require(selected, [*SELECTED, *["target_gene"] * has_target_genes])
    outside = region == "outside-transcripts"
    if outside:
        if has_target_genes:
            selected = strongest_association(selected)
        joined = R.validated_join(selected, G.select_outside(vep), ["variant"], validate="m:1")
    elif has_target_genes:
        notes = G.select_transcripts(vep, list(REMOVED), targets=selected.select("variant", "target_gene"))
        joined = selected.join(notes.withColumnRenamed("variant", "__v"), (F.col("variant") == F.col("__v")) & (F.col("target_gene") == F.col("gene"))).drop("__v")
    else:
        joined = R.validated_join(selected, G.select_transcripts(vep, list(REMOVED)), ["variant"], validate="1:m")
    sampled = G.downsample(joined, list(negatives), fraction, seed, outside)
    return joined.orderBy(*genomic_order()), sampled.orderBy(*genomic_order())


def stage_report(df: DataFrame, biotypes: Sequence[str] | None = None) -> DataFrame:
    """Rows and distinct variants; with ``biotypes`` the rows of each label by biotype, missing ones 0."""
    if biotypes is None:
        return df.agg(F.count("*").alias("rows"), R.distinct_with_null("variant").alias("variants"))
    return df.groupBy("label").pivot("biotype", list(biotypes)).agg(F.count("variant")).na.fill(0, list(biotypes))


def collate(datasets: Mapping[str, DataFrame], keys: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """One row for each key of any dataset.

    Shared columns are the first known value in the order of the datasets; all
    other columns are prefixed with their dataset's name, and ``in_<name>``
    tells which dataset has the key.  One shuffle, whatever the number of datasets.
    """
    frames = []
    for name, df in datasets.items():
        own = [c for c in df.columns if c not in keys and c not in shared]
        frames.append(R.assert_unique(df, keys, f"duplicate_key_{name}").withColumnsRenamed({c: f"{name}_{c}" for c in own}).withColumn(f"in_{name}", F.lit(True)))
    out = R.coalescing_union(frames, keys)
    return out.withColumns({f"in_{n}": F.coalesce(f"in_{n}", F.lit(False)) for n in datasets})


def disagreements(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys and column names whose values differ, null-safe, between the rows that both frames have."""
    left = a.select(*keys, F.struct(*columns).alias("__a"))
    both = left.join(b.select(*keys, F.struct(*columns).alias("__b")), list(keys))
    names = F.array_compact(F.array(*[F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in columns]))
    return both.select(*keys, F.explode(names).alias("column"))


def uneven_genes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Variants in both frames whose sets of genes differ, with the genes that only one side has."""
    one = lambda df, n: df.groupBy("variant").agg(F.collect_set("gene").alias(n))
    both = one(a, "__a").join(one(b, "__b"), "variant")
    out = both.select("variant", F.array_sort(F.array_except("__a", "__b")).alias("left_only"), F.array_sort(F.array_except("__b", "__a")).alias("right_only"))
    return out.where("size(left_only) + size(right_only) > 0")


def lift_positions(variants: DataFrame, lift: DataFrame, rsid: str = "rsid") -> DataFrame:
    """Variants on the coordinates of a map (rsid, new_chromosome, new_start, new_ref); where the reference allele differs they go."""
    out = variants.join(lift, rsid).where(F.col("ref") == F.col("new_ref"))
    return out.drop("chromosome", "start", "new_ref").withColumnsRenamed({"new_chromosome": "chromosome", "new_start": "start"})


def source_population(rows: DataFrame, flags: Sequence[str], biobank: str, trait: str, traits: Sequence[str], pip: str, low: float = 0.1, high: float = 0.5) -> DataFrame:
    """Rows of a variant in any other dataset, or in the biobank for an allowed trait with a decided pip."""
    other = F.lit(False)
    for f in flags:
        if f != biobank:
            other = other | F.coalesce(F.col(f), F.lit(False))
    decided = F.coalesce(F.col(trait).isin(list(traits)) & ((F.col(pip) >= high) | (F.col(pip) <= low)), F.lit(False))
    return rows.where(other | (F.coalesce(F.col(biobank), F.lit(False)) & decided))


def cohort_eligible(consequence: Column, biotype: Column, ref: Column, alt: Column, start: Column, end: Column, scores: Sequence[Column]) -> Column:
    """A coding missense or an lncRNA variant of one base, A, C, G or T, that changes it, with finite scores."""
    from ..functions.columns import finite

    missense = F.array_contains(F.split(consequence, ","), "missense_variant") & (biotype == "protein_coding")
    out = (missense | (biotype == "lncRNA")) & ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & (ref != alt) & (end == start + 1)
    for s in scores:
        out = out & finite(s)
    return F.coalesce(out, F.lit(False))


def eqtl_class(rows: DataFrame) -> DataFrame:
    """variant, pip, label, tissues from (variant, tissue, pip, fine_mapped) records.

    Positive needs a fine-mapped pip of 0.5 or more, negative a largest pip of
    0.1 or less; the pip is that of the matching record; others go.
    """
    one = rows.groupBy("variant").agg(F.max("pip").alias("__max"), F.max(F.when(F.col("fine_mapped"), F.col("pip"))).alias("__fine"), F.array_join(F.array_sort(F.collect_set("tissue")), ",").alias("tissues"))
    high = F.coalesce(F.col("__fine") >= 0.5, F.lit(False))
    label = F.when(high, "high_pip").when(F.col("__max") <= 0.1, "low_pip")
    return one.select("variant", F.when(high, F.col("__fine")).otherwise(F.col("__max")).alias("pip"), label.alias("label"), "tissues").where(F.col("label").isNotNull())


#: Stars of review statuses: fixed values; any other status, and none, has 0.
STARS = {
    "practice_guideline": 4, "reviewed_by_expert_panel": 3, "criteria_provided,_multiple_submitters,_no_conflicts": 2,
    "criteria_provided,_conflicting_classifications": 1, "criteria_provided,_single_submitter": 1,
}


def clinvar_stars(review: Column) -> Column:
    """Stars of a review status."""
    from ..functions.columns import replace_or

    return replace_or(review, STARS, 0, "int")


def covered_mean(intervals: DataFrame, track: DataFrame, key: str, span: tuple[str, str], track_span: tuple[str, str], value: str, width: int, ids: Sequence[str]) -> DataFrame:
    """ids, covered (bases), fraction, mean: a track's values over intervals, weighted by covered bases; null where nothing is covered."""
    size = F.col(span[1]) - F.col(span[0])
    met = R.overlapping(intervals, track.where(F.col(value).isNotNull()), key, span, track_span, width)
    one = met.groupBy(*ids).agg(F.sum("overlap").alias("covered"), F.sum(F.col(value) * F.col("overlap")).alias("__s"))
    base = intervals.groupBy(*ids).agg(F.sum(size).alias("__size"))
    covered = F.coalesce("covered", F.lit(0))
    return base.join(one, list(ids), "left").select(*ids, covered.cast("long").alias("covered"), F.try_divide(covered, F.col("__size")).alias("fraction"), F.try_divide("__s", "covered").alias("mean"))


def select_cohorts(rows: DataFrame, shared: str, keys: Sequence[str], cohorts: Mapping[str, Column]) -> DataFrame:
    """One row for each cohort and site (chromosome, start): shared rows first, then by keys; with ``cohort`` and ``site_id``."""
    site = F.concat_ws(":", "chromosome", (F.col("start") + 1).cast("string"))
    tagged = rows.withColumn("cohort", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cohorts.items()])))).withColumn("site_id", site)
    return R.keep_first(tagged, ["cohort", "site_id"], [F.coalesce(F.col(shared), F.lit(False)).desc(), *[R.nulls_last(k) for k in keys]])


def silent_variants(vep: DataFrame, silent: Sequence[str]) -> DataFrame:
    """Variants whose every consequence, in every row, is among ``silent``."""
    return G.select_outside(vep, tuple(silent)).select("variant")


def annotate(variants: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``variants`` with values of a table that has each key once (null where absent); rows and their number stay."""
    return R.validated_join(variants, table.select(*keys, *values), list(keys), "left", "m:1")


def annotation_coverage(rows: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """by, rows, and for each value the rows that know it."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *[F.count(v).alias(v) for v in values])


def collate_shards(shards: Sequence[DataFrame], expected: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """All shards in order, if together they have exactly the keys of ``expected``, each once."""
    out = None
    for s in shards:
        out = s if out is None else out.unionByName(s)
    R.assert_unique(out, [key], "duplicate_across_shards")
    odd = R.key_set_difference(out.select(key), expected.select(key), [key]).orderBy(key).limit(5).collect()
    if odd:
        raise ValueError(f"key_mismatch: {[(r['side'], r[key]) for r in odd]}")
    return out.orderBy(*order)


def check_folds(rows: DataFrame, fold: str, chromosome: str, folds: int = 5) -> DataFrame:
    """``rows``, if all folds are there and each chromosome is in one."""
    seen = sorted(r[0] for r in rows.select(fold).distinct().limit(folds + 2).collect())
    if seen != list(range(folds)):
        raise ValueError(f"wrong_folds: {seen}")
    return R.first_offenders(rows.groupBy(chromosome).agg(F.count_distinct(fold).alias("n")), F.col("n") > 1, [chromosome], "chromosome_in_two_folds") and rows


def check_vectors(rows: DataFrame, vector: str, keys: Sequence[str], size: int) -> DataFrame:
    """``rows``, if every vector has ``size`` finite numbers and every key occurs once."""
    ok = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return R.assert_unique(R.first_offenders(rows, ~F.coalesce(ok, F.lit(False)), list(keys), "broken_vector"), list(keys), "duplicate_vector")


def check_unchanged(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``after``, if it has the rows of ``before``, with multiplicity, in ``columns``."""
    left, right = before.select(*columns), after.select(*columns)
    if not left.exceptAll(right).isEmpty() or not right.exceptAll(left).isEmpty():
        raise ValueError("rows_changed")
    return after


def merge_evaluations(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Saved evaluations as one table; a key in two of them raises."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return R.assert_unique(out, list(keys), "duplicate_evaluation")


def comparison_table(metrics: DataFrame, names: Mapping[str, str], columns: Sequence[str], by: str) -> DataFrame:
    """Models under their shown names, the best first, names as tie-break."""
    from ..functions.columns import replace_strict

    return metrics.withColumn("model", replace_strict(F.col("model"), names)).select("model", *columns).orderBy(F.col(by).desc_nulls_last(), "model")
