"""Readers of the file formats of variant studies; all by Spark, in parallel, without schema inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C


def normalise_header(names: Sequence[str]) -> list[str]:
    """Strip ``#``, lower-case, and call the VEP key ``variant``; duplicates are an error."""
    out = [{"uploaded_variation": "variant"}.get(n := x.strip().lstrip("#").lower(), n) for x in names]
    if len(set(out)) != len(out):
        raise ValueError(f"duplicate_header: {sorted(x for x in set(out) if out.count(x) > 1)}")
    return out


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, null: str = "-", comment: str | None = "##") -> DataFrame:
    """A TSV with a header; all columns strings unless a schema casts them.

    Lines that start with ``comment`` are skipped; the header may itself start
    with ``#``.  Header names are normalised.
    """
    lines = spark.read.text(path)
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    head = lines.first()
    if head is None:
        raise ValueError(f"empty_table: {path}")
    raw = head["value"]
    names = normalise_header(raw.split("\t"))
    parts = F.split(F.col("value"), "\t", -1)
    cells = [F.nullif(F.get(parts, F.lit(i)), F.lit(null)).alias(n) for i, n in enumerate(names)]
    out = lines.where(F.col("value") != raw).select(*cells)
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name not in names]
        if missing:
            raise ValueError(f"missing_columns: {missing}")
        out = out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return out


def read_vep(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path)


def read_score_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A score table whose header must equal ``columns``; an empty cell is null."""
    head = spark.read.text(path).first()
    if head is None or head["value"].split("\t") != list(columns):
        raise ValueError(f"unexpected_header: {head and head['value']}")
    return read_tsv(spark, path, null="", comment=None)


def read_bed(spark: SparkSession, path: str, names: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """A headerless table whose names come from elsewhere; named columns get types."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, sep="\t", schema=schema, header=False)
    return df.select(*[F.col(n).cast((types or {}).get(n, "string")).alias(n) for n in names])


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """The eight fixed VCF columns, start and end zero-based half-open, and INFO as a map."""
    parts = F.split(F.col("value"), "\t")
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]
    df = spark.read.text(path).where(~F.col("value").startswith("#")).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return df.withColumn("start", F.col("pos").cast("int") - 1).withColumn("end", F.col("pos").cast("int")).withColumn("info", C.info_map("info"))


def read_fasta(spark: SparkSession, path: str, field: int = 0, rna: bool = False) -> DataFrame:
    """id, sequence of every record; ``field`` picks the part of the name between bars."""
    text = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    name = F.get(F.split(F.regexp_extract("value", r"^([^\r\n]*)", 1), r"\|"), F.lit(field))
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", ""))
    return text.select(F.split_part(F.trim(name), F.lit(" "), F.lit(1)).alias("id"), (F.translate(body, "U", "T") if rna else body).alias("sequence"))


def read_gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """gene, chromosome, start, end, strand; zero-based; ValueError if a gene has two spans."""
    parts = F.split("value", "\t")
    df = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.get(parts, F.lit(2)) == "gene")
    df = df.select(
        C.without_version(C.extract(F.get(parts, F.lit(8)), 'gene_id "([^"]+)"')).alias("gene"), F.get(parts, F.lit(0)).alias("chromosome"),
        (F.get(parts, F.lit(3)).cast("int") - 1).alias("start"), F.get(parts, F.lit(4)).cast("int").alias("end"), F.get(parts, F.lit(6)).alias("strand"),
    ).distinct()
    bad = df.groupBy("gene").count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"conflicting_gene_span: {[r['gene'] for r in bad]}")
    return df


def read_tissues(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """A folder of Parquet files, one a tissue; ``tissue`` is the file name up to its first dot."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.parquet(folder).select(*columns, F.split_part(name, F.lit("."), F.lit(1)).alias("tissue"))


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    """Selected variants; missing columns are named in the error."""
    from ..operators.curation import SELECTED, require

    df = require(read_tsv(spark, path), SELECTED)
    return df.withColumns({"start": F.col("start").try_cast("int"), "end": F.col("end").try_cast("int"), "pip": F.col("pip").try_cast("double")})


def read_vep_extra(spark: SparkSession, path: str, key: str = "extra") -> DataFrame:
    """A VEP table whose ``Extra`` column becomes one column a key; rows are never gathered."""
    return C.info_columns(read_vep(spark, path), key)


def read_names(spark: SparkSession, path: str, limit: int = 10_000) -> list[str]:
    """Lines of a short list, without blanks and empty ones; more than ``limit`` raise."""
    rows = [r[0].strip() for r in spark.read.text(path).limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"too_many_lines: over {limit}")
    return [r for r in rows if r]


def read_bed_with_names(spark: SparkSession, path: str, names_path: str, types: dict[str, str] | None = None) -> DataFrame:
    """A headerless BED whose column names, one a line or split by tabs, are in another file."""
    names = [n for line in read_names(spark, names_path) for n in line.split("\t")]
    return read_bed(spark, path, names, types)


def read_rsid_map(spark: SparkSession, path: str) -> DataFrame:
    """rsid, new_chromosome, new_start, new_end, new_ref: the first five columns of a headerless table."""
    parts = F.split("value", "\t")
    cell = lambda i: F.get(parts, F.lit(i))
    return spark.read.text(path).select(cell(0).alias("new_chromosome"), cell(1).cast("int").alias("new_start"), cell(2).cast("int").alias("new_end"), cell(3).alias("rsid"), cell(4).alias("new_ref"))


def read_columns(spark: SparkSession, path: str, names: dict[str, str], negate: Sequence[str] = (), null: str = "") -> DataFrame:
    """Some columns of a TSV (or of Parquet, by suffix) under new names; ``negate`` turns the sign of numbers."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_tsv(spark, path, null=null)
    from ..operators.curation import require

    require(df, list(names))
    return df.select(*[(-F.col(old).cast("double") if new in negate else F.col(old)).alias(new) for old, new in names.items()])


def read_intervals(spark: SparkSession, path: str, value: str, chromosome: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """chromosome, start, end and a number of an interval track."""
    df = read_tsv(spark, path, null="")
    return df.select(F.col(chromosome).alias("chromosome"), F.col(start).cast("int").alias("start"), F.col(end).cast("int").alias("end"), F.col(value).cast("double").alias(value))


def read_info_values(spark: SparkSession, path: str, keys: Sequence[str], positions: DataFrame | None = None) -> DataFrame:
    """chrom, start, ref, alt and numbers of INFO; with ``positions`` (chrom, start) only their rows, by a semi join."""
    df = read_vcf(spark, path).select("chrom", "start", "ref", "alt", *[F.try_element_at("info", F.lit(k)).try_cast("double").alias(k.lower()) for k in keys])
    return df if positions is None else df.join(positions.select("chrom", "start").distinct(), ["chrom", "start"], "left_semi")


def read_required_fasta(spark: SparkSession, path: str, required: DataFrame, rna: bool = True, versions: bool = False) -> DataFrame:
    """id, sequence of the ids of ``required``; equal copies are one, different ones and missing ids raise."""
    own = read_fasta(spark, path, rna=rna)
    own = own if versions else own.withColumn("id", C.without_version("id"))
    found = own.join(required.select("id").distinct(), "id", "left_semi").distinct().persist()
    bad = [r[0] for r in found.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()]
    if bad:
        raise ValueError(f"conflicting_sequence: {bad}")
    missing = [r[0] for r in required.select("id").distinct().join(found, "id", "left_anti").orderBy("id").limit(5).collect()]
    if missing:
        raise ValueError(f"missing_sequence: {missing}")
    return found


def read_protein_fasta(spark: SparkSession, path: str) -> DataFrame:
    """transcript (the first part of the name that starts with ENST, without version), sequence; any duplicate raises."""
    from ..operators.relational import assert_unique

    text = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split(F.regexp_extract("value", r"^([^\r\n]*)", 1), r"\|")
    name = F.get(F.filter(parts, lambda x: F.startswith(x, F.lit("ENST"))), F.lit(0))
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", ""))
    return assert_unique(text.select(C.without_version(F.trim(name)).alias("transcript"), body.alias("sequence")).where("transcript is not null"), ["transcript"], "duplicate_transcript")


def read_dna_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates with ``input_index``: typed coordinates, upper-case alleles, genes without version; broken rows are named."""
    from ..operators.relational import first_offenders

    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("__i"))
    head = lines.orderBy("__i").first()
    if head is None:
        raise ValueError(f"missing_header: {path}")
    names, parts = normalise_header(head["value"].split("\t")), F.split("value", "\t", -1)
    required = ["variant", "chromosome", "start", "end", "ref", "alt"]
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"missing_columns: {', '.join(missing)}")
    cell = lambda n: F.nullif(F.get(parts, F.lit(names.index(n))), F.lit("-")) if n in names else F.lit(None).cast("string")
    df = lines.where(F.col("__i") != head["__i"]).select("__i", *[F.nullif(cell(n), F.lit("")).alias(n) for n in [*required, "gene", "feature"]])
    empty = F.lit(False)
    for n in required[:-1]:
        empty = empty | F.col(n).isNull()
    first_offenders(df, empty, ["variant"], "missing_value")
    whole = lambda n: F.col(n).rlike(r"^\s*[+-]?\d+\s*$")
    first_offenders(df, ~whole("start") | ~whole("end"), ["variant"], "invalid_coordinate")
    known = df.select(
        "variant", F.coalesce(C.without_version("gene"), F.lit("")).alias("gene"), F.coalesce("feature", F.lit("")).alias("feature"), "chromosome", F.trim("start").cast("int").alias("start"),
        F.trim("end").cast("int").alias("end"), F.upper("ref").alias("ref"), F.coalesce(F.upper("alt"), F.lit("")).alias("alt"), "__i",
    )
    from ..operators.relational import rank_globally

    return rank_globally(known, [F.col("__i")]).withColumnRenamed("__rank", "input_index").drop("__i")


def read_gff3(spark: SparkSession, path: str, coding: bool = True) -> DataFrame:
    """type, transcript, gene, chromosome, start, end, strand of transcripts, exons and, if ``coding``, coding parts.

    Record types are filtered before coordinates are read, so a broken record of another type does no harm.
    """
    from ..operators.relational import first_offenders

    parts = F.split("value", "\t")
    cell = lambda i: F.get(parts, F.lit(i))
    kinds = ["transcript", "mRNA", "lnc_RNA", "exon", *["CDS"] * coding]
    raw = spark.read.text(path).where(~F.col("value").startswith("#")).select(cell(2).alias("type"), cell(0).alias("chromosome"), cell(3).alias("a"), cell(4).alias("b"), cell(6).alias("strand"), cell(8).alias("info")).where(F.col("type").isin(kinds))
    first_offenders(raw, ~F.coalesce(F.col("a").rlike(r"^\d+$") & F.col("b").rlike(r"^\d+$"), F.lit(False)), ["chromosome", "type"], "invalid_gff3_coordinate")
    tag = lambda k: C.extract("info", f"(?:^|;){k}=([^;]*)")
    name = F.coalesce(tag("transcript_id"), F.regexp_replace(F.when(F.col("type").isin("exon", "CDS"), tag("Parent")).otherwise(tag("ID")), "^(transcript|rna):", ""))
    return raw.select("type", C.without_version(name).alias("transcript"), C.without_version(F.coalesce(tag("gene_id"), F.regexp_replace(tag("Parent"), "^gene:", ""))).alias("gene"), "chromosome", (F.col("a").cast("int") - 1).alias("start"), F.col("b").cast("int").alias("end"), "strand")


def read_protein_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Coding missense rows of an annotation table with ``ref`` and ``alt`` from REF/ALT amino acids and a numeric position."""
    df = read_tsv(spark, path)
    aa = F.split("amino_acids", "/")
    return df.where((F.col("biotype") == "protein_coding") & F.array_contains(F.split("consequence", ","), "missense_variant")).select(
        "variant", C.without_version("feature").alias("transcript"), F.col("protein_position").try_cast("int").alias("position"), F.get(aa, F.lit(0)).alias("ref_aa"), F.get(aa, F.lit(1)).alias("alt_aa"),
    )


def with_rejections(df: DataFrame, reasons: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """Rows that no rule rejects, and the rows that each reason rejects; the first reason that fits a row counts."""
    reason = F.lit(None).cast("string")
    for code, bad in reversed(reasons.items()):
        reason = F.when(bad, code).otherwise(reason)
    marked = df.withColumn("__reason", reason)
    return marked.where("__reason is null").drop("__reason"), marked.where("__reason is not null").groupBy(F.col("__reason").alias("reason")).agg(F.count("*").alias("n"))


def read_log_values(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of every ``key=value`` in a folder of logs."""
    text = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    return text.select("file", F.explode(C.find_pairs(F.col("value"), r"([A-Za-z_]\w*)=(\S+)")).alias("x")).select("file", F.col("x.k").alias("key"), F.col("x.v").alias("value"))


def elapsed_seconds(c):
    """h:m:s or m:s as seconds."""
    p = F.split(c, ":")
    return F.aggregate(p, F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))
