"""DNA windows, transcripts and protein requests as plans over tables of sequences.

A reference genome is a table of chunks (contig, chunk, seq), so that a window
meets the few chunks that it touches in an equality join, whatever the genome's
size; no task holds a whole contig.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import genomics as G
from . import relational as R

CHUNK = 1 << 16
#: Bases that an allele may be, in the order of one-hot rows: fixed values.
BASES = ("A", "C", "G", "T")


# DNA


def check_window_policy(width: int, margin: int) -> None:
    if width <= 0 or width % 128:
        raise ValueError(f"invalid_window_length: {width}; a positive multiple of 128 is needed")
    if not 0 <= margin < width / 2:
        raise ValueError(f"invalid_variant_margin: {margin}; from 0 to less than half of the window")


def chunked(contigs: DataFrame, size: int = CHUNK) -> DataFrame:
    """contig, chunk, seq (upper case) of a table (id, sequence)."""
    last = F.floor(F.greatest(F.length("sequence") - 1, F.lit(0)) / size).cast("int")
    out = contigs.select(F.col("id").alias("contig"), F.upper("sequence").alias("__s"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return out.select("contig", "chunk", F.substring("__s", F.col("chunk") * size + 1, F.lit(size)).alias("seq"))


def contig_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("contig").agg(F.sum(F.length("seq")).cast("int").alias("length"))


def fetch(ranges: DataFrame, chunks: DataFrame, keys: Sequence[str], contig: str, start: str, end: str, name: str = "sequence", size: int = CHUNK) -> DataFrame:
    """keys and the bases of [start, end) of each range, N outside its contig; ranges of one key are one."""
    one = ranges.select(*keys, F.col(contig).alias("__contig"), F.col(start).cast("int").alias("__b"), F.col(end).cast("int").alias("__e"))
    touched = F.sequence(F.floor(F.greatest(F.col("__b"), F.lit(0)) / size).cast("int"), F.floor(F.greatest(F.col("__e") - 1, F.col("__b"), F.lit(0)) / size).cast("int"))
    met = one.withColumn("chunk", F.explode(touched)).join(chunks.withColumnRenamed("contig", "__contig"), ["__contig", "chunk"], "left")
    low = F.greatest(F.col("__b") - F.col("chunk") * size, F.lit(0))
    part = F.substring(F.coalesce("seq", F.lit("")), low + 1, F.least(F.col("__e"), (F.col("chunk") + 1) * size) - F.greatest(F.col("__b"), F.col("chunk") * size))
    whole = met.groupBy(*keys, "__b", "__e").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("p")))), lambda x: x["p"]), "").alias("__s"))
    left = F.least(F.greatest(-F.col("__b"), F.lit(0)), F.col("__e") - F.col("__b"))
    return whole.select(*keys, F.rpad(F.concat(F.repeat(F.lit("N"), left), "__s"), F.col("__e") - F.col("__b"), F.lit("N")).alias(name))


def resolve_contigs(candidates: DataFrame, contigs: DataFrame) -> DataFrame:
    """``candidates`` with ``contig`` and ``length``: the first alias that the reference has (itself, with or without chr, then the names of M); else null."""
    c = F.col("chromosome")
    swapped = F.when(F.startswith(c, F.lit("chr")), F.substring(c, F.lit(4), F.length(c))).otherwise(F.concat(F.lit("chr"), c))
    mito = F.array(*[F.lit(x) for x in ("M", "MT", "chrM", "chrMT")])
    names = F.concat(F.array(c, swapped), F.when(F.array_contains(mito, c), mito).otherwise(F.array().cast("array<string>")))
    wanted = candidates.select("chromosome").distinct().select("chromosome", F.posexplode(names).alias("__i", "contig")).join(contigs, "contig")
    best = wanted.groupBy("chromosome").agg(F.min(F.struct("__i", "contig", "length")).alias("__x")).select("chromosome", "__x.contig", "__x.length")
    return candidates.join(F.broadcast(best) if best.limit(100_001).count() <= 100_000 else best, "chromosome", "left")


def dna_problem(observed: Column | None = None) -> Column:
    """The first rule that a candidate with ``contig`` and ``length`` breaks; null if none."""
    base = lambda c: F.col(c).isin(*BASES)
    out = (
        F.when(F.coalesce(F.col("end") != F.col("start") + 1, F.lit(True)), "not_snv_interval")
        .when(~C.single(F.col("ref")) | ~C.single(F.col("alt")), "not_snv_alleles").when(~base("ref") | ~base("alt"), "invalid_allele")
        .when(F.col("ref") == F.col("alt"), "identical_alleles").when(F.col("contig").isNull(), "missing_contig")
        .when((F.col("start") < 0) | (F.col("end") > F.col("length")), "coordinate_out_of_bounds")
    )
    return out if observed is None else out.when(observed != F.col("ref"), "reference_mismatch")


def validate_dna(candidates: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Candidates with ``contig`` and ``length``, or an error that names the rule and the first five offenders."""
    R.assert_unique(candidates, ["variant", "gene"], "duplicate_variant_gene")
    known = resolve_contigs(candidates, contig_lengths(chunks))
    for code in ("not_snv_interval", "not_snv_alleles", "invalid_allele", "identical_alleles", "missing_contig", "coordinate_out_of_bounds"):
        R.first_offenders(known.withColumn("__p", dna_problem()), F.col("__p") == code, ["variant"], code)
    signature = F.struct("contig", "start", "end", "ref", "alt")
    mixed = known.groupBy("variant").agg(F.min(signature).alias("a"), F.max(signature).alias("b"))
    R.first_offenders(mixed, F.col("a") != F.col("b"), ["variant"], "inconsistent_variant")
    seen = fetch(known.select("variant", "contig", "start", "end", "ref").distinct(), chunks, ["variant", "ref"], "contig", "start", "end", "__seen", size)
    R.first_offenders(seen, F.col("__seen") != F.col("ref"), ["variant"], "reference_mismatch")
    return known


def plan_windows(candidates: DataFrame, spans: DataFrame | None, width: int, margin: int) -> DataFrame:
    """Candidates (with ``contig`` and ``length``) with their centered window and, if gene ``spans`` are given, the gene's.

    ``spans``: gene, chromosome, start, end; a gene without a span has the status
    ``missing_gene_span``; without spans every status is ``not_requested``.
    """
    check_window_policy(width, margin)
    w = G.centered_window(F.col("start"), F.col("length"), width)
    out = candidates.withColumns({"window_start": w["window_start"], "target": w["target"], "left_pad": w["left_pad"], "right_pad": w["right_pad"]})
    if spans is None:
        return out.withColumns({"gene_context_status": F.lit("not_requested"), "gene_window_start": F.lit(None).cast("int")})
    known = spans.select("gene", F.col("chromosome").alias("__c"), F.col("start").alias("__b"), F.col("end").alias("__e"))
    out = R.validated_join(out, known, ["gene"], "left", "m:1")
    start, kind = G.gene_window(F.col("start"), F.col("__b"), F.col("__e"), width, margin, F.col("length"), F.col("__c") == F.col("contig"))
    return out.withColumns({"gene_window_start": start, "gene_context_status": kind}).drop("__c", "__b", "__e")


def contexts(plans: DataFrame) -> DataFrame:
    """Distinct (contig, window_start, target, ref, alt) of centered and gene windows, with ``place``: the input index that first asks for it."""
    own = plans.select("input_index", "contig", "window_start", "target", "ref", "alt")
    gene = plans.where("gene_window_start is not null").select("input_index", "contig", F.col("gene_window_start").alias("window_start"), (F.col("start") - F.col("gene_window_start")).alias("target"), "ref", "alt")
    return own.unionByName(gene).groupBy("contig", "window_start", "target", "ref", "alt").agg(F.min("input_index").alias("place"))


def context_sequences(asked: DataFrame, chunks: DataFrame, width: int, size: int = CHUNK) -> DataFrame:
    """Contexts with ``sequence``, padded with N; an error if the base at the target is not ``ref``."""
    keys = ["contig", "window_start", "target", "ref", "alt"]
    out = fetch(asked.withColumns({"__from": F.col("window_start"), "__to": F.col("window_start") + width}), chunks, keys, "contig", "__from", "__to", size=size)
    ok = (F.length("sequence") == width) & (F.substring("sequence", F.col("target") + 1, F.lit(1)) == F.col("ref"))
    return out.withColumn("sequence", F.when(ok, F.col("sequence")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("reference_mismatch:"), "contig", "window_start", "ref"))))


def allele_sequences(sequence: Column, target: Column, alt: Column) -> Column:
    """Array: reference, its reverse complement, alternate, its reverse complement."""
    changed = F.overlay(sequence, alt, target + 1, F.lit(1))
    return F.array(sequence, C.reverse_complement(sequence), changed, C.reverse_complement(changed))


def pool_bounds(target: Column, width: int, pool: int = 128) -> Column:
    """Array of (low, high) for the four allele sequences: the same bases in either direction."""
    low = target - pool // 2
    forward = F.struct(low.alias("low"), (low + pool).alias("high"))
    back = F.struct((F.lit(width) - low - pool).alias("low"), (F.lit(width) - low).alias("high"))
    return F.array(forward, back, forward, back)


def assemble_scores(plans: DataFrame, scores: DataFrame) -> DataFrame:
    """Plans with score_forward, score_reverse, score, and the same of the gene window.

    ``scores``: the key of a context, forward, reverse.  A centered window that
    holds the gene gives both; every asked context has to have a score.
    """
    key = ["contig", "window_start", "target", "ref", "alt"]
    mean = (F.col("forward") + F.col("reverse")) / 2
    own = R.assert_unique(scores, key, "duplicate_score").select(*key, F.col("forward").alias("score_forward"), F.col("reverse").alias("score_reverse"), mean.alias("score"))
    out = plans.join(own, key, "left")
    gene = own.withColumnsRenamed({"window_start": "gene_window_start", "target": "__t", **{c: f"gene_{c}" for c in ("score_forward", "score_reverse", "score")}})
    out = out.withColumn("__t", F.col("start") - F.col("gene_window_start")).join(gene, ["contig", "gene_window_start", "__t", "ref", "alt"], "left").drop("__t")
    missing = F.col("score").isNull() | (F.col("gene_window_start").isNotNull() & F.col("gene_score").isNull())
    return R.first_offenders(out, missing, ["variant", "gene"], "missing_score").orderBy("input_index")


# Transcripts


def transcripts(features: DataFrame, sequences: DataFrame) -> DataFrame:
    """transcript, gene, chromosome, strand, sequence, exons (in transcript order), cds_track, splice_track.

    ``features``: type (transcript, exon, CDS), transcript, gene, chromosome,
    start, end, strand.  Broken annotations raise, by the rule's name.
    """
    one = features.where("type not in ('exon', 'CDS')").groupBy("transcript").agg(F.min(F.struct("gene", "chromosome", "strand")).alias("r"), F.max(F.struct("gene", "chromosome", "strand")).alias("q"))
    R.first_offenders(one, F.col("r") != F.col("q"), ["transcript"], "conflicting_transcript_record")
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))))
    parts = features.groupBy("transcript").agg(pick("exon").alias("e"), pick("CDS").alias("c"), F.bool_or(F.col("type").isin("exon", "CDS")).alias("any"))
    df = one.select("transcript", "r.*").join(parts, "transcript").join(sequences.select(F.col("id").alias("transcript"), "sequence"), "transcript", "left")
    plus = F.col("strand") == "+"
    total = lambda spans: F.aggregate(spans, F.lit(0), lambda a, x: a + x["end"] - x["start"])
    df = df.withColumn("exons", F.when(plus, F.col("e")).otherwise(F.reverse("e")))
    before = F.transform("exons", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.aggregate(F.slice("exons", F.lit(1), i), F.lit(0), lambda a, y: a + y["end"] - y["start"]).alias("offset")))
    df = df.withColumn("__x", before)
    # A coding part lies in an exon; what of it does, in transcript coordinates.
    meet = F.flatten(F.transform("c", lambda c: F.transform(F.filter("__x", lambda e: (c["start"] < e["end"]) & (e["start"] < c["end"])), lambda e: F.struct(
        F.when(plus, e["offset"] + F.greatest(c["start"], e["start"]) - e["start"]).otherwise(e["offset"] + e["end"] - F.least(c["end"], e["end"])).alias("start"),
        F.when(plus, e["offset"] + F.least(c["end"], e["end"]) - e["start"]).otherwise(e["offset"] + e["end"] - F.greatest(c["start"], e["start"])).alias("end"),
    ))))
    df = df.withColumn("__cds", F.array_sort(meet)).withColumn("__length", total("exons"))
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("a"), b["start"].alias("b")))
    problem = (
        F.when(F.size("e") == 0, "missing_exons").when(F.exists(pairs("e"), lambda p: p["a"] > p["b"]), "overlapping_exons")
        .when(F.col("sequence").isNull(), "missing_transcript").when(F.length("sequence") != F.col("__length"), "transcript_length_mismatch")
        .when((total("__cds") != total("c")) | F.exists(pairs("__cds"), lambda p: p["a"] > p["b"]), "cds_outside_or_overlapping_exons")
        .when(F.exists(pairs("__cds"), lambda p: p["a"] != p["b"]), "noncontiguous_spliced_cds")
    )
    df = df.withColumn("__p", problem)
    bad = df.where("__p is not null").select("transcript", "__p").orderBy("transcript").limit(5).collect()
    if bad:
        raise ValueError(f"{bad[0]['__p']}: {[r['transcript'] for r in bad]}")
    low, high = F.element_at("__cds", 1)["start"], F.element_at("__cds", -1)["end"]
    none = F.transform(F.sequence(F.lit(0), F.col("__length") - 1), lambda p: F.lit(0))
    coding = F.when(F.size("__cds") > 0, G.codon_track(F.col("__length"), low, high)).otherwise(none)
    lengths = F.transform("exons", lambda x: x["end"] - x["start"])
    return df.select("transcript", "gene", "chromosome", "strand", "sequence", "exons", coding.alias("cds_track"), G.splice_track(lengths).alias("splice_track"))


def genomic_position(exons: Column, strand: Column, index: Column) -> Column:
    """The genomic place (from 0) of a transcript's base; null beyond its end."""
    walk = F.aggregate(
        exons, F.struct(index.cast("int").alias("left"), F.lit(None).cast("int").alias("at")),
        lambda a, x: F.struct((a["left"] - (x["end"] - x["start"])).alias("left"), F.when(a["at"].isNotNull(), a["at"]).when((a["left"] >= 0) & (a["left"] < x["end"] - x["start"]), F.when(strand == "+", x["start"] + a["left"]).otherwise(x["end"] - 1 - a["left"])).alias("at")),
    )
    return walk["at"]


def six_tracks(sequence: Column, cds: Column, splice: Column, target: Column, prefix_only: bool = True, mask_target: bool = True) -> Column:
    """One row a base: four one-hot bases (none for others, nor at a masked target), coding and splice marks."""
    end = target + 1 if prefix_only else F.length(sequence)
    shown = lambda i: (i != target) if mask_target else F.lit(True)
    row = lambda i: F.array(*[(shown(i) & (F.substring(sequence, i + 1, F.lit(1)) == b)).cast("double") for b in BASES], F.get(cds, i).cast("double"), F.get(splice, i).cast("double"))
    return F.transform(F.sequence(F.lit(0), end - 1), row)


def crop(length: Column, target: Column, most: int = 1024) -> Column:
    """(start, end, at): the longest stretch around a base that fits ``most`` tokens, one for each true end that it holds; then the most balanced, then the first."""
    tries = F.sequence(F.greatest(F.lit(0), target - most + 1), target)

    def window(s):
        cls = (s == 0).cast("int")
        e = F.least(length, s + most - cls)
        e = F.when((e == length) & (e - s + cls + 1 > most), e - 1).otherwise(e)
        return F.struct((-(e - s)).alias("k1"), F.abs((target - s) - (e - 1 - target)).alias("k2"), s.alias("start"), e.alias("end"), (cls + target - s).alias("at"))

    best = F.array_min(F.filter(F.transform(tries, window), lambda x: x["end"] > target))
    return F.struct(best["start"].alias("start"), best["end"].alias("end"), best["at"].alias("at"))


# Proteins


def position_requests(candidates: DataFrame, sequences: DataFrame, width: int, mode: str = "window") -> DataFrame:
    """Distinct (transcript, position, window_start) with the window's ``sequence``: every window of a transcript that holds the position.

    Longer sequences are tiled, or have no request in another ``mode``; positions count from 1.
    """
    own = candidates.select("transcript", "position").distinct().join(sequences.select("transcript", F.col("sequence").alias("__s")), "transcript")
    n = F.length("__s")
    starts = F.when(n <= width, F.array(F.lit(0))).otherwise(G.tile_starts(n, width) if mode == "window" else F.array().cast("array<int>"))
    out = own.withColumn("window_start", F.explode(starts)).where((F.col("window_start") < F.col("position")) & (F.col("position") <= F.col("window_start") + width))
    return out.select("transcript", "position", "window_start", F.substring("__s", F.col("window_start") + 1, F.lit(width)).alias("sequence"), n.alias("length"))


def combine_windows(scored: DataFrame, width: int, values: str = "scores") -> DataFrame:
    """transcript, position and the map ``values`` averaged over windows, by normalised edge weights."""
    w = G.edge_weight(F.col("position") - F.col("window_start") - 1, F.col("window_start"), F.length("sequence"), F.col("length"), width)
    flat = scored.select("transcript", "position", w.alias("__w"), F.explode(values).alias("__k", "__v"))
    one = flat.groupBy("transcript", "position", "__k").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("__v"))
    return one.groupBy("transcript", "position").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(values))


def protein_problem(structure: bool = True) -> Column:
    """The first rule that a candidate with ``sequence`` (and ``tokens``), position, ref breaks; null if none."""
    out = F.when(F.col("sequence").isNull(), "missing_sequence")
    if structure:
        out = out.when(F.col("tokens").isNull(), "missing_structure_tokens").when(F.length("tokens") != F.length("sequence"), "sequence_structure_length_mismatch")
    return out.when((F.col("position") < 1) | (F.col("position") > F.length("sequence")), "position_out_of_range").when(F.substring("sequence", F.col("position"), F.lit(1)) != F.col("ref"), "reference_mismatch")
