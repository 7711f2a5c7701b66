"""Windows over a chunked reference, transcripts and protein requests, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import sequences as Q


@pytest.fixture(scope="module")
def genome():
    dice = random.Random(1)
    return {"chr1": "".join(dice.choice("ACGT") for _ in range(700)), "MT": "".join(dice.choice("ACGT") for _ in range(300))}


@pytest.fixture(scope="module")
def chunks(spark, genome):
    return Q.chunked(spark.createDataFrame(list(genome.items()), "id string, sequence string"), 64).cache()


def test_fetch_pads_and_crosses_chunks(spark, genome, chunks):
    ranges = [("chr1", -20, 30), ("chr1", 60, 200), ("chr1", 690, 720), ("MT", 0, 300), ("MT", 63, 64), ("chr1", -40, -10), ("MT", 310, 330)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i int, c string, s int, e int")
    got = {r["i"]: r["sequence"] for r in Q.fetch(df, chunks, ["i"], "c", "s", "e", size=64).collect()}
    assert got == {i: "".join(genome[c][p] if 0 <= p < len(genome[c]) else "N" for p in range(s, e)) for i, (c, s, e) in enumerate(ranges)}


def candidates(spark, genome, rows):
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    out = []
    for i, (v, g, c, p) in enumerate(rows):
        ref = genome[{"M": "MT", "1": "chr1"}.get(c, c)][p]
        out.append((v, g, c, p, p + 1, ref, other[ref], i))
    return spark.createDataFrame(out, "variant string, gene string, chromosome string, start int, end int, ref string, alt string, input_index int")


def test_dna_plan_to_rows(spark, genome, chunks):
    df = candidates(spark, genome, [("a", "g1", "1", 300), ("a", "g2", "1", 300), ("b", "g3", "M", 10), ("c", "g4", "chr1", 500)])
    known = Q.validate_dna(df, chunks, 64)
    assert {(r["variant"], r["contig"]) for r in known.collect()} == {("a", "chr1"), ("b", "MT"), ("c", "chr1")}
    spans = spark.createDataFrame([("g1", "chr1", 290, 330), ("g2", "chr1", 310, 400), ("g4", "chr1", 300, 560)], "gene string, chromosome string, start int, end int")
    plans = Q.plan_windows(known, spans, 128, 8)
    got = {(r["variant"], r["gene"]): (r["window_start"], r["left_pad"], r["gene_context_status"], r["gene_window_start"]) for r in plans.collect()}
    assert got == {("a", "g1"): (236, 0, "centered_full_gene", 236), ("a", "g2"): (236, 0, "shifted_full_gene", 272), ("b", "g3"): (-54, 54, "missing_gene_span", None), ("c", "g4"): (436, 0, "gene_too_long", None)}
    asked = Q.contexts(plans)
    assert sorted((r["window_start"], r["target"], r["place"]) for r in asked.collect()) == [(-54, 64, 2), (236, 64, 0), (272, 28, 1), (436, 64, 3)]
    seqs = Q.context_sequences(asked, chunks, 128, 64)
    rows = {r["window_start"]: r["sequence"] for r in seqs.collect()}
    assert rows[236] == genome["chr1"][236:364] and rows[-54] == "N" * 54 + genome["MT"][:74]
    four = seqs.where("window_start = 236").select(Q.allele_sequences(F.col("sequence"), F.col("target"), F.col("alt")).alias("x"), "alt").first()
    back = str.maketrans("ACGT", "TGCA")
    assert four["x"][1] == rows[236].translate(back)[::-1] and four["x"][2] == rows[236][:64] + four["alt"] + rows[236][65:] and four["x"][3] == four["x"][2].translate(back)[::-1]
    assert [tuple(x) for x in spark.range(1).select(Q.pool_bounds(F.lit(200), 512)).first()[0]] == [(136, 264), (248, 376)] * 2
    scores = asked.select("contig", "window_start", "target", "ref", "alt", F.col("window_start").cast("double").alias("forward"), F.lit(2.0).alias("reverse"))
    out = {(r["variant"], r["gene"]): (r["score"], r["gene_score"]) for r in Q.assemble_scores(plans, scores).collect()}
    assert out == {("a", "g1"): (119.0, 119.0), ("a", "g2"): (119.0, 137.0), ("b", "g3"): (-26.0, None), ("c", "g4"): (219.0, None)}
    with pytest.raises(ValueError, match="missing_score"):
        Q.assemble_scores(plans, scores.where("window_start <> 272"))


@pytest.mark.parametrize("change,code", [
    ({"end": "start + 2"}, "not_snv_interval"), ({"alt": "'AC'"}, "not_snv_alleles"), ({"alt": "'N'"}, "invalid_allele"), ({"alt": "ref"}, "identical_alleles"),
    ({"chromosome": "'7'"}, "missing_contig"), ({"start": "700", "end": "701"}, "coordinate_out_of_bounds"), ({"start": "start + 1", "end": "end + 1"}, "reference_mismatch"),
])
def test_dna_rules(spark, genome, chunks, change, code):
    p = next(i for i in range(100, 200) if genome["chr1"][i] != genome["chr1"][i + 1])
    with pytest.raises(ValueError, match=f"{code}: 1"):
        Q.validate_dna(candidates(spark, genome, [("a", "g", "1", p)]).withColumns({k: F.expr(v) for k, v in change.items()}), chunks, 64)


def test_window_policy():
    for width, margin in ((0, 1), (100, 1), (128, 64), (128, -1)):
        with pytest.raises(ValueError, match="invalid_"):
            Q.check_window_policy(width, margin)
    Q.check_window_policy(256, 127)


FEATURES = "type string, transcript string, gene string, chromosome string, start int, end int, strand string"


def test_transcripts(spark):
    rows = []
    for name, strand in (("P", "+"), ("M", "-")):
        rows += [("mRNA", name, "g", "chr1", 10, 40, strand), ("exon", name, "g", "chr1", 10, 16, strand), ("exon", name, "g", "chr1", 20, 25, strand), ("exon", name, "g", "chr1", 30, 40, strand)]
        rows += [("CDS", name, "g", "chr1", 13, 16, strand), ("CDS", name, "g", "chr1", 20, 25, strand), ("CDS", name, "g", "chr1", 30, 31, strand)]
    seqs = spark.createDataFrame([("P", "ACGTACGTACGTACGTACGTA"), ("M", "TTTTTTTTTTTTTTTTTTTTT")], "id string, sequence string")
    df = Q.transcripts(spark.createDataFrame(rows, FEATURES), seqs)
    got = {r["transcript"]: r for r in df.collect()}
    ones = lambda t: [i for i, x in enumerate(t) if x]
    assert ones(got["P"]["splice_track"]) == [5, 10, 20] and ones(got["P"]["cds_track"]) == [3, 6, 9]
    assert ones(got["M"]["splice_track"]) == [9, 14, 20] and ones(got["M"]["cds_track"]) == [9, 12, 15]
    at = lambda n, i: df.where(F.col("transcript") == n).select(Q.genomic_position(F.col("exons"), F.col("strand"), F.lit(i))).first()[0]
    assert [at("P", i) for i in (0, 5, 6, 20, 21)] == [10, 15, 20, 39, None] and [at("M", i) for i in (0, 9, 10, 20)] == [39, 30, 24, 10]
    tracks = df.where("transcript = 'P'").select(Q.six_tracks(F.col("sequence"), F.col("cds_track"), F.col("splice_track"), F.lit(6))).first()[0]
    assert len(tracks) == 7 and tracks[0] == [1, 0, 0, 0, 0, 0] and tracks[3] == [0, 0, 0, 1, 1, 0] and tracks[5] == [0, 1, 0, 0, 0, 1] and tracks[6] == [0, 0, 0, 0, 1, 0]


@pytest.mark.parametrize("rows,code", [
    ([("mRNA", 0, 9)], "missing_exons"), ([("mRNA", 0, 9), ("exon", 0, 5), ("exon", 4, 9)], "overlapping_exons"), ([("mRNA", 0, 9), ("exon", 0, 5)], "transcript_length_mismatch"),
    ([("mRNA", 0, 9), ("exon", 0, 9), ("CDS", 5, 12)], "cds_outside_or_overlapping_exons"), ([("mRNA", 0, 9), ("exon", 0, 9), ("CDS", 0, 3), ("CDS", 5, 8)], "noncontiguous_spliced_cds"),
])
def test_transcript_rules(spark, rows, code):
    df = spark.createDataFrame([(k, "T", "g", "chr1", a, b, "+") for k, a, b in rows], FEATURES)
    with pytest.raises(ValueError, match=code):
        Q.transcripts(df, spark.createDataFrame([("T", "ACGTACGTA")], "id string, sequence string"))


@pytest.mark.parametrize("length,target", [(5, 0), (14, 13), (15, 3), (16, 8), (40, 0), (40, 20), (40, 39), (17, 2)])
def test_crop(spark, length, target, most=16):
    best = None
    for s in range(max(0, target - most + 1), target + 1):
        e = min(length, s + most - (s == 0))
        if e == length and e - s + (s == 0) + 1 > most:
            e -= 1
        if e > target:
            key = (s - e, abs((target - s) - (e - 1 - target)), s)
            best = min([x for x in (best, (key, (s, e, (s == 0) + target - s))) if x])
    assert tuple(spark.range(1).select(Q.crop(F.lit(length), F.lit(target), most).alias("x")).first()["x"]) == best[1]


def test_position_requests_and_their_mean(spark):
    seqs = spark.createDataFrame([("s", "MKLVW"), ("l", "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2)], "transcript string, sequence string")
    cand = spark.createDataFrame([("s", 3), ("s", 3), ("l", 1), ("l", 20), ("s", 9)], "transcript string, position int")
    got = Q.position_requests(cand, seqs, 16)
    rows = [(r["transcript"], r["position"], r["window_start"], r["sequence"]) for r in got.collect()]
    assert ("s", 3, 0, "MKLVW") in rows and ("l", 1, 0, "ABCDEFGHIJKLMNOP") in rows and len(rows) == len(set(rows))
    assert all(p in range(s + 1, s + 17) for t, p, s, _ in rows if t == "l") and sum(t == "l" and p == 20 for t, p, _, _ in rows) >= 2
    assert {r["transcript"] for r in Q.position_requests(cand, seqs, 16, "skip").collect()} == {"s"}
    scored = got.withColumn("scores", F.create_map(F.lit("A"), F.lit(0.5), F.lit("C"), F.lit(-2.0)))
    for r in Q.combine_windows(scored, 16).collect():
        assert abs(r["scores"]["A"] - 0.5) < 1e-12 and abs(r["scores"]["C"] + 2.0) < 1e-12


def test_protein_rules(spark):
    rows = [(None, "x", 1, "M", "missing_sequence"), ("MK", None, 1, "M", "missing_structure_tokens"), ("MK", "a", 1, "M", "sequence_structure_length_mismatch"), ("MK", "ab", 3, "M", "position_out_of_range"), ("MK", "ab", 2, "M", "reference_mismatch"), ("MK", "ab", 2, "K", None)]
    df = spark.createDataFrame(rows, "sequence string, tokens string, position int, ref string, want string")
    assert all(r[0] == r[1] for r in df.select(Q.protein_problem(), "want").collect())
