"""Fixtures of the domain operators: values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.operators import curation as U
from helixframe.operators import genomics as G
from helixframe.operators import relational as R
from helixframe.operators import statistics as S
from helixframe.sources import files, sinks


@pytest.mark.parametrize("length,starts", [(2, [0]), (6, [0]), (7, [0, 1]), (10, [0, 2, 4]), (13, [0, 3, 4, 7]), (15, [0, 3, 6, 9])])
def test_tiling(spark, length, starts):
    """Width 6: tiles overlap by three or more, from both ends; a middle one where the two sides would not."""
    assert spark.range(1).select(G.tile_starts(F.lit(length), 6)).first()[0] == starts


def test_outside_transcripts(spark):
    rows = [
        ("p1", "intergenic_variant", 0.25, None), ("p2", "downstream_gene_variant", None, 0.5), ("p2", "downstream_gene_variant,upstream_gene_variant", 0.125, None),
        ("p3", "intergenic_variant", None, None), ("p3", "stop_gained", None, None), ("p4", None, None, None), ("p5", "upstream_gene_variant,3_prime_UTR_variant", None, None),
    ]
    vep = spark.createDataFrame(rows, "variant string, consequence string, max_af double, gnomade_af double")
    got = {r["variant"]: (r["gene"], r["consequence"], r["max_af"], r["gnomade_af"]) for r in G.select_outside(vep).collect()}
    assert got == {"p1": (None, "intergenic_variant", 0.25, None), "p2": (None, "downstream_gene_variant,upstream_gene_variant", 0.125, 0.5)}


def test_select_transcripts_prefers_mane_then_canonical_then_numeric_support(spark):
    rows = [("v", "g", "T1", "missense_variant", "protein_coding", None, "YES", "10"), ("v", "g", "T2", "missense_variant", "protein_coding", None, "YES", "2"), ("w", "g", "T3", "missense_variant", "protein_coding", "NM", None, None), ("w", "g", "T1", "missense_variant", "protein_coding", None, "YES", "1"), ("x", "g", "T1", "stop_gained,missense_variant", "protein_coding", None, None, None)]
    vep = spark.createDataFrame(rows, "variant string, gene string, feature string, consequence string, biotype string, mane string, canonical string, tsl string")
    got = {(r["variant"], r["feature"]) for r in G.select_transcripts(vep, ["stop_gained"]).collect()}
    assert got == {("v", "T2"), ("w", "T3")}


def test_downsample(spark):
    rows = [("p", "pathogenic", "lncRNA"), ("p", "benign", "lncRNA"), ("q", "benign", "lncRNA"), ("r", "benign", "protein_coding"), ("u", None, "lncRNA"), ("p", None, "lncRNA")]
    df = spark.createDataFrame(rows, "variant string, label string, biotype string")
    key = lambda d: sorted(map(tuple, d.select("variant", "label").collect()), key=repr)
    # Transcribed: only positive rows and chosen negatives; rows without a label go.
    assert key(G.downsample(df, ["benign"], 0.0, 1)) == [("p", "pathogenic")]
    assert key(G.downsample(df, ["benign"], 1.0, 1)) == [("p", "benign"), ("p", "pathogenic"), ("q", "benign"), ("r", "benign")]
    # Outside transcripts: every row of a variant that is positive or chosen stays.
    assert key(G.downsample(df, ["benign"], 0.0, 1, True)) == sorted([("p", "benign"), ("p", None), ("p", "pathogenic")], key=repr)
    many = spark.range(100).selectExpr("concat('v', id) variant", "'benign' label", "if(id < 40, 'lncRNA', 'protein_coding') biotype")
    got = {r[0]: r[1] for r in G.downsample(many, ["benign"], 0.25, 4).groupBy("biotype").count().collect()}
    assert got == {"lncRNA": 10, "protein_coding": 15} and G.downsample(many, ["benign"], 0.25, 4, True).count() == 25


def test_gene_window(spark):
    one = spark.range(1)
    ask = lambda *a: tuple(one.select(*G.gene_window(*[F.lit(x).cast("int") for x in a[:3]], 128, 8, F.lit(a[3]))).first())
    assert ask(10, 70, 100, 1000) == (0, "shifted_full_gene")  # the centered window ends at 74; 0 is the first that may be
    assert ask(500, 480, 540, 1000) == (436, "centered_full_gene")
    assert ask(20, 10, 60, 1000) == (-44, "centered_full_gene")  # it may leave the contig
    assert ask(995, 900, 930, 1000) == (None, "gene_too_long")  # no window inside the contig keeps the margin
    assert ask(500, 300, 560, 1000) == (None, "gene_too_long") and ask(500, None, None, 1000) == (None, "missing_gene_span")
    assert ask(500, 400, 520, 1000) == (400, "shifted_full_gene")
    with pytest.raises(Exception, match="gene_contig_mismatch"):
        one.select(*G.gene_window(F.lit(5), F.lit(1), F.lit(9), 128, 8, F.lit(100), F.lit(False))).collect()


def test_edge_weight(spark):
    import math

    one = spark.range(1)
    ask = lambda o, s, size=32, n=100: one.select(G.edge_weight(F.lit(o), F.lit(s), F.lit(size), F.lit(n), 32)).first()[0]
    scale = 640 / 1022
    assert ask(16, 10) == ask(0, 0) == ask(8, 10) == ask(23, 10) == ask(31, 68) == ask(0, 5, 20) == 1.0
    assert abs(ask(0, 10) - 1 / (1 + math.exp(4 / scale))) < 1e-12 and abs(ask(4, 10) - 0.5) < 1e-12
    assert abs(ask(31, 10) - 1 / (1 + math.exp(3 / scale))) < 1e-12 and abs(ask(28, 10) - 0.5) < 1e-12


def test_curate(spark):
    schema = "variant string, chromosome string, start int, end int, ref string, alt string, pip double, label string, target_gene string"
    rows = [("b", "chr10", 5, 6, "A", "C", 0.9, "high_pip", "G1"), ("a", "chr2", 7, 8, "A", "C", 0.9, "high_pip", "G1"), ("a", "chr2", 7, 8, "A", "C", 0.05, "low_pip", "G2"), ("c", "chr2", 1, 2, "A", "C", None, "high_pip", "G3")]
    selected = spark.createDataFrame(rows, schema)
    vep_schema = "variant string, gene string, feature string, consequence string, biotype string, mane string, canonical string, tsl string"
    note = lambda v, g, c: (v, g, f"T{v}{g}", c, "protein_coding", None, "YES", "1")
    vep = spark.createDataFrame([note("a", "G1", "missense_variant"), note("a", "G2", "missense_variant"), note("b", "G2", "missense_variant"), note("c", "G3", "intron_variant,missense_variant")], vep_schema)
    full, sampled = U.curate(selected, vep, has_target_genes=True, fraction=0.0)
    assert [(r["variant"], r["gene"]) for r in full.collect()] == [("a", "G1"), ("a", "G2")] and [r["gene"] for r in sampled.collect()] == ["G1"]
    out = spark.createDataFrame([note("a", "G1", "intergenic_variant"), note("b", "G1", "upstream_gene_variant")], vep_schema)
    full, _ = U.curate(selected, out, "outside-transcripts", has_target_genes=True)
    assert [(r["variant"], r["pip"], r["gene"]) for r in full.collect()] == [("a", 0.9, None), ("b", 0.9, None)]  # chr2 before chr10
    with pytest.raises(ValueError, match="missing_columns"):
        U.curate(selected.drop("pip"), vep)
    assert tuple(U.stage_report(selected).first()) == (4, 3)


def test_collate_and_checks(spark):
    a = spark.createDataFrame([("v1", "g", 1, None), ("v2", "g", 2, "x")], "variant string, gene string, pip int, note string")
    b = spark.createDataFrame([("v1", "g", 5, "y")], "variant string, gene string, pip int, note string")
    got = {r["variant"]: (r["note"], r["a_pip"], r["b_pip"], r["in_a"], r["in_b"]) for r in U.collate({"a": a, "b": b}, ["variant", "gene"], ["note"]).collect()}
    assert got == {"v1": ("y", 1, 5, True, True), "v2": ("x", 2, None, True, False)}
    with pytest.raises(ValueError, match="duplicate_key_a"):
        U.collate({"a": a.unionAll(a), "b": b}, ["variant", "gene"], ["note"])
    with pytest.raises(ValueError, match=r"bad_pip: 1: \[\('v2',\)\]"):
        R.first_offenders(a, F.col("pip") > 1, ["variant"], "bad_pip")
    with pytest.raises(ValueError, match="incomplete_shards: \\[1\\]"):
        R.check_shards(a.withColumn("shard", F.lit(0)), "shard", "variant", 2)
    with pytest.raises(ValueError, match="length_mismatch"):
        R.hstack(a.select("variant"), b.select("pip"), [F.col("variant")], [F.col("pip")])


def test_windows_and_tracks(spark):
    one = spark.range(1)
    w = G.centered_window(F.lit(5), F.lit(200), 128)
    assert tuple(one.select(w["window_start"], w["left_pad"], w["target"]).first()) == (-59, 59, 64)
    assert one.select(G.extract_window(F.lit("ACGT"), F.lit(-2), 8)).first()[0] == "NNACGTNN"
    assert one.select(G.splice_track(F.array(F.lit(4), F.lit(3)))).first()[0] == [0, 0, 0, 1, 0, 0, 1]
    assert one.select(G.codon_track(F.lit(7), F.lit(2), F.lit(7))).first()[0] == [0, 0, 1, 0, 0, 1, 0]
    assert one.select(C.reverse_complement(F.lit("ATCGN"))).first()[0] == "NCGAT"


def test_merge_intervals(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 3, 10), ("c", 12, 13), ("d", 1, 2)], "k string, s int, e int")
    assert sorted(map(tuple, R.merge_intervals(df, "k", "s", "e").collect())) == [("c", 0, 10), ("c", 12, 13), ("d", 1, 2)]


def test_validated_join_names_the_rule(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    assert R.validated_join(left, left.distinct(), ["k"], validate="m:1").count() == 2
    with pytest.raises(ValueError, match="duplicate_right_key: 1"):
        R.validated_join(left, left, ["k"], validate="m:1")


def test_asof_is_the_same_for_any_partitioning(spark):
    left = spark.createDataFrame([(i, i % 3, i) for i in range(60)], "id int, k int, at int")
    right = spark.createDataFrame([(i % 3, i, i * 10) for i in range(0, 60, 7)], "k int, p int, v int")
    want = sorted(map(tuple, R.asof_backward(left, right, "k", "at", "p", ["v"]).collect()), key=repr)
    assert want == sorted(map(tuple, R.asof_backward(left.repartition(7), right.repartition(5), "k", "at", "p", ["v"]).collect()), key=repr)
    assert {r[0]: r[4] for r in want}[21] == 210


def test_folds_and_quotas():
    folds = S.chromosome_folds([(f"chr{i}", 40, 40) for i in range(1, 23)])
    assert set(folds.values()) == set(range(5))
    q = S.largest_remainder({"1": 60, "2": 30, "3": 10}, 17)
    assert sum(q.values()) == 17 and all(abs(q[k] - 17 * v / 100) < 1 for k, v in {"1": 60, "2": 30, "3": 10}.items())


def test_folds_weigh_cohorts_equally():
    # Shares: chr1 (0.6, 0.1), chr2 (0.3, 0.1), chr3 (0.1, 0.8); chr2 adds 0.32 to fold 0 and 0.48 to fold 1.
    counts = [("chr1", 600, 1), ("chr2", 300, 1), ("chr3", 100, 8)]
    assert S.chromosome_folds(counts, 2) == {"chr3": 0, "chr1": 1, "chr2": 0}


def test_sample_tail(spark):
    import numpy as np

    rows = [(f"chr{c}", f"s{c}{i:02d}") for c, n in ((1, 20), (2, 10), (3, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "chromosome string, site string").repartition(3)
    rng, want = np.random.default_rng(5), []
    for c, n, k in ((1, 20, 6), (2, 10, 3), (3, 5, 1)):
        want += [f"s{c}{i:02d}" for i in rng.choice(n, size=k, replace=False)]
    assert [r["site"] for r in S.sample_tail(df, "chromosome", "site", 10, 5).collect()] == sorted(want)
    assert [r["site"] for r in S.sample_tail(df, "chromosome", "site", 35, 5).collect()] == sorted(s for _, s in rows)


def test_files(spark, tmp_path):
    (tmp_path / "vep.txt").write_text("## note\n#Uploaded_variation\tGene\tCDNA_position\nv1\t-\t3\nv2\tg\t-\n")
    assert sorted(map(tuple, files.read_vep(spark, str(tmp_path / "vep.txt")).collect())) == [("v1", None, "3"), ("v2", "g", None)]
    (tmp_path / "a.fa").write_text(">ENST1.7|ENSG1.2|x\nacgu\nAC\n>ENST2|y\nGG\n")
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "a.fa"), rna=True).collect())) == [("ENST1.7", "ACGTAC"), ("ENST2", "GG")]
    (tmp_path / "g.gtf").write_text('chr1\tx\tgene\t11\t20\t.\t+\t.\tgene_id "X.7"; a "b";\nchr1\tx\texon\t11\t12\t.\t+\t.\tgene_id "X.7";\n')
    assert [tuple(r) for r in files.read_gtf_genes(spark, str(tmp_path / "g.gtf")).collect()] == [("X", "chr1", 10, 20, "+")]
    df = spark.createDataFrame([("v", -0.123456789012345, None), ("w", 2.5, "g")], "variant string, score double, gene string")
    sinks.write_tsv(df, str(tmp_path / "out"), ["variant"], null="-")
    back = files.read_tsv(spark, str(tmp_path / "out"), df.schema)
    sinks.verify_written(back, df)
    with pytest.raises(ValueError, match="unexpected_header"):
        files.read_score_table(spark, str(tmp_path / "vep.txt"), ["a"])


def test_more_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    with pytest.raises(ValueError, match="missing_columns"):
        files.read_selected(spark, put("sel.tsv", "variant\tstart\nv\t1\n"))
    vep = files.read_vep_extra(spark, put("x.txt", "##n\n#Uploaded_variation\tExtra\nv1\tA=1;FLAG\nv2\tB=x;B=y\nv3\t-\n"))
    assert vep.columns == ["variant", "A", "B", "FLAG"] and sorted(map(tuple, vep.collect())) == [("v1", "1", None, "true"), ("v2", None, "y", None), ("v3", None, None, None)]
    bed = files.read_bed_with_names(spark, put("a.bed", "chr1\t5\t6\n"), put("a.cols", "chromosome\nstart\nend\n"), {"start": "int"})
    assert tuple(bed.first()) == ("chr1", 5, "6")
    assert tuple(files.read_rsid_map(spark, put("m.tsv", "chr1\t5\t6\trs1\tA\textra\n")).first()) == ("chr1", 5, 6, "rs1", "A")
    assert tuple(files.read_columns(spark, put("s.tsv", "a\tb\tc\nx\t1.5\t2\n"), {"a": "variant", "b": "score"}, ["score"]).first()) == ("x", -1.5)
    vcf = put("r.vcf", "##x\n#CHROM\tPOS\nchr1\t10\t.\tA\tC\t.\t.\tMR=0.5;AR=x\nchr1\t11\t.\tA\tG\t.\t.\tMR=1\n")
    at = spark.createDataFrame([("chr1", 9)], "chrom string, start int")
    assert [tuple(r) for r in files.read_info_values(spark, vcf, ["MR", "AR"], at).collect()] == [("chr1", 9, "A", "C", 0.5, None)]
    fasta = put("t.fa", ">T1.2|x\nACGU\n>T1.2|x\nacgu\n>T2.1\nGG\n>T3\nAA\n>T3\nCC\n")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(map(tuple, files.read_required_fasta(spark, fasta, ids("T1", "T2")).collect())) == [("T1", "ACGT"), ("T2", "GG")]
    for x, code in (("T3", "conflicting_sequence"), ("T9", "missing_sequence")):
        with pytest.raises(ValueError, match=code):
            files.read_required_fasta(spark, fasta, ids(x))
    assert [tuple(r) for r in files.read_protein_fasta(spark, put("p.fa", ">ENSP1.1|ENST7.3|ENSG1\nMKL\nV\n")).collect()] == [("ENST7", "MKLV")]
    head = "#Uploaded_variation\tgene\tchromosome\tstart\tend\tref\talt\n"
    got = files.read_dna_candidates(spark, put("d.tsv", head + "v1\tG1.4\tchr1\t5\t6\ta\tc\nv2\t-\tchr1\t7\t8\tA\t-\n")).orderBy("input_index").collect()
    assert [(r["variant"], r["gene"], r["start"], r["ref"], r["alt"], r["input_index"]) for r in got] == [("v1", "G1", 5, "A", "C", 0), ("v2", "", 7, "A", "", 1)]
    for row, code in (("v1\tG\t\t5\t6\tA\tC\n", "missing_value"), ("v1\tG\tchr1\t5x\t6\tA\tC\n", "invalid_coordinate")):
        with pytest.raises(ValueError, match=code):
            files.read_dna_candidates(spark, put("d2.tsv", head + row))
    gff = "##g\nchr1\tx\tmRNA\t1\t9\t.\t+\t.\tID=transcript:T1.1;Parent=gene:G1.2\nchr1\tx\texon\t1\t9\t.\t+\t.\tParent=transcript:T1.1\nchr1\tx\tCDS\tbad\t9\t.\t+\t.\tParent=transcript:T1.1\n"
    assert sorted((r["type"], r["transcript"], r["start"], r["end"]) for r in files.read_gff3(spark, put("g.gff3", gff), coding=False).collect()) == [("exon", "T1", 0, 9), ("mRNA", "T1", 0, 9)]
    with pytest.raises(ValueError, match="invalid_gff3_coordinate"):
        files.read_gff3(spark, put("g.gff3", gff))
    prot = files.read_protein_candidates(spark, put("q.tsv", "variant\tfeature\tbiotype\tconsequence\tprotein_position\tamino_acids\nv\tENST1.2\tprotein_coding\tmissense_variant,x\t7\tK/M\nw\tENST1.2\tlncRNA\tmissense_variant\t7\tK/M\n"))
    assert [tuple(r) for r in prot.collect()] == [("v", "ENST1", 7, "K", "M")]
    kept, why = files.with_rejections(spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int"), {"null": F.col("x").isNull(), "big": F.col("x") > 1, "odd": F.col("x") == 3})
    assert [r[0] for r in kept.collect()] == [1] and {r[0]: r[1] for r in why.collect()} == {"null": 1, "big": 2}
    (tmp_path / "logs").mkdir()
    put("logs/a.log", "start model=evo n=5\nelapsed=1:02:03 rss=77\n")
    got = {r["key"]: r["value"] for r in files.read_log_values(spark, str(tmp_path / "logs")).collect()}
    assert got == {"model": "evo", "n": "5", "elapsed": "1:02:03", "rss": "77"}
    assert spark.range(1).select(files.elapsed_seconds(F.lit("1:02:03"))).first()[0] == 3723


def test_more_writers(spark, tmp_path):
    seqs = spark.createDataFrame([("b", "ACGTA"), ("a", "GG")], "id string, sequence string")
    sinks.write_fasta(seqs, str(tmp_path / "f"), 3, "gzip")
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "f")).collect())) == [("a", "GG"), ("b", "ACGTA")]
    v = spark.createDataFrame([("rs9",), ("rs2",), ("1:5",), ("rs2",)], "variant string")
    sinks.write_rsids(v, str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["rs2", "rs9"]
    s = spark.createDataFrame([("b", 1.5), ("a", None)], "variant string, score double")
    assert sinks.write_scores(s, str(tmp_path / "s"), ["variant", "score"], ["variant"]) == 2
    back = files.read_score_table(spark, str(tmp_path / "s"), ["variant", "score"])
    sinks.verify_order(back, ["variant"])
    with pytest.raises(ValueError, match="key_order_mismatch"):
        sinks.verify_order(s.coalesce(1), ["variant"])
    with pytest.raises(ValueError, match="score_not_finite"):
        sinks.write_scores(s.withColumn("score", F.lit(float("nan"))), str(tmp_path / "n"), ["variant", "score"], ["variant"])
    assert not (tmp_path / "n").exists()  # nothing is written on failure
    sinks.write_tables({"folds": s, "sizes": v}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/folds.parquet")).count() == 2


def test_cohorts_folds_vectors_and_shards(spark):
    rows = spark.createDataFrame([("chr1", 4, "v2", False, "a"), ("chr1", 4, "v1", False, "a"), ("chr1", 4, "v9", True, "b"), ("chr2", 5, "v3", None, "b")], "chromosome string, start int, variant string, shared boolean, kind string")
    got = U.select_cohorts(rows, "shared", ["variant"], {"all": F.lit(True), "only_a": F.col("kind") == "a"})
    assert sorted((r["cohort"], r["site_id"], r["variant"]) for r in got.collect()) == [("all", "chr1:5", "v9"), ("all", "chr2:6", "v3"), ("only_a", "chr1:5", "v1")]
    assert [r[0] for r in U.silent_variants(spark.createDataFrame([("a", "x,y"), ("a", "x"), ("b", "x"), ("b", "z")], "variant string, consequence string"), ["x", "y"]).collect()] == ["a"]
    folds = spark.createDataFrame([(f"chr{i}", i % 5) for i in range(1, 11)], "chromosome string, fold int")
    assert U.check_folds(folds, "fold", "chromosome").count() == 10
    with pytest.raises(ValueError, match="chromosome_in_two_folds"):
        U.check_folds(folds.unionAll(folds.withColumn("fold", (F.col("fold") + 1) % 5)), "fold", "chromosome")
    with pytest.raises(ValueError, match="wrong_folds"):
        U.check_folds(folds.where("fold > 0"), "fold", "chromosome")
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, float("nan")])], "k int, v array<double>")
    assert U.check_vectors(vec.where("k = 1"), "v", ["k"], 2).count() == 1
    for bad, code in ((vec, "broken_vector"), (vec.where("k = 1").unionAll(vec.where("k = 1")), "duplicate_vector")):
        with pytest.raises(ValueError, match=code):
            U.check_vectors(bad, "v", ["k"], 2)
    a, b = spark.createDataFrame([(2, 0.5)], "k int, s double"), spark.createDataFrame([(1, 0.25)], "k int, s double")
    want = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r["k"] for r in U.collate_shards([a, b], want, "k", ["k"]).collect()] == [1, 2]
    for parts, code in (([a], "key_mismatch"), ([a, a, b], "duplicate_across_shards")):
        with pytest.raises(ValueError, match=code):
            U.collate_shards(parts, want, "k", ["k"])
    with pytest.raises(ValueError, match="rows_changed"):
        U.check_unchanged(a, b, ["k"])
    shown = U.comparison_table(spark.createDataFrame([("m", 0.5), ("n", 0.75)], "model string, auroc double"), {"m": "M", "n": "N"}, ["auroc"], "auroc")
    assert [tuple(r) for r in shown.collect()] == [("N", 0.75), ("M", 0.5)]


def test_scorers(spark):
    import pandas as pd

    from helixframe.operators import scoring as O

    df = spark.createDataFrame([(i, "ACGT"[: 1 + i % 4]) for i in range(20)], "k int, s string").repartition(3)

    def factory():
        return lambda frame: pd.DataFrame({"n": frame["s"].str.len()})

    got = O.score_batches(df, factory, ["k"], "n long", batch=3, by_length="s")
    assert sorted((r["k"], r["n"]) for r in got.collect()) == [(i, 1 + i % 4) for i in range(20)]
    with pytest.raises(Exception, match="score_count_mismatch"):
        O.score_batches(df, lambda: lambda frame: pd.DataFrame({"n": [1]}), ["k"], "n long").collect()
    two = O.both_strands(spark.createDataFrame([("AACG", 1)], "s string, t int"), "s", "t").collect()
    assert [(r["strand"], r["s"], r["t"]) for r in two] == [("+", "AACG", 1), ("-", "CGTT", 2)]
    one = spark.range(1)
    assert one.select(O.mean_log_likelihood(F.array(F.lit(-1.0), F.lit(None).cast("double"), F.lit(-2.0)))).first()[0] == -1.5
    assert abs(sum(2.718281828459045**x for x in one.select(O.log_softmax(F.array(F.lit(0.5), F.lit(-2.0), F.lit(3.0)))).first()[0]) - 1) < 1e-12
    assert one.select(O.tokens(F.lit("ACX"), {"A": 5, "C": 6}, 3, cls=1, eos=2, mask=4, target=F.lit(1))).first()[0] == [1, 5, 4, 3, 2]


def test_command_line(spark, tmp_path):
    from helixframe import __main__ as cli

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    for bad in (["curate", "--vep", "a", "--selected", "b", "--output-prefix", "c", "--neg-fraction", "2"], ["windows", "--candidates", "a", "--fasta", "b", "--output", "c", "--window-length", "100"], []):
        with pytest.raises(SystemExit):
            cli.checked(bad)
    selected = put("s.tsv", "variant\tchromosome\tstart\tend\tref\talt\tpip\tlabel\nv1\tchr2\t5\t6\tA\tC\t0.9\thigh_pip\nv2\tchr1\t5\t6\tA\tC\t0.01\tlow_pip\n")
    vep = put("v.txt", "##x\n#Uploaded_variation\tGene\tFeature\tConsequence\tBIOTYPE\tMANE\tCANONICAL\tTSL\nv1\tG\tT1\tmissense_variant\tprotein_coding\t-\tYES\t1\nv2\tG\tT1\tmissense_variant\tprotein_coding\t-\tYES\t1\n")
    cli.run(spark, cli.checked(["curate", "--vep", vep, "--selected", selected, "--output-prefix", str(tmp_path / "out"), "--neg-fraction", "0"]))
    assert [r["variant"] for r in files.read_tsv(spark, str(tmp_path / "out.tsv")).collect()] == ["v2", "v1"]
    assert [r["variant"] for r in files.read_tsv(spark, str(tmp_path / "out.downsampled.tsv")).collect()] == ["v1"]
    fasta = put("g.fa", ">chr1\n" + "ACGT" * 100 + "\n")
    cand = put("c.tsv", "variant\tchromosome\tstart\tend\tref\talt\nw\t1\t8\t9\tA\tC\n")
    cli.run(spark, cli.checked(["windows", "--candidates", cand, "--fasta", fasta, "--output", str(tmp_path / "w"), "--window-length", "128", "--min-variant-margin", "8"]))
    assert spark.read.parquet(str(tmp_path / "w/contexts.parquet")).first()["sequence"] == "N" * 56 + "ACGT" * 18
