"""Queries of curation, collation, windows and statistics, on stand-ins for variants and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as U
from ..operators import genomics as G
from ..operators import relational as R
from ..operators import statistics as S
from .registered import query

#: One row for each transcript that a variant meets.
_VEP = """SELECT 'v' || l_orderkey AS variant, 'g' || (l_partkey % 2) AS gene, 'T0' || l_linenumber AS feature,
    CASE WHEN l_quantity <= 5 THEN 'intron_variant,missense_variant' WHEN l_quantity <= 30 THEN 'missense_variant' ELSE 'splice_region_variant,synonymous_variant' END AS consequence,
    CASE l_suppkey % 5 WHEN 0 THEN 'lncRNA' WHEN 1 THEN 'miRNA' ELSE 'protein_coding' END AS biotype, CASE WHEN l_linenumber % 3 = 0 THEN 'NM' END AS mane,
    CASE l_partkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' END AS canonical, CASE l_partkey % 5 WHEN 0 THEN '10 (x)' WHEN 1 THEN '2' WHEN 2 THEN 'tsl1' END AS tsl FROM lineitem"""
_SELECTED = """SELECT 'v' || o_orderkey AS variant, 'chr' || (1 + o_custkey % 22) AS chromosome, o_custkey * 10 AS start, o_custkey * 10 + 1 AS "end", 'A' AS ref, 'C' AS alt,
    o_totalprice / 400000 AS pip, CASE WHEN o_totalprice >= 200000 THEN 'high_pip' WHEN o_totalprice <= 100000 THEN 'low_pip' END AS label, 'g' || (o_custkey % 2) AS target_gene FROM orders"""
_NOTES = f"""v AS ({_VEP}), k AS (SELECT * FROM v WHERE NOT list_has_any(string_split(consequence, ','), ['intron_variant'])),
    e AS (SELECT variant FROM k GROUP BY variant HAVING bool_or(biotype = 'protein_coding') <> bool_or(biotype = 'lncRNA')),
    n AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY variant, gene ORDER BY mane IS NULL, coalesce(canonical <> 'YES', true),
      try_cast(nullif(regexp_extract(tsl, '^([0-9]+)', 1), '') AS INT) NULLS LAST, feature) AS r FROM k SEMI JOIN e USING (variant) WHERE biotype IN ('protein_coding', 'lncRNA')) WHERE r = 1)"""


def _text(prefix, c):
    return F.concat(F.lit(prefix), c.cast("string"))


def _vep(t):
    q, p = F.col("l_quantity"), F.col("l_partkey")
    return t("lineitem").select(
        _text("v", F.col("l_orderkey")).alias("variant"), _text("g", p % 2).alias("gene"), _text("T0", F.col("l_linenumber")).alias("feature"),
        F.when(q <= 5, "intron_variant,missense_variant").when(q <= 30, "missense_variant").otherwise("splice_region_variant,synonymous_variant").alias("consequence"),
        F.when(F.col("l_suppkey") % 5 == 0, "lncRNA").when(F.col("l_suppkey") % 5 == 1, "miRNA").otherwise("protein_coding").alias("biotype"),
        F.when(F.col("l_linenumber") % 3 == 0, "NM").alias("mane"), F.when(p % 3 == 0, "YES").when(p % 3 == 1, "NO").alias("canonical"),
        F.when(p % 5 == 0, "10 (x)").when(p % 5 == 1, "2").when(p % 5 == 2, "tsl1").alias("tsl"),
    )


def _selected(t):
    price, k = F.col("o_totalprice"), F.col("o_custkey")
    return t("orders").select(
        _text("v", F.col("o_orderkey")).alias("variant"), _text("chr", 1 + k % 22).alias("chromosome"), (k * 10).alias("start"), (k * 10 + 1).alias("end"), F.lit("A").alias("ref"), F.lit("C").alias("alt"),
        (price / 400000).alias("pip"), F.when(price >= 200000, "high_pip").when(price <= 100000, "low_pip").alias("label"), _text("g", k % 2).alias("target_gene"),
    )


@query("dom01_select_transcripts", f"WITH {_NOTES} SELECT variant, gene, feature, biotype FROM n")
def _(t):
    return G.select_transcripts(_vep(t), list(U.REMOVED)).select("variant", "gene", "feature", "biotype")


@query("dom03_strongest_association", f"""SELECT chromosome AS variant, pip, target_gene FROM (SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY pip DESC NULLS LAST, target_gene, variant) AS r
    FROM (SELECT * REPLACE (CAST(round(pip, 1) AS DOUBLE) AS pip) FROM ({_SELECTED}) s)) WHERE r = 1""")
def _(t):
    s = _selected(t).select(F.col("chromosome").alias("variant"), F.round("pip", 1).alias("pip"), "target_gene")
    return U.strongest_association(s).select("variant", "pip", "target_gene")


@query("dom04_curate", f"WITH {_NOTES}, s AS ({_SELECTED}) SELECT s.variant, chromosome, start, n.gene, feature, label FROM s JOIN n USING (variant)")
def _(t):
    return U.curate(_selected(t), _vep(t))[0].select("variant", "chromosome", "start", "gene", "feature", "label")


@query("jon02_target_genes", f"""WITH v AS (SELECT v.* FROM ({_VEP}) v WHERE NOT list_has_any(string_split(consequence, ','), ['intron_variant'])), s AS ({_SELECTED}),
    k AS (SELECT v.* FROM v JOIN s ON v.variant = s.variant AND v.gene = s.target_gene), e AS (SELECT variant FROM k GROUP BY variant HAVING bool_or(biotype = 'protein_coding') <> bool_or(biotype = 'lncRNA')),
    n AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY variant, gene ORDER BY mane IS NULL, coalesce(canonical <> 'YES', true), try_cast(nullif(regexp_extract(tsl, '^([0-9]+)', 1), '') AS INT) NULLS LAST, feature) AS r
      FROM k SEMI JOIN e USING (variant) WHERE biotype IN ('protein_coding', 'lncRNA')) WHERE r = 1)
    SELECT s.variant, n.gene, n.feature, s.label FROM s JOIN n ON s.variant = n.variant AND s.target_gene = n.gene""")
def _(t):
    return U.curate(_selected(t), _vep(t), has_target_genes=True)[0].select("variant", "gene", "feature", "label")


@query("dom04_downsample_positives", f"WITH {_NOTES}, s AS ({_SELECTED}) SELECT s.variant, n.gene FROM s JOIN n USING (variant) WHERE label <> 'low_pip'")
def _(t):
    return U.curate(_selected(t), _vep(t))[1].where("label <> 'low_pip'").select("variant", "gene")


@query("dom05_stage_report", f"WITH {_NOTES}, s AS ({_SELECTED}) SELECT label, count(*) FILTER (WHERE biotype = 'lncRNA') AS \"lncRNA\", count(*) FILTER (WHERE biotype = 'protein_coding') AS protein_coding FROM s JOIN n USING (variant) GROUP BY label")
def _(t):
    return U.stage_report(U.curate(_selected(t), _vep(t))[0], ["lncRNA", "protein_coding"])


@query("srt01_genomic_order", f"SELECT variant, CAST(row_number() OVER (ORDER BY try_cast(nullif(regexp_extract(chromosome, '^chr([0-9]+)$', 1), '') AS INT) NULLS FIRST, start, variant, target_gene) - 1 AS BIGINT) AS place FROM ({_SELECTED}) s")
def _(t):
    s = _selected(t).withColumnRenamed("target_gene", "gene")
    return R.rank_globally(s, U.genomic_order()).select("variant", F.col("__rank").alias("place"))


@query("srt02_string_order", f"SELECT variant, CAST(row_number() OVER (ORDER BY chromosome, start, variant) - 1 AS BIGINT) AS place FROM ({_SELECTED}) s")
def _(t):
    return R.rank_globally(_selected(t), [F.col("chromosome"), F.col("start"), F.col("variant")]).select("variant", F.col("__rank").alias("place"))


@query("dom06_collate", """WITH a AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS pip FROM customer), b AS (SELECT o_custkey AS k, max(o_orderpriority) AS name, max(o_totalprice) AS pip FROM orders GROUP BY 1), c AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS pip FROM supplier)
    SELECT coalesce(a.k, b.k, c.k) AS k, coalesce(b.name, a.name, c.name) AS name, a.pip AS a_pip, b.pip AS b_pip, c.pip AS c_pip, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b, c.k IS NOT NULL AS in_c
    FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""")
def _(t):
    a = t("customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("pip"))
    b = t("orders").groupBy(F.col("o_custkey").cast("long").alias("k")).agg(F.max("o_orderpriority").alias("name"), F.max("o_totalprice").alias("pip"))
    c = t("supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("pip"))
    return U.collate({"b": b, "a": a, "c": c}, ["k"], ["name"]).select("k", "name", "a_pip", "b_pip", "c_pip", "in_a", "in_b", "in_c")


@query("val06_disagreements", "SELECT a.p_partkey, 'brand' AS \"column\" FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1 WHERE nullif(a.p_brand, 'Brand#11') IS DISTINCT FROM nullif(b.p_brand, 'Brand#11') UNION ALL SELECT a.p_partkey, 'size' FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1 WHERE a.p_size IS DISTINCT FROM b.p_size")
def _(t):
    p = t("part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("brand"), F.col("p_size").alias("size"))
    return U.disagreements(p, p.withColumn("p_partkey", F.col("p_partkey") + 1), ["p_partkey"], ["brand", "size"])


@query("val05_uneven_genes", """WITH a AS (SELECT l_orderkey AS variant, list_distinct(list('g' || (l_partkey % 3))) AS g FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS variant, list_distinct(list('g' || (l_suppkey % 3))) AS g FROM lineitem GROUP BY 1)
    SELECT variant, array_to_string(list_sort(list_filter(a.g, lambda x: NOT list_contains(b.g, x))), ',') AS left_only, array_to_string(list_sort(list_filter(b.g, lambda x: NOT list_contains(a.g, x))), ',') AS right_only FROM a JOIN b USING (variant)
    WHERE len(list_filter(a.g, lambda x: NOT list_contains(b.g, x))) + len(list_filter(b.g, lambda x: NOT list_contains(a.g, x))) > 0""")
def _(t):
    li = t("lineitem")
    a = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("variant"), _text("g", F.col("l_partkey") % 3).alias("gene"))
    b = li.select(F.col("l_orderkey").alias("variant"), _text("g", F.col("l_suppkey") % 3).alias("gene"))
    return U.uneven_genes(a, b).select("variant", F.array_join("left_only", ",").alias("left_only"), F.array_join("right_only", ",").alias("right_only"))


@query("jon17_lift", "SELECT c_custkey, o_orderkey, o_orderkey * 2 AS start, 'chr' || (o_custkey % 22) AS chromosome FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 3 = o_orderkey % 3")
def _(t):
    v = t("customer").select(F.col("c_custkey").alias("rsid"), F.lit("chr1").alias("chromosome"), F.lit(0).alias("start"), (F.col("c_custkey") % 3).alias("ref"))
    lift = t("orders").select(F.col("o_custkey").alias("rsid"), "o_orderkey", _text("chr", F.col("o_custkey") % 22).alias("new_chromosome"), (F.col("o_orderkey") * 2).alias("new_start"), (F.col("o_orderkey") % 3).alias("new_ref"))
    return U.lift_positions(v, lift).select(F.col("rsid").alias("c_custkey"), "o_orderkey", "start", "chromosome")


@query("prj21_source_population", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderpriority <> '2-HIGH' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND (o_totalprice / 400000 >= 0.5 OR o_totalprice / 400000 <= 0.1))")
def _(t):
    df = t("orders").select("o_orderkey", F.nullif(F.col("o_orderstatus") == "O", F.lit(False)).alias("in_b"), (F.col("o_orderpriority") != "2-HIGH").alias("in_a"), F.col("o_orderpriority").alias("trait"), (F.col("o_totalprice") / 400000).alias("pip"))
    return U.source_population(df, ["in_a", "in_b"], "in_a", "trait", ["1-URGENT", "3-MEDIUM"], "pip").select("o_orderkey")


@query("prj22_cohort_eligible", f"SELECT variant, feature FROM ({_VEP}) WHERE ((list_contains(string_split(consequence, ','), 'missense_variant') AND biotype = 'protein_coding') OR biotype = 'lncRNA') AND gene = 'g0'")
def _(t):
    ok = U.cohort_eligible(F.col("consequence"), F.col("biotype"), F.lit("A"), F.when(F.col("gene") == "g0", "C").otherwise("A"), F.lit(4), F.lit(5), [F.lit(1.5)])
    return _vep(t).where(ok).select("variant", "feature")


@query("prj07_eqtl_class", """WITH e AS (SELECT l_partkey AS variant, CAST(l_linenumber AS VARCHAR) AS tissue, l_quantity / 60 AS pip, l_suppkey % 3 = 0 AS f FROM lineitem),
    g AS (SELECT variant, max(pip) AS m, max(pip) FILTER (WHERE f) AS h FROM e GROUP BY variant), s AS (SELECT variant, string_agg(tissue, ',' ORDER BY tissue) AS tissues FROM (SELECT DISTINCT variant, tissue FROM e) GROUP BY variant)
    SELECT variant, round(CASE WHEN coalesce(h >= 0.5, false) THEN h ELSE m END, 9) AS pip, CASE WHEN coalesce(h >= 0.5, false) THEN 'high_pip' ELSE 'low_pip' END AS label, tissues FROM g JOIN s USING (variant) WHERE coalesce(h >= 0.5, false) OR m <= 0.1""")
def _(t):
    e = t("lineitem").select(F.col("l_partkey").alias("variant"), F.col("l_linenumber").cast("string").alias("tissue"), (F.col("l_quantity") / 60).alias("pip"), (F.col("l_suppkey") % 3 == 0).alias("fine_mapped"))
    return U.eqtl_class(e).withColumn("pip", F.round("pip", 9))


_GENE = "SELECT p_partkey, p_partkey * 37 % 5000 AS pos, p_partkey * 37 % 5000 - p_size * 2 AS gs, p_partkey * 37 % 5000 + p_size * 3 AS ge FROM part"


@query("dom11_gene_window", f"""WITH g AS (SELECT p_partkey, pos, greatest(gs, 0) AS gs, least(ge, 5000) AS ge FROM ({_GENE}) x), w AS (SELECT *, pos - 64 AS c, greatest(ge - 128, pos + 9 - 128, 0) AS lo, least(gs, pos - 8, 4872) AS hi FROM g),
    k AS (SELECT *, CASE WHEN c <= gs AND ge <= c + 128 AND c <= pos - 8 AND pos + 9 <= c + 128 THEN 'centered_full_gene' WHEN lo > hi THEN 'gene_too_long' ELSE 'shifted_full_gene' END AS kind FROM w)
    SELECT p_partkey, kind, CASE kind WHEN 'centered_full_gene' THEN c WHEN 'shifted_full_gene' THEN least(greatest(c, lo), hi) END AS start FROM k""")
def _(t):
    at = F.col("p_partkey") * 37 % 5000
    start, kind = G.gene_window(at, F.greatest(at - F.col("p_size") * 2, F.lit(0)), F.least(at + F.col("p_size") * 3, F.lit(5000)), 128, 8, F.lit(5000))
    return t("part").select("p_partkey", kind.alias("kind"), start.alias("start"))


@query("dom19_edge_weight", """WITH p AS (SELECT event_id, event_id % 32 AS o, event_id % 7 AS s FROM events)
    SELECT event_id, round(CASE WHEN s > 0 AND o < 8 THEN 1 / (1 + exp(-(o - 4.0) / (640.0 / 1022))) WHEN s + 32 < 36 AND o >= 24 THEN 1 / (1 + exp((o - 24 - 4.0) / (640.0 / 1022))) ELSE 1.0 END, 9) AS w FROM p""")
def _(t):
    w = G.edge_weight(F.col("event_id") % 32, F.col("event_id") % 7, F.lit(32), F.lit(36), 32)
    return t("events").select("event_id", F.round(w, 9).alias("w"))


@query("jon12_asof_bounded", """WITH r AS (SELECT p_partkey % 20 AS k, p_partkey * 13 % 5000 AS s, max(p_partkey * 13 % 5000 + p_size) AS e FROM part GROUP BY ALL), p AS (SELECT event_id, user_id % 20 AS k, event_id * 7 % 5000 AS pos FROM events)
    SELECT event_id, CASE WHEN pos < e THEN e - s END AS z FROM p ASOF LEFT JOIN r ON p.k = r.k AND p.pos >= r.s""")
def _(t):
    at = F.col("p_partkey") * 13 % 5000
    r = t("part").groupBy((F.col("p_partkey") % 20).alias("k"), at.alias("s")).agg(F.max(at + F.col("p_size")).alias("e")).withColumn("z", F.col("e") - F.col("s"))
    p = t("events").select("event_id", (F.col("user_id") % 20).alias("k"), (F.col("event_id") * 7 % 5000).alias("at"))
    return R.asof_bounded(p, r, "k", "at", "s", "e", ["z"]).select("event_id", "z")


@query("agg30_covered_mean", """WITH a AS (SELECT p_partkey AS id, p_partkey % 20 AS k, p_partkey * 13 % 5000 AS s, p_partkey * 13 % 5000 + p_size AS e FROM part), b AS (SELECT l_suppkey % 20 AS k, l_orderkey % 500 * 10 AS s, l_orderkey % 500 * 10 + 5 AS e, max(l_quantity) AS v FROM lineitem GROUP BY ALL),
    m AS (SELECT id, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS c, sum(v * (least(a.e, b.e) - greatest(a.s, b.s))) AS t FROM a JOIN b ON a.k = b.k AND a.s < b.e AND b.s < a.e GROUP BY id)
    SELECT id, coalesce(c, 0) AS covered, round(coalesce(c, 0) / (e - s), 9) AS fraction, round(t / c, 6) AS mean FROM a LEFT JOIN m USING (id)""")
def _(t):
    at = F.col("p_partkey") * 13 % 5000
    a = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 20).alias("k"), at.alias("s1"), (at + F.col("p_size")).alias("e1"))
    low = F.col("l_orderkey") % 500 * 10
    b = t("lineitem").groupBy((F.col("l_suppkey") % 20).alias("k"), low.alias("s2"), (low + 5).alias("e2")).agg(F.max("l_quantity").alias("v"))
    return U.covered_mean(a, b, "k", ("s1", "e1"), ("s2", "e2"), "v", 64, ["id"]).select("id", "covered", F.round("fraction", 9).alias("fraction"), F.round("mean", 6).alias("mean"))


@query("agg24_conflict_merge", "SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS flag, CASE WHEN min(nullif(l_linestatus, 'O')) = max(nullif(l_linestatus, 'O')) THEN min(nullif(l_linestatus, 'O')) END AS status FROM lineitem GROUP BY 1")
def _(t):
    df = t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.nullif("l_linestatus", F.lit("O")).alias("status"))
    return R.conflict_to_null(df, ["l_orderkey"], ["flag", "status"])


@query("shd03_modulo_shards", "SELECT DISTINCT o_custkey, CAST((dense_rank() OVER (ORDER BY o_custkey) - 1) % 4 AS INT) AS shard FROM orders")
def _(t):
    return R.shard_modulo(t("orders").select("o_custkey"), "o_custkey", 4).distinct()


@query("shd07_batches", "SELECT batch, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch FROM orders) GROUP BY batch")
def _(t):
    return R.batches(t("orders"), [F.col("o_orderkey")], 1000).groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("win07_every_nth", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r FROM orders) WHERE r % 7 = 2")
def _(t):
    return R.every_nth(t("orders"), [F.col("o_totalprice"), F.col("o_orderkey")], 7, 2).select("o_orderkey")


@query("rsh08_hstack", "SELECT a.k AS a, b.k AS b FROM (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) a JOIN (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer) b USING (r)")
def _(t):
    c = t("customer")
    return R.hstack(c.select(F.col("c_custkey").alias("a")), c.select(F.col("c_custkey").alias("b"), "c_acctbal"), [F.col("a")], [F.col("c_acctbal"), F.col("b")]).select("a", "b")


_METRICS = "SELECT l_linenumber AS draw, CASE l_suppkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS model, avg(l_quantity) AS auroc, avg(l_discount) AS average_precision FROM lineitem GROUP BY ALL"


@query("sta07_paired_differences", f"WITH m AS ({_METRICS}) SELECT a.draw, a.model, round(a.auroc - b.auroc, 8) AS auroc, round(100 * (a.auroc - b.auroc) / b.auroc, 7) AS auroc_pct FROM m a JOIN m b ON a.draw = b.draw AND b.model = 'x' WHERE a.model IN ('y', 'z')")
def _(t):
    model = F.when(F.col("l_suppkey") % 3 == 0, "x").when(F.col("l_suppkey") % 3 == 1, "y").otherwise("z")
    m = t("lineitem").groupBy(F.col("l_linenumber").alias("draw"), model.alias("model")).agg(F.avg("l_quantity").alias("auroc"), F.avg("l_discount").alias("average_precision"))
    return S.paired_differences(m, "x", ["y", "z"]).select("draw", "model", F.round("auroc", 8).alias("auroc"), F.round("auroc_pct", 7).alias("auroc_pct"))


@query("sta24_percentile_interval", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1")
def _(t):
    return S.percentile_interval(t("events"), ["event_type"], "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


@query("agg27_fold_summary", "SELECT l_returnflag AS model, count(*) AS folds, sum(n) AS n, round(avg(m), 8) AS m_mean, round(stddev_samp(m), 8) AS m_sd FROM (SELECT l_returnflag, l_linenumber, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(t):
    f = t("lineitem").groupBy(F.col("l_returnflag").alias("model"), "l_linenumber").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"))
    return S.summarize_folds(f, ["model"], "n", ["m"]).select("model", "folds", "n", F.round("m_mean", 8).alias("m_mean"), F.round("m_sd", 8).alias("m_sd"))


@query("sta20_negative_z", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part WHERE p_size > 25)) / (SELECT stddev_samp(p_retailprice) FROM part WHERE p_size > 25), 7) AS z FROM part")
def _(t):
    df = t("part").withColumn("y", (F.col("p_size") <= 25).cast("int"))
    return S.negative_z(df, "p_retailprice", "y", "z").select("p_partkey", F.round("z", 7).alias("z"))


@query("dom30_tails", "WITH r AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS r, count(*) OVER () AS n FROM part), q AS (SELECT max(v) FILTER (WHERE r = floor(0.25 * (n - 1) + 0.5)) AS lo, max(v) FILTER (WHERE r = floor(0.75 * (n - 1) + 0.5)) AS hi FROM r) SELECT p_partkey, CASE WHEN p_retailprice <= lo THEN 'low' ELSE 'high' END AS tail FROM part, q WHERE p_retailprice <= lo OR p_retailprice >= hi")
def _(t):
    return S.tails(t("part"), "p_retailprice").select("p_partkey", "tail")


@query("agg29_weighted_vectors", "SELECT label, i, round(sum(x * w) / sum(w), 5) AS v FROM (SELECT label, (vec_id % 3 + 1) AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def _(t):
    e = t("embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3 + 1).alias("w"))
    return S.weighted_means(e, ["label"], "v", "w").select("label", F.posexplode("v").alias("i", "v")).select("label", "i", F.round("v", 5).alias("v"))


@query("sta05_bootstrap_mass", "SELECT CAST(d AS BIGINT) AS draw, count(DISTINCT o_custkey) AS mass FROM orders, generate_series(0, 15) AS g(d) GROUP BY d")
def _(t):
    w = S.bootstrap_weights(t("orders"), "o_custkey", jobs=4, draws=4)
    return w.groupBy("draw").agg(F.sum("__m").alias("mass"))
