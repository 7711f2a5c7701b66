"""Queries of the relational and domain operators on the driver's tables, each with its SQL.

for variants, annotations and scores as FIXTURES.md part B says.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import genomics as G
from ..operators import relational as R
from ..operators import statistics as S
from .registered import ORACLE_SQL, QUERIES, query

FLAGSHIP = "sta01_auroc"
@query("prj05_labels", "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice <= 50000 THEN 'low' END AS label FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 200000, "high").when(F.col("o_totalprice") <= 50000, "low").alias("label"))


@query("prj06_pip_class", "SELECT o_orderkey, CASE WHEN o_totalprice / 400000 >= 0.5 THEN 'high_pip' ELSE 'low_pip' END AS label FROM orders WHERE o_totalprice / 400000 >= 0.5 OR o_totalprice / 400000 <= 0.1")
def _(t):
    pip = F.col("o_totalprice") / 400000
    return t("orders").where((pip >= 0.5) | (pip <= 0.1)).select("o_orderkey", F.when(pip >= 0.5, "high_pip").otherwise("low_pip").alias("label"))


@query("prj09_complete_cases", "SELECT event_id, user_id, event_type FROM events WHERE nullif(event_type, 'click') IS NOT NULL AND nullif(user_id % 7, 0) IS NOT NULL")
def _(t):
    df = t("events").withColumn("a", F.nullif("event_type", F.lit("click"))).withColumn("b", F.nullif(F.col("user_id") % 7, F.lit(0)))
    return df.where(C.all_known(["a", "b"])).select("event_id", "user_id", "event_type")


@query("prj10_any_true", "SELECT l_orderkey, l_linenumber, CAST(coalesce(l_quantity > 45, false) OR coalesce(nullif(l_returnflag, 'N') = 'R', false) AS INT) AS label FROM lineitem")
def _(t):
    df = t("lineitem").withColumn("a", F.col("l_quantity") > 45).withColumn("b", F.nullif("l_returnflag", F.lit("N")) == "R")
    return df.select("l_orderkey", "l_linenumber", C.any_true(["a", "b"]).alias("label"))


@query("prj12_greatest", "SELECT p_partkey, greatest(nullif(p_size, 10), CAST(p_retailprice AS INT) % 50) AS best FROM part")
def _(t):
    return t("part").select("p_partkey", F.greatest(F.nullif("p_size", F.lit(10)), F.floor("p_retailprice").cast("int") % 50).alias("best"))


ORACLE_SQL["prj12_greatest"] = "SELECT p_partkey, greatest(nullif(p_size, 10), CAST(floor(p_retailprice) AS INT) % 50) AS best FROM part"


@query("prj16_allow_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    allowed = t("orders").select("o_orderpriority").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).distinct()
    return t("orders").join(F.broadcast(allowed), "o_orderpriority", "left_semi").select("o_orderkey")


@query("jon01_inner", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("jon08_validated_lookup", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    left = t("orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return R.validated_join(left, t("customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment"), ["key"], "left", "m:1").drop("key")


@query("jon10_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jon11_anti", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query(
    "jon12_asof",
    """WITH r AS (SELECT user_id, ts AS at, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL),
    l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
    SELECT event_id, v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.at""",
)
def _(t):
    e = t("events")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("v"))
    return R.asof_backward(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "at", ["v"]).select("event_id", "v")


_POINTS = "SELECT event_id, user_id % 20 AS k, event_id * 7 % 5000 AS at FROM events"
_SPANS = "SELECT p_partkey, p_partkey % 20 AS k, p_partkey * 13 % 5000 AS s, p_partkey * 13 % 5000 + p_size AS e FROM part"


def _points(t):
    return t("events").select("event_id", (F.col("user_id") % 20).alias("k"), (F.col("event_id") * 7 % 5000).alias("at"))


def _spans(t):
    at = F.col("p_partkey") * 13 % 5000
    return t("part").select("p_partkey", (F.col("p_partkey") % 20).alias("k"), at.alias("s"), (at + F.col("p_size")).alias("e"))


@query("jon13_point_in_interval", f"SELECT event_id, p_partkey FROM ({_POINTS}) p JOIN ({_SPANS}) i ON p.k = i.k AND p.at >= i.s AND p.at < i.e")
def _(t):
    return R.point_in_interval(_points(t), _spans(t), "k", "at", "s", "e", 64).select("event_id", "p_partkey")


@query("jon14_overlap", f"SELECT a.p_partkey AS a, b.p_partkey AS b, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM ({_SPANS}) a JOIN ({_SPANS}) b ON a.k = b.k AND a.s < b.e AND b.s < a.e WHERE a.e > a.s AND b.e > b.s")
def _(t):
    a = _spans(t).select("k", F.col("p_partkey").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = _spans(t).select("k", F.col("p_partkey").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return R.overlapping(a, b, "k", ("s1", "e1"), ("s2", "e2"), 64).select("a", "b", "overlap")


@query("dom25_merge_intervals", f"""WITH i AS (SELECT * FROM ({_SPANS}) WHERE e > s),
    b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i),
    g AS (SELECT *, sum(CASE WHEN m IS NULL OR m < s THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM b)
    SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, g""")
def _(t):
    return R.merge_intervals(_spans(t).select("k", "s", "e"), "k", "s", "e")


@query("jon20_key_sets", "(SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT o_custkey, 'left' FROM orders) UNION ALL (SELECT o_custkey, 'right' FROM orders EXCEPT SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 2 = 0)")
def _(t):
    return R.key_set_difference(t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("agg02_distinct_null", "SELECT event_type, count(DISTINCT u) + max(CASE WHEN u IS NULL THEN 1 ELSE 0 END) AS n FROM (SELECT event_type, nullif(user_id, 3) AS u FROM events) GROUP BY event_type")
def _(t):
    return t("events").select("event_type", F.nullif("user_id", F.lit(3)).alias("u")).groupBy("event_type").agg(R.distinct_with_null("u").alias("n"))


@query("agg05_exclusive_groups", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderpriority = '1-URGENT') <> bool_or(o_orderpriority = '5-LOW')")
def _(t):
    g = t("orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("b"))
    return g.where("a <> b").select("o_custkey")


@query("agg06_arg_max", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t):
    return R.arg_max(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query("agg09_filtered_first", "SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (WHERE l_returnflag = 'R') AS part FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.expr("min_by(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (WHERE l_returnflag = 'R')").alias("part"))


@query("agg11_ordered_distinct", "SELECT o_custkey, string_agg(p, ',' ORDER BY p) AS priorities FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) GROUP BY o_custkey")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("agg12_coalescing_union", """WITH u AS (SELECT c_custkey AS k, c_name AS name, NULL AS bal, 0 AS o FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, 1 FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, 2 FROM customer)
    SELECT k, arg_min(name, o) FILTER (WHERE name IS NOT NULL) AS name, arg_min(bal, o) FILTER (WHERE bal IS NOT NULL) AS bal FROM u GROUP BY k""")
def _(t):
    c, s = t("customer"), t("supplier")
    k = F.col("c_custkey").alias("k")
    return R.coalescing_union([c.where("c_custkey % 3 = 0").select(k, F.col("c_name").alias("name")), s.select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")), c.select(k, F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))], ["k"])


@query("agg13_token_union", "SELECT p_brand, string_agg(w, ',' ORDER BY w) AS tokens FROM (SELECT DISTINCT p_brand, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY p_brand")
def _(t):
    return t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("p_type", " "))))), ",").alias("tokens"))


@query("agg16_median", "SELECT event_type, round(median(value), 6) AS mid, round(quantile_cont(value, 0.25), 6) AS low FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("mid"), F.round(F.percentile("value", 0.25), 6).alias("low"))


@query("agg17_nearest_quantile", """SELECT event_type, value AS q25 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    WHERE r = floor(0.25 * (n - 1) + 0.5)""")
def _(t):
    return S.quantile_nearest(t("events"), ["event_type"], "value", 0.25, "q25")


@query("agg21_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg26_presence", "SELECT l_quantity > 25 AS a, l_discount > 0.05 AS b, l_tax > 0.04 AS c, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return t("lineitem").groupBy((F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b"), (F.col("l_tax") > 0.04).alias("c")).agg(F.count("*").alias("n"))


@query("win02_keep_first", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY nullif(l_returnflag, 'A') ASC NULLS LAST, l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def _(t):
    order = [F.nullif("l_returnflag", F.lit("A")).asc_nulls_last(), F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return R.keep_first(t("lineitem"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber")


@query("win04_offsets", "SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM conversations")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t("conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("begin"))


@query("win08_duplicated", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 AS duplicated FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.count("*").over(Window.partitionBy("l_orderkey", "l_suppkey")) > 1).alias("duplicated"))


@query("win09_quantile_bins", """WITH q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS c FROM part)
    SELECT p_partkey, 1 + (p_retailprice > c[1])::INT + (p_retailprice > c[2])::INT + (p_retailprice > c[3])::INT + (p_retailprice > c[4])::INT AS bin FROM part, q""")
def _(t):
    return S.quantile_bins(t("part"), "p_retailprice", 5, "bin").select("p_partkey", "bin")


@query("srt03_natural_order", """SELECT n_name, row_number() OVER (ORDER BY CASE WHEN n_nationkey < 22 THEN 0 ELSE 1 END, CASE WHEN n_nationkey < 22 THEN n_nationkey ELSE 0 END, n_name) AS place FROM nation""")
def _(t):
    df = t("nation").withColumn("c", F.when(F.col("n_nationkey") < 22, F.concat(F.lit("chr"), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name")))
    return df.select("n_name", F.row_number().over(Window.orderBy(C.natural_chromosome(F.col("c")))).alias("place"))


@query("srt09_longest", "SELECT doc_id, n FROM (SELECT doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1 ORDER BY n DESC, doc_id LIMIT 10")
def _(t):
    df = t("documents").select("doc_id", "source", F.length("text").alias("n"))
    return R.keep_first(df, ["source"], [F.desc("n"), F.asc("doc_id")]).orderBy(F.desc("n"), "doc_id").limit(10).select("doc_id", "n")


@query("set03_replicate", "SELECT c, count(*) AS n FROM (SELECT o_orderpriority AS c FROM orders UNION ALL SELECT 'all' FROM orders) GROUP BY c")
def _(t):
    return R.replicate(t("orders").select(F.col("o_orderpriority").alias("c")), "c").groupBy("c").agg(F.count("*").alias("n"))


@query("rsh02_info_map", "SELECT event_id, 'k' || (event_id % 5) AS a, CASE WHEN event_id % 2 = 0 THEN 'true' END AS flag FROM events")
def _(t):
    info = F.concat(F.lit("A=x;A=k"), (F.col("event_id") % 5).cast("string"), F.when(F.col("event_id") % 2 == 0, ";FLAG").otherwise(""))
    m = C.info_map(info)
    return t("events").select("event_id", F.try_element_at(m, F.lit("A")).alias("a"), F.try_element_at(m, F.lit("FLAG")).alias("flag"))


@query("rsh03_pivot", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def _(t):
    p = t("orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1))).na.fill(0)
    return p.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("rsh05_unpivot", "SELECT l_orderkey, l_linenumber, 'discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return df.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "name", "value")


@query("str04_extract", "SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS number FROM pages")
def _(t):
    return t("pages").select("page_id", C.extract("url", "/([0-9]+)").alias("number"))


@query("str12_reverse_complement", "SELECT p_partkey, translate(reverse(upper(p_type)), 'ACGTN', 'TGCAN') AS s FROM part")
def _(t):
    return t("part").select("p_partkey", C.reverse_complement("p_type").alias("s"))


@query("num09_log_sum_exp", "SELECT p_partkey, round(ln(exp(p_size / 10.0) + exp(p_retailprice / 1000.0)), 6) AS v FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(C.log_sum_exp(F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0)), 6).alias("v"))


@query("num10_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS c FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.round(C.cosine("embedding", F.reverse("embedding")), 5).alias("c"))


@query("dom02_outside", """WITH v AS (SELECT l_orderkey AS variant, CASE WHEN l_shipdate IS NULL THEN NULL WHEN l_quantity <= 25 THEN 'intergenic_variant' WHEN l_quantity <= 48 THEN 'upstream_gene_variant,intergenic_variant' ELSE 'missense_variant' END AS c FROM lineitem),
    ok AS (SELECT variant FROM v GROUP BY variant HAVING bool_and(coalesce(c <> 'missense_variant', false)))
    SELECT variant, string_agg(x, ',' ORDER BY x) AS consequence FROM (SELECT DISTINCT variant, unnest(string_split(c, ',')) AS x FROM v SEMI JOIN ok USING (variant)) GROUP BY variant""")
def _(t):
    c = F.when(F.col("l_quantity") <= 25, "intergenic_variant").when(F.col("l_quantity") <= 48, "upstream_gene_variant,intergenic_variant").otherwise("missense_variant")
    return G.select_outside(t("lineitem").select(F.col("l_orderkey").alias("variant"), c.alias("consequence"))).select("variant", "consequence")


@query("dom10_windows", "SELECT event_id, p.at - 64 AS window_start, greatest(0, 64 - p.at) AS left_pad, greatest(0, p.at + 64 - 5000) AS right_pad FROM (" + _POINTS + ") p")
def _(t):
    w = G.centered_window(F.col("at"), F.lit(5000), 128)
    return _points(t).select("event_id", *[w[k].alias(k) for k in ("window_start", "left_pad", "right_pad")])


@query("dom14_extract_window", "SELECT doc_id, repeat('N', 3) || substr(text, 1, 13) AS s FROM documents WHERE length(text) >= 13")
def _(t):
    return t("documents").where(F.length("text") >= 13).select("doc_id", G.extract_window(F.col("text"), F.lit(-3), 16).alias("s"))


@query("dom07_coverage", "SELECT lang, count(*) AS rows, count(quality) AS covered, count(quality) / count(*) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def _(t):
    return G.coverage(t("documents").join(t("labels"), "doc_id", "left"), "lang", "quality")


@query("smp01_stratified", "SELECT o_orderpriority, floor(count(DISTINCT o_custkey) * 0.1)::BIGINT AS n FROM orders GROUP BY o_orderpriority")
def _(t):
    kept = R.stratified_sample(t("orders"), "o_custkey", "o_orderpriority", 0.1, 7)
    return kept.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))


@query("shd01_shards", "WITH k AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS r, count(*) OVER () AS n FROM k) SELECT o_custkey, CAST(floor(((r + 1) * 5 - 1) / n) AS INT) AS shard FROM r")
def _(t):
    return R.shard_contiguous(t("orders").select("o_custkey"), "o_custkey", [F.col("o_custkey")], 5).distinct()


_SCORED = "SELECT lang, quality, n_chars // 100 AS s FROM documents JOIN labels USING (doc_id)"


def _scored(t):
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "lang", "quality", F.floor(F.col("n_chars") / 100).cast("double").alias("s"))


@query("sta01_auroc", f"""WITH g AS (SELECT lang, s, sum(quality) AS p, sum(1 - quality) AS q FROM ({_SCORED}) GROUP BY ALL),
    w AS (SELECT *, sum(p) OVER d AS tp, sum(q) OVER d AS fp FROM g WINDOW d AS (PARTITION BY lang ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
    SELECT lang, round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 9) AS auroc, round(sum(p * tp / (tp + fp)) / sum(p), 9) AS average_precision FROM w GROUP BY lang""")
def _(t):
    return S.roc_and_precision(_scored(t), ["lang"], "s", "quality").select("lang", F.round("auroc", 9).alias("auroc"), F.round("average_precision", 9).alias("average_precision"))


@query("sta04_correlations", "WITH r AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part) SELECT p_brand, round(corr(p_size, p_retailprice), 8) AS pearson, round(corr(a, b), 8) AS spearman FROM r GROUP BY p_brand")
def _(t):
    return S.correlations(t("part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", F.round("pearson", 8).alias("pearson"), F.round("spearman", 8).alias("spearman"))


@query("sta06_bootstrap")
def _(t):
    return S.cluster_bootstrap(_scored(t), "doc_id", "s", "quality", jobs=8, draws=12)


@query("sta21_binned_rates", """WITH q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS c FROM part)
    SELECT 1 + (p_retailprice > c[1])::INT + (p_retailprice > c[2])::INT + (p_retailprice > c[3])::INT + (p_retailprice > c[4])::INT AS bin, round(avg((p_size > 25)::INT), 9) AS rate, count(*) AS n FROM part, q GROUP BY 1""")
def _(t):
    return S.quantile_bins(t("part"), "p_retailprice", 5, "bin").groupBy("bin").agg(F.round(F.avg((F.col("p_size") > 25).cast("int")), 9).alias("rate"), F.count("*").alias("n"))


@query("sta21_rate_matrix", """WITH q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS c, quantile_cont(p_size, [0.2, 0.4, 0.6, 0.8]) AS d FROM part),
    b AS (SELECT 1 + (p_retailprice > c[1])::INT + (p_retailprice > c[2])::INT + (p_retailprice > c[3])::INT + (p_retailprice > c[4])::INT AS x, 1 + (p_size > d[1])::INT + (p_size > d[2])::INT + (p_size > d[3])::INT + (p_size > d[4])::INT AS y, (p_partkey % 3 = 0)::INT AS label FROM part, q)
    SELECT x AS bin, round(avg(label) FILTER (WHERE y = 1), 9) AS q1, round(avg(label) FILTER (WHERE y = 2), 9) AS q2, round(avg(label) FILTER (WHERE y = 3), 9) AS q3, round(avg(label) FILTER (WHERE y = 4), 9) AS q4, round(avg(label) FILTER (WHERE y = 5), 9) AS q5 FROM b GROUP BY x""")
def _(t):
    part = t("part").withColumn("label", (F.col("p_partkey") % 3 == 0).cast("int"))
    return S.binned_rates(part, "p_retailprice", "p_size", "label").select("bin", *[F.round(f"q{i}", 9).alias(f"q{i}") for i in range(1, 6)])


@query("jon20_whole_key_sets", "(SELECT c_custkey AS k, 'left' AS side FROM customer EXCEPT SELECT o_custkey + 10, 'left' FROM orders) UNION ALL (SELECT o_custkey + 10, 'right' FROM orders EXCEPT SELECT c_custkey, 'right' FROM customer)")
def _(t):
    return R.key_set_difference(t("customer").select(F.col("c_custkey").alias("k")), t("orders").select((F.col("o_custkey") + 10).alias("k")), ["k"])


@query("agg12_whole_coalescing_union", """WITH u AS (SELECT c_custkey AS k, nullif(c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END) AS name, NULL AS bal, 0 AS o FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, 1 FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, 2 FROM customer)
    SELECT k, arg_min(name, o) FILTER (WHERE name IS NOT NULL) AS name, arg_min(bal, o) FILTER (WHERE bal IS NOT NULL) AS bal FROM u GROUP BY k""")
def _(t):
    c, s = t("customer"), t("supplier")
    k, name = F.col("c_custkey").alias("k"), F.nullif("c_name", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name"))).alias("name")
    return R.coalescing_union([c.select(k, name), s.select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")), c.select(k, F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))], ["k"])


@query("dom14_windows_anywhere", """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) * (doc_id % 5) // 4 - 8 AS s FROM documents),
    p AS (SELECT *, greatest(0, -s) AS l, greatest(0, s + 16 - length(t)) AS r FROM d)
    SELECT doc_id, repeat('N', l) || substr(t, greatest(0, s) + 1, 16 - l - r) || repeat('N', r) AS s FROM p""")
def _(t):
    text = F.coalesce("text", F.lit(""))
    start = (F.floor(F.length(text) * (F.col("doc_id") % 5) / 4) - 8).cast("int")
    return t("documents").select("doc_id", G.extract_window(text, start, 16).alias("s"))


from . import domain, rows  # noqa: E402,F401  they register further queries
