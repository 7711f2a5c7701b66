"""Queries of projections, joins, aggregates, windows, sorts, sets, reshapes and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import curation as U
from ..operators import relational as R
from ..operators import statistics as S
from .registered import query


def _add(name, sql, f):
    query(name, sql)(f)


_c = F.col

# Projections and predicates
_add("prj01_select_exclude", "SELECT * EXCLUDE (o_orderdate, o_totalprice) FROM orders", lambda t: t("orders").drop("o_orderdate", "o_totalprice"))
_add("prj02_selectors", "SELECT l_discount, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_suppkey FROM lineitem", lambda t: (lambda d: d.select(*C.starting_with(d, "l_di", "l_li"), *C.ending_with(d, "key")))(t("lineitem")))
_add("prj03_rename", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation", lambda t: t("nation").select("n_nationkey", "n_name", "n_regionkey").withColumnsRenamed({"n_nationkey": "key", "n_name": "name", "n_regionkey": "region"}))
_add("prj04_prefix", "SELECT c_custkey, c_acctbal AS ds_c_acctbal, c_mktsegment AS ds_c_mktsegment FROM customer", lambda t: C.prefixed(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "ds", ["c_custkey"]))
_add("prj08_membership", "SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') IN ('1-URGENT', '5-LOW') AS plain, coalesce(nullif(o_orderpriority, '2-HIGH') IN ('1-URGENT', '5-LOW'), false) AS known FROM orders", lambda t: t("orders").withColumn("p", F.nullif("o_orderpriority", F.lit("2-HIGH"))).select("o_orderkey", _c("p").isin("1-URGENT", "5-LOW").alias("plain"), F.coalesce(_c("p").isin("1-URGENT", "5-LOW"), F.lit(False)).alias("known")))
_add("prj10_any_substring", "SELECT p_partkey, CAST(coalesce(contains(nullif(p_type, (SELECT min(p_type) FROM part)), 'STEEL'), false) OR p_size > 45 AS INT) AS label FROM part", lambda t: t("part").crossJoin(F.broadcast(t("part").agg(F.min("p_type").alias("m")))).withColumn("a", F.contains(F.nullif("p_type", "m"), F.lit("STEEL"))).withColumn("b", _c("p_size") > 45).select("p_partkey", C.any_true(["a", "b"]).alias("label")))
_add("prj11_all_finite", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE isfinite(ln(l_discount * 100 + CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE 1 END)) AND nullif(l_quantity, 7) IS NOT NULL", lambda t: t("lineitem").withColumns({"a": F.log(_c("l_discount") * 100 + F.when(_c("l_tax") == 0, float("nan")).otherwise(1.0)), "b": F.nullif("l_quantity", F.lit(7.0))}).where(C.all_finite(["a", "b"])).select("l_orderkey", "l_linenumber"))
_add("prj13_mean_of_exp", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0.05 THEN exp(l_discount) ELSE (exp(l_discount) + exp(l_tax)) / 2 END, 9) AS m FROM lineitem", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.round(C.mean_of([F.exp("l_discount"), F.exp(F.nullif("l_tax", F.lit(0.05)))]), 9).alias("m")))
_add("prj14_single_base", "SELECT p_partkey FROM part WHERE length(split_part(p_brand, '#', 2)) = 2 AND length(CAST(p_size AS VARCHAR)) = 1", lambda t: t("part").where(C.single(F.split_part("p_brand", F.lit("#"), F.lit(2)), 2) & C.single(_c("p_size").cast("string"))).select("p_partkey"))
_add("prj15_autosomes", "SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 1 AND 22", lambda t: t("nation").where(C.autosome(F.concat(F.lit("chr"), _c("n_nationkey").cast("string")))).select("n_nationkey"))
_add("prj17_quality_flags", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_tax > 0.04) AND NOT (l_discount > 0.05)", lambda t: t("lineitem").where(~(_c("l_tax") > 0.04) & ~(_c("l_discount") > 0.05)).select("l_orderkey", "l_linenumber"))
_add("prj18_filter_chain", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 2 AND l_returnflag IN ('A', 'R') AND length(l_linestatus) = 1 AND l_suppkey % 25 BETWEEN 1 AND 22", lambda t: t("lineitem").where(_c("l_linenumber") >= 2).where(_c("l_returnflag").isin("A", "R")).where(C.single(_c("l_linestatus"))).where(C.autosome(F.concat(F.lit("chr"), (_c("l_suppkey") % 25).cast("string")))).select("l_orderkey", "l_linenumber"))
_add("prj19_dot_and_null", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' AND nullif(l_linenumber, 3) IS NOT NULL", lambda t: t("lineitem").withColumn("alt", F.when(_c("l_returnflag") == "N", ".").otherwise(_c("l_returnflag"))).where((_c("alt") != ".") & F.nullif("l_linenumber", F.lit(3)).isNotNull()).select("l_orderkey", "l_linenumber"))
_add("prj20_only_excluded", "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))", lambda t: t("customer").join(t("customer").where("c_mktsegment = 'BUILDING'").join(t("orders"), _c("c_custkey") == _c("o_custkey"), "left_anti").select("c_custkey"), "c_custkey", "left_anti").select("c_custkey"))
_add("prj23_biotype_all_or_one", "SELECT 'all' AS b, count(*) AS n FROM orders UNION ALL SELECT '1-URGENT', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'", lambda t: C.only(t("orders"), "o_orderpriority", "all").agg(F.lit("all").alias("b"), F.count("*").alias("n")).unionAll(C.only(t("orders"), "o_orderpriority", "1-URGENT").agg(F.lit("1-URGENT").alias("b"), F.count("*").alias("n"))))
_add("prj24_literals", "SELECT r_regionkey, 'x' AS a, 1 AS b, NULL::VARCHAR AS c FROM region", lambda t: t("region").select("r_regionkey", F.lit("x").alias("a"), F.lit(1).alias("b"), F.lit(None).cast("string").alias("c")))
_add("prj25_three_way", "SELECT o_orderkey, CASE WHEN nullif(o_orderpriority, '3-MEDIUM') IS NULL THEN 'None' WHEN o_orderpriority = '1-URGENT' THEN 'pos' ELSE 'neg' END AS k FROM orders", lambda t: t("orders").withColumn("p", F.nullif("o_orderpriority", F.lit("3-MEDIUM"))).select("o_orderkey", F.when(_c("p").isNull(), "None").when(_c("p") == "1-URGENT", "pos").otherwise("neg").alias("k")))
_add("prj26_keyword_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'", lambda t: C.equal_to(t("orders"), o_orderstatus="F", o_orderpriority="5-LOW").select("o_orderkey"))
_add("prj27_expression", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P'", lambda t: t("orders").where("o_totalprice > 1000 and o_orderstatus <> 'P'").select("o_orderkey"))
_add("prj28_retained_rejected", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'retained' ELSE 'rejected' END AS part FROM lineitem", lambda t: (lambda a, b: a.withColumn("part", F.lit("retained")).unionAll(b.withColumn("part", F.lit("rejected"))).select("l_orderkey", "l_linenumber", "part"))(*R.split(t("lineitem"), _c("l_returnflag") == "A")))
_add("prj29_rebuild_labels", "SELECT o_custkey, CASE WHEN max(o_totalprice) >= 200000 THEN 'high' ELSE 'low' END AS label FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1 HAVING max(o_totalprice) >= 200000 OR max(o_totalprice) <= 100000", lambda t: t("orders").where(_c("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_custkey").agg(F.max("o_totalprice").alias("p")).select("o_custkey", F.when(_c("p") >= 200000, "high").when(_c("p") <= 100000, "low").alias("label")).where("label is not null"))

# Joins
_add("jon03_left_order_kept", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", lambda t: t("orders").join(t("customer"), _c("o_custkey") == _c("c_custkey")).drop("c_custkey").orderBy("o_orderkey").select("o_orderkey", "c_name"))
_add("jon04_one_to_many", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey", lambda t: R.validated_join(t("orders").withColumnRenamed("o_orderkey", "k"), t("lineitem").withColumnRenamed("l_orderkey", "k"), ["k"], validate="1:m").select(_c("k").alias("o_orderkey"), "l_linenumber"))
_add("jon05_chain", "SELECT k, a, b, c FROM (SELECT o_custkey AS k, count(*) AS a FROM orders GROUP BY 1) JOIN (SELECT c_custkey AS k, c_acctbal AS b FROM customer) USING (k) JOIN (SELECT o_custkey AS k, max(o_totalprice) AS c FROM orders GROUP BY 1) USING (k)", lambda t: R.validated_join(R.validated_join(t("orders").groupBy(_c("o_custkey").alias("k")).agg(F.count("*").alias("a")), t("customer").select(_c("c_custkey").alias("k"), _c("c_acctbal").alias("b")), ["k"], validate="1:1"), t("orders").groupBy(_c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("c")), ["k"], validate="1:1"))
_add("jon06_suffix", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_quantity AS l_quantity_right FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", lambda t: R.suffixed_join(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"]))
_add("jon09_left_one_to_one", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey", lambda t: R.validated_join(t("customer"), t("orders").groupBy(_c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), ["c_custkey"], "left", "1:1").select("c_custkey", "n"))
_add("jon11_anti_composite", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)", lambda t: t("lineitem").join(t("lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_anti").select("l_partkey", "l_suppkey").distinct())
_add("jon15_position_alleles", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_returnflag = CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' END", lambda t: t("lineitem").join(t("orders").select(_c("o_orderkey").alias("l_orderkey"), F.when(_c("o_orderstatus") == "F", "R").when(_c("o_orderstatus") == "O", "N").alias("l_returnflag"), "o_totalprice"), ["l_orderkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "o_totalprice"))
_add("jon16_position_filter", "SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY 1", lambda t: t("lineitem").join(t("part").where("p_size < 5").select(_c("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")))
_add("jon18_shared_keys", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", lambda t: t("customer").select(_c("c_custkey").alias("k")).intersect(t("orders").select(_c("o_custkey").alias("k"))))
_add("jon19_pairs_by_draw", "WITH m AS (SELECT l_linenumber AS draw, l_returnflag AS model, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT 'A' AS x, 'R' AS y UNION ALL SELECT 'N', 'R') SELECT a.draw, x, y, b.v - a.v AS d FROM p JOIN m a ON a.model = x JOIN m b ON b.model = y AND a.draw = b.draw", lambda t: R.pair_differences(t("lineitem").groupBy(_c("l_linenumber").alias("draw"), _c("l_returnflag").alias("model")).agg(F.sum("l_quantity").alias("v")), [("A", "R"), ("N", "R")], ["draw"], "model", "v").select("draw", "x", "y", "d"))
_add("jon22_optional_lookup", "SELECT p_partkey, s_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey", lambda t: R.validated_join(t("part").withColumnRenamed("p_partkey", "k"), t("supplier").withColumnRenamed("s_suppkey", "k"), ["k"], "left", "m:1").select(_c("k").alias("p_partkey"), "s_name"))
_add("jon23_null_keys", "SELECT count(*) AS n FROM (SELECT nullif(o_custkey % 3, 0) AS k FROM orders) a JOIN (SELECT nullif(n_nationkey % 3, 0) AS k FROM nation) b ON a.k = b.k", lambda t: t("orders").select(F.nullif(_c("o_custkey") % 3, F.lit(0)).alias("k")).join(t("nation").select(F.nullif(_c("n_nationkey") % 3, F.lit(0)).alias("k")), "k").agg(F.count("*").alias("n")))
_add("jon24_key_widths", "SELECT l_orderkey, l_linenumber, a, b FROM lineitem LEFT JOIN (SELECT l_orderkey, min(l_tax) AS a FROM lineitem WHERE l_tax > 0.03 GROUP BY 1) USING (l_orderkey) LEFT JOIN (SELECT l_orderkey, l_linenumber, l_discount AS b FROM lineitem WHERE l_discount > 0.05) USING (l_orderkey, l_linenumber)", lambda t: t("lineitem").join(t("lineitem").where("l_tax > 0.03").groupBy("l_orderkey").agg(F.min("l_tax").alias("a")), "l_orderkey", "left").join(t("lineitem").where("l_discount > 0.05").select("l_orderkey", "l_linenumber", _c("l_discount").alias("b")), ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "a", "b"))

# Aggregates
_add("agg01_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2", lambda t: t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))
_add("agg03_any", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS v FROM lineitem GROUP BY 1", lambda t: t("lineitem").groupBy("l_orderkey").agg(F.bool_or(_c("l_returnflag") == "R").alias("v")))
_add("agg04_all_known", "SELECT l_orderkey, bool_and(coalesce(nullif(l_returnflag, 'N') = 'R', false)) AS v FROM lineitem GROUP BY 1", lambda t: t("lineitem").groupBy("l_orderkey").agg(F.bool_and(F.coalesce(F.nullif("l_returnflag", F.lit("N")) == "R", F.lit(False))).alias("v")))
_add("agg07_max", "SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1", lambda t: t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v")))
_add("agg08_first_by_other", "SELECT o_custkey, arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS v FROM orders GROUP BY 1", lambda t: t("orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_totalprice", -_c("o_orderkey"))).alias("v")))
_add("agg10_filtered_max", "SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS v FROM lineitem GROUP BY 1", lambda t: t("lineitem").groupBy("l_orderkey").agg(F.expr("max(l_quantity) FILTER (WHERE l_returnflag = 'R')").alias("v")))
_add("agg15_mean_std", "SELECT event_type, round(avg(value), 7) AS m, round(stddev_samp(value), 7) AS s FROM events GROUP BY 1", lambda t: t("events").groupBy("event_type").agg(F.round(F.avg("value"), 7).alias("m"), F.round(F.stddev_samp("value"), 7).alias("s")))
_add("agg18_linear_quantile", "SELECT event_type, round(quantile_cont(value, 0.01), 6) AS a, round(quantile_cont(value, 0.99), 6) AS b FROM events GROUP BY 1", lambda t: t("events").groupBy("event_type").agg(F.round(F.percentile("value", 0.01), 6).alias("a"), F.round(F.percentile("value", 0.99), 6).alias("b")))
_add("agg19_rate_grid", "SELECT l_linenumber, l_returnflag, round(avg(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END), 9) AS r, count(*) AS n FROM lineitem GROUP BY 1, 2", lambda t: t("lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.round(F.avg((_c("l_quantity") > 25).cast("int")), 9).alias("r"), F.count("*").alias("n")))
_add("agg20_sum", "SELECT l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1", lambda t: t("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v")))
_add("agg22_conflict_count", "SELECT l_partkey, greatest(count(DISTINCT l_returnflag), count(DISTINCT l_linestatus)) AS n FROM lineitem GROUP BY 1", lambda t: t("lineitem").groupBy("l_partkey").agg(F.greatest(R.distinct_with_null("l_returnflag"), R.distinct_with_null("l_linestatus")).alias("n")))
_add("agg23_global_scalar", "SELECT o_orderkey, round(o_totalprice / (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F'), 8) AS v FROM orders", lambda t: t("orders").crossJoin(F.broadcast(t("orders").where("o_orderstatus = 'F'").agg(F.avg("o_totalprice").alias("m")))).select("o_orderkey", F.round(_c("o_totalprice") / _c("m"), 8).alias("v")))
_add("agg25_by_reason", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size < 5 THEN 'too_short' WHEN p_size > 45 THEN 'too_long' WHEN p_brand = 'Brand#11' THEN 'brand' END AS reason FROM part) WHERE reason IS NOT NULL GROUP BY 1", lambda t: t("part").select(F.when(_c("p_size") < 5, "too_short").when(_c("p_size") > 45, "too_long").when(_c("p_brand") == "Brand#11", "brand").alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")))
_add("agg28_weighted_mean", "SELECT l_partkey, l_linenumber, round(sum(l_quantity * l_tax) / nullif(sum(l_tax), 0), 7) AS v FROM lineitem GROUP BY 1, 2", lambda t: t("lineitem").groupBy("l_partkey", "l_linenumber").agg(F.round(F.try_divide(F.sum(_c("l_quantity") * _c("l_tax")), F.sum("l_tax")), 7).alias("v")))
_add("agg31_equal_weight_groups", "SELECT l_returnflag, round(avg(m), 7) AS v FROM (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1", lambda t: t("lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("m")).groupBy("l_returnflag").agg(F.round(F.avg("m"), 7).alias("v")))
_add("agg32_mean_by_dataset", "SELECT lang, round(avg(quality), 9) AS q, round(avg(toxic), 9) AS x FROM documents JOIN labels USING (doc_id) GROUP BY 1", lambda t: t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.round(F.avg("quality"), 9).alias("q"), F.round(F.avg("toxic"), 9).alias("x")))
_add("agg33_most_common", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1 ORDER BY n DESC, w LIMIT 5", lambda t: t("part").select(F.explode(F.split("p_type", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(5))

# Windows and order
_add("win01_row_number", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INT) AS draw FROM lineitem", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("draw")))
_add("win03_dense_codes", "SELECT DISTINCT o_custkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS code FROM orders", lambda t: R.rank_globally(t("orders").select("o_custkey").distinct(), [_c("o_custkey")]).withColumnRenamed("__rank", "code"))
_add("win05_neighbours", "SELECT l_orderkey, l_linenumber, coalesce(l_partkey < lag(l_partkey) OVER w, false) AS overlaps FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber, l_partkey)", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.coalesce(_c("l_partkey") < F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_suppkey", "l_linenumber", "l_partkey")), F.lit(False)).alias("overlaps")))
_add("win06_ordinal", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS i FROM part", lambda t: R.rank_globally(t("part").select("p_partkey"), [_c("p_partkey")]).withColumnRenamed("__rank", "i"))
_add("srt04_composite_key", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag, l_linestatus, l_suppkey, l_partkey, l_shipdate, l_quantity, l_orderkey, l_linenumber LIMIT 50", lambda t: t("lineitem").orderBy(F.struct("l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber").limit(50))
_add("srt05_contig_order", "SELECT o_orderkey FROM orders JOIN (SELECT n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS i, n_nationkey FROM nation) ON o_custkey % 25 = n_nationkey ORDER BY i, o_orderkey LIMIT 30", lambda t: t("orders").join(F.broadcast(R.rank_globally(t("nation"), [_c("n_regionkey"), _c("n_nationkey")])), _c("o_custkey") % 25 == _c("n_nationkey")).orderBy("__rank", "o_orderkey").limit(30).select("o_orderkey"))
_add("srt06_mixed_directions", "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderpriority, '1-URGENT') DESC NULLS LAST, o_totalprice, o_orderkey LIMIT 40", lambda t: t("orders").orderBy(F.nullif("o_orderpriority", F.lit("1-URGENT")).desc_nulls_last(), "o_totalprice", "o_orderkey").limit(40).select("o_orderkey"))
_add("smp04_fixed_n", "SELECT CAST(least(50, count(*)) AS BIGINT) AS n, CAST(least(50, count(*)) AS BIGINT) AS distinct_n FROM customer", lambda t: R.sample_n(t("customer"), ["c_custkey"], 50, 3).agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("distinct_n")))
_add("smp05_fixed_n_by_group", "SELECT c_mktsegment, least(7, count(*)) AS n FROM customer GROUP BY 1", lambda t: R.sample_n(t("customer"), ["c_custkey"], 7, 3, ["c_mktsegment"]).groupBy("c_mktsegment").agg(F.count("*").alias("n")))

# Sets and reshapes
_add("set01_union_all", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier", lambda t: t("customer").select(_c("c_name").alias("name")).unionByName(t("supplier").select(_c("s_name").alias("name"))))
_add("set02_diagonal_union", "SELECT c_name AS name, c_acctbal AS bal, NULL::VARCHAR AS seg FROM customer UNION ALL SELECT s_name, s_suppkey, 'x' FROM supplier", lambda t: t("customer").select(_c("c_name").alias("name"), _c("c_acctbal").alias("bal")).unionByName(t("supplier").select(_c("s_name").alias("name"), _c("s_suppkey").cast("int").alias("bal"), F.lit("x").alias("seg")), allowMissingColumns=True))
_add("set04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", lambda t: t("lineitem").select("l_returnflag", "l_linestatus").distinct())
_add("set05_difference_examples", "SELECT 'missing' AS side, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)", lambda t: R.key_set_difference(t("customer").select(_c("c_custkey").alias("k")), t("orders").select(_c("o_custkey").alias("k")), ["k"]).where("side = 'left'").agg(F.lit("missing").alias("side"), F.count("*").alias("n"), F.min("k").alias("first")))
_add("set06_arrays", "SELECT p_partkey, len(list_intersect(string_split(p_type, ' '), ['STEEL', 'SMALL'])) AS a, list_contains(string_split(p_type, ' '), 'STEEL') AS b, len(list_filter(string_split(p_type, ' '), lambda x: x <> 'STEEL')) AS c FROM part", lambda t: t("part").withColumn("w", F.split("p_type", " ")).select("p_partkey", F.size(F.array_intersect("w", F.array(F.lit("STEEL"), F.lit("SMALL")))).alias("a"), F.array_contains("w", "STEEL").alias("b"), F.size(F.array_except("w", F.array(F.lit("STEEL")))).alias("c")))
_add("set07_intersect_except", "(SELECT c_nationkey AS k, 'both' AS s FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'first' FROM customer EXCEPT SELECT s_nationkey, 'first' FROM supplier)", lambda t: (lambda a, b: a.intersect(b).withColumn("s", F.lit("both")).unionAll(a.subtract(b).withColumn("s", F.lit("first"))))(t("customer").select(_c("c_nationkey").alias("k")), t("supplier").select(_c("s_nationkey").alias("k"))))
_add("rsh01_explode", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part", lambda t: t("part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("w")))
_add("rsh02_dynamic_pivot", "SELECT event_id, 'k' || (event_id % 5) AS \"A\", CASE WHEN event_id % 2 = 0 THEN 'true' END AS \"FLAG\" FROM events", lambda t: C.info_columns(t("events").select("event_id", F.concat(F.lit("A=x;A=k"), (_c("event_id") % 5).cast("string"), F.when(_c("event_id") % 2 == 0, ";FLAG").otherwise("")).alias("info")), "info"))
_add("rsh06_double_unpivot", "SELECT l_orderkey, l_linenumber, s, d, v FROM (SELECT l_orderkey, l_linenumber, unnest(['tax', 'discount']) AS s, unnest([l_tax, l_discount]) AS v, l_returnflag AS a, l_linestatus AS b FROM lineitem), LATERAL (SELECT unnest([a, b]) AS d)", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", _c("l_tax").alias("tax"), _c("l_discount").alias("discount"), _c("l_returnflag").alias("a"), _c("l_linestatus").alias("b")).unpivot(["l_orderkey", "l_linenumber", "a", "b"], ["tax", "discount"], "s", "v").unpivot(["l_orderkey", "l_linenumber", "s", "v"], ["a", "b"], "which", "d").drop("which"))
_add("rsh07_unnest_struct", "SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1", lambda t: t("orders").groupBy("o_custkey").agg(F.max(F.struct(_c("o_orderkey").alias("k"), _c("o_totalprice").alias("p"))).alias("x")).select("o_custkey", "x.*"))
_add("rsh09_partition", "SELECT l_returnflag AS part, count(*) AS n FROM lineitem GROUP BY 1", lambda t: (lambda parts: parts["A"].unionAll(parts["N"]).unionAll(parts["R"]).groupBy(_c("l_returnflag").alias("part")).agg(F.count("*").alias("n")))(R.parts_by(t("lineitem"), "l_returnflag")))
_add("rsh10_nested_to_long", "SELECT l_orderkey, k, v FROM (SELECT l_orderkey, unnest(['q', 'q', 't']) AS k, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)", lambda t: t("lineitem").select("l_orderkey", F.create_map(F.lit("q"), F.array("l_quantity", "l_discount"), F.lit("t"), F.array("l_tax")).alias("m")).select("l_orderkey", F.explode("m").alias("k", "vs")).select("l_orderkey", "k", F.explode("vs").alias("v")))

# Strings, numbers, lists, JSON
_add("str01_split_get", "SELECT page_id, string_split(url, '/')[1] AS a, string_split(url, '/')[3] AS b, len(string_split(url, '/')) AS n FROM pages", lambda t: t("pages").withColumn("p", F.split("url", "/")).select("page_id", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(2)).alias("b"), F.size("p").alias("n")))
_add("str03_split_once", "SELECT page_id, split_part(url, '/', 1) AS a, substr(url, length(split_part(url, '/', 1)) + 2) AS b FROM pages WHERE contains(url, '/')", lambda t: t("pages").where(F.contains("url", F.lit("/"))).withColumn("p", F.split("url", "/", 2)).select("page_id", _c("p")[0].alias("a"), _c("p")[1].alias("b")))
_add("str05_contains", "SELECT page_id, regexp_matches(url, 'https?://[a-z]+[.]') AS a, contains(url, 'org') AS b FROM pages", lambda t: t("pages").select("page_id", F.rlike("url", F.lit("https?://[a-z]+[.]")).alias("a"), F.contains("url", F.lit("org")).alias("b")))
_add("str06_length", "SELECT doc_id, length(text) AS n FROM documents", lambda t: t("documents").select("doc_id", F.length("text").alias("n")))
_add("str07_prefixes", "SELECT c_custkey, starts_with(c_name, 'Customer#') AS a, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS b FROM customer", lambda t: t("customer").select("c_custkey", F.startswith("c_name", F.lit("Customer#")).alias("a"), C.without_prefix(_c("c_name"), "Customer#").alias("b")))
_add("str08_format", "SELECT l_orderkey || ':' || l_linenumber || ':' || l_returnflag AS v FROM lineitem", lambda t: t("lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_returnflag").alias("v")))
_add("str09_list_join", "SELECT p_partkey, array_to_string(list_reverse(string_split(p_type, ' ')), '|') AS v FROM part", lambda t: t("part").select("p_partkey", F.array_join(F.reverse(F.split("p_type", " ")), "|").alias("v")))
_add("str10_replace_default", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 0 END AS v FROM orders", lambda t: t("orders").select("o_orderkey", C.replace_or(_c("o_orderstatus"), {"F": 4, "O": 3}, 0, "int").alias("v")))
_add("str11_case_strip", "SELECT p_partkey, lower(trim('  ' || p_type || ' ')) AS a, upper(p_brand) AS b FROM part", lambda t: t("part").select("p_partkey", F.lower(F.trim(F.concat(F.lit("  "), "p_type", F.lit(" ")))).alias("a"), F.upper("p_brand").alias("b")))
_add("str13_versions", "SELECT p_partkey, 'ENST' || p_partkey AS a FROM part", lambda t: t("part").select("p_partkey", C.without_version(F.concat(F.lit("ENST"), "p_partkey", F.lit("."), "p_size")).alias("a")))
_add("str14_key_value_decode", "SELECT p_partkey, 'Name' AS k, p_type AS v FROM part", lambda t: t("part").withColumn("x", F.concat(F.lit("Name="), F.replace("p_type", F.lit(" "), F.lit("%20")))).select("p_partkey", *C.key_value(_c("x"), "k", "v")))
_add("str15_find_pairs", "SELECT p_partkey, 'brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part", lambda t: t("part").select("p_partkey", F.explode(C.find_pairs(F.concat(F.lit('brand "'), "p_brand", F.lit('"; size "'), "p_size", F.lit('";')), '([a-z]+) "([^"]*)"')).alias("x")).select("p_partkey", "x.k", "x.v"))
_add("num01_casts", "SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS INT) AS a, try_cast(p_type AS INT) AS b FROM part", lambda t: t("part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int").alias("a"), _c("p_type").try_cast("int").alias("b")))
_add("num02_logs", "SELECT p_partkey, round(log10(p_retailprice), 9) AS a, round(ln(p_retailprice), 9) AS b, round(exp(p_size / 10.0), 6) AS c FROM part", lambda t: t("part").select("p_partkey", F.round(F.log10("p_retailprice"), 9).alias("a"), F.round(F.log("p_retailprice"), 9).alias("b"), F.round(F.exp(_c("p_size") / 10.0), 6).alias("c")))
_add("num03_arithmetic", "SELECT l_orderkey, l_linenumber, -l_quantity AS a, round(l_extendedprice * (1 - l_discount), 4) AS b FROM lineitem", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", (-_c("l_quantity")).alias("a"), F.round(_c("l_extendedprice") * (1 - _c("l_discount")), 4).alias("b")))
_add("num04_known", "SELECT count(*) - count(nullif(l_returnflag, 'R')) AS nulls, count(nullif(l_returnflag, 'R')) AS known, count(*) FILTER (WHERE isfinite(ln(l_tax))) AS finite FROM lineitem WHERE l_tax > 0", lambda t: t("lineitem").where("l_tax > 0").agg(F.count_if(F.nullif("l_returnflag", F.lit("R")).isNull()).alias("nulls"), F.count(F.nullif("l_returnflag", F.lit("R"))).alias("known"), F.count_if(C.finite(F.log("l_tax"))).alias("finite")))
_add("num05_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20", lambda t: t("lineitem").where(_c("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber"))
_add("num06_percent_change", "SELECT l_orderkey, l_linenumber, round(100 * (l_tax - l_discount) / nullif(l_discount, 0), 7) AS v FROM lineitem", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.round(C.percent_change(_c("l_discount"), _c("l_tax")), 7).alias("v")))
_add("num08_shard_bounds", "SELECT CAST(i AS BIGINT) AS shard, (SELECT count(*) FROM orders) * i // 5 AS low, (SELECT count(*) FROM orders) * (i + 1) // 5 AS high FROM generate_series(0, 4) AS g(i)", lambda t: t("orders").agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select(_c("i").cast("long").alias("shard"), F.expr("n * i div 5").alias("low"), F.expr("n * (i + 1) div 5").alias("high")))
_add("num10_vector_distances", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS l2, round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 5) AS top FROM embeddings", lambda t: t("embeddings").select("vec_id", F.round(C.l2_norm(_c("embedding")), 5).alias("l2"), F.round(C.max_abs_difference(_c("embedding"), F.transform("embedding", lambda x: F.lit(0.0))), 5).alias("top")))
_add("lst01_lists", "SELECT p_partkey, len(string_split(p_type, ' ')) AS n, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ' ') AS v FROM part", lambda t: t("part").withColumn("w", F.split("p_type", " ")).select("p_partkey", F.size("w").alias("n"), F.array_join(F.array_sort(F.array_distinct("w")), " ").alias("v")))
_add("jsn01_fallbacks", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' || event_id ELSE 'b' || event_id END AS name FROM events", lambda t: t("events").withColumn("j", F.concat(F.when(_c("event_id") % 2 == 0, '{"name": "a').otherwise('{"names": {"full": "b'), _c("event_id").cast("string"), F.when(_c("event_id") % 2 == 0, '"}').otherwise('"}}'))).select("event_id", C.json_first(_c("j"), "$.name", "$.names.full").alias("name")))
_add("dom36_stars", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 0 END AS stars FROM orders", lambda t: t("orders").select("o_orderkey", U.clinvar_stars(F.when(_c("o_orderpriority") == "1-URGENT", "practice_guideline").when(_c("o_orderpriority") == "2-HIGH", "reviewed_by_expert_panel").when(_c("o_orderpriority") == "3-MEDIUM", "criteria_provided,_multiple_submitters,_no_conflicts").otherwise("no_assertion_provided")).alias("stars")))
_add("dom38_feature_order", "SELECT p_partkey, CAST((p_size > 10)::INT + 2 * (p_size > 20)::INT + 4 * (p_size > 30)::INT AS BIGINT) AS k FROM part", lambda t: t("part").select("p_partkey", C.feature_set_key([_c("p_size") > 10, _c("p_size") > 20, _c("p_size") > 30]).alias("k")))
_add("sta25_group_sizes", "SELECT lang, count(*) AS n, sum(toxic) AS positives FROM documents JOIN labels USING (doc_id) GROUP BY 1", lambda t: t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("positives")))
_add("sta26_correlation_matrix", "SELECT x, y, round(corr(a, b), 7) AS r FROM (SELECT unnest(['l_tax', 'l_tax', 'l_discount', 'l_discount']) AS x, unnest(['l_quantity', 'l_extendedprice', 'l_quantity', 'l_extendedprice']) AS y, unnest([l_tax, l_tax, l_discount, l_discount]) AS a, unnest([l_quantity, l_extendedprice, l_quantity, l_extendedprice]) AS b FROM lineitem) GROUP BY 1, 2", lambda t: S.correlation_matrix(t("lineitem"), ["l_tax", "l_discount"], ["l_quantity", "l_extendedprice"]).withColumn("r", F.round("r", 7)))
_add("sta27_histogram", "SELECT CAST(least(9, floor(l_quantity / 5)) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1", lambda t: S.histogram(t("lineitem"), "l_quantity", 0.0, 50.0, 10))
_add("sta28_log_odds", "SELECT l_orderkey, l_linenumber, round(ln((l_discount + 0.01) / (1 - l_discount - 0.01)), 8) AS v FROM lineitem", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.round(C.log_odds(_c("l_discount") + 0.01), 8).alias("v")))
