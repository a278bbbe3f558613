"""Ledgers, choice sets, alignments and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import ledger, rules
from sluice.plans.registry import query
from sluice.session import table


@query(
    "budget_running_total",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, sum(o_totalprice) OVER w > 1000000 AS beyond FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def budget_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals against a limit."""
    out = ledger.running_total(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 1000000)
    return out.select("o_orderkey", F.round("running", 2).alias("running"), "beyond")


@query(
    "resource_reconciliation",
    """
    WITH a AS (SELECT p_brand, sum(p_retailprice) AS est, sum(p_retailprice * (1 + (p_size % 5) / 10.0)) AS act FROM part GROUP BY 1)
    SELECT p_brand, round(abs(act - est) / est, 6) AS relative_error, abs(act - est) / est > 0.2 AS reforecast FROM a
    """,
)
def resource_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative error of estimates by brand."""
    sums = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("est"), F.sum(F.col("p_retailprice") * (1 + (F.col("p_size") % 5) / 10.0)).alias("act"))
    return ledger.reconciled(sums, "est", "act", 0.2).select("p_brand", F.round("relative_error", 6).alias("relative_error"), "reforecast")


@query(
    "choice_sets",
    """
    SELECT l_orderkey, l_suppkey, CASE WHEN count(DISTINCT l_linenumber) = 1 THEN min(l_linenumber) END AS rank, count(DISTINCT l_linenumber) > 1 AS rank_conflict, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS outcome, count(DISTINCT l_returnflag) > 1 AS outcome_conflict FROM lineitem GROUP BY 1, 2
    """,
)
def choice_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (order, supplier); conflicting ranks are null, conflicting outcomes joined."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("outcome"))
    return ledger.conflict_collapse(li, ["l_orderkey", "l_suppkey"], ["rank", "outcome"])


@query(
    "name_year_profile",
    "SELECT l_returnflag AS name, array_to_string(list(y || ':' || n ORDER BY y), ',') AS years FROM (SELECT l_returnflag, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1",
)
def name_year_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by year as a map for each name."""
    out = ledger.name_year_map(table(spark, sf_dir, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("y")), "l_returnflag", "y")
    pairs = F.transform(F.map_entries("years"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return out.select(F.col("l_returnflag").alias("name"), F.array_join(pairs, ",").alias("years"))


@query(
    "coverage_reconciliation",
    """
    WITH c AS (SELECT c_nationkey, count(*) AS found, max(c_custkey) % 40 + 40 AS e1, min(c_custkey) % 30 + 45 AS e2 FROM customer GROUP BY 1)
    SELECT c_nationkey, greatest(e1, e2)::bigint AS expected, round(least(1.0, found / greatest(e1, e2)::double), 6) AS ratio, CASE WHEN least(1.0, found / greatest(e1, e2)::double) < 0.95 THEN 'U' ELSE 'A' END AS grade FROM c
    """,
)
def coverage_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found against the greatest expected count, with the grade that is left."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("found"), (F.max("c_custkey") % 40 + 40).alias("e1"), (F.min("c_custkey") % 30 + 45).alias("e2")).withColumn("g", F.lit("A"))
    out = rules.reconciled_coverage(c, "found", ["e1", "e2"], "g")
    return out.select("c_nationkey", "expected", F.round("ratio", 6).alias("ratio"), F.col("effective_grade").alias("grade"))


@query(
    "claim_alignment",
    """
    WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2), g AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1, 2)
    SELECT coalesce(f.k, g.k) AS k, coalesce(f.n, g.n) AS n, CASE WHEN f.c > 1 OR g.c > 1 THEN 'duplicate_number_ambiguous' WHEN g.k IS NULL THEN 'not_present_in_final' WHEN f.k IS NULL THEN 'new_in_final' ELSE 'same_number_continuation' END AS state FROM f FULL JOIN g ON f.k = g.k AND f.n = g.n
    """,
)
def claim_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of two versions aligned, in one aggregation."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_suppkey")
    both = li.groupBy("k", "n").agg(F.count_if(F.col("l_suppkey") % 2 == 0).alias("f"), F.count_if(F.col("l_suppkey") % 3 == 0).alias("g")).where((F.col("f") > 0) | (F.col("g") > 0))
    state = F.when((F.col("f") > 1) | (F.col("g") > 1), "duplicate_number_ambiguous").when(F.col("g") == 0, "not_present_in_final").when(F.col("f") == 0, "new_in_final").otherwise("same_number_continuation")
    return both.select("k", "n", state.alias("state"))


@query(
    "visibility_at",
    "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderdate <= TIMESTAMP '1996-01-01' AND (o_orderstatus = 'F' OR TIMESTAMP '1996-01-01' <= o_orderdate + INTERVAL 90 DAY)",
)
def visibility_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders visible at a moment; finished ones stay open-ended."""
    moment = F.lit("1996-01-01").cast("timestamp_ntz")
    audience = F.when(F.col("c_mktsegment") == "BUILDING", "public").when(F.col("c_mktsegment") == "MACHINERY", "reviewer").otherwise("nobody")
    end = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.where(rules.visible_at(moment, "reviewer", F.col("o_orderdate"), end, audience)).select("o_orderkey")


@query(
    "release_gate",
    "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_retailprice > 1500)",
)
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands without passing evidence."""
    p = table(spark, sf_dir, "part")
    return ledger.gate(p.select("p_brand").distinct(), p.select("p_brand", "p_size", "p_retailprice"), "p_brand", (F.col("p_size") == 50) & (F.col("p_retailprice") > 1500))
