"""Stage flows, audits, policy intervals, chains, grids and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import flow, rules
from sluice.operators.history import latest
from sluice.plans.registry import query
from sluice.session import table


@query(
    "cycle_flow_star",
    """
    WITH base AS (SELECT n_nationkey, n_name FROM nation),
    c AS (SELECT c_nationkey AS n_nationkey, count(*) AS received FROM customer GROUP BY 1),
    o AS (SELECT c_nationkey AS n_nationkey, count(DISTINCT o_orderkey) AS observable, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS selected, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS withdrawn FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    s AS (SELECT s_nationkey AS n_nationkey, count(*) AS evaluators, max(s_name) AS grade FROM supplier GROUP BY 1)
    SELECT n_name, coalesce(received, 0)::bigint AS received, coalesce(observable, 0)::bigint AS observable, coalesce(selected, 0)::bigint AS selected, coalesce(withdrawn, 0)::bigint AS withdrawn, coalesce(evaluators, 0)::bigint AS evaluators, grade,
      greatest(coalesce(observable, 0) - coalesce(selected, 0) - coalesce(withdrawn, 0), 0)::bigint AS other,
      CASE WHEN coalesce(observable, 0) > coalesce(received, 0) THEN 'observable_gt_received' ELSE '' END AS violations,
      CASE WHEN observable > 0 THEN round(selected / observable::double, 6) END AS selected_share
    FROM base LEFT JOIN c USING (n_nationkey) LEFT JOIN o USING (n_nationkey) LEFT JOIN s USING (n_nationkey)
    """,
)
def cycle_flow_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by nation from three pre-aggregated sides, with violations and a guarded share."""
    customer, orders, supplier = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    key = "n_nationkey"
    received = customer.groupBy(F.col("c_nationkey").alias(key)).agg(F.count("*").alias("received"))
    joined = orders.select("o_orderkey", "o_orderstatus", "o_custkey").join(customer.select("c_custkey", F.col("c_nationkey").alias(key)), F.col("o_custkey") == F.col("c_custkey"))
    status = lambda s: F.count_distinct(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    seen = joined.groupBy(key).agg(F.count_distinct("o_orderkey").alias("observable"), status("F").alias("selected"), status("P").alias("withdrawn"))
    people = supplier.groupBy(F.col("s_nationkey").alias(key)).agg(F.count("*").alias("evaluators"), F.max("s_name").alias("grade"))
    out = flow.star(table(spark, sf_dir, "nation").select(key, "n_name"), key, received, seen, people)
    out = out.fillna(0, ["received", "observable", "selected", "withdrawn", "evaluators"])
    zero = F.lit(0)
    violations = flow.flow_checks(F.col("received"), F.col("observable"), zero, zero, zero)
    share = F.when(F.col("observable") > 0, F.round(F.col("selected") / F.col("observable"), 6))
    other = F.greatest(F.col("observable") - F.col("selected") - F.col("withdrawn"), F.lit(0).cast("long"))
    return out.select("n_name", "received", "observable", "selected", "withdrawn", "evaluators", "grade", other.alias("other"), F.array_join(violations, ",").alias("violations"), share.alias("selected_share"))


@query(
    "grade_firewall",
    """
    WITH g AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 300000 THEN 'A' WHEN o_totalprice > 200000 THEN 'B' WHEN o_totalprice > 100000 THEN 'C' WHEN o_totalprice > 50000 THEN 'D' ELSE 'U' END AS grade FROM orders)
    SELECT 'entry_selection' AS analysis, count(*)::bigint AS n FROM g WHERE grade = 'A' UNION ALL SELECT 'stage_selection', count(*) FROM g WHERE grade IN ('A', 'B')
    UNION ALL SELECT 'evaluation', count(*) FROM g WHERE grade IN ('A', 'B', 'C') UNION ALL SELECT 'portfolio', count(*) FROM g WHERE grade IN ('A', 'B', 'C', 'D')
    """,
)
def grade_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each analysis admits."""
    p = F.col("o_totalprice")
    grade = F.when(p > 300000, "A").when(p > 200000, "B").when(p > 100000, "C").when(p > 50000, "D").otherwise("U")
    names = ("entry_selection", "stage_selection", "evaluation", "portfolio")
    counts = table(spark, sf_dir, "orders").select(grade.alias("grade")).agg(*[F.count_if(rules.admitted(F.col("grade"), n)).alias(n) for n in names])
    return counts.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("analysis", "n"))


@query("anti_orphans", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a late order."""
    late = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return flow.orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), late, "c_custkey", "o_custkey")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*)::bigint AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) <> 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of lineitem that occur more than once."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where(F.col("n") != 1)


@query(
    "filtered_distinct",
    """
    SELECT l_returnflag, count(DISTINCT l_orderkey)::bigint AS all_orders, count(DISTINCT l_orderkey) FILTER (WHERE l_linestatus = 'O')::bigint AS open_orders, count(*) FILTER (WHERE l_discount > 0.05)::bigint AS discounted FROM lineitem GROUP BY ALL
    """,
)
def filtered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct and filtered counts."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.count_distinct("l_orderkey").alias("all_orders"), F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_orderkey"))).alias("open_orders"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))
    )


@query(
    "interval_overlap_join",
    """
    WITH p AS (SELECT o_custkey AS k, o_orderkey AS pid, o_orderdate AS vf, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS vt FROM orders),
    q AS (SELECT c_custkey AS k, TIMESTAMP '1995-03-01' AS st, TIMESTAMP '1995-06-01' AS en, CASE WHEN c_custkey % 10 = 0 THEN c_custkey END AS declared FROM customer),
    m AS (SELECT q.k, max(row(vf, pid)) AS best FROM q JOIN p ON p.k = q.k AND vf <= en AND (vt IS NULL OR vt >= st) GROUP BY 1)
    SELECT q.k AS c_custkey, coalesce(declared, best[2]) AS matched_id, CASE WHEN declared IS NOT NULL THEN 'source_declared' WHEN best IS NOT NULL THEN 'interval_overlap' ELSE 'explicit_unknown_pointer' END AS match_method
    FROM q LEFT JOIN m USING (k)
    """,
)
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order interval that overlaps a quarter, per customer; every tenth customer declares one."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pid"), F.col("o_orderdate").alias("vf"))
    policies = orders.withColumn("vt", F.lead("vf").over(Window.partitionBy("k").orderBy("vf", "pid")))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    cycles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), day("1995-03-01").alias("st"), day("1995-06-01").alias("en"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey")).alias("declared"))
    return flow.match_interval(cycles, policies, "k", "st", "en", "vf", "vt", "pid", "declared").select(F.col("k").alias("c_custkey"), "matched_id", "match_method")


@query(
    "verified_metrics",
    """
    WITH d AS (SELECT l_orderkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'reject' ELSE 'other' END AS outcome FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_linenumber DESC, l_partkey DESC, l_returnflag DESC) rn FROM lineitem) WHERE rn = 1)
    SELECT l_suppkey, count(*)::bigint AS decided, count(*) FILTER (WHERE outcome = 'accept')::bigint AS accepted, count(*) FILTER (WHERE outcome = 'reject')::bigint AS rejected, round(count(*) FILTER (WHERE outcome = 'accept') / count(*)::double, 6) AS accept_share FROM d GROUP BY 1
    """,
)
def verified_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest decision of each (supplier, order), counted by supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_returnflag")
    last = latest(rows, ["l_suppkey", "l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_returnflag"])
    yes, no = F.count_if(F.col("l_returnflag") == "A"), F.count_if(F.col("l_returnflag") == "R")
    return last.groupBy("l_suppkey").agg(F.count("*").alias("decided"), yes.alias("accepted"), no.alias("rejected"), F.round(yes / F.count("*"), 6).alias("accept_share"))


@query(
    "turn_gaps",
    "SELECT conv_id, array_to_string(list_sort(list_filter(range(1, max(turn) + 1), lambda x: NOT list_contains(list(turn), x))), ',') AS missing FROM conversations WHERE role <> 'system' AND turn % 3 <> 1 GROUP BY conv_id HAVING max(turn) >= 1",
)
def turn_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers missing from filtered conversations."""
    kept = table(spark, sf_dir, "conversations").where((F.col("role") != "system") & (F.col("turn") % 3 != 1))
    top = flow.missing_numbers(kept, "conv_id", "turn")
    has = kept.groupBy("conv_id").agg(F.max("turn").alias("m")).where(F.col("m") >= 1).select("conv_id")
    return top.join(has, "conv_id").select("conv_id", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@query(
    "gate_chain_flags",
    "SELECT o_orderkey, (row_number() OVER w - 1)::bigint AS position, row_number() OVER w = 1 AS left_censored, row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) AS right_censored FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def gate_chain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and censoring flags in each customer's chain of orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return flow.chain_positions(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "position", "left_censored", "right_censored")


@query(
    "timeline_check",
    "SELECT o_custkey, bool_and(p IS NULL OR o_totalprice >= p) AS ordered FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) p FROM orders) GROUP BY 1",
)
def timeline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose order prices never fall."""
    return flow.non_decreasing(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice")


@query("hash_sample", "SELECT doc_id, lang FROM documents ORDER BY sha256(doc_id::varchar) LIMIT 50")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents with the smallest hashes."""
    return flow.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@query(
    "stratified_sample",
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::varchar)) rn FROM documents) ORDER BY rn, source LIMIT 45",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """45 documents in turn from the sources, by hash."""
    return flow.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 45)


@query(
    "sensitivity_grid",
    """
    SELECT o_orderpriority, f AS fraction, ceil(observed / f)::bigint AS implied, (ceil(observed / f) - observed)::bigint AS hidden
    FROM (SELECT o_orderpriority, count(*) AS observed FROM orders GROUP BY 1) CROSS JOIN (SELECT unnest([0.1, 0.2, 0.33, 0.5, 0.67, 0.8, 1.0])::double AS f)
    """,
)
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implied and hidden counts over a grid of observed fractions."""
    seen = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("observed"))
    grid = seen.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in (0.1, 0.2, 0.33, 0.5, 0.67, 0.8, 1.0)])))
    implied = F.ceil(F.col("observed") / F.col("fraction"))
    return grid.select("o_orderpriority", "fraction", implied.alias("implied"), (implied - F.col("observed")).alias("hidden"))


@query(
    "maturity_windows",
    """
    SELECT w AS window_days, count(*) FILTER (WHERE age >= w)::bigint AS mature, count(*) FILTER (WHERE age < w)::bigint AS immature FROM (
      SELECT date_diff('day', o_orderdate::date, DATE '1998-08-02') AS age FROM orders) CROSS JOIN (SELECT unnest([365, 730, 1095, 1825]) AS w) GROUP BY 1
    """,
)
def maturity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders old enough for each follow-up window at a cutoff."""
    ages = table(spark, sf_dir, "orders").select(F.date_diff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date")).alias("age"))
    windows = ages.select("age", F.explode(F.array(*map(F.lit, (365, 730, 1095, 1825)))).alias("window_days"))
    return windows.groupBy("window_days").agg(F.count_if(F.col("age") >= F.col("window_days")).alias("mature"), F.count_if(F.col("age") < F.col("window_days")).alias("immature"))


@query("group_by_all_cells", "SELECT year(o_orderdate)::int AS y, o_orderstatus, o_orderpriority, count(*)::bigint AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def group_by_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of three attributes."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "lineage_quarantine",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey = l_linenumber AS self_loop, l_shipdate < o_orderdate AND l_returnflag <> 'N' AS temporally_impossible FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_suppkey = l_linenumber OR (l_shipdate < o_orderdate AND l_returnflag <> 'N')
    """,
)
def lineage_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that point at themselves or back in time."""
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    both = edges.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    marked = both.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") == F.col("l_linenumber")).alias("self_loop"), ((F.col("l_shipdate") < F.col("o_orderdate")) & (F.col("l_returnflag") != "N")).alias("temporally_impossible"))
    return marked.where(F.col("self_loop") | F.col("temporally_impossible"))
