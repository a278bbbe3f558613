"""Parts of the report products over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import atlas, matching, novelty
from sluice.plans.registry import query
from sluice.session import table

STOP_WORDS = ("the", "and", "for", "was")


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "textual_recombination",
    """
    WITH w AS (SELECT doc_id, (2015 + doc_id % 7)::int AS y, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9]{2,}'), lambda x: x NOT IN ('the', 'and', 'for', 'was')) AS ws FROM documents),
    u AS (SELECT doc_id, y, unnest(ws) AS unit FROM w UNION ALL SELECT doc_id, y, ws[i] || ' ' || ws[i + 1] FROM (SELECT doc_id, y, ws, unnest(range(1, len(ws))) AS i FROM w) WHERE ws[i] <> ws[i + 1]),
    c AS (SELECT doc_id, y, unit, count(*) AS n FROM u GROUP BY ALL),
    t AS (SELECT doc_id, y, unit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, len(string_split(unit, ' ')) DESC, unit) AS r FROM c) WHERE r <= 12),
    f AS (SELECT unit, min(y) AS first FROM t GROUP BY 1),
    k AS (SELECT doc_id, y, unit FROM t JOIN f USING (unit) WHERE first < y),
    p AS (SELECT a.doc_id, a.y, a.unit AS u, b.unit AS v FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.unit < b.unit),
    s AS (SELECT u, v, y, count(*) AS n FROM p GROUP BY ALL),
    b AS (SELECT u, v, y, coalesce(sum(n) OVER (PARTITION BY u, v ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM s),
    e AS (SELECT doc_id, count(*) AS pairs, avg((prior = 0)::int) AS share, median(prior)::double AS med, quantile_cont(prior, 0.1) AS low FROM p JOIN b USING (u, v, y) GROUP BY 1),
    g AS (SELECT doc_id, count(*) AS units FROM t GROUP BY 1), h AS (SELECT doc_id, count(*) AS known FROM k GROUP BY 1)
    SELECT doc_id, y, coalesce(units, 0)::bigint AS selected_unit_count, coalesce(known, 0)::bigint AS strictly_prior_unit_count, coalesce(pairs, 0)::bigint AS pair_count, round(share, 6) AS new_combination_share, med AS conventionality_median_prior_count,
      round(low, 6) AS novelty_tenth_percentile_prior_count, coalesce(known, 0) >= 2 AS coverage_eligible, CASE WHEN coalesce(known, 0) < 2 THEN 'fewer_than_two_lexical_elements_observed_in_strictly_prior_years' END AS abstention_reason
    FROM w LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN e USING (doc_id)
    """,
)
def textual_recombination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How new each document's pairs of leading units are; the year is made of the number."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.lit(2015) + F.col("doc_id") % 7).cast("int").alias("y"))
    return _round(novelty.textual_recombination(d, "doc_id", F.coalesce("text", F.lit("")), "y", STOP_WORDS), new_combination_share=6, novelty_tenth_percentile_prior_count=6)


@query(
    "rubric_crosswalk",
    """
    WITH r AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'rating' WHEN 'view' THEN 'clarity' ELSE 'k' END AS label, json_extract_string(props, '$.k') AS k FROM events)
    SELECT event_id AS policy_version_id, 'scores.' || label AS native_path, label AS native_label, k AS native_value_json, CASE label WHEN 'rating' THEN 'overall_recommendation' WHEN 'clarity' THEN 'clarity' ELSE '' END AS constructs, CASE label WHEN 'k' THEN 'unmapped' ELSE 'mapped' END AS mapping_status FROM r
    """,
)
def rubric_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the events' properties as rubric fields."""
    label = F.when(F.col("event_type") == "click", "rating").when(F.col("event_type") == "view", "clarity").otherwise("k")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"scores": {"'), label, F.lit('": '), F.get_json_object("props", "$.k"), F.lit("}}")).alias("rubric"))
    out = atlas.rubric_crosswalk(e, "event_id", "rubric", F.lit("events"))
    return out.select("policy_version_id", "native_path", "native_label", "native_value_json", F.array_join("constructs", ",").alias("constructs"), "mapping_status")


_LINKED = """
    SELECT o_orderkey, o_custkey % 20 AS source, o_orderdate AS start, o_orderstatus = 'F' AS linked, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 400 DAY END AS gone FROM orders
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_custkey") % 20).alias("source"), F.col("o_orderdate").alias("start"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("gone"))


_WINDOWED = f"SELECT *, date_diff('day', start::date, DATE '1998-08-02') AS age FROM ({_LINKED}) CROSS JOIN (SELECT unnest([365, 730, 1095, 1825]) AS w)"


@query(
    "outcome_windows",
    f"""
    SELECT w AS window_days, CASE WHEN greatest(age, 0) < w THEN 'immature_excluded' WHEN linked THEN 'relation_observed_timing_unknown' ELSE 'no_relation_detected_right_censored' END AS windowed_publication_status,
      coalesce(greatest(age, 0) >= w AND date_diff('day', start::date, gone::date) <= w, false) AS competing_withdrawal_by_window, count(*)::bigint AS n FROM ({_WINDOWED}) GROUP BY ALL
    """,
)
def outcome_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by window, state and competing withdrawal."""
    out = atlas.outcome_windows(_candidates(spark, sf_dir), F.lit("1998-08-02").cast("date"), "start", F.col("s") == "F", "gone")
    return out.groupBy("window_days", "windowed_publication_status", "competing_withdrawal_by_window").agg(F.count(F.lit(1)).alias("n"))


@query(
    "linkage_bounds",
    f"""
    WITH m AS (SELECT source, w AS window_days, count(*)::bigint AS mature_candidates, count(*) FILTER (linked)::bigint AS observed_declared_relations FROM ({_WINDOWED}) WHERE greatest(age, 0) >= w GROUP BY 1, 2)
    SELECT *, round(observed_declared_relations / mature_candidates::double, 6) AS observed_relation_share, f AS assumed_linkage_capture_fraction, round(least(1.0, observed_declared_relations / mature_candidates::double / f), 6) AS capture_adjusted_publication_share FROM m CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75, 1.0])::double AS f)
    """.replace("SELECT *, round", "SELECT source, window_days, mature_candidates, observed_declared_relations, round"),
)
def linkage_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of links by source and window, and what they would be if some were missed."""
    windows = atlas.outcome_windows(_candidates(spark, sf_dir), F.lit("1998-08-02").cast("date"), "start", F.col("s") == "F", "gone")
    return _round(atlas.linkage_bounds(windows, "source"), observed_relation_share=6, capture_adjusted_publication_share=6)


@query(
    "citation_windows",
    """
    WITH k AS (SELECT l_orderkey, year(l_shipdate) AS cy, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT o_orderkey, year(o_orderdate)::int AS y, unnest([1, 2, 3, 5])::int AS window_years FROM orders)
    SELECT o_orderkey, y, window_years, 1998 >= y + window_years AS mature, coalesce(sum(n) FILTER (1998 >= y + window_years AND cy BETWEEN y AND y + window_years), 0)::bigint AS citation_count, CASE WHEN 1998 >= y + window_years THEN 'mature' ELSE 'immature_excluded' END AS eligibility
    FROM w LEFT JOIN k ON l_orderkey = o_orderkey GROUP BY ALL
    """,
)
def citation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within windows of years behind the order, as citations."""
    works = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("cited_year")).agg(F.count(F.lit(1)).alias("n"))
    return atlas.citation_windows(works, "o_orderkey", "y", counts, 1998)


@query(
    "portfolio_series",
    "SELECT o_orderpriority AS programme, year(o_orderdate)::int AS y, nullif(o_orderstatus, 'P') AS round, count(DISTINCT o_orderkey)::bigint AS awards, round(sum(o_totalprice), 2) AS total_awarded, round(avg((o_orderkey % 3 = 0)::int), 6) AS text_coverage FROM orders GROUP BY ALL",
)
def portfolio_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards by programme, year and round."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("programme"), F.year("o_orderdate").alias("y"), F.nullif("o_orderstatus", F.lit("P")).alias("round"), "o_totalprice")
    return _round(atlas.portfolio_series(o, ["programme", "y", "round"], "o_orderkey", "o_totalprice", F.col("o_orderkey") % 3 == 0), total_awarded=2, text_coverage=6)


@query(
    "repeat_recipients",
    'SELECT o_custkey, count(DISTINCT o_orderkey)::bigint AS awards, min(o_orderdate) AS "first", max(o_orderdate) AS "last", (year(max(o_orderdate)) - year(min(o_orderdate)))::int AS years_between FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 1',
)
def repeat_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of several orders."""
    return atlas.repeat_recipients(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query(
    "vote_panels",
    """
    WITH v AS (SELECT l_orderkey, unnest([CASE WHEN l_linenumber <= 5 THEN l_discount END, l_tax, CASE WHEN l_returnflag = 'N' THEN 0.05 END]) AS vote FROM lineitem)
    SELECT l_orderkey, count(*)::bigint AS votes, round(avg(vote), 6) AS mean_vote, round(max(vote) - min(vote), 6) AS "range", max(vote) = min(vote) AS unanimous FROM v WHERE vote IS NOT NULL GROUP BY 1
    """,
)
def vote_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three voters' columns as votes, by panel."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") <= 5, F.col("l_discount")).alias("a"), F.col("l_tax").alias("b"), F.when(F.col("l_returnflag") == "N", 0.05).alias("c"))
    return _round(atlas.vote_panel(atlas.votes(li, ["l_orderkey"], ["a", "b", "c"]), ["l_orderkey"]), mean_vote=6, range=6)


@query(
    "action_chain",
    """
    SELECT l_orderkey, l_linenumber, row_number() OVER w AS position, lag(l_returnflag) OVER w AS previous, date_diff('day', (lag(l_shipdate) OVER w)::date, l_shipdate::date)::int AS days_since, lead(l_returnflag) OVER w IS NULL AS "last"
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey)
    """,
)
def action_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its chain of actions."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag")
    return atlas.action_chain(li, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], "l_returnflag").select("l_orderkey", "l_linenumber", "position", "previous", "days_since", "last")


@query(
    "prior_art",
    "SELECT l_orderkey, count(*)::bigint AS cited, count(*) FILTER (e)::bigint AS by_examiner FROM (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'R') AS e FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def prior_art(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as cited works."""
    return atlas.prior_art(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), "l_orderkey", "l_partkey", F.col("l_returnflag") == "R")


@query(
    "application_crosswalk",
    """
    SELECT o_orderkey, c_custkey IS NOT NULL AS in_population, CASE WHEN c_custkey IS NOT NULL THEN 'exact_application_match' WHEN year(try_cast(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::date::varchar ELSE 'n/a' END AS date)) BETWEEN 1994 AND 1996 THEN 'within_year_boundary_not_present' ELSE 'outside_filing_year_boundary' END AS population_reconciliation_state, c_mktsegment AS matched_segment
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey
    """,
)
def application_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders reconciled with half of the customers by the digest of a number's digits."""
    from sluice.functions.identifiers import digits_hash

    filed = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date").cast("string")).otherwise("n/a")
    left = table(spark, sf_dir, "orders").select("o_orderkey", digits_hash(F.concat(F.lit("US "), F.col("o_custkey"), F.lit("/A"))).alias("h"), filed.alias("filed"))
    right = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0).select(digits_hash(F.concat(F.lit("no. "), F.col("c_custkey"))).alias("h"), F.col("c_mktsegment").alias("segment"))
    return matching.crosswalk(left, right, "h", "filed", 1994, 1996, ["segment"]).select("o_orderkey", "in_population", "population_reconciliation_state", "matched_segment")


@query(
    "capacity_panel",
    """
    WITH a AS (SELECT l_suppkey % 40 AS unit, year(o_orderdate)::int AS filing_year, l_orderkey, date_diff('day', o_orderdate::date, l_shipdate::date) AS d, (l_returnflag = 'R')::int AS act FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT unit, filing_year, count(DISTINCT l_orderkey)::bigint AS application_count, CASE WHEN count(DISTINCT l_orderkey) >= 10 THEN median(d)::double END AS median_pendency_days, CASE WHEN count(DISTINCT l_orderkey) >= 10 THEN round(avg(act), 6) END AS mean_action_count, count(DISTINCT l_orderkey) < 10 AS small_cell_suppressed FROM a GROUP BY 1, 2
    """,
)
def capacity_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays and actions by unit and year."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 40).alias("u"), "l_shipdate", "l_returnflag")
    j = li.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _round(atlas.capacity_panel(j, "u", "o_orderdate", "l_shipdate", "l_orderkey", F.col("l_returnflag") == "R"), mean_action_count=6)


_NATIVE = "CASE o_orderkey % 5 WHEN 0 THEN 'Accept (oral)' WHEN 1 THEN 'Reject' WHEN 2 THEN 'Withdrawn' WHEN 3 THEN 'pending' END"


@query(
    "stage_outcome_audit",
    f"""
    WITH d AS (SELECT o_orderpriority AS source, {_NATIVE} AS native, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' END AS normalized FROM orders),
    e AS (SELECT *, CASE native WHEN 'Accept (oral)' THEN 'accepted' WHEN 'Reject' THEN 'rejected' WHEN 'Withdrawn' THEN 'withdrawn' END AS expected FROM d)
    SELECT source, native, count(*)::bigint AS population, bool_or(expected IS NOT NULL) AS mapping_supported, count(*) FILTER (normalized IS NOT DISTINCT FROM expected)::bigint AS exact, round(count(*) FILTER (normalized IS NOT DISTINCT FROM expected) / count(*)::double, 6) AS "precision" FROM e GROUP BY 1, 2
    """,
)
def stage_outcome_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised outcomes against what the native text says by itself."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.expr(_NATIVE).alias("native"), F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").alias("normalized"))
    return _round(atlas.stage_outcome_audit(d, "source", "native", "normalized"), precision=6)


@query(
    "descriptive_atlas",
    """
    SELECT c_mktsegment AS platform, count(*)::bigint AS process_cycles, count(*) FILTER (g = 'A')::bigint AS "grade_A", count(*) FILTER (g = 'B')::bigint AS "grade_B", count(*) FILTER (g = 'C')::bigint AS "grade_C", count(*) FILTER (g = 'D')::bigint AS "grade_D", count(*) FILTER (g = 'U')::bigint AS "grade_U",
      count(*) FILTER (c_acctbal > 0)::bigint AS verified_denominators, count(*) FILTER (c_acctbal > 0 AND g IN ('A', 'B'))::bigint AS selection_rate_cycles, count(*) FILTER (c_acctbal > 5000)::bigint AS review_rate_cycles
    FROM (SELECT *, CASE c_nationkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'U' END AS g FROM customer) GROUP BY 1
    """,
)
def descriptive_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles by platform and grade, and which of them allow rates."""
    n = F.col("c_nationkey") % 6
    grade = F.when(n == 0, "A").when(n == 1, "B").when(n == 2, "C").when(n == 3, "D")
    c = table(spark, sf_dir, "customer").withColumn("g", grade)
    known = F.col("c_acctbal") > 0
    return atlas.descriptive_atlas(c.withColumnRenamed("c_mktsegment", "platform"), "platform", "g", known, known & F.coalesce(F.col("g").isin("A", "B"), F.lit(False)), F.col("c_acctbal") > 5000)


@query(
    "moments_panel",
    """
    WITH m AS (SELECT avg(l_quantity) AS a, sqrt(avg((l_discount - 0.05) * (l_discount - 0.05))) AS b, avg(l_tax) AS c, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS s FROM lineitem)
    SELECT 'review_score_mean' AS moment, round(a, 6) AS value FROM m UNION ALL SELECT 'review_score_cycle_z_sd', round(b, 6) FROM m UNION ALL SELECT 'semantic_novelty_mean', round(c, 6) FROM m UNION ALL SELECT 'observed_rejection_share', round(r / greatest(r + s, 1)::double, 6) FROM m UNION ALL SELECT 'rejected_afterlife_cases', r::double FROM m
    """,
)
def moments_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target moments of a calibration."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_discount") - 0.05).alias("z"), "l_tax", F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "selected").alias("o"))
    return _round(atlas.moments(li, "l_quantity", "z", "l_tax", "o"), value=6)


@query(
    "id_set_digest",
    "SELECT o_orderpriority, count(DISTINCT o_custkey)::bigint AS members, sha256(string_agg(DISTINCT o_custkey::varchar, chr(10) ORDER BY o_custkey::varchar)) AS digest FROM orders GROUP BY 1",
)
def id_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the customers of each priority."""
    return atlas.id_digest(table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey"), ["o_orderpriority"], "o_custkey")


@query(
    "ranking_metrics",
    """
    WITH j AS (SELECT quality AS y, least(n_chars, 5000) / 5000.0::double AS s FROM labels JOIN documents USING (doc_id)),
    b AS (SELECT s, sum(y) AS p, count(*) AS n FROM j GROUP BY 1), r AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS pp, sum(n) OVER (ORDER BY s DESC) AS nn FROM b)
    SELECT round(sum(p / (SELECT sum(y) FROM j) * (pp / nn)), 6) AS average_precision, (SELECT round(avg(pow(s - y, 2)), 6) FROM j) AS brier FROM r
    """,
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and Brier score of document length for quality."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", (F.least("n_chars", F.lit(5000)) / 5000.0).alias("s"))
    return _round(atlas.ranking_metrics(j, "quality", "s"), average_precision=6, brier=6)


@query("running_sums", "SELECT c_custkey, round(sum(c_acctbal) OVER (ORDER BY c_acctbal), 2) AS up_to FROM customer")
def running_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances up to each customer's, over ranges."""
    out = atlas.running_sums(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_acctbal"], parts=8)
    return out.select("c_custkey", F.round("c_acctbal_sum", 2).alias("up_to"))


@query("one_to_one_join", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of a table joined back, keys checked on both sides."""
    c = table(spark, sf_dir, "customer")
    return atlas.one_to_one(c.select("c_custkey", "c_name"), c.select("c_custkey", "c_mktsegment"), "c_custkey")


@query("disjoint_union", "SELECT s_suppkey AS k, s_name AS name, NULL::double AS balance FROM supplier UNION ALL SELECT -1 - c_custkey, c_name, c_acctbal FROM customer")
def disjoint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames with keys that must not meet."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return atlas.disjoint_union(s, c, "k")


@query("modulo_shard", "SELECT doc_id, lang FROM documents WHERE doc_id % 8 = 3")
def modulo_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard of eight: the operator itself."""
    return atlas.shard(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 8, 3)


@query("literal_id_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 4, 7, 10, 13, 22)")
def literal_id_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a given list of customers."""
    ids = spark.createDataFrame([(i,) for i in (1, 4, 7, 10, 13, 22)], "o_custkey long")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(F.broadcast(ids), "o_custkey", "left_semi")


@query("valid_in_time", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE coalesce(o_orderdate + INTERVAL 30 DAY <= CASE WHEN l_returnflag <> 'A' THEN l_shipdate END, l_returnflag = 'A')")
def valid_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped a month after the order, or without a known date."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    seen = F.when(F.col("l_returnflag") != "A", F.col("l_shipdate"))
    return j.where(atlas.valid_in_time(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), seen)).select("l_orderkey", "l_linenumber")


@query("first_examples", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 3")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three orders of each priority."""
    return atlas.first_examples(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 3, "o_orderpriority").select("o_orderpriority", "o_orderkey")


@query("distinct_first", "SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_orderdate, o_orderkey LIMIT 25")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 customers that ordered first, each by the first order."""
    return atlas.distinct_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"], 25)


@query("native_mapping", "SELECT o_orderstatus AS native, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS normalized_value, o_orderstatus IN ('F', 'O') AS mapped, count(*)::bigint AS n FROM orders GROUP BY 1")
def native_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native values by a mapping, unmapped ones marked."""
    m = spark.createDataFrame([("tpch", "status", "F", "final"), ("tpch", "status", "O", "open"), ("other", "status", "P", "no")], "source_id string, vocabulary string, native_value string, normalized_value string")
    o = table(spark, sf_dir, "orders").select(F.lit("tpch").alias("s"), F.lit("status").alias("v"), F.col("o_orderstatus").alias("native"))
    return matching.map_native(o, m, "s", "v", "native").groupBy("native", "normalized_value", "mapped").agg(F.count(F.lit(1)).alias("n"))


@query(
    "alias_resolution",
    """
    WITH a AS (SELECT p_size % 25 AS v, list_sort(list(DISTINCT p_brand)) AS e FROM part GROUP BY 1)
    SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'invalid' WHEN e IS NULL THEN 'unresolved' WHEN len(e) = 1 THEN 'resolved' ELSE 'quarantined_conflict' END AS status, CASE WHEN p_partkey % 7 = 0 OR e IS NULL THEN '' ELSE array_to_string(e, ',') END AS entities
    FROM part LEFT JOIN a ON v = p_partkey % 40
    """,
)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part asks for an alias: some are no identifiers, some unknown, some of several entities."""
    p = table(spark, sf_dir, "part")
    doi = lambda n: F.concat(F.lit("https://doi.org/10.1234/A"), n.cast("string"))
    aliases = p.select(F.lit("DOI").alias("scheme"), doi(F.col("p_size") % 25).alias("value"), F.col("p_brand").alias("entity_id"), F.lit(None).cast("string").alias("evidence")).distinct()
    wanted = p.select("p_partkey", F.lit("doi").alias("scheme"), F.when(F.col("p_partkey") % 7 == 0, "nonsense").otherwise(F.lower(doi(F.col("p_partkey") % 40))).alias("value"))
    found = matching.resolve_aliases(aliases, wanted.select("scheme", "value").distinct())
    return wanted.join(found.drop("scheme"), "value").select("p_partkey", "status", F.array_join("entity_ids", ",").alias("entities"))


@query("schema_fingerprint", "SELECT sha256('n_name:string,n_nationkey:int,n_regionkey:int') AS fingerprint, count(*)::bigint AS n FROM nation")
def schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a table's columns and types, with its rows."""
    n = table(spark, sf_dir, "nation")
    names = ",".join(sorted(f"{c}:{t}" for c, t in n.dtypes))
    return n.agg(F.sha2(F.lit(names), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@query("null_last_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_totalprice, o_orderkey)::int AS place FROM orders")
def null_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders placed by a column with nulls last, then two more."""
    from pyspark.sql import Window

    status = F.nullif("o_orderstatus", F.lit("F"))
    w = Window.partitionBy("o_custkey").orderBy(status.desc_nulls_last(), "o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("construct_congruence")
def construct_congruence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First components of four measures by return flag against all rows; SQL has no eigenvectors, so numpy checks it in the tests."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return _round(atlas.congruence(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag"), loading_congruence=6)


@query("reference_matches")
def reference_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as references to parts: some by DOI, some by a name with a changed end; SQL has no matching share, so a plain version checks it in the tests."""
    p = table(spark, sf_dir, "part")
    works = p.select(F.concat(F.lit("w"), "p_partkey").alias("candidate_id"), F.concat(F.lit("10.1234/p"), "p_partkey").alias("doi"), F.concat_ws(" ", "p_name", "p_type").alias("title"), (F.lit(2000) + F.col("p_size") % 5).alias("year"))
    doi = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://doi.org/10.1234/P"), "p_partkey"))
    refs = p.select(F.col("p_partkey").alias("reference_id"), doi.alias("doi"), F.lit("raw").alias("raw"), F.concat_ws(" ", "p_name", F.expr("substr(p_type, 1, length(p_type) - 1)")).alias("title"), (F.lit(2000) + F.col("p_size") % 5).alias("year"))
    return matching.match_references(refs, works).withColumn("confidence", F.round("confidence", 6))




@query(
    "cycle_flow_grades",
    """
    WITH c AS (
      SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN count(*) END AS received, CASE WHEN o_custkey % 5 <> 0 THEN count(*) + o_custkey % 4 - 1 END AS expected, count(DISTINCT o_orderdate) AS observable, count(*) FILTER (o_totalprice > 100000) AS evaluated,
        CASE WHEN o_custkey % 7 = 0 THEN count(*) + 1 END AS selected_declared, count(*) FILTER (o_orderstatus = 'F') AS selected, count(*) FILTER (o_orderstatus <> 'O') AS decided, CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS grade
      FROM orders GROUP BY 1
    ), f AS (SELECT *, coalesce(received, expected) AS r, coalesce(selected_declared, selected) AS s FROM c),
    v AS (SELECT *, concat_ws(',', CASE WHEN observable > r THEN 'observable_gt_received' END, CASE WHEN evaluated > observable THEN 'evaluated_gt_observable' END, CASE WHEN s > observable THEN 'selected_gt_observable' END, CASE WHEN decided > observable THEN 'decided_gt_observable' END) AS violations FROM f)
    SELECT o_custkey, r::bigint AS received_final, s::bigint AS selected_final, violations, CASE WHEN violations <> '' AND grade IN ('A', 'B') THEN 'U' ELSE grade END AS effective_grade FROM v
    """,
)
def cycle_flow_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each customer's orders as a cycle's flow, with violations and the grade that is left."""
    from sluice.operators import flow

    k, n = F.col("o_custkey"), F.count(F.lit(1))
    none = F.lit(None).cast("long")
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        n.alias("n"), F.count_distinct("o_orderdate").alias("observable"), F.count_if(F.col("o_totalprice") > 100000).alias("evaluated"), F.count_if(F.col("o_orderstatus") == "F").alias("selected"), F.count_if(F.col("o_orderstatus") != "O").alias("decided")
    )
    c = c.select(
        "*", F.when(k % 3 == 0, F.col("n")).alias("received"), F.when(k % 5 != 0, F.col("n") + k % 4 - 1).alias("expected"), none.alias("observable_declared"), none.alias("evaluated_declared"), F.when(k % 7 == 0, F.col("n") + 1).alias("selected_declared"),
        F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "C").alias("grade"),
    )
    return flow.cycle_flows(c).select("o_custkey", "received_final", "selected_final", F.array_join("violations", ",").alias("violations"), "effective_grade")


@query(
    "claim_features",
    r"""
    SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i)\b(?:method|algorithm|experiment|simulation|regression|survey|dataset)\b'))::bigint AS method, len(regexp_extract_all(coalesce(text, ''), '(?i)\b(?:code|data|repository|github|zenodo|osf)\b'))::bigint AS data_or_code,
      len(regexp_extract_all(coalesce(text, ''), '(?i)\b(?:limitation|limited by|future work|cannot establish|uncertain)\b'))::bigint AS limitation, coalesce(trim(text), '') <> '' AS has_text FROM documents
    """,
)
def claim_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of some kinds in each document."""
    from sluice.functions import text

    d = table(spark, sf_dir, "documents")
    counts = text.claim_counts(F.col("text"))
    return d.select("doc_id", *[counts[c].cast("long").alias(c) for c in ("method", "data_or_code", "limitation")], (F.coalesce(F.trim("text"), F.lit("")) != "").alias("has_text"))


@query(
    "novelty_z",
    """
    WITH n AS (SELECT vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS u FROM embeddings),
    f AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM n), s AS (SELECT label, d, sum(x) AS s, count(*) AS c FROM f GROUP BY 1, 2),
    p AS (SELECT t.label, s.d, sum(s.s) AS s, sum(s.c) AS c FROM (SELECT DISTINCT label FROM n) t JOIN s ON s.label < t.label GROUP BY 1, 2), v AS (SELECT label, max(c) AS refs, list(s ORDER BY d) AS p FROM p GROUP BY 1),
    e AS (SELECT vec_id, label, 1 - list_dot_product(u, p) / sqrt(list_dot_product(p, p)) AS distance FROM n JOIN v USING (label) WHERE refs >= 20)
    SELECT vec_id, label, round(CASE WHEN stddev_pop(distance) OVER w > 0 THEN (distance - avg(distance) OVER w) / stddev_pop(distance) OVER w ELSE 0 END, 4) AS z FROM e WINDOW w AS (PARTITION BY vec_id % 3, label)
    """,
)
def novelty_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to earlier cohorts' centroid, standardised within source (made of the number) and cohort."""
    from sluice.operators import panels

    found = novelty.prior_centroid_distance(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 20)
    z = panels.calibrated(found.withColumn("source", F.col("vec_id") % 3), ["source", "label"], "distance")
    return z.select("vec_id", "label", F.round("z", 4).alias("z"))
