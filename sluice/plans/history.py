"""Current state, as-of state, change and drift of append-only histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import history as H
from sluice.plans.registry import query
from sluice.session import table


@query(
    "current_state",
    """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) rn FROM events
    ) WHERE rn = 1
    """,
)
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of each user's history."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return H.latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query(
    "as_of_state",
    """
    SELECT user_id, event_id, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'
    ) WHERE rn = 1 AND event_type <> 'error'
    """,
)
def as_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State on 20 January; a latest row of type error is a deletion and hides the user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    state = H.as_of(events, ["user_id"], F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "ts", ["event_id"], F.col("event_type") == "error")
    return state.select("user_id", "event_id", "event_type")


@query("history_drift", "SELECT count(*)::bigint AS history_rows, count(DISTINCT user_id)::bigint AS current_rows, (count(*) - count(DISTINCT user_id))::bigint AS superseded FROM events")
def history_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the history against current rows."""
    return H.history_drift(table(spark, sf_dir, "events"), "user_id")


@query(
    "lag_change",
    """
    SELECT event_id, user_id, event_type, previous, previous IS NOT NULL AND previous <> event_type AS changed FROM (
      SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    """,
)
def lag_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's previous type."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return H.change_from_previous(events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "user_id", "event_type", "previous", "changed")


@query(
    "carry_forward",
    """
    SELECT event_id, value, previous, event_type = 'purchase' AND previous IS NOT NULL AND previous <> value AS changed FROM (
      SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events)
    """,
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event against the user's last purchase before it; only purchases claim a change."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    out = H.change_from_qualifying(events, ["user_id"], [F.col("ts"), F.col("event_id")], "value", F.col("event_type") == "purchase")
    return out.select("event_id", "value", "previous", "changed")


@query(
    "changed_fields",
    """
    SELECT o_orderkey, CASE WHEN p IS NOT NULL THEN array_to_string(list_filter([CASE WHEN o_orderstatus IS DISTINCT FROM ps THEN 'o_orderstatus' END, CASE WHEN o_orderpriority IS DISTINCT FROM pp THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') END AS changed FROM (
      SELECT *, lag(o_orderkey) OVER w AS p, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    """,
)
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two columns differ from the customer's previous order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    out = H.changed_fields(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderstatus", "o_orderpriority"])
    return out.select("o_orderkey", F.array_join("changed_fields", ",").alias("changed"))


@query(
    "manifest_diff",
    """
    WITH b AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 0), a AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0)
    SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, b.v AS before_value, a.v AS after_value,
      CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' WHEN b.v IS NOT DISTINCT FROM a.v THEN 'unchanged' ELSE 'modified' END AS status
    FROM b FULL JOIN a ON b.c_custkey = a.c_custkey
    """,
)
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests of customers compared."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    before = c.where(F.col("c_custkey") % 7 != 0)
    after = c.where(F.col("c_custkey") % 11 != 0).withColumn("v", F.when(F.col("c_custkey") % 5 == 0, "CHANGED").otherwise(F.col("v")))
    return H.manifest_diff(before, after, ["c_custkey"], "v")


@query(
    "grade_diff",
    """
    WITH g AS (SELECT c_custkey, CASE WHEN c_acctbal > 7000 THEN 'A' WHEN c_acctbal > 3000 THEN 'B' WHEN c_acctbal > 0 THEN 'C' ELSE 'U' END AS old_grade, CASE WHEN c_acctbal * 1.1 > 7000 THEN 'A' WHEN c_acctbal * 1.1 > 3000 THEN 'B' WHEN c_acctbal > 0 THEN 'C' ELSE 'U' END AS new_grade FROM customer)
    SELECT old_grade, new_grade, count(*)::bigint AS n FROM g WHERE old_grade <> new_grade GROUP BY ALL
    """,
)
def grade_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of grade between two gradings, counted."""

    def graded(x):
        return F.when(x > 7000, "A").when(x > 3000, "B").when(F.col("c_acctbal") > 0, "C").otherwise("U")

    c = table(spark, sf_dir, "customer")
    pairs = c.select(graded(F.col("c_acctbal")).alias("old_grade"), graded(F.col("c_acctbal") * 1.1).alias("new_grade"))
    return pairs.where(F.col("old_grade") != F.col("new_grade")).groupBy("old_grade", "new_grade").agg(F.count("*").alias("n"))


@query(
    "json_latest_k",
    "SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top_k, count(*)::bigint AS n FROM events WHERE event_type = 'click' GROUP BY user_id",
)
def json_latest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text, by user."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    return events.groupBy("user_id").agg(F.max(F.get_json_object("props", "$.k").cast("long")).alias("top_k"), F.count("*").alias("n"))
