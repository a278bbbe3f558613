"""Panels, reliability, agreement, comparison of sources and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import stats
from sluice.operators import atlas, novelty, panels
from sluice.plans.registry import query
from sluice.session import cut, table

_CALIBRATED = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN sd = 0 THEN 0 ELSE (l_quantity - m) / sd END, 6) AS z, round(pct, 6) AS percentile FROM (
      SELECT *, avg(l_quantity) OVER w AS m, stddev_pop(l_quantity) OVER w AS sd, cume_dist() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity) AS pct FROM lineitem WHERE l_quantity IS NOT NULL WINDOW w AS (PARTITION BY l_suppkey, l_returnflag))
"""


@query("cycle_z_percentile", _CALIBRATED)
def cycle_z_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z and percentile of quantities within supplier and return flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    out = panels.calibrated(rows, ["l_suppkey", "l_returnflag"], "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("z", 6).alias("z"), F.round("percentile", 6).alias("percentile"))


@query(
    "ruler_pct_rank",
    "SELECT c_custkey, c_mktsegment, round((rank() OVER (PARTITION BY c_mktsegment ORDER BY b) + (count(*) OVER (PARTITION BY c_mktsegment, b) - 1) / 2.0) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS pct FROM (SELECT *, floor(c_acctbal / 500) AS b FROM customer)",
)
def ruler_pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-tie percentile ranks."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 500).alias("b"))
    return c.select("c_custkey", "c_mktsegment", F.round(panels.pct_rank("b", "c_mktsegment"), 6).alias("pct"))


@query(
    "icc_reliability",
    """
    WITH g AS (SELECT l_returnflag, l_orderkey, count(*) AS n, avg(l_discount) AS m, var_pop(l_discount) AS v FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2),
    t AS (SELECT l_returnflag, count(*) AS groups, sum(n) AS vals, sum(n * n) AS n2, sum(n * v) AS ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb FROM g GROUP BY 1),
    i AS (SELECT *, ssb / (groups - 1) AS msb, ssw / (vals - groups) AS msw, (vals - n2 / vals::double) / (groups - 1) AS k FROM t)
    SELECT l_returnflag, groups::bigint AS groups, vals::bigint AS "values", round((msb - msw) / (msb + (k - 1) * msw), 6) AS icc FROM i
    """,
)
def icc_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of discounts within orders, by return flag."""
    out = panels.icc(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_discount"), ["l_returnflag"], "l_orderkey", "l_discount")
    return out.select("l_returnflag", "groups", "values", F.round("icc", 6).alias("icc"))


@query(
    "strain_percentiles",
    """
    WITH j AS (SELECT l_suppkey, l_orderkey, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0 AS h, l_tax FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
    p AS (SELECT l_suppkey, l_orderkey, count(*) AS reports FROM j GROUP BY 1, 2)
    SELECT a.*, b.mean_reports, b.median_reports FROM (
      SELECT l_suppkey, count(*)::bigint AS n, count(DISTINCT l_orderkey)::bigint AS candidates, round(median(h), 3) AS median_hours, round(quantile_cont(h, 0.9), 3) AS p90_hours, round(avg((l_tax > 0.04)::int), 6) AS share FROM j GROUP BY 1) a
    JOIN (SELECT l_suppkey, round(avg(reports), 6) AS mean_reports, median(reports) AS median_reports FROM p GROUP BY 1) b USING (l_suppkey)
    """,
)
def strain_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load and delays by supplier, in two levels."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate", "l_tax")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    hours = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 3.6e9
    j = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("h", hours)
    j = cut(j.select("l_suppkey", "l_orderkey", "h", (F.col("l_tax") > 0.04).cast("double").alias("t")))
    each = j.groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("reports"), F.sum("t").alias("t"))
    # Counts by order give the counts by supplier, so lines are shuffled once for them.
    wide = each.groupBy("l_suppkey").agg(F.sum("reports").alias("n"), F.count("*").alias("candidates"), F.round(F.sum("t") / F.sum("reports"), 6).alias("share"), F.round(F.avg("reports"), 6).alias("mean_reports"))
    hours_ = atlas.quantiles(j, ["l_suppkey"], "h", {"median_hours": 0.5, "p90_hours": 0.9})
    reports = atlas.quantiles(each, ["l_suppkey"], "reports", {"median_reports": 0.5})
    return wide.join(hours_.withColumns({c: F.round(c, 3) for c in ("median_hours", "p90_hours")}), "l_suppkey", "left").join(reports, "l_suppkey")


@query(
    "small_cell_suppression",
    "SELECT p_brand, year(l_shipdate)::int AS y, count(*)::bigint AS n, CASE WHEN count(*) >= 340 THEN round(avg(l_quantity), 6) END AS mean_quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
)
def small_cell_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by brand and year, kept only in large cells."""
    j = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return panels.suppressed(j.withColumn("y", F.year("l_shipdate")), ["p_brand", "y"], {"mean_quantity": F.round(F.avg("l_quantity"), 6)}, 340)


@query(
    "transport_pairs",
    """
    WITH s AS (SELECT source, count(*) AS n, quantile_cont(n_chars, 0.05) AS lo, quantile_cont(n_chars, 0.95) AS hi, avg(n_chars) AS m, var_samp(n_chars) AS v FROM documents GROUP BY 1)
    SELECT a.source AS "left", b.source AS "right", round(greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / greatest(greatest(a.hi, b.hi) - least(a.lo, b.lo), 1e-12), 6) AS overlap,
      round(CASE WHEN a.v + b.v = 0 THEN 0 ELSE abs(a.m - b.m) / sqrt((a.v + b.v) / 2) END, 6) AS smd, least(a.n, b.n) >= 10 AND greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / greatest(greatest(a.hi, b.hi) - least(a.lo, b.lo), 1e-12) >= 0.1 AS supported
    FROM s a JOIN s b ON a.source < b.source
    """,
)
def transport_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparability of sources by document length."""
    out = panels.transport(table(spark, sf_dir, "documents").select("source", "n_chars"), "source", ["n_chars"], least_overlaps=1)
    return out.select("left", "right", F.round("n_chars_overlap", 6).alias("overlap"), F.round("n_chars_smd", 6).alias("smd"), "supported")


@query(
    "binary_metrics",
    """
    WITH j AS (SELECT quality = 1 AS t, n_chars >= 600 AS g FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn FROM j)
    SELECT tp::bigint AS tp, fp::bigint AS fp, fn::bigint AS fn, tn::bigint AS tn, round(tp / (tp + fp)::double, 6) AS "precision", round(tp / (tp + fn)::double, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::double, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::double, 6) AS accuracy,
      round(((tp + tn) / (tp + fp + fn + tn)::double - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))::double) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))::double), 6) AS kappa FROM c
    """,
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length rule against quality labels."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = panels.confusion(j, F.col("quality") == 1, F.col("n_chars") >= 600)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "kappa")])


@query(
    "auc_rank",
    """
    WITH j AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM j)
    SELECT sum(y)::bigint AS positives, sum(1 - y)::bigint AS negatives, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r
    """,
)
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC AUC of document length for quality."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return panels.roc_auc(j, "quality", "n_chars").withColumn("auc", F.round("auc", 6))


@query(
    "spearman_by_segment",
    """
    WITH c AS (SELECT c_mktsegment AS g, floor(c_acctbal / 100) AS x, c_custkey % 97 AS y FROM customer),
    r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM c)
    SELECT g, count(*)::bigint AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY g
    """,
)
def spearman_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation within segments."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.floor(F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97).alias("y"))
    return panels.spearman(c, "x", "y", "g").withColumn("spearman", F.round("spearman", 6))


@query("pearson_pair", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*)::bigint AS n FROM lineitem GROUP BY 1")
def pearson_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of quantity and price."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count("*").alias("n"))


@query(
    "wilson_bounds",
    """
    WITH c AS (SELECT source, count(*) AS n, sum(quality) AS s FROM labels JOIN documents USING (doc_id) GROUP BY 1)
    SELECT source, n::bigint AS n, round((s / n::double + 3.8414588206941227 / (2 * n) - 1.959963984540054 * sqrt(s / n::double * (1 - s / n::double) / n + 3.8414588206941227 / (4.0 * n * n))) / (1 + 3.8414588206941227 / n), 6) AS lower FROM c
    """,
)
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower bounds of quality shares by source."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("s"))
    return j.select("source", "n", F.round(stats.wilson_lower(F.col("s"), F.col("n")), 6).alias("lower"))


@query(
    "id_set_jaccard",
    """
    WITH a AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey FROM orders WHERE o_orderstatus = 'O')
    SELECT coalesce(a.y, b.y)::int AS y, count(*) FILTER (a.y IS NOT NULL AND b.y IS NOT NULL)::bigint AS shared, count(*)::bigint AS all_ids, round(count(*) FILTER (a.y IS NOT NULL AND b.y IS NOT NULL) / count(*)::double, 6) AS jaccard FROM a FULL JOIN b ON a.y = b.y AND a.o_custkey = b.o_custkey GROUP BY 1
    """,
)
def id_set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two sets of customers by year: one aggregation by id, then by year."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    ids = o.groupBy(F.year("o_orderdate").alias("y"), "o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") == "O").alias("b"))
    both = F.count_if(F.col("a") & F.col("b"))
    return ids.groupBy("y").agg(both.alias("shared"), F.count("*").alias("all_ids"), F.round(both / F.count("*"), 6).alias("jaccard"))


@query("missingness", """SELECT * FROM (SELECT 'user_id' AS "column", count(*)::bigint AS "rows", count(user_id)::bigint AS non_null FROM e UNION ALL SELECT 'event_type', count(*), count(t) FROM e UNION ALL SELECT 'value', count(*), count(v) FROM e)""".replace("FROM e", "FROM (SELECT user_id, nullif(event_type, 'error') AS t, CASE WHEN value > 50 THEN value END AS v FROM events) e"))
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-null counts of each column."""
    e = table(spark, sf_dir, "events").select("user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return panels.missingness(e)


@query("pivot_mean", "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS o, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS p FROM orders GROUP BY 1")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by priority, one column a status."""
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return wide.select("o_orderpriority", *[F.round(F.col(c), 4).alias(c.lower()) for c in "FOP"])


@query(
    "prior_centroid",
    """
    WITH n AS (SELECT vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS u FROM embeddings),
    f AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM n),
    s AS (SELECT label, d, sum(x) AS s, count(*) AS c FROM f GROUP BY 1, 2),
    p AS (SELECT t.label, s.d, sum(s.s) AS s, sum(s.c) AS c FROM (SELECT DISTINCT label FROM n) t JOIN s ON s.label < t.label GROUP BY 1, 2),
    v AS (SELECT label, max(c) AS refs, list(s ORDER BY d) AS p FROM p GROUP BY 1)
    SELECT vec_id, label, coalesce(refs, 0)::bigint AS "references", CASE WHEN refs >= 120 THEN round(1 - list_dot_product(u, p) / sqrt(list_dot_product(p, p)), 6) END AS distance FROM n LEFT JOIN v USING (label)
    """,
)
def prior_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the centroid of earlier cohorts."""
    out = novelty.prior_centroid_distance(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 120)
    return out.withColumn("distance", F.round("distance", 6))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cohort"), F.col("embedding").alias("v"))


@query(
    "prior_nearest",
    """
    WITH n AS (SELECT vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS u FROM embeddings)
    SELECT a.vec_id, round(1 - max(list_dot_product(a.u, b.u)), 6) AS distance FROM n a JOIN n b ON b.label < a.label GROUP BY 1
    """,
)
def prior_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest vector of an earlier cohort."""
    v = _vectors(spark, sf_dir)
    return novelty.best_cosines(v, v, 1, True).select(F.col("target").alias("vec_id"), F.round(1 - F.col("cosine"), 6).alias("distance"))


@query(
    "topk_neighbours",
    """
    WITH n AS (SELECT vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS u FROM embeddings),
    r AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.u, b.u) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.u, b.u) DESC, b.vec_id) AS rn FROM n a JOIN n b ON a.vec_id <> b.vec_id)
    SELECT least(a, b) AS lo, greatest(a, b) AS hi, round(max(c), 6) AS cosine FROM r WHERE rn <= 11 GROUP BY 1, 2
    """,
)
def topk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among each vector's 11 nearest, with their best cosine."""
    v = _vectors(spark, sf_dir)
    near = novelty.best_cosines(v, v, 11, False)
    return near.groupBy(F.least("target", "reference").alias("lo"), F.greatest("target", "reference").alias("hi")).agg(F.round(F.max("cosine"), 6).alias("cosine"))


@query(
    "citation_recombination",
    """
    WITH u AS (SELECT DISTINCT l_orderkey AS item, year(o_orderdate) AS y, p_brand AS unit FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    p AS (SELECT a.item, a.y, a.unit AS u, b.unit AS v FROM u a JOIN u b ON a.item = b.item AND a.unit < b.unit),
    s AS (SELECT u, v, y, count(*) AS n FROM p GROUP BY ALL),
    e AS (SELECT p.item, coalesce((SELECT sum(n) FROM s WHERE s.u = p.u AND s.v = p.v AND s.y < p.y), 0) AS prior FROM p)
    SELECT item, count(*)::bigint AS pairs, round(avg((prior = 0)::int), 6) AS new_share, median(prior)::double AS median_prior, round(quantile_cont(prior, 0.1), 6) AS p10_prior FROM e GROUP BY 1
    """,
)
def citation_recombination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an order's pairs of brands stood together in earlier years."""
    li, od, pa = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    u = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).join(pa, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("item"), F.year("o_orderdate").alias("y"), F.col("p_brand").alias("unit"))
    out = novelty.recombination(u, "item", "y", "unit")
    return out.select("item", "pairs", F.round("new_share", 6).alias("new_share"), "median_prior", F.round("p10_prior", 6).alias("p10_prior"))
