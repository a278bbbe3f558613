"""Texts, urls, identifiers, deduplication and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import identifiers, text
from sluice.operators import dedup, graph, novelty
from sluice.plans.registry import query
from sluice.session import table

@query(
    "language_guess",
    """
    WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda x: NOT regexp_matches(x, '[\\p{Nd}_]')) AS ws FROM documents),
    c AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: x IN ('the', 'and', 'of', 'in', 'with'))) AS en, len(list_filter(ws, lambda x: x IN ('der', 'die', 'und', 'von', 'mit'))) AS de,
      len(list_filter(ws, lambda x: x IN ('le', 'la', 'et', 'de', 'avec'))) AS fr, len(list_filter(ws, lambda x: x IN ('el', 'la', 'y', 'de', 'con'))) AS es FROM w),
    g AS (SELECT *, greatest(de, en, es, fr) AS top FROM c)
    SELECT doc_id, CASE WHEN n >= 20 AND top >= 2 AND (de = top)::int + (en = top)::int + (es = top)::int + (fr = top)::int = 1 THEN CASE top WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END END AS guess FROM g
    """,
)
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by marker words."""
    return table(spark, sf_dir, "documents").select("doc_id", text.language_guess(F.col("text")).alias("guess"))


@query(
    "claim_regex_counts",
    """
    SELECT source, sum(len(regexp_extract_all(lower(text), '(the|der|la|et) ')))::bigint AS markers, sum(len(regexp_extract_all(text, '[0-9]+')))::bigint AS numbers, sum((regexp_matches(text, '(?i)licen[cs]e'))::int)::bigint AS licence_docs FROM documents GROUP BY 1
    """,
)
def claim_regex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern counts by source."""
    d = table(spark, sf_dir, "documents")
    count = lambda c, p: F.sum(F.regexp_count(c, F.lit(p))).alias
    return d.groupBy("source").agg(count(F.lower("text"), "(the|der|la|et) ")("markers"), count(F.col("text"), "[0-9]+")("numbers"), F.count_if(F.col("text").rlike("(?i)licen[cs]e")).alias("licence_docs"))


@query("content_hash_dedup", "SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*)::bigint AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a content hash."""
    return table(spark, sf_dir, "documents").groupBy(identifiers.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "title_blocks",
    """
    WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents),
    b AS (SELECT doc_id, k, lead(doc_id) OVER (PARTITION BY k ORDER BY doc_id) AS nxt FROM t WHERE length(k) >= 20)
    SELECT doc_id AS a, nxt AS b, md5(k) AS k FROM b WHERE nxt IS NOT NULL
    """,
)
def title_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents with the same normal form."""
    t = table(spark, sf_dir, "documents").select("doc_id", text.title_key(F.col("text")).alias("k")).where(F.length("k") >= 20)
    w = Window.partitionBy("k").orderBy("doc_id")
    return t.withColumn("b", F.lead("doc_id").over(w)).where(F.col("b").isNotNull()).select(F.col("doc_id").alias("a"), "b", F.md5("k").alias("k"))


@query(
    "url_canonical",
    """
    WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages)
    SELECT page_id, regexp_replace(h, '^(www|m)\\.', '') || rtrim(regexp_replace(p, '\\.html$', ''), '/') AS canonical, url LIKE 'https://%.%' AS https FROM u
    """,
)
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls without scheme, mobile and www hosts, query, fragment and trailing marks."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), r"^(www|m)\.", "")
    path = F.rtrim(F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), r"\.html$", ""), F.lit("/"))
    return p.select("page_id", F.concat(host, path).alias("canonical"), text.https_target(F.col("url")).alias("https"))


@query("html_title_meta", """SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, length(html)::bigint AS size FROM pages""")
def html_title_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and language attribute of pages."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.length("html").cast("long").alias("size"))


@query(
    "doi_canonical",
    """SELECT doc_id, '10.1234/ab.' || doc_id AS doi, sha256(doc_id::varchar) AS digits FROM documents""",
)
def doi_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical DOIs of resolver urls, and hashes of the digits of an application number."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://doi.org/10.1234/AB."), "doc_id", F.lit(").")).alias("u"), F.concat(F.lit("US "), "doc_id", F.lit("-A")).alias("number"))
    return d.select("doc_id", identifiers.canonical_doi(F.col("u")).alias("doi"), identifiers.digits_hash(F.col("number")).alias("digits"))


@query(
    "stable_ids",
    """
    WITH h AS (SELECT c_custkey, sha1(unhex('7087e635619a5b4199bcc8ab98842348') || encode('candidate|tpch|' || lower(c_name))) AS d FROM customer)
    SELECT c_custkey, 'obs:candidate:' || d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || '89ab89ab89ab89ab'[('0x' || d[17])::int + 1] || d[18:20] || '-' || d[21:32] AS id FROM h
    """,
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ids of customers."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", identifiers.stable_id("candidate", F.lit("tpch"), F.col("c_name"), ascii_only=True).alias("id"))


@query(
    "outcome_classes",
    "SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'accepted' WHEN o_orderpriority LIKE '2%' THEN 'rejected' WHEN o_orderpriority LIKE '3%' THEN 'withdrawn' ELSE 'other_or_unresolved' END AS outcome, count(*)::bigint AS n FROM orders GROUP BY 1",
)
def outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native outcomes classed by prefix."""
    p = F.col("o_orderpriority")
    native = F.when(p.startswith("1"), "Accept (poster)").when(p.startswith("2"), "Reject").when(p.startswith("3"), "Withdrawn by authors").otherwise(p)
    return table(spark, sf_dir, "orders").select(text.outcome_class(native).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "lexical_units",
    """
    WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}'), lambda x: x NOT IN ('the', 'and', 'for', 'was')) AS ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS unit FROM w UNION ALL SELECT doc_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w) WHERE ws[i] <> ws[i + 1]),
    c AS (SELECT doc_id, unit, count(*) AS n FROM u GROUP BY ALL)
    SELECT doc_id, unit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, len(string_split(unit, ' ')) DESC, unit) AS r FROM c) WHERE r <= 12
    """,
)
def lexical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 leading words and pairs of every document, counted over its whole text.

    Texts are dealt by document once, before they are split: the many units are then counted and ranked where they arise.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return novelty.top_units(d, "doc_id", F.col("text"), ("the", "and", "for", "was"))


@query(
    "semantic_dedup",
    """
    SELECT l_orderkey, l_linenumber, max(row(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate))[1] AS l_partkey, count(*)::bigint AS n FROM lineitem GROUP BY 1, 2
    """,
)
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each repeated key, by a total order."""
    li = table(spark, sf_dir, "lineitem")
    rest = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.max(rest)["l_partkey"].alias("l_partkey"), F.count(F.lit(1)).alias("n"))


@query(
    "semantic_merge",
    """
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS title, o_orderstatus AS status FROM orders)
    SELECT o_custkey AS candidate_id, min(o_orderdate) AS first_observed_at, max(row(o_orderkey, title)) FILTER (title IS NOT NULL)[2] AS canonical_title, max(row(o_orderkey, status))[2] AS status FROM r GROUP BY 1
    """,
)
def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of customers merged by the candidates' rule: the earliest date, the latest title and status that are known."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderdate").alias("first_observed_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("canonical_title"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("observed_at"))
    return dedup.deduplicate(rows, "candidate", "candidate_id", ["observed_at"]).drop("observed_at")


@query(
    "field_lww_merge",
    """
    WITH e AS (SELECT user_id, event_type AS field, value, event_id, ts, value < 5 AS del FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY ts DESC, event_id DESC) rn FROM e)
    SELECT user_id, field, value FROM w WHERE rn = 1 AND NOT del
    """,
)
def field_lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write of each (user, field); small values delete the field."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), "value", "ts", "event_id", (F.col("value") < 5).alias("deleted"))
    return dedup.merge_fields(e, "user_id", "field", "value", ["ts", "event_id"], "deleted")


@query(
    "exact_and_conflicting",
    """
    WITH b AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY 1, 2)
    SELECT count(*)::bigint AS keys, sum(n)::bigint AS "rows", sum(n - k)::bigint AS exact_repeats, count(*) FILTER (k > 1)::bigint AS conflicting_keys FROM b
    """,
)
def exact_and_conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats and conflicts of keys."""
    li = table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return dedup.exact_and_conflicting(li, "key", F.col("l_partkey"))


@query(
    "alias_conflicts",
    "SELECT v, array_to_string(list_sort(list(DISTINCT e)), ',') AS entities FROM (SELECT lower(substr(p_name, 1, 6)) AS v, p_brand AS e FROM part) GROUP BY 1 HAVING count(DISTINCT e) > 1",
)
def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical values that stand for several entities."""
    a = table(spark, sf_dir, "part").select(F.lit("name").alias("scheme"), F.lower(F.substring("p_name", 1, 6)).alias("canonical_value"), F.col("p_brand").alias("entity_id"))
    return dedup.alias_conflicts(a).select(F.col("canonical_value").alias("v"), F.array_join("entities", ",").alias("entities"))


@query("graph_cycles")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, root) of the nodes on cycles of a graph with an edge from every customer, on three nodes to four customers.

    No oracle: recursive SQL makes every pair of nodes with a path.
    """
    c = table(spark, sf_dir, "customer")
    n = max(1, c.count() * 3 // 4)
    edges = c.select((F.col("c_custkey") % n).alias("src"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % n).alias("dst"))
    return graph.strong_components(edges)
