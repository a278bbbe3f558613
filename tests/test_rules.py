import uuid

import pytest
from pyspark.sql import functions as F

from sluice import schema
from sluice.functions import identifiers, stats, text
from sluice.operators import dedup, flow, graph, history, novelty, panels, rules
from sluice.sources import parsers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column).first()[0]


def test_stable_id_is_a_uuid5(spark):
    got = one(spark, identifiers.stable_id("candidate", F.lit(" Src "), F.lit("A  b ﬁ")))
    assert got == "obs:candidate:" + str(uuid.uuid5(identifiers.NAMESPACE, "candidate|src|a b fi"))
    with pytest.raises(Exception, match="needs all its parts"):
        spark.range(1).select(identifiers.stable_id("x", F.lit(" "))).collect()


@pytest.mark.parametrize(
    ("scheme", "value", "canonical"),
    [
        ("doi", "https://doi.org/10.1234/ABC.1).", "10.1234/abc.1"),
        ("doi", "nonsense", None),
        ("arxiv", "arXiv:2401.00001v3", "2401.00001"),
        ("orcid", "https://orcid.org/0000-0002-1825-009x", "0000-0002-1825-009X"),
        ("pmcid", "123", "PMC123"),
    ],
)
def test_canonical_identifier(spark, scheme, value, canonical):
    assert one(spark, identifiers.canonical_identifier(F.lit(scheme), F.lit(value))) == canonical


@pytest.mark.parametrize(
    ("native", "independent"), [("ICLR 2021 Spotlight", "accepted"), ("Publish", "selected"), ("unclear provider state", None), ("Desk Rejected", "rejected")]
)
def test_independent_outcome(spark, native, independent):
    assert one(spark, text.independent_outcome(F.lit(native))) == independent


def test_licences(spark):
    found = [one(spark, text.canonical_licence(F.lit(x))) for x in ("https://creativecommons.org/licenses/by/4.0/", "CC BY-NC 4.0", "CC0", "All rights reserved", "?", "")]
    assert found == ["cc-by-4.0", "CC-BY-NC-4.0", "CC0", "All rights reserved", "?", None]


def test_sha_and_https(spark):
    assert one(spark, text.genuine_sha256(F.lit("ab" * 32))) and not one(spark, text.genuine_sha256(F.lit("0" * 64))) and not one(spark, text.genuine_sha256(F.lit(None).cast("string")))
    assert one(spark, text.https_target(F.lit("https://a.org/x"))) and not one(spark, text.https_target(F.lit("http://a.org")))


def test_current_history_and_as_of(spark):
    df = spark.createDataFrame([("a", 1, "Earlier", "2026-01-01"), ("a", 2, "Later", "2026-02-01")], "id string, record_version int, title string, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp")).withColumn("source_id", F.lit("s"))
    assert [r["title"] for r in history.current(df, "id", "observed_at").collect()] == ["Later"]
    early = history.as_of(df, ["id"], F.lit("2026-01-15").cast("timestamp"), "observed_at", ["record_version"])
    assert [r["title"] for r in early.collect()] == ["Earlier"]


def test_tombstone_hides_older_rows(spark):
    df = spark.createDataFrame([("s", "a", "2026-01-01", None, "old"), ("s", "a", "2026-02-01", "2026-03-01", "new")], "source_id string, native_id string, r string, d string, value string").select("source_id", "native_id", F.col("r").cast("timestamp").alias("retrieved_at"), F.col("d").cast("timestamp").alias("deleted_at"), "value")

    def at(day):
        cutoff = F.lit(day).cast("timestamp")
        return [r["value"] for r in history.as_of(df, ["source_id", "native_id"], cutoff, "retrieved_at", [], F.col("deleted_at") <= cutoff).collect()]

    assert at("2026-02-15") == ["new"] and at("2026-04-01") == []


def test_manifest_diff(spark):
    b = spark.createDataFrame([("a", 1), ("gone", 1), ("same", 3)], "k string, v int")
    a = spark.createDataFrame([("a", 2), ("new", 1), ("same", 3)], "k string, v int")
    assert {r["k"]: r["status"] for r in history.manifest_diff(b, a, ["k"], "v").collect()} == {"a": "modified", "gone": "removed", "new": "added", "same": "unchanged"}


def test_only_dated_rows_become_previous(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, "x", True), (4, "z", True)], "t int, h string, dated boolean").withColumn("g", F.lit(1))
    out = history.change_from_qualifying(df, ["g"], [F.col("t")], "h", F.col("dated")).orderBy("t").collect()
    assert [(r["previous"], r["changed"]) for r in out] == [(None, False), ("x", False), ("x", False), ("x", True)]


def test_grades(spark):
    assert one(spark, rules.effective_grade(F.lit("A"), F.lit(0.9), F.lit(False))) == "U"
    assert one(spark, rules.effective_grade(F.lit("B"), F.lit(None).cast("double"), F.lit(False))) == "U"
    assert one(spark, rules.effective_grade(F.lit("C"), F.lit(0.1), F.lit(True))) == "C"
    assert not one(spark, rules.admitted(F.lit("U"), "portfolio"))


def test_leaks_fail(spark):
    df = spark.createDataFrame([(2, 1, "review")], "a int, b int, role string")
    with pytest.raises(Exception, match="not available"):
        rules.require_no_leak(df, "a", "b", "role").collect()


def test_interval_match_prefers_declared_then_last(spark):
    periods = spark.createDataFrame([(1, 5, 8, None), (1, 5, 8, "p0"), (2, 5, 8, None)], "k int, s int, e int, d string")
    intervals = spark.createDataFrame([(1, None, 6, "a"), (1, 7, None, "b"), (1, 9, 10, "c")], "k int, f int, t int, id string")
    out = flow.match_interval(periods, intervals, "k", "s", "e", "f", "t", "id", "d").collect()
    assert sorted((r["k"], r["matched_id"] or "", r["match_method"]) for r in out) == [(1, "b", "interval_overlap"), (1, "p0", "source_declared"), (2, "", "explicit_unknown_pointer")]


def test_policies_are_made_up_where_none_is_known(spark):
    periods = spark.createDataFrame([("c1", 1, 5, 8), ("c2", 2, 5, 8)], "gate_cycle_id string, k int, s int, e int")
    intervals = spark.createDataFrame([(1, 1, 6, "a")], "k int, f int, t int, id string")
    out = flow.policy_archive(periods, intervals, F.lit("src"), key="k", start="s", end="e", valid_from="f", valid_to="t", interval_id="id")
    unknown = "obs:policy_version:" + str(uuid.uuid5(identifiers.NAMESPACE, "policy_version|src|unknown:c2"))
    assert {(r["gate_cycle_id"], r["policy_version_id"], r["release_treatment"]) for r in out.collect()} == {("c1", "a", None), ("c2", unknown, "pointer_only_unknown")}


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 3.0), ("b", 3.0)], "g string, v double").withColumn("o", F.lit(1))
    assert panels.icc(df, ["o"], "g", "v").first()["icc"] == 1.0
    assert one(spark, stats.range_overlap(F.lit(0.0), F.lit(3.0), F.lit(2.0), F.lit(5.0))) == pytest.approx(0.2)
    assert one(spark, stats.standardized_difference(F.lit(2.0), F.lit(0.0), F.lit(2), F.lit(2.0), F.lit(0.0), F.lit(2))) == 0.0
    assert one(spark, stats.wilson_lower(F.lit(0), F.lit(0))) == 0.0
    z = panels.calibrated(df, ["g"], "v").collect()
    assert {r["z"] for r in z} == {0.0} and {r["percentile"] for r in z} == {1.0}


def test_candidate_dedup(spark):
    rows = [("c", "2020-01-02", "Old", "open", 1), ("c", "2020-01-01", None, "closed", 2), ("d", "2020-01-01", "T", "x", 1)]
    df = spark.createDataFrame(rows, "candidate_id string, first_observed_at string, canonical_title string, status string, observed_at int")
    got = {r["candidate_id"]: (r["first_observed_at"], r["canonical_title"], r["status"]) for r in dedup.deduplicate(df, "candidate", "candidate_id", ["observed_at"]).collect()}
    assert got == {"c": ("2020-01-01", "Old", "closed"), "d": ("2020-01-01", "T", "x")}


def test_conflicting_rows_fail(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "evaluation_id string, criterion string, observed_at int")
    with pytest.raises(Exception, match="conflicting rows"):
        dedup.deduplicate(df, "evaluation", "evaluation_id", ["observed_at"]).collect()


def test_merge_is_order_independent(spark):
    edits = [("n", "rating", "6", 1, "e1", False), ("n", "rating", "8", 2, "e2", False), ("n", "review", "text", 1, "e1", False), ("n", "review", None, 3, "e3", True), ("n", "readers", "all", 1, "e1", False)]
    schema_ = "k string, f string, v string, t int, id string, d boolean"

    def merged(rows):
        df = spark.createDataFrame(rows, schema_)
        return dedup.materialize(dedup.merge_fields(df, "k", "f", "v", ["t", "id"], "d"), "k", "f", "v").first()["state"]

    assert merged(edits) == merged(edits[::-1] + edits[:2]) == {"rating": "8", "readers": "all"}


def test_alias_conflicts_keep_all(spark):
    df = spark.createDataFrame([("i1", "doi", "10.1/x", "e1", None), ("i1", "doi", "10.1/x", "e2", None), ("i2", "doi", "10.1/y", "e1", None)], "identifier_alias_id string, scheme string, canonical_value string, entity_id string, conflict_status string")
    out = dedup.flag_conflicts(df).collect()
    assert len(out) == 3 and len({r["identifier_alias_id"] for r in out}) == 3
    assert sorted(r["conflict_status"] or "" for r in out) == ["", "conflict", "conflict"]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src int, dst int")
    assert {(r["node"], r["root"]) for r in graph.strong_components(edges).collect()} == {(1, 1), (2, 1), (4, 4), (5, 4), (6, 6)}
    events = spark.createDataFrame([("c", ["a", "b"]), ("b", ["a"]), ("a", [])], "provenance_event_id string, parent_event_ids array<string>")
    start = spark.createDataFrame([("c",)], "x string")
    assert {r["node"] for r in graph.provenance_trace(events, start).collect()} == {"a", "b", "c"}


def test_recombination(spark):
    df = spark.createDataFrame([("p", 1, "A"), ("p", 1, "B"), ("q", 2, "A"), ("q", 2, "C"), ("r", 3, "A"), ("r", 3, "B"), ("r", 3, "C")], "item string, y int, unit string")
    got = {r["item"]: (r["pairs"], round(r["new_share"], 3), r["median_prior"]) for r in novelty.recombination(df, "item", "y", "unit").collect()}
    assert got == {"p": (1, 1.0, 0.0), "q": (1, 1.0, 0.0), "r": (3, 0.333, 1.0)}


def test_schema_registry(spark):
    assert len(schema.TABLES) == 22 and schema.primary_key("evaluation") == "evaluation_id"
    raw = spark.createDataFrame([("c1", "0000-01-01", "paper", "s", "o", "p", "2024-01-01T00:00:00Z", "1")], "candidate_id string, first_observed_at string, candidate_type string, source_id string, source_object_id string, provenance_event_id string, observed_at string, record_version string")
    row = schema.conform(raw, "candidate").first()
    assert row["first_observed_at"] is None and row["record_version"] == 1 and row["domain"] is None
    with pytest.raises(ValueError, match="no fields"):
        schema.conform(raw.withColumn("extra", F.lit(1)), "candidate")
    with pytest.raises(Exception, match="candidate_type is null"):
        schema.conform(raw.drop("candidate_type"), "candidate").collect()


def test_parsers(spark):
    oai = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords><record><header status="deleted"><identifier>x</identifier><datestamp>2020</datestamp><setSpec>a</setSpec></header></record><resumptionToken>t</resumptionToken></ListRecords></OAI-PMH>'
    got = parsers.parse_oai(oai)
    assert got["resumption_token"] == "t" and got["records"][0]["deleted"] and got["records"][0]["sets"] == ["a"]
    page = parsers.parse_html("<html><head><title>T &amp; U</title><meta name='d' content='m'><script>x</script></head><body><p>a</p><p>b</p></body></html>")
    assert page["title"] == "T & U" and page["meta"] == {"d": "m"} and page["text"] == "a b" or page["text"] == "ab"
    df = spark.createDataFrame([(1, "<a/>"), (2, "<a>")], "id int, p string")
    good, bad = parsers.safe_parse(df, "jats", "id", "p")
    assert [r["id"] for r in good.collect()] == ["1"] and [r["id"] for r in bad.collect()] == ["2"]
