import json

from pyspark.sql import functions as F

from sluice.sources import crossref


def test_normalize(spark):
    work = {"DOI": "10.1234/REV/1", "URL": "https://doi.org/10.1234/REV/1", "type": "peer-review", "stage": "pre-publication", "author": [{"name": "Anonymous"}], "created": {"date-time": "2024-05-30T21:06:16Z"}, "relation": {"is-review-of": [{"id": "10.1234/ABC", "id-type": "doi"}, {"id": "bad", "id-type": "doi"}]}}
    other = {"URL": "https://x.org/2", "subtype": "decision", "relation": {"is-review-of": [{"id": "https://doi.org/10.1234/abc", "id-type": "doi"}]}}
    rows = [("o1", "p1", json.dumps(work)), ("o2", "p2", json.dumps({"items": [work, other]})), ("o3", "p3", "{broken")]
    raw = spark.createDataFrame(rows, "source_object_id string, provenance_event_id string, payload string").withColumn("retrieved_at", F.lit("2024-06-01").cast("timestamp"))
    tables = {t: df.collect() for t, df in crossref.normalize(raw).items()}
    assert {t: len(r) for t, r in tables.items()} == {"gate": 1, "gate_cycle": 1, "content_artifact": 3, "candidate": 1, "candidate_version": 1, "identifier_alias": 2, "evaluation": 2}
    assert {(r["native_id"], r["evaluation_type"], r["anonymous"]) for r in tables["evaluation"]} == {("10.1234/rev/1", "peer-review", True), ("https://x.org/2", "decision", False)}
    assert {r["value"] for r in tables["identifier_alias"]} == {"10.1234/rev/1", "10.1234/abc"}
