"""Providers' payloads, raw objects, files and dumps."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sluice.functions.identifiers import NAMESPACE
from sluice.sources import indexes, parsers, providers, raw

RAW = "source_object_id string, provenance_event_id string, payload string"


def frame(spark, payloads, **more):
    rows = [(f"o{i}", f"p{i}", json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, RAW)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def held(tables):
    return {t: df.collect() for t, df in tables.items()}


def key(kind, *parts):
    import uuid

    return f"obs:{kind}:{uuid.uuid5(NAMESPACE, '|'.join([kind, *parts]).lower())}"


def test_deposited_works(spark):
    work = {"DOI": "10.7717/PEERJ.1", "type": "journal-article", "title": ["A  title"], "issued": {"date-parts": [[2020, 5]]}, "indexed": {"date-time": "2021-01-02T03:04:05Z"}, "license": [{"URL": "http://l"}], "relation": {"has-review": [{"id": "10.7287/rev.1", "id-type": "doi"}, {"id": "x"}]}}
    got = held(providers.deposited_works(frame(spark, [work, work, {"DOI": "bad"}]), "peerj", "Peer J", "rolling_threshold", "published"))
    assert {t: len(r) for t, r in got.items()} == {"gate": 1, "gate_cycle": 1, "candidate": 1, "candidate_version": 1, "candidate_gate_event": 1, "identifier_alias": 2, "lineage_edge": 1}
    assert got["gate"][0]["native_id"] == "peer_j" and got["gate_cycle"][0]["name"] == "Peer J 2020"
    version = got["candidate_version"][0]
    assert (version["title"], version["licence"], str(version["created_at"])) == ("A  title", "http://l", "2020-05-01 00:00:00")
    assert got["candidate"][0]["candidate_id"] == key("candidate", "doi", "10.7717/peerj.1")
    edge = got["lineage_edge"][0]
    assert edge["evidence_json"] == '{"id": "10.7287/rev.1", "id-type": "doi"}' and edge["target_candidate_id"] == key("candidate", "doi", "10.7287/rev.1")


def test_indexed_works(spark):
    work = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1234/A", "display_name": "T", "publication_date": "2020-01-02", "updated_date": "2021-01-01T00:00:00", "topics": [{"id": "t1", "display_name": "X", "score": 0.5, "field": {"display_name": "CS"}}], "referenced_works": ["https://openalex.org/W2", "https://openalex.org/W3"]}
    got = held(providers.indexed_works(frame(spark, [work, {"id": "W9", "display_name": "U", "publication_date": "2020"}])))
    assert {t: len(r) for t, r in got.items()} == {"candidate": 2, "candidate_version": 2, "identifier_alias": 3, "field_assignment": 1, "reference_edge": 2}
    assert sorted((r["reference_position"], r["cited_identifier"]) for r in got["reference_edge"]) == [(0, "W2"), (1, "W3")]
    assert {r["candidate_id"] for r in got["candidate"]} == {key("candidate", "doi", "10.1234/a"), key("candidate", "openalex", "w9")}


def test_venue_settings(spark):
    group = {"id": "ICML.cc/2024/Conference", "tcdate": 1577836800000, "tmdate": 1577836801000, "content": {"title": {"value": "ICML \"24\""}, "contact_email": {"value": "a@b"}, "review_rating": {"value": {"b": 1, "a": [1]}}, "decision_name": "D", "other": 1}}
    got = held(providers.venue_settings(frame(spark, [group, {"id": "x", "missing": True}], source_url="https://v")))
    assert {t: len(r) for t, r in got.items()} == {"gate": 1, "policy_version": 1, "gate_cycle": 1}
    assert (got["gate"][0]["name"], got["gate"][0]["organization"], got["gate"][0]["architecture"]) == ('ICML "24"', "ICML.cc", "competitive_quota")
    policy = got["policy_version"][0]
    assert json.loads(policy["rubric_json"]) == {"review_rating": {"a": [1], "b": 1}} and json.loads(policy["stage_rules_json"]) == {"decision_name": "D"}
    assert "a@b" not in policy["criteria_json"] and str(got["gate_cycle"][0]["cycle_start"]) == "2024-01-01 00:00:00"


def test_review_records(spark):
    note = {"id": "f1", "title": "T", "abstract": "A", "outcome": "accepted", "venue": "ICLR Poster", "cdate": 1577836800000, "prior_submission": "https://openreview.net/forum?id=f0"}
    review = {"id": "r1", "forum": "f1", "review_text": "Good  work", "rating_raw": "8: accept", "confidence_raw": "4", "cdate": 1577836800000}
    rows = [("o1", "p1", json.dumps(note), "submission", "ICLR_2020.jsonl", 0), ("o2", "p2", json.dumps(review), "review", "ICLR_2020_reviews.jsonl", 0), ("o3", "p3", json.dumps(review), "review", "ICLR_2020_reviews.jsonl", 7)]
    df = spark.createDataFrame(rows, f"{RAW}, object_type string, file string, line int").withColumns({"native_id": F.lit("n"), "licence": F.lit("l"), "release_class": F.lit("pointer_hash"), "source_url": F.lit("u")})
    got = held(providers.review_records(df))
    assert {t: len(r) for t, r in got.items()} == {"gate": 1, "gate_cycle": 1, "content_artifact": 1, "evaluation": 2, "candidate": 1, "candidate_version": 1, "candidate_gate_event": 1, "decision_event": 1, "identifier_alias": 1, "lineage_edge": 1}
    main = next(r for r in got["evaluation"] if r["criterion_native"] == "overall_rating")
    assert (main["criterion_value_numeric"], main["confidence_value"], main["scale_json"]) == (8.0, 4.0, '{"rating_raw": "8: accept"}')
    assert got["decision_event"][0]["outcome_native"] == "ICLR Poster" and got["candidate_gate_event"][0]["final_observed_stage"] == "selected"
    assert got["gate_cycle"][0]["gate_cycle_id"] == key("gate_cycle", "openreview", "iclr-2020") and got["lineage_edge"][0]["source_candidate_id"] == key("candidate", "openreview", "f0")
    other = df.union(df.where("source_object_id = 'o2'").withColumn("payload", F.lit(json.dumps(review | {"rating_raw": "1"}))))
    with pytest.raises(Exception, match="conflicting duplicate"):
        providers.review_records(other)["evaluation"].collect()


def test_preprints(spark):
    xml = "<arXivRaw><id>2401.00001</id><title>A\n title</title><abstract>B</abstract><doi>10.1234/Z</doi><categories>cs.LG</categories><journal-ref>J. 1</journal-ref><version version='v1'><date>Mon, 1 Jan 2024 10:00:00 GMT</date></version><version version='v2'><date>Tue, 2 Jan 2024 10:00:00 GMT</date></version></arXivRaw>"
    dc = "<dc><identifier>http://arxiv.org/abs/2401.00002</identifier><title>C</title><description>D</description><date>2024-03-04</date></dc>"
    rows = [("o1", "p1", "oai:arXiv.org:2401.00001", "2024-02-01", False, xml), ("o2", "p2", "oai:arXiv.org:2401.00002", "2024-03-05", False, dc), ("o3", "p3", "x", "2024-01-01", True, xml)]
    df = spark.createDataFrame(rows, "source_object_id string, provenance_event_id string, identifier string, datestamp string, deleted boolean, metadata_xml string").withColumn("metadata_prefix", F.lit("arXivRaw"))
    got = held(providers.preprints(df))
    assert {t: len(r) for t, r in got.items()} == {"candidate": 2, "candidate_version": 3, "identity_visibility": 3, "lineage_edge": 1, "identifier_alias": 4}
    assert sorted((r["native_id"], r["version_number"], str(r["created_at"])) for r in got["candidate_version"]) == [("2401.00001v1", 1, "2024-01-01 10:00:00"), ("2401.00001v2", 2, "2024-01-02 10:00:00"), ("2401.00002v1", 1, "2024-03-04 00:00:00")]
    assert got["lineage_edge"][0]["evidence_json"] == '{"version_date": "2024-01-02T10:00:00+00:00", "version_number": 2}'
    assert {(r["scheme"], r["canonical_value"]) for r in got["identifier_alias"]} == {("arxiv", "2401.00001"), ("arxiv", "2401.00002"), ("doi", "10.1234/z"), ("journal_ref", "j. 1")}


def test_raw_store_and_packs(spark, tmp_path):
    rows = [(f"n{i}", bytes([i % 7]) * (i + 1)) for i in range(30)] + [("again", b"\x00")]
    objects = spark.createDataFrame(rows, "native_id string, payload binary")
    path = str(tmp_path / "store")
    raw.put(objects, path)
    raw.put(objects, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 30 and raw.verify(stored).isEmpty()
    wanted = stored.orderBy("sha256").limit(5).select("sha256")
    plain = {r["sha256"]: bytes(r["payload"]) for r in stored.collect()}
    assert {r["sha256"]: bytes(r["payload"]) for r in raw.get(spark, path, wanted).collect()}.items() <= plain.items()
    packs, index = raw.pack(stored.select("sha256", "payload"), 100)
    assert packs.count() > 1 and {r["sha256"]: bytes(r["payload"]) for r in raw.unpack(packs, index, stored.select("sha256")).collect()} == plain
    receipts = stored.select("sha256").union(wanted).union(spark.createDataFrame([("0" * 64,)], "sha256 string"))
    bad = stored.select("sha256", "payload").union(spark.createDataFrame([("1" * 64, b"x")], "sha256 string, payload binary"))
    assert tuple(raw.receipts_integrity(receipts, bad).first()) == (30, 1, 0, 5)


def test_snapshot_and_pages(spark):
    lines = spark.createDataFrame([('{"id": "https://openalex.org/W1", "doi": null}',), ('{"id": "W2", "doi": "10.1234/X"}',), ("",), ('{"id": "W3"}',)], "value string")
    ids, dois = spark.createDataFrame([("w1",)], "i string"), spark.createDataFrame([("https://doi.org/10.1234/x",)], "d string")
    assert raw.snapshot_works(lines, ids, dois).count() == 2 and raw.snapshot_works(lines).count() == 3
    bundles = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "source_object_id string, retrieved_at int, page string")
    assert {r["page"] for r in raw.newest_pages(bundles).collect()} == {"new", "only"}


def workbook(main, relations):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>sp</t></r><r><t>lit</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark):
    forms = [("http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"), ("http://purl.oclc.org/ooxml/spreadsheetml/main", "http://purl.oclc.org/ooxml/officeDocument/relationships")]
    for form in forms:
        df = spark.createDataFrame([("f.xlsx", workbook(*form))], "path string, content binary")
        assert [(r["sheet"], r["row"], r["cells"]) for r in raw.workbooks(df).orderBy("row").collect()] == [("S", 1, {"A": "name", "C": "3"}), ("S", 2, {"A": "split"})]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("C/Annotated/a.txt", "Good idea [[CLA, NOV]] but [[]] unclear [[CLA]]")
        z.writestr("C/Other/b.txt", "x [[CLA]]")
    spans = raw.annotated_spans(spark.createDataFrame([("z", out.getvalue())], "path string, content binary")).collect()
    assert [(r["text"], r["tags"]) for r in spans] == [("Good idea", ["CLA", "NOV"]), ("unclear", ["CLA"])]
    rows = raw.csv_rows(spark.createDataFrame([("1,a",), ("x,b",)], "v string"), "v", "n int, s string").collect()
    assert (rows[0]["n"], rows[0]["_corrupt_record"]) == (1, None) and rows[1]["_corrupt_record"] == "x,b"
    assert raw.tar_bundle({"b": b"2", "a": b"1"}) == raw.tar_bundle({"a": b"1", "b": b"2"})
    claims = raw.patent_xml("<us-patent><invention-title>T</invention-title><claims><claim num='1'><claim-text>One.</claim-text></claim></claims></us-patent>")
    assert claims["title"] == "T" and claims["claims"] == [{"number": "1", "text": "One."}]


def test_full_texts(spark):
    page = zlib.compress(b"BT (This page shows more than fifty plain characters of text,) Tj (as it must \\(here\\).) Tj ET")
    pdf = b"%PDF-1.4 /Type /Page \nstream\n" + page + b"\nendstream"
    jats = b"<article><front><article-title>T</article-title><abstract>A b</abstract></front><back><ref id='1'>R</ref></back></article>"
    jobs = [("j", "application/jats+xml", jats, 2), ("p", "application/pdf", pdf, None), ("s", "application/pdf", b"%PDF", None), ("h", "text/html", b"<p>x</p>", None), ("u", "image/png", b"", None), ("b", "application/xml", b"<a", None)]
    df = spark.createDataFrame(jobs, "native_id string, media_type string, payload binary, expected_references int")
    got = {r["native_id"]: r for r in raw.full_texts(df).collect()}
    assert {k: (r["route"], r["ok"]) for k, r in got.items()} == {"j": ("jats", True), "p": ("born_digital_pdf", True), "s": ("born_digital_pdf", False), "h": ("html", True), "u": ("unknown", False), "b": ("jats", False)}
    assert got["j"]["reference_recall"] == 0.5 and "ocr" in got["s"]["error"] and got["p"]["characters"] > 50
    done = raw.full_texts(df)
    assert {r["native_id"] for r in raw.full_texts(df, done).collect()} == {"s", "u", "b"}
    assert sum(raw.full_texts(df, shard=k, shards=3).count() for k in range(3)) == 6


def test_dump_is_read_by_lines(spark, tmp_path):
    body = "SET x;\nCOPY public.a (id, name) FROM stdin;\n1\tx\n2\tCOPY y\n\\.\nSELECT 1;\nCOPY b (id) FROM stdin;\n\\.\nCOPY c (k, v) FROM stdin;\n" + "9\tz\n" * 500 + "\\.\n"
    (tmp_path / "d.sql").write_text(body)
    lines = parsers.dump_lines(spark, str(tmp_path / "d.sql"))
    assert {(r["table"], r["columns"], r["rows"]) for r in parsers.copy_blocks(lines).collect()} == {("public.a", "id, name", 2), ("c", "k, v", 500)}
    assert parsers.copy_rows(lines).where("table = 'public.a'").count() == 2


def test_release(spark, tmp_path):
    version = dict.fromkeys(raw.RELEASE_COLUMNS, "1")
    out = raw.release({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path / "r"), version).collect()
    assert [(r["table"], r["rows"], r["columns"]) for r in out] == [("a", 3, 7), ("b", 2, 7)]


def test_discussion_records(spark):
    dc = '<oai_dc:dc xmlns:oai_dc="o" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{}</dc:title><dc:identifier>{}</dc:identifier><dc:date>2023-04-05</dc:date><dc:language>eng</dc:language></oai_dc:dc>'
    record = "<record><header{}><identifier>{}</identifier><datestamp>2023-05-01</datestamp></header>{}</record>"
    body = [
        record.format("", "r1", "<metadata>" + dc.format("Ice & rain", "https://doi.org/10.5194/tc-2023-12") + "</metadata>"),
        record.format("", "r2", "<metadata>" + dc.format("Final", "https://tc.copernicus.org/articles/1/2</dc:identifier><dc:identifier>10.5194/tc-17-1") + "</metadata>"),
        record.format(' status="deleted"', "r3", ""),
        record.format("", "r4", "<metadata>" + dc.format("No number", "none") + "</metadata>"),
    ]
    pages = spark.createDataFrame([("o1", "p1", '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>' + "".join(body) + "</ListRecords></OAI-PMH>")], RAW)
    records = indexes.oai_records(pages.withColumns({"source_url": F.lit("u"), "licence": F.lit("l"), "release_class": F.lit("pointer_hash")}))
    assert {r["repairs"] for r in records.collect()} == {1}
    got = held(indexes.discussion_records(records))
    assert {t: len(r) for t, r in got.items()} == {"content_artifact": 6, "gate": 1, "gate_cycle": 1, "candidate": 2, "candidate_version": 2, "identifier_alias": 2, "candidate_gate_event": 1}
    assert sorted(r["object_type"] for r in got["content_artifact"] if "wrapper" in r["object_type"]) == ["oai_record_wrapper__deleted", "oai_record_wrapper__discussion_preprint", "oai_record_wrapper__final_article", "oai_record_wrapper__unclassified"]
    assert got["gate"][0]["native_id"] == "tc" and got["candidate_gate_event"][0]["native_id"] == "10.5194/tc-2023-12"
    assert {r["canonical_title"] for r in got["candidate"]} == {"Ice & rain", "Final"}


def test_life_science_results(spark):
    works = [
        {"id": "1", "source": "MED", "doi": "10.1234/A", "pmid": "11", "title": "Retracted work", "isRetracted": "Y", "journalTitle": "J", "commentCorrectionList": {"commentCorrection": [{"id": "77", "source": "MED", "type": "Erratum in"}, {"type": "Comment"}]}},
        {"id": "2", "source": "PPR", "title": "WITHDRAWN: B", "pubTypeList": {"pubType": "preprint"}, "commentCorrectionList": {"commentCorrection": {"id": "88", "source": "PPR", "type": "Update of"}}},
        {"id": "3", "source": "MED", "pmcid": "PMC3", "title": "C", "pubTypeList": {"pubType": ["a", "withdrawal notice"]}},
    ]
    df = frame(spark, works).withColumns({"created_at": F.lit("2020-01-01").cast("timestamp"), "release_class": F.lit("pointer_hash")})
    got = held(indexes.life_science_results(df))
    assert {t: len(r) for t, r in got.items()} == {"candidate": 3, "candidate_version": 3, "identifier_alias": 3, "field_assignment": 1, "downstream_outcome": 6, "lineage_edge": 2}
    assert {r["canonical_title"]: r["status"] for r in got["candidate"]} == {"Retracted work": "retracted", "WITHDRAWN: B": "withdrawn", "C": "withdrawn"}
    assert {r["relation_type"] for r in got["lineage_edge"]} == {"Erratum in", "Update of"}
    assert key("candidate", "med", "77") in {r["target_candidate_id"] for r in got["lineage_edge"]}
