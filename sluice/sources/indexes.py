"""Normalisers of a discussion publisher's OAI records and of a life-science index's results into the canonical tables."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import text
from sluice.functions.identifiers import canonical_doi, stable_id
from sluice.functions.json_text import canonical_json
from sluice.sources import parsers
from sluice.sources.providers import Tables, _alias, _all, _first, _key, _rows

_BARE = re.compile(r"&(?!amp;|lt;|gt;|quot;|apos;|#\d+;|#x[0-9A-Fa-f]+;)")
_RECORD = "identifier string, datestamp string, deleted boolean, metadata_xml string"


def repaired(payload: str) -> tuple[str, int]:
    """An XML text with its bare ampersands escaped, and how many there were."""
    return _BARE.subn("&amp;", payload)


def _page(payload: str) -> str:
    try:
        page, repairs = parsers.parse_oai(payload), 0
    except ET.ParseError:
        fixed, repairs = repaired(payload)
        if not repairs:
            raise
        page = parsers.parse_oai(fixed)
    return json.dumps({"records": page["records"], "repairs": repairs})


@F.pandas_udf(T.StringType())
def _pages_json(payload: pd.Series) -> pd.Series:
    return payload.map(_page)


def _dublin_core(xml: str) -> str:
    root = ET.fromstring(xml)
    out: dict[str, list[str]] = {}
    for e in root.iter():
        if e.tag.startswith("{http://purl.org/dc/elements/1.1/}") and e.text:
            out.setdefault(parsers._local(e.tag), []).append(" ".join(e.text.split()))
    return json.dumps(out)


@F.pandas_udf(T.StringType())
def _dublin_core_json(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: None if not x else _dublin_core(x))


def oai_records(pages: DataFrame) -> DataFrame:
    """The records of OAI pages (source_object_id, provenance_event_id, payload and more), each with its place and the repairs of its page."""
    read = pages.withColumn("_p", F.from_json(_pages_json(F.col("payload")), f"records array<struct<{_RECORD.replace(' ', ':').replace(',:', ',')}>>, repairs int"))
    kept = [c for c in pages.columns if c != "payload"]
    return read.select(*kept, F.col("_p.repairs").alias("repairs"), F.posexplode("_p.records").alias("place", "r")).select(*kept, "repairs", "place", "r.*")


def _object_kind(doi: Column, identifiers: Column) -> Column:
    low = F.lower(F.concat_ws(" ", doi, F.array_join(identifiers, " ")))
    return (
        F.when(low.rlike("egusphere-egu|meetings[.]copernicus|/conference"), "conference_abstract")
        .when(low.contains("/preprints/") | doi.rlike(r"^10\.5194/[a-z0-9]+-\d{4}-\d+$"), "discussion_preprint")
        .when(low.contains("/articles/"), "final_article")
        .otherwise("other_posted_content")
    )


def discussion_records(records: DataFrame, source: str = "copernicus", version: str = "5") -> Tables:
    """OAI records of a publisher with public discussions. records: source_object_id, provenance_event_id, identifier, datestamp, deleted, metadata_xml, place, source_url, licence, release_class.

    Every record leaves its wrapper; those with a DOI a metadata artifact, and those that are not
    conference abstracts a work. Only discussed preprints are gate events; their outcome is open.
    """
    shape = "identifier array<string>, title array<string>, date array<string>, language array<string>, rights array<string>, description array<string>"
    r = records.withColumn("there", ~F.coalesce("deleted", F.lit(False)) & (F.coalesce("metadata_xml", F.lit("")) != "")).withColumn("m", F.from_json(_dublin_core_json(F.when(F.col("there"), F.col("metadata_xml"))), shape))
    none = F.array().cast("array<string>")
    ids = F.coalesce("m.identifier", none)
    r = r.withColumn("doi", F.get(F.filter(F.transform(ids, lambda v: canonical_doi(v, ascii_only=True)), lambda d: d.isNotNull()), F.lit(0)))
    first = lambda name: F.get(F.col(f"m.{name}"), F.lit(0))
    stamp = text.moment(F.col("datestamp"))
    date = text.moment(F.coalesce(first("date"), "datestamp"))
    r = r.withColumn("kind", _object_kind(F.col("doi"), ids)).withColumn("date", date).withColumn("stamp", stamp).withColumn("observed_at", F.coalesce("stamp", "date"))
    tail = F.regexp_extract("doi", "^[^/]*/(.*)$", 1)
    r = r.withColumn("journal", F.when(tail.contains("-"), F.lower(F.substring_index(tail, "-", 1))).otherwise("copernicus")).withColumn("year", F.coalesce(F.year("date"), F.year("stamp"), F.lit(1970)))
    label = F.when(~F.col("there"), "deleted").when(F.col("doi").isNull(), "unclassified").otherwise(F.col("kind"))
    pointer = F.concat(F.lit("bundle.records["), F.col("place").cast("string"), F.lit("]"))
    native = F.coalesce("identifier", F.concat(F.lit("record:"), F.sha2(F.coalesce("metadata_xml", F.lit("")), 256)))
    size = F.coalesce(F.octet_length("metadata_xml"), F.lit(0))
    rights = F.coalesce(first("rights"), F.lit("CC-BY-4.0"))
    wrapper = _rows(
        r, "content_artifact", source, content_artifact_id=_key("content_artifact", source, F.concat(F.lit("wrapper|"), native)), object_type=F.concat(F.lit("oai_record_wrapper__"), label), media_type=F.lit("application/xml"), source_url=F.col("source_url"), local_pointer=pointer,
        licence=F.col("licence"), release_class=F.col("release_class"), size_bytes=F.when(F.col("there"), size).otherwise(F.lit(0)), language=first("language"), parser_version=F.lit(version),
    )
    known = r.where(F.col("doi").isNotNull())
    metadata = _rows(
        known, "content_artifact", source, content_artifact_id=_key("content_artifact", source, F.col("doi")), object_type=F.concat(F.lit("copernicus_"), "kind", F.lit("_metadata")), media_type=F.lit("application/xml"), source_url=F.concat(F.lit("https://doi.org/"), "doi"), local_pointer=pointer,
        licence=rights, release_class=F.lit("redistribute"), size_bytes=size, language=first("language"), parser_version=F.lit(version),
    )
    works = known.where(F.col("kind") != "conference_abstract")
    cycle_native = F.concat_ws("|", "journal", F.col("year").cast("string"))
    gate, cycle = _key("gate", source, F.col("journal")), _key("gate_cycle", source, cycle_native)
    candidate, work_version = stable_id("candidate", F.lit("doi"), F.col("doi")), stable_id("candidate_version", F.lit("doi"), F.col("doi"))
    day = lambda m, d, *t: F.make_timestamp(F.col("year"), F.lit(m), F.lit(d), *map(F.lit, t))
    domain = F.lit("earth and environmental sciences")
    abstract = F.nullif(F.array_join(F.coalesce("m.description", none), "\n"), F.lit(""))
    return _first(
        {
            "content_artifact": wrapper.unionByName(metadata),
            "gate": _rows(works, "gate", source, gate_id=gate, native_id=F.col("journal"), name=F.col("journal"), organization=F.lit("Copernicus Publications"), domain=domain, country=F.lit("DE"), architecture=F.lit("access_public_discussion")),
            "gate_cycle": _rows(
                works, "gate_cycle", source, gate_cycle_id=cycle, gate_id=gate, native_id=cycle_native, name=F.concat_ws(" ", "journal", F.col("year").cast("string")), cycle_start=day(1, 1, 0, 0, 0), cycle_end=day(12, 31, 23, 59, 59), architecture=F.lit("access_public_discussion"), status=F.lit("observed")
            ),
            "candidate": _rows(works, "candidate", source, candidate_id=candidate, first_observed_at=F.col("date"), domain=domain, candidate_type=F.col("kind"), canonical_title=first("title"), status=F.lit("visible")),
            "candidate_version": _rows(
                works, "candidate_version", source, candidate_version_id=work_version, candidate_id=candidate, native_id=F.col("doi"), version_label=F.when(F.col("kind") == "discussion_preprint", "public_discussion_preprint").otherwise("final_article"), created_at=F.col("date"), modified_at=F.col("stamp"),
                title=first("title"), abstract=abstract, licence=rights, language=first("language"), authorship_visible=F.lit(True), withdrawn=F.lit(False),
            ),
            "identifier_alias": _alias(works, source, "candidate", candidate, "doi", F.col("doi"), F.col("doi"), "native"),
            "candidate_gate_event": _rows(
                works.where(F.col("kind") == "discussion_preprint"), "candidate_gate_event", source, candidate_gate_event_id=_key("candidate_gate_event", source, F.concat_ws("|", cycle, "doi")), candidate_id=candidate, candidate_version_id=work_version, gate_cycle_id=cycle, native_id=F.col("doi"),
                earliest_observed_stage=F.lit("post_access_public_discussion"), final_observed_stage=F.lit("outcome_unresolved_or_censored"), coverage_observation_id=_key("coverage", source, F.concat(cycle, F.lit("|discussion_preprint"))),
            ),
        }
    )


_RESULT = "id string, source string, doi string, pmcid string, pmid string, title string, abstractText string, pubType string, pubTypeList string, journalTitle string, license string, language string, isRetracted string, commentCorrectionList string"


def _listed(column: Column, key: str) -> Column:
    """Items (as JSON) of a list that is given as such, under a key, or as a single item under that key."""
    inner = F.coalesce(F.when(column.startswith("{"), F.get_json_object(column, f"$.{key}")), F.when(column.startswith("["), column))
    return F.coalesce(F.from_json(F.when(inner.startswith("["), inner).when(inner.isNotNull(), F.concat(F.lit("["), F.when(inner.startswith("{"), inner).otherwise(F.to_json(F.array(inner)).substr(F.lit(2), F.length(F.to_json(F.array(inner))) - 2)), F.lit("]"))), "array<string>"), F.array().cast("array<string>"))


def life_science_results(raw: DataFrame, source: str = "europe_pmc") -> Tables:
    """Search results of a life-science index: works with their names and journal, retractions, withdrawals and corrections. raw also has created_at (timestamp) and release_class."""
    r = raw.withColumn("w", F.from_json("payload", _RESULT)).where(F.col("w").isNotNull()).withColumn("doi", canonical_doi(F.col("w.doi"))).withColumn("observed_at", F.col("created_at"))
    native = F.coalesce("doi", "w.pmcid", F.concat_ws(":", F.coalesce("w.source", F.lit("None")), F.coalesce("w.id", F.lit("None"))))
    r = r.withColumn("native", native)
    space = F.when(F.col("doi").isNotNull(), "doi").otherwise(source)
    r = r.withColumn("candidate", stable_id("candidate", space, F.col("native"))).withColumn("version", stable_id("candidate_version", space, F.col("native")))
    kinds = F.lower(F.array_join(_listed(F.col("w.pubTypeList"), "pubType"), " "))
    low = F.lower(F.coalesce("w.title", F.lit("")))
    retracted = F.coalesce(F.upper("w.isRetracted").isin("Y", "TRUE", "1"), F.lit(False))
    withdrawn = kinds.contains("withdraw") | low.startswith("withdrawn") | low.startswith("removed")
    r = r.withColumn("retracted", retracted).withColumn("withdrawn", withdrawn)
    gone = r.where(F.col("retracted") | F.col("withdrawn")).withColumn("what", F.when(F.col("retracted"), "retraction").otherwise("withdrawal"))
    fixed = r.select("*", F.posexplode(_listed(F.col("w.commentCorrectionList"), "commentCorrection")).alias("place", "c"))
    target = F.coalesce(F.get_json_object("c", "$.id"), F.lit(""))
    target_source = F.lower(F.coalesce(F.get_json_object("c", "$.source"), F.lit(source)))
    fixed = fixed.withColumn("target", target).withColumn("target_source", target_source).withColumn("kind", F.coalesce(F.get_json_object("c", "$.type"), F.lit("comment_correction")))
    linked = fixed.where(F.col("target") != "")
    other = stable_id("candidate", F.col("target_source"), F.col("target"))
    schemes = [_alias(r.where(v.isNotNull() & (v != "")), source, "candidate", F.col("candidate"), s, v, F.lower(v), "native") for s, v in (("doi", F.col("doi")), ("pmcid", F.col("w.pmcid")), ("pmid", F.col("w.pmid")))]
    journal = F.col("w.journalTitle")
    because = F.to_json(F.struct(F.col("w.isRetracted").alias("isRetracted"), F.when(F.col("withdrawn"), F.substring_index(F.lower("w.title"), ":", 1)).alias("title_status_prefix")), {"ignoreNullFields": "false"})
    return _first(
        {
            "candidate": _rows(
                r, "candidate", source, candidate_id=F.col("candidate"), first_observed_at=F.col("created_at"), domain=F.lit("biomedical and life sciences"), candidate_type=F.coalesce("w.pubType", F.lit("scholarly_work")), canonical_title=F.col("w.title"),
                status=F.when(F.col("retracted"), "retracted").when(F.col("withdrawn"), "withdrawn").otherwise("visible"),
            ),
            "candidate_version": _rows(
                r, "candidate_version", source, candidate_version_id=F.col("version"), candidate_id=F.col("candidate"), native_id=F.col("native"), version_label=F.coalesce("w.pubType", F.lit("indexed")), created_at=F.col("created_at"), title=F.col("w.title"),
                abstract=F.when(F.col("release_class") != "pointer_hash", F.col("w.abstractText")), licence=F.col("w.license"), language=F.col("w.language"), authorship_visible=F.lit(True), withdrawn=F.col("withdrawn"),
            ),
            "identifier_alias": _all(schemes),
            "field_assignment": _rows(
                r.where(F.coalesce(journal, F.lit("")) != ""), "field_assignment", source, field_assignment_id=_key("field_assignment", source, F.concat_ws("|", "candidate", F.lit("journal"), journal)), entity_kind=F.lit("candidate"), entity_id=F.col("candidate"), taxonomy=F.lit("europe_pmc_journal"),
                native_label=journal, score=F.lit(1.0), mapping_version=F.lit("native/1"),
            ),
            "downstream_outcome": _all(
                [
                    _rows(
                        gone, "downstream_outcome", source, downstream_outcome_id=_key("downstream_outcome", source, F.concat_ws("|", "candidate", "what")), candidate_id=F.col("candidate"), candidate_version_id=F.col("version"), outcome_type=F.col("what"), native_id=F.coalesce("w.id", "native"), doi=F.col("doi"),
                        venue=journal, value_json=canonical_json(because), censoring_date=F.col("created_at"),
                    ),
                    _rows(
                        fixed, "downstream_outcome", source, downstream_outcome_id=_key("downstream_outcome", source, F.concat_ws("|", "candidate", F.lit("correction"), F.col("place").cast("string"), "target_source", "target")), candidate_id=F.col("candidate"), candidate_version_id=F.col("version"),
                        outcome_type=F.col("kind"), native_id=F.nullif("target", F.lit("")), venue=journal, value_json=canonical_json(F.col("c")), censoring_date=F.col("created_at"),
                    ),
                ]
            ),
            "lineage_edge": _rows(
                linked, "lineage_edge", source, lineage_edge_id=_key("lineage_edge", source, F.concat_ws("|", "candidate", other, F.coalesce(F.get_json_object("c", "$.type"), F.lit("None")))), source_candidate_id=F.col("candidate"), source_version_id=F.col("version"), target_candidate_id=other,
                relation_type=F.col("kind"), declared=F.lit(True), confidence=F.lit(1.0), linkage_tier=F.lit("source_declared"), method_version=F.lit("europe-pmc-comment-correction/1"), evidence_json=canonical_json(F.col("c")),
            ),
        }
    )
