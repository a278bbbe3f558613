"""Normalisers of providers' payloads into rows of the canonical tables.

Each takes raw payloads (source_object_id, provenance_event_id, payload and what came with them) and
returns rows by table, one a key: the earliest observed. Payloads are parsed by declared schemas and
fanned out by selections; nothing is remembered between payloads, so any part can run anywhere.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import schema
from sluice.functions import text
from sluice.functions.identifiers import canonical_doi, canonical_identifier, collapse, stable_id
from sluice.functions.json_text import canonical_json
from sluice.sources import parsers

Tables = dict[str, DataFrame]


def _key(kind: str, source: str, value: Column) -> Column:
    return stable_id(kind, F.lit(source), value)


def _rows(df: DataFrame, table: str, source: str, **values: Column) -> DataFrame:
    """Rows of a table from a frame with source_object_id, provenance_event_id and observed_at."""
    common = {"source_id": F.lit(source), "source_object_id": F.col("source_object_id"), "provenance_event_id": F.col("provenance_event_id"), "observed_at": F.col("observed_at"), "record_version": F.lit(1)}
    return schema.conform(df.select(*[v.alias(k) for k, v in (values | common).items()]), table)


def _first(tables: Tables) -> Tables:
    """One row a key: the earliest observed, then the smallest source object."""
    out = {}
    for name, df in tables.items():
        best = F.min_by(F.struct(*df.columns), F.struct("observed_at", "source_object_id"))
        out[name] = df.groupBy(schema.primary_key(name)).agg(best.alias("r")).select("r.*")
    return out


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _alias(df: DataFrame, source: str, kind: str, entity: Column, scheme: str, value: Column, canonical: Column, relation: str, confidence: float = 1.0) -> DataFrame:
    key = _key("identifier_alias", source, F.concat(F.lit(f"{kind}|{scheme}|"), value))
    return _rows(df, "identifier_alias", source, identifier_alias_id=key, entity_kind=F.lit(kind), entity_id=entity, scheme=F.lit(scheme), value=value, canonical_value=canonical, relation=F.lit(relation), confidence=F.lit(confidence), conflict_status=F.lit("none"))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


_PARTS = "struct<`date-parts`:array<array<int>>>"
_STAMP = "struct<`date-time`:string,timestamp:bigint>"
_WORK = f"DOI string, URL string, type string, subtype string, title array<string>, language string, license array<struct<URL:string>>, published {_PARTS}, `published-online` {_PARTS}, `published-print` {_PARTS}, issued {_PARTS}, created {_STAMP}, indexed {_STAMP}, relation map<string,array<string>>"


def _stamp(name: str) -> Column:
    return F.coalesce(F.try_to_timestamp(F.col(f"w.{name}.date-time")), F.timestamp_millis(f"w.{name}.timestamp"))


def _published() -> Column:
    """The first known publication date of a work; missing months and days are the first."""
    each = []
    for name in ("published-online", "published-print", "published", "issued"):
        parts = F.get(F.col(f"w.`{name}`.`date-parts`"), F.lit(0))
        part = lambda i, p=parts: F.coalesce(F.get(p, F.lit(i)), F.lit(1))
        each.append(F.when(F.get(parts, F.lit(0)).isNotNull(), F.try_make_timestamp(F.get(parts, F.lit(0)), part(1), part(2), F.lit(0), F.lit(0), F.lit(0))))
    return F.coalesce(*each)


def deposited_works(raw: DataFrame, source: str, provider: str, architecture: str, earliest_stage: str) -> Tables:
    """Works that a publisher has deposited: one gate, a cycle a year, the works, and the relations that they declare. No submission is implied."""
    w = raw.withColumn("w", F.from_json("payload", _WORK)).withColumn("doi", canonical_doi(F.col("w.DOI"))).where(F.col("doi").isNotNull())
    w = w.withColumn("created_at", F.coalesce(_published(), _stamp("created"))).withColumn("modified_at", _stamp("indexed")).withColumn("observed_at", F.coalesce("modified_at", "created_at"))
    year = F.coalesce(F.year("created_at"), F.lit(1970))
    gate, cycle = _key("gate", source, F.lit(provider)), _key("gate_cycle", source, year.cast("string"))
    candidate, version = stable_id("candidate", F.lit("doi"), F.col("doi")), stable_id("candidate_version", F.lit("doi"), F.col("doi"))
    coverage = _key("coverage", source, F.concat(cycle, F.lit("|work_metadata")))
    title = F.when(F.size("w.title") > 0, F.nullif(F.array_join("w.title", " "), F.lit("")))
    links = w.select("*", F.explode("w.relation").alias("relation_type", "targets")).select("*", F.explode("targets").alias("t")).withColumn("target", canonical_doi(F.get_json_object("t", "$.id"))).where(F.col("target").isNotNull())
    other, other_version = stable_id("candidate", F.lit("doi"), F.col("target")), stable_id("candidate_version", F.lit("doi"), F.col("target"))
    return _first(
        {
            "gate": _rows(w, "gate", source, gate_id=gate, native_id=F.lit(provider.lower().replace(" ", "_")), name=F.lit(provider), organization=F.lit(provider), architecture=F.lit(architecture)),
            "gate_cycle": _rows(
                w, "gate_cycle", source, gate_cycle_id=cycle, gate_id=gate, native_id=year.cast("string"), name=F.concat_ws(" ", F.lit(provider), year.cast("string")), cycle_start=F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
                cycle_end=F.make_timestamp(year, F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59)), architecture=F.lit(architecture), status=F.lit("visible-deposit"),
            ),
            "candidate": _rows(w, "candidate", source, candidate_id=candidate, first_observed_at=F.col("created_at"), candidate_type=F.coalesce("w.type", F.lit("scholarly_work")), canonical_title=title, status=F.lit("visible")),
            "candidate_version": _rows(
                w, "candidate_version", source, candidate_version_id=version, candidate_id=candidate, native_id=F.col("doi"), version_label=F.coalesce("w.subtype", "w.type"), created_at=F.col("created_at"), modified_at=F.col("modified_at"), title=title,
                licence=F.get(F.col("w.license"), F.lit(0))["URL"], language=F.col("w.language"), authorship_visible=F.lit(True), withdrawn=F.lit(False),
            ),
            "candidate_gate_event": _rows(
                w, "candidate_gate_event", source, candidate_gate_event_id=_key("candidate_gate_event", source, F.concat_ws("|", cycle, "doi")), candidate_id=candidate, candidate_version_id=version, gate_cycle_id=cycle, native_id=F.col("doi"),
                earliest_observed_stage=F.lit(earliest_stage), final_observed_stage=F.lit("visible_deposited_object"), coverage_observation_id=coverage,
            ),
            "identifier_alias": _all([_alias(w, source, "candidate", candidate, "doi", F.col("doi"), F.col("doi"), "native"), _alias(links, source, "candidate", other, "doi", F.col("target"), F.col("target"), "native")]),
            "lineage_edge": _rows(
                links, "lineage_edge", source, lineage_edge_id=_key("lineage_edge", source, F.concat_ws("|", candidate, "relation_type", other)), source_candidate_id=candidate, source_version_id=version, target_candidate_id=other, target_version_id=other_version,
                relation_type=F.col("relation_type"), declared=F.lit(True), confidence=F.lit(1.0), linkage_tier=F.lit("source_declared"), method_version=F.lit("crossref-relation/1"), evidence_json=canonical_json(F.col("t")),
            ),
        }
    )


_TOPIC = "struct<id:string,display_name:string,score:double,field:struct<display_name:string>>"
_INDEXED = f"id string, doi string, type string, display_name string, language string, publication_date string, updated_date string, primary_topic {_TOPIC}, primary_location struct<version:string,license:string>, topics array<{_TOPIC}>, referenced_works array<string>"


def indexed_works(raw: DataFrame, source: str = "openalex") -> Tables:
    """Works of an open index: the work, its version, its names, its topics, and the works that it cites, in order."""
    w = raw.withColumn("w", F.from_json("payload", _INDEXED)).withColumn("oid", F.substring_index(F.col("w.id"), "/", -1)).where(F.col("oid").isNotNull())
    w = w.withColumn("doi", canonical_doi(F.col("w.doi"))).withColumn("created_at", text.moment(F.col("w.publication_date"))).withColumn("modified_at", text.moment(F.col("w.updated_date"))).withColumn("observed_at", F.coalesce("modified_at", "created_at"))
    named = lambda kind: F.when(F.col("doi").isNotNull(), stable_id(kind, F.lit("doi"), F.coalesce("doi", F.lit("-")))).otherwise(_key(kind, source, F.col("oid")))
    w = w.withColumn("candidate", named("candidate")).withColumn("version", named("candidate_version"))
    topics = w.select("*", F.explode("w.topics").alias("t"))
    cited = w.select("*", F.posexplode("w.referenced_works").alias("place", "c")).withColumn("cited", F.substring_index("c", "/", -1))
    with_doi = w.where(F.col("doi").isNotNull())
    return _first(
        {
            "candidate": _rows(
                w, "candidate", source, candidate_id=F.col("candidate"), first_observed_at=F.col("created_at"), domain=F.col("w.primary_topic.field.display_name"), candidate_type=F.coalesce("w.type", F.lit("scholarly_work")), canonical_title=F.col("w.display_name"), status=F.lit("visible")
            ),
            "candidate_version": _rows(
                w, "candidate_version", source, candidate_version_id=F.col("version"), candidate_id=F.col("candidate"), native_id=F.col("oid"), version_label=F.coalesce("w.primary_location.version", F.lit("indexed")), created_at=F.col("created_at"), modified_at=F.col("modified_at"),
                title=F.col("w.display_name"), licence=F.col("w.primary_location.license"), language=F.col("w.language"), authorship_visible=F.lit(True), withdrawn=F.lit(False),
            ),
            "identifier_alias": _all([_alias(w, source, "candidate", F.col("candidate"), "openalex", F.col("oid"), F.lower("oid"), "native"), _alias(with_doi, source, "candidate", F.col("candidate"), "doi", F.col("doi"), F.col("doi"), "native")]),
            "field_assignment": _rows(
                topics, "field_assignment", source, field_assignment_id=_key("field_assignment", source, F.concat_ws("|", "candidate", F.coalesce("t.id", F.lit("None")))), entity_kind=F.lit("candidate"), entity_id=F.col("candidate"), taxonomy=F.lit("openalex_topics"),
                native_label=F.col("t.display_name"), normalized_label=F.col("t.field.display_name"), score=F.col("t.score"), mapping_version=F.lit("openalex-snapshot/API-2026"),
            ),
            "reference_edge": _rows(
                cited, "reference_edge", source, reference_edge_id=_key("reference_edge", source, F.concat_ws("|", "version", F.col("place").cast("string"), "cited")), citing_version_id=F.col("version"), reference_position=F.col("place"), cited_candidate_id=_key("candidate", source, F.col("cited")),
                cited_version_id=_key("candidate_version", source, F.col("cited")), cited_identifier=F.col("cited"), match_method=F.lit("openalex_declared"), confidence=F.lit(1.0),
            ),
        }
    )


_GROUP = "id string, missing boolean, tcdate string, tmdate string, content map<string,string>"


def _json_map(settings: Column) -> Column:
    """Settings (raw JSON by key) as one canonical JSON object."""
    # to_json of a one-element array gives the escaped key between brackets.
    made = F.transform(F.map_entries(settings), lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"(?s)^\[(.*)\]$", 1), F.lit(": "), e["value"]))
    return canonical_json(F.concat(F.lit("{"), F.array_join(made, ", "), F.lit("}")))


def venue_settings(raw: DataFrame, source: str = "openreview_surface") -> Tables:
    """Public settings of venues as gates, cycles and policies; what concerns contacts is left out. raw also has source_url."""
    g = raw.withColumn("g", F.from_json("payload", _GROUP)).where(F.col("g.id").isNotNull() & ~F.coalesce("g.missing", F.lit(False)))
    created, modified = text.epoch_moment(F.col("g.tcdate")), text.epoch_moment(F.col("g.tmdate"))
    g = g.withColumn("venue", F.col("g.id")).withColumn("created_at", created).withColumn("modified_at", modified).withColumn("observed_at", F.coalesce("modified_at", "created_at"))
    # A setting is its "value" where it has one.
    value = lambda v: F.coalesce(F.when(v.startswith("{"), F.get_json_object(v, "$.value")), v)
    raw_value = lambda v: F.when(v.rlike(r'^\{.*"value"'), F.to_json(F.from_json(v, "value variant")["value"])).otherwise(F.when(v.rlike(r'^(\{|\[|"|-?\d|true$|false$|null$)'), v).otherwise(F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))))
    public = text.public_configuration(F.coalesce("g.content", F.create_map().cast("map<string,string>")))
    g = g.withColumn("plain", F.transform_values(public, lambda _, v: value(v))).withColumn("raw", F.transform_values(public, lambda _, v: raw_value(v)))
    low = F.lower("venue")
    architecture = (
        F.when((low == "tmlr") | low.contains("transactions_on_machine_learning_research"), "rolling_threshold")
        .when(low.rlike("conference|workshop|symposium|meeting"), "competitive_quota")
        .when(F.col("plain")["public_submissions"] == "true", "rolling_threshold")
        .otherwise("unknown")
    )
    year = F.nullif(F.regexp_extract("venue", r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    gate, cycle = _key("gate", source, F.col("venue")), _key("gate_cycle", source, F.col("venue"))
    policy = _key("policy_version", source, F.concat_ws("|", "venue", F.coalesce("g.tmdate", F.lit("None"))))
    chosen = lambda pattern: _json_map(F.map_filter("raw", lambda k, _: F.lower(k).rlike(pattern)))
    title, subtitle = F.col("plain")["title"], F.col("plain")["subtitle"]
    return _first(
        {
            "gate": _rows(g, "gate", source, gate_id=gate, native_id=F.col("venue"), name=F.coalesce(title, subtitle, "venue"), organization=F.substring_index("venue", "/", 1), architecture=architecture, active_from=F.col("created_at")),
            "policy_version": _rows(
                g, "policy_version", source, policy_version_id=policy, gate_id=gate, native_id=F.col("venue"), effective_at=F.col("observed_at"), criteria_json=chosen("review"), rubric_json=chosen("rating|score|confidence"),
                stage_rules_json=chosen("submission|decision|withdraw|desk_reject|public_"), anonymity_model=F.lit("native configuration retained"), revision_rules=chosen("revision"), policy_url=F.col("source_url"), content_hash=F.sha2(_json_map(F.col("raw")), 256),
                date_confidence=F.when(F.col("g.tmdate").isNotNull(), 1.0).otherwise(0.5),
            ),
            "gate_cycle": _rows(
                g, "gate_cycle", source, gate_cycle_id=cycle, gate_id=gate, native_id=F.col("venue"), name=F.coalesce(subtitle, title, "venue"), cycle_start=F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
                cycle_end=F.make_timestamp(year, F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59)), policy_version_id=policy, architecture=architecture, status=F.lit("surface-mapped"),
            ),
        }
    )


_NOTE = "id string, forum string, title string, abstract string, outcome string, venue string, venueid string, tier string, cdate string, odate string, pdate string, prior_submission string, review_text string, rating_raw string, confidence_raw string, technical_novelty_raw string, empirical_novelty_raw string"


def review_records(raw: DataFrame, source: str = "openreview", version: str = "2") -> Tables:
    """Lines of submission and review files. raw also has object_type (submission or review), file (its name), line, native_id, licence, release_class and source_url.

    Repeats of a line count once; lines of one object that differ are an error.
    """
    n = raw.withColumn("n", F.from_json("payload", _NOTE)).withColumn("own", F.coalesce("n.id", "n.forum", "native_id"))
    n = n.withColumn("digest", F.sha2("payload", 256))
    once = n.groupBy("object_type", "own").agg(F.min_by(F.struct(*n.columns), F.struct("file", "line")).alias("r"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
    conflict = F.raise_error(F.concat(F.lit("conflicting duplicate native object: "), "own")).cast("boolean")
    n = once.where(F.when(F.col("d0") == F.col("d1"), True).otherwise(conflict)).select("r.*")
    cdate, odate, pdate = (text.epoch_moment(F.col(f"n.{c}")) for c in ("cdate", "odate", "pdate"))
    stem = F.regexp_replace(F.regexp_replace("file", r"\.jsonl$", ""), "_reviews", "")
    year = F.when(stem.startswith("ICLR_"), F.substring(stem, 6, 1 << 20))
    quarter = text.year_quarter(cdate)
    rolling = F.concat(F.lit("tmlr-"), quarter["year"].cast("string"), F.lit("-q"), quarter["quarter"].cast("string"))
    n = (
        n.withColumn("gate_native", F.when(year.isNotNull(), "iclr").otherwise("tmlr"))
        .withColumn("cycle_native", F.when(year.isNotNull(), F.concat(F.lit("iclr-"), year)).otherwise(rolling))
        .withColumn("cycle_name", F.when(year.isNotNull(), F.concat(F.lit("ICLR "), year)).otherwise(F.concat(F.lit("TMLR "), quarter["year"].cast("string"), F.lit(" Q"), quarter["quarter"].cast("string"))))
        .withColumn("architecture", F.when(year.isNotNull(), "competitive_quota").otherwise("rolling_threshold"))
        .withColumn("created_at", cdate)
        .withColumn("modified_at", odate)
        .withColumn("observed_at", F.coalesce(odate, cdate))
    )
    gate, cycle = _key("gate", source, F.col("gate_native")), _key("gate_cycle", source, F.col("cycle_native"))
    n = n.withColumn("forum", F.coalesce(F.nullif("n.forum", F.lit("")), "n.id"))
    noted = n.where(F.coalesce("forum", F.lit("")) != "")
    candidate, candidate_version = _key("candidate", source, F.col("forum")), _key("candidate_version", source, F.col("forum"))
    reviews, submissions = noted.where(F.col("object_type") == "review"), noted.where(F.col("object_type") != "review")
    with_text = reviews.where(F.coalesce("n.review_text", F.lit("")) != "")
    artifact = _key("content_artifact", source, F.concat(F.lit("review|"), F.coalesce("n.id", F.lit("None"))))
    own_artifact = F.when(F.coalesce("n.review_text", F.lit("")) != "", artifact)
    native = F.coalesce("n.id", "native_id")

    def evaluation(df: DataFrame, key: Column, native_id: Column, criterion: Column, normalized: Column, value: Column, scale: Column, confidence: Column) -> DataFrame:
        return _rows(
            df, "evaluation", source, evaluation_id=key, candidate_version_id=candidate_version, gate_cycle_id=cycle, native_id=native_id, evaluation_type=F.lit("official_review"), evaluator_role=F.lit("reviewer"), anonymous=F.lit(True), official=F.lit(True), criterion_native=criterion,
            criterion_normalized=normalized, criterion_value=value, criterion_value_numeric=text.first_number(value), scale_json=scale, confidence_value=confidence, text_artifact_id=own_artifact, created_at=F.col("created_at"), forum_native_id=F.col("forum"), reply_to_native_id=F.col("forum"),
        )

    main = evaluation(reviews, _key("evaluation", source, native), native, F.lit("overall_rating"), F.lit("overall_recommendation"), F.col("n.rating_raw"), canonical_json(F.to_json(F.struct(F.col("n.rating_raw").alias("rating_raw")), {"ignoreNullFields": "false"})), text.first_number(F.col("n.confidence_raw")))
    criteria = F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(m).alias("normalized"), F.col(f"n.{c}").alias("value")) for c, m in (("confidence_raw", "reviewer_confidence"), ("technical_novelty_raw", "technical_novelty"), ("empirical_novelty_raw", "empirical_novelty"))])
    each = reviews.select("*", F.explode(criteria).alias("c")).where(F.coalesce("c.value", F.lit("")) != "")
    more = evaluation(each, _key("evaluation", source, F.concat_ws("|", "n.id", "c.criterion")), F.concat_ws(":", "n.id", "c.criterion"), F.col("c.criterion"), F.col("c.normalized"), F.col("c.value"), _none(), _none("double"))
    outcome = F.coalesce(F.nullif("n.outcome", F.lit("")), F.lit("unknown"))
    stage = F.when(outcome == "accepted", "selected").when(outcome.isin("rejected", "withdrawn", "desk_rejected"), outcome).otherwise("outcome_unknown")
    policy = _key("policy_version", source, F.col("cycle_native"))
    prior = submissions.where(F.coalesce("n.prior_submission", F.lit("")) != "").withColumn("before", F.substring_index("n.prior_submission", "id=", -1))
    return _first(
        {
            "gate": _rows(n, "gate", source, gate_id=gate, native_id=F.col("gate_native"), name=F.upper("gate_native"), organization=F.lit("OpenReview venue"), domain=F.lit("machine learning"), architecture=F.col("architecture")),
            "gate_cycle": _rows(n, "gate_cycle", source, gate_cycle_id=cycle, gate_id=gate, native_id=F.col("cycle_native"), name=F.col("cycle_name"), policy_version_id=policy, architecture=F.col("architecture"), status=F.lit("observed")),
            "content_artifact": _rows(
                with_text, "content_artifact", source, content_artifact_id=artifact, object_type=F.lit("review_text"), media_type=F.lit("text/plain"), byte_hash=F.sha2("n.review_text", 256), normalized_text_hash=F.sha2(collapse(F.col("n.review_text")), 256), source_url=F.col("source_url"),
                local_pointer=F.concat(F.col("file"), F.lit("#line="), F.col("line").cast("string")), licence=F.col("licence"), release_class=F.col("release_class"), size_bytes=F.octet_length("n.review_text"), parser_version=F.lit(version),
            ),
            "evaluation": main.unionByName(more),
            "candidate": _rows(submissions, "candidate", source, candidate_id=candidate, first_observed_at=F.col("created_at"), domain=F.lit("machine learning"), candidate_type=F.lit("manuscript"), canonical_title=F.col("n.title"), status=F.col("n.outcome")),
            "candidate_version": _rows(
                submissions, "candidate_version", source, candidate_version_id=candidate_version, candidate_id=candidate, native_id=F.col("forum"), version_label=F.lit("submitted"), version_number=F.lit(1), created_at=F.col("created_at"), modified_at=F.col("modified_at"), title=F.col("n.title"),
                abstract=F.col("n.abstract"), licence=F.lit("per-object"), withdrawn=F.coalesce(F.col("n.outcome") == "withdrawn", F.lit(False)),
            ),
            "candidate_gate_event": _rows(
                submissions, "candidate_gate_event", source, candidate_gate_event_id=_key("candidate_gate_event", source, F.concat_ws("|", cycle, "forum")), candidate_id=candidate, candidate_version_id=candidate_version, gate_cycle_id=cycle, native_id=F.col("forum"), submitted_at=F.col("created_at"),
                earliest_observed_stage=F.lit("submission_record"), final_observed_stage=stage, coverage_observation_id=_key("coverage", source, F.concat(cycle, F.lit("|submission"))),
            ),
            "decision_event": _rows(
                submissions, "decision_event", source, decision_event_id=_key("decision_event", source, F.concat_ws("|", cycle, "forum", outcome)), candidate_version_id=candidate_version, gate_cycle_id=cycle, native_id=F.concat_ws(":", "forum", outcome),
                stage_native=F.coalesce(F.nullif("n.venueid", F.lit("")), F.lit("decision")), stage_normalized=F.lit("final_observed_decision"), outcome_native=F.coalesce(F.nullif("n.venue", F.lit("")), outcome), outcome_normalized=outcome, tier_or_band=F.col("n.tier"),
                deciding_body=F.upper("gate_native"), decided_at=F.coalesce(pdate, "modified_at"), policy_version_id=policy,
            ),
            # The key names the platform, the row the kind of number.
            "identifier_alias": _rows(
                submissions, "identifier_alias", source, identifier_alias_id=_key("identifier_alias", source, F.concat(F.lit("candidate|openreview|"), "forum")), entity_kind=F.lit("candidate"), entity_id=candidate, scheme=F.lit("openreview_forum"), value=F.col("forum"), canonical_value=F.col("forum"),
                relation=F.lit("native"), confidence=F.lit(1.0), conflict_status=F.lit("none"),
            ),
            "lineage_edge": _rows(
                prior, "lineage_edge", source, lineage_edge_id=_key("lineage_edge", source, F.concat_ws("|", "before", "forum")), source_candidate_id=_key("candidate", source, F.col("before")), source_version_id=_key("candidate_version", source, F.col("before")), target_candidate_id=candidate,
                target_version_id=candidate_version, relation_type=F.lit("source_declared_resubmission"), declared=F.lit(True), confidence=F.lit(1.0), linkage_tier=F.lit("source_declared"), method_version=F.lit("openreview-prior/1"),
                evidence_json=canonical_json(F.to_json(F.struct(F.col("n.prior_submission").alias("prior_submission")))),
            ),
        }
    )


_OAI = "id string, identifiers array<string>, title string, abstract string, description string, doi string, categories string, license string, authors string, journal_ref string, created string, dates array<string>, versions array<struct<label:string,date:string>>"


def _oai_fields(payload: str) -> dict:
    """The fields of a preprint's metadata, white space collapsed."""
    root = ET.fromstring(payload)
    named = lambda name: [e for e in root.iter() if parsers._local(e.tag) == name]
    one = lambda name: next((t for e in named(name)[:1] if (t := " ".join("".join(e.itertext()).split()))), None)
    many = lambda name: [" ".join(e.text.split()) for e in named(name) if e.text]
    versions = [{"label": e.get("version") or f"v{i}", "date": " ".join("".join(next((d.itertext() for d in e.iter() if parsers._local(d.tag) == "date"), ())).split())} for i, e in enumerate(named("version"), 1)]
    return {
        "id": one("id"), "identifiers": many("identifier"), "title": one("title"), "abstract": one("abstract"), "description": next(iter(many("description")), None), "doi": one("doi"), "categories": one("categories"), "license": one("license"), "authors": one("authors"),
        "journal_ref": one("journal-ref"), "created": one("created"), "dates": many("date"), "versions": versions,
    }


@F.pandas_udf(T.StringType())
def _oai_json(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: None if x is None else json.dumps(_oai_fields(x)))


def preprints(raw: DataFrame, source: str = "arxiv") -> Tables:
    """Preprints of an OAI repository: the work, each version with the visibility of its authors, the chain of versions, and its names.

    raw: identifier, datestamp, deleted and metadata_xml of each record, and metadata_prefix. Deleted records and
    those without a number give no rows.
    """
    m = raw.where(~F.coalesce("deleted", F.lit(False)) & (F.coalesce("metadata_xml", F.lit("")) != "")).withColumn("m", F.from_json(_oai_json(F.col("metadata_xml")), _OAI))
    listed = F.get(F.filter("m.identifiers", lambda v: v.contains("arxiv.org/")), F.lit(0))
    number = canonical_identifier(F.lit("arxiv"), F.coalesce("m.id", listed, F.substring_index("identifier", ":", -1)))
    m = m.withColumn("number", number).where(F.coalesce("number", F.lit("")) != "")
    doi = F.coalesce(canonical_doi(F.col("m.doi")), F.get(F.filter(F.transform("m.identifiers", lambda v: canonical_doi(v, ascii_only=True)), lambda d: d.isNotNull()), F.lit(0)))
    dated = F.filter(F.transform("m.versions", lambda v: F.struct(v["label"].alias("label"), text.moment(v["date"]).alias("at"))), lambda v: v["at"].isNotNull())
    plain = F.when(F.size("m.dates") > 0, F.col("m.dates")).otherwise(F.array(F.coalesce("m.created", "datestamp")))
    fallback = F.filter(F.transform(plain, lambda d, i: F.struct(F.concat(F.lit("v"), (i + 1).cast("string")).alias("label"), text.moment(d).alias("at"))), lambda v: v["at"].isNotNull())
    m = m.withColumn("doi", doi).withColumn("entries", F.when(F.size(dated) > 0, dated).otherwise(fallback))
    m = m.withColumn("created_at", F.coalesce(F.get("entries", F.lit(0))["at"], text.moment(F.col("datestamp")))).withColumn("observed_at", F.coalesce(text.moment(F.col("datestamp")), "created_at"))
    entries = F.when(F.size("entries") > 0, F.col("entries")).otherwise(F.array(F.struct(F.lit("v1").alias("label"), F.col("created_at").alias("at"))))
    candidate = _key("candidate", source, F.col("number"))
    abstract = F.coalesce("m.abstract", "m.description")
    versions = m.withColumn("entries", entries).select("*", F.posexplode("entries").alias("place", "v")).withColumn("before", F.when(F.col("place") > 0, F.get("entries", F.col("place") - 1)["label"]))
    name = lambda label: _key("candidate_version", source, F.concat_ws("|", "number", label))
    own = name(F.col("v.label"))
    chain = versions.where(F.col("before").isNotNull())
    iso = F.date_format("v.at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return _first(
        {
            "candidate": _rows(m, "candidate", source, candidate_id=candidate, first_observed_at=F.col("created_at"), domain=F.col("m.categories"), candidate_type=F.lit("preprint"), canonical_title=F.col("m.title"), status=F.lit("public")),
            "candidate_version": _rows(
                versions, "candidate_version", source, candidate_version_id=own, candidate_id=candidate, native_id=F.concat("number", "v.label"), version_label=F.col("v.label"), version_number=F.col("place") + 1, created_at=F.col("v.at"), modified_at=F.col("v.at"), title=F.col("m.title"), abstract=abstract,
                licence=F.coalesce("m.license", F.lit("per-submission")), authorship_visible=F.lit(True), withdrawn=F.lit(False),
            ),
            "identity_visibility": _rows(
                versions, "identity_visibility", source, identity_visibility_id=_key("identity_visibility", source, F.concat(own, F.lit("|authors"))), candidate_version_id=own, identity_kind=F.lit("authors"), visible_from=F.col("v.at"), audience=F.lit("public"),
                source_evidence=canonical_json(F.to_json(F.struct(F.col("m.authors").alias("authors"), F.col("metadata_prefix")), {"ignoreNullFields": "false"})),
            ),
            "lineage_edge": _rows(
                chain, "lineage_edge", source, lineage_edge_id=_key("lineage_edge", source, F.concat_ws("|", name(F.col("before")), own)), source_candidate_id=candidate, source_version_id=name(F.col("before")), target_candidate_id=candidate, target_version_id=own,
                relation_type=F.lit("source_declared_version"), declared=F.lit(True), confidence=F.lit(1.0), linkage_tier=F.lit("source_declared"), method_version=F.lit("arxiv-oai-dates/1"),
                evidence_json=F.concat(F.lit('{"version_date": "'), iso, F.lit('", "version_number": '), (F.col("place") + 1).cast("string"), F.lit("}")),
            ),
            "identifier_alias": _all(
                [
                    _alias(m, source, "candidate", candidate, "arxiv", F.col("number"), F.lower("number"), "native"),
                    _alias(m.where(F.col("doi").isNotNull()), source, "candidate", candidate, "doi", F.col("doi"), F.col("doi"), "publication"),
                    _alias(m.where(F.col("m.journal_ref").isNotNull()), source, "candidate", candidate, "journal_ref", F.col("m.journal_ref"), collapse(F.lower("m.journal_ref")), "source_declared_publication", 0.8),
                ]
            ),
        }
    )
