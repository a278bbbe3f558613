"""Peer-review deposits of the Crossref API as rows of the canonical tables.

Payloads are parsed by a declared schema and fanned out to tables by selections; nothing is
remembered between payloads, so any part can run anywhere and repeats are dropped by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import schema
from sluice.functions.identifiers import canonical_doi, stable_id
from sluice.functions.json_text import canonical_json

_DATE = "struct<`date-time`:string,timestamp:bigint>"
_TARGET = "array<struct<id:string,`id-type`:string>>"
#: Fields of a work that rows are made of.
WORK = f"DOI string, URL string, type string, subtype string, stage string, recommendation string, language string, created {_DATE}, indexed {_DATE}, author array<string>, relation map<string,{_TARGET}>"
SOURCE, NATIVE = "crossref_peer_review", "peer-review-discovery"
#: Version of this normalisation, as published artifacts carry it. Fixed value.
VERSION = "3"


def works(raw: DataFrame) -> DataFrame:
    """(source_object_id, provenance_event_id, retrieved_at, payload) to one row a work; pages of works (items) are opened."""
    page = F.from_json("payload", "items array<string>")["items"]
    opened = raw.select("source_object_id", "provenance_event_id", "retrieved_at", F.posexplode(F.coalesce(page, F.array("payload"))).alias("position", "json"), page.isNotNull().alias("paged"))
    created, indexed = (F.coalesce(F.try_to_timestamp(F.col(f"w.{c}.date-time")), F.timestamp_millis(f"w.{c}.timestamp")) for c in ("created", "indexed"))
    native = F.coalesce("w.DOI", "w.URL", stable_id("crossref_work", F.lit("crossref"), F.coalesce(canonical_json(F.col("json")), F.col("json"))))
    return opened.withColumn("w", F.from_json("json", WORK)).select("source_object_id", "provenance_event_id", "position", "paged", "json", "w", native.alias("native"), canonical_doi(F.col("w.DOI")).alias("doi"), created.alias("created_at"), F.coalesce(indexed, created, "retrieved_at").alias("observed_at"))


def _common() -> dict[str, Column]:
    return {"source_id": F.lit(SOURCE), "source_object_id": F.col("source_object_id"), "provenance_event_id": F.col("provenance_event_id"), "observed_at": F.col("observed_at"), "record_version": F.lit(1)}


def _rows(df: DataFrame, table: str, **values: Column) -> DataFrame:
    made = df.select(*[v.alias(k) for k, v in (values | _common()).items()])
    return schema.conform(made, table)


def normalize(raw: DataFrame) -> dict[str, DataFrame]:
    """Rows of each table, one a key."""
    w = works(raw)
    gate, cycle = (stable_id(k, F.lit(SOURCE), F.lit(NATIVE), ascii_only=True) for k in ("gate", "gate_cycle"))
    artifact = stable_id("content_artifact", F.lit(SOURCE), F.col("native"))
    review = F.coalesce("doi", "native")
    links = w.select("*", F.explode_outer("w.relation").alias("relation_type", "targets")).select("*", F.explode("targets").alias("t")).withColumn("target", canonical_doi(F.col("t.id"))).where(F.col("target").isNotNull())
    candidate, version = stable_id("candidate", F.lit("doi"), F.col("target")), stable_id("candidate_version", F.lit("doi"), F.col("target"))
    alias = lambda kind, value: stable_id("identifier_alias", F.lit(SOURCE), F.concat(F.lit(f"{kind}|doi|"), value))
    native_alias = {"scheme": F.lit("doi"), "relation": F.lit("native"), "confidence": F.lit(1.0), "conflict_status": F.lit("none")}
    own_aliases = _rows(w.where(F.col("doi").isNotNull()), "identifier_alias", identifier_alias_id=alias("content", F.col("doi")), entity_kind=F.lit("content_artifact"), entity_id=stable_id("content_artifact", F.lit("doi"), F.col("doi")), value=F.col("doi"), canonical_value=F.col("doi"), **native_alias)
    target_aliases = _rows(links, "identifier_alias", identifier_alias_id=alias("candidate", F.col("target")), entity_kind=F.lit("candidate"), entity_id=candidate, value=F.col("target"), canonical_value=F.col("target"), **native_alias)
    out = {
        "gate": _rows(w, "gate", gate_id=gate, native_id=F.lit(NATIVE), name=F.lit("Crossref peer-review deposits"), organization=F.lit("Crossref depositors"), architecture=F.lit("unknown")),
        "gate_cycle": _rows(w, "gate_cycle", gate_cycle_id=cycle, gate_id=gate, native_id=F.lit(NATIVE), name=F.lit("Crossref peer-review discovery snapshot"), architecture=F.lit("unknown"), status=F.lit("discovery-only")),
        "content_artifact": _rows(w, "content_artifact", content_artifact_id=artifact, object_type=F.lit("peer_review_metadata"), media_type=F.lit("application/json"), byte_hash=F.sha2(canonical_json(F.col("json")), 256), source_url=F.col("w.URL"), local_pointer=F.when(F.col("paged"), F.concat(F.lit("items["), "position", F.lit("]"))), licence=F.lit("Crossref-metadata-with-abstract-exception"), release_class=F.lit("pointer_hash"), size_bytes=F.octet_length(canonical_json(F.col("json"))), language=F.col("w.language"), parser_version=F.lit(VERSION)),
        "candidate": _rows(links, "candidate", candidate_id=candidate, first_observed_at=F.col("created_at"), candidate_type=F.lit("scholarly_work"), status=F.lit("visible")),
        "candidate_version": _rows(links, "candidate_version", candidate_version_id=version, candidate_id=candidate, native_id=F.col("target"), version_label=F.lit("reviewed_object")),
        "identifier_alias": own_aliases.unionByName(target_aliases),
        "evaluation": _rows(links, "evaluation", evaluation_id=stable_id("evaluation", F.lit(SOURCE), F.concat_ws("|", review, "relation_type", "target")), candidate_version_id=version, gate_cycle_id=cycle, native_id=review, evaluation_type=F.coalesce("w.subtype", "w.type", F.lit("peer-review")), anonymous=F.coalesce(F.exists("w.author", lambda a: F.lower(a).contains("anonymous")), F.lit(False)), criterion_native=F.col("w.stage"), criterion_value=F.col("w.recommendation"), text_artifact_id=artifact, created_at=F.col("created_at")),
    }
    first = lambda df, key: df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct("observed_at", "source_object_id")).alias("r")).select("r.*")
    return {t: first(df, schema.primary_key(t)) for t, df in out.items()}


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of a normalisation."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows") for t, df in sorted(tables.items())])
