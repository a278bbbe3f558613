"""The canonical tables: one registry from which Spark schemas, DDL, JSON Schema and row checks are derived."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES: dict[str, tuple[T.DataType, str, str]] = {
    "str": (T.StringType(), "VARCHAR", "string"),
    "json": (T.StringType(), "JSON", "string"),
    "int": (T.LongType(), "BIGINT", "integer"),
    "dbl": (T.DoubleType(), "DOUBLE", "number"),
    "bool": (T.BooleanType(), "BOOLEAN", "boolean"),
    "ts": (T.TimestampType(), "TIMESTAMPTZ", "string"),
    "list": (T.ArrayType(T.StringType()), "VARCHAR[]", "array"),
}
#: Fields that all tables but three end with; "!" marks a field that is never null.
COMMON = "source_id! source_object_id! provenance_event_id! observed_at:ts! record_version:int!"
WITHOUT_COMMON = ("source_object", "provenance_event", "field_provenance")
#: Fields of each table as name:type, a string where no type is given; the first is the key. Fixed by the data model.
TABLES: dict[str, str] = {
    "gate": "gate_id! native_id! name! organization domain country architecture! active_from:ts active_to:ts",
    "gate_cycle": "gate_cycle_id! gate_id! native_id! name track cycle_start:ts cycle_end:ts policy_version_id architecture! received_count:int observable_count:int evaluated_count:int selected_count:int status",
    "policy_version": "policy_version_id! gate_id! native_id! effective_at:ts valid_to:ts criteria_json:json rubric_json:json stage_rules_json:json quota_or_cap anonymity_model revision_rules policy_url content_hash date_confidence:dbl",
    "candidate": "candidate_id! first_observed_at:ts domain candidate_type! canonical_title status",
    "candidate_version": "candidate_version_id! candidate_id! native_id! version_label version_number:int created_at:ts modified_at:ts title abstract content_artifact_id content_hash licence language authorship_visible:bool withdrawn:bool",
    "candidate_gate_event": "candidate_gate_event_id! candidate_id! candidate_version_id gate_cycle_id! native_id! submitted_at:ts earliest_observed_stage! final_observed_stage coverage_observation_id!",
    "evaluation": "evaluation_id! candidate_version_id! gate_cycle_id! native_id! evaluation_type! evaluator_role evaluator_public_id evaluator_protected_id anonymous:bool official:bool criterion_native criterion_normalized criterion_value criterion_value_numeric:dbl scale_json:json confidence_value:dbl text_artifact_id created_at:ts forum_native_id invitation_native readers_json:json signatures_json:json reply_to_native_id",
    "decision_event": "decision_event_id! candidate_version_id! gate_cycle_id! native_id! stage_native! stage_normalized! outcome_native outcome_normalized tier_or_band reason deciding_body decided_at:ts policy_version_id",
    "content_artifact": "content_artifact_id! object_type! media_type byte_hash normalized_text_hash source_url local_pointer licence release_class! size_bytes:int language parser_version",
    "lineage_edge": "lineage_edge_id! source_candidate_id source_version_id target_candidate_id target_version_id relation_type! declared:bool! confidence:dbl linkage_tier method_version evidence_json:json",
    "capacity_observation": "capacity_observation_id! gate_cycle_id! period_start:ts period_end:ts submitted_count:int review_count:int evaluator_count:int panel_size:int assignments_per_evaluator:dbl turnaround_days:dbl missing_review_share:dbl proxy_definition measurement_caveat",
    "coverage_observation": "coverage_observation_id! gate_cycle_id! object_type! earliest_public_stage! observability_grade! expected_count:int found_count:int coverage_ratio:dbl expected_count_method query_or_invitation known_hidden_stages:list known_exclusions:list missing_reason audit_status valid_from:ts valid_to:ts",
    "downstream_outcome": "downstream_outcome_id! candidate_id! candidate_version_id outcome_type! native_id doi venue occurred_at:ts window_years:int value_numeric:dbl value_json:json censoring_date:ts",
    "source_object": "source_object_id! source_id! native_id! object_type! source_url created_at:ts modified_at:ts retrieved_at:ts! deleted_at:ts byte_hash raw_pointer http_status:int etag last_modified licence release_class! status!",
    "provenance_event": "provenance_event_id! source_id! source_object_id! event_type! occurred_at:ts! parser_name parser_version code_hash input_hash output_hash parameters_json:json parent_event_ids:list success:bool! error",
    "field_provenance": "field_provenance_id! table_name! record_id! field_name! source_object_id! provenance_event_id! source_selector confidence:dbl override_reason observed_at:ts!",
    "identifier_alias": "identifier_alias_id! entity_kind! entity_id! scheme! value! canonical_value relation confidence:dbl conflict_status",
    "reference_edge": "reference_edge_id! citing_version_id! reference_position:int cited_candidate_id cited_version_id cited_identifier raw_citation_hash match_method confidence:dbl time_valid:bool",
    "field_assignment": "field_assignment_id! entity_kind! entity_id! taxonomy! native_label normalized_label score:dbl mapping_version",
    "identity_visibility": "identity_visibility_id! candidate_version_id! identity_kind! visible_from:ts visible_to:ts audience! source_evidence",
    "authorship_observation": "authorship_observation_id! candidate_version_id! position:int public_name public_identifier protected_person_id anonymous_label visible_from:ts visible_to:ts audience! source_evidence",
    "language_derivative": "language_derivative_id! content_artifact_id! source_language target_language method model_version derived_artifact_id validated:bool",
}


def fields(table: str) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) of each field."""
    spec = TABLES[table] + ("" if table in WITHOUT_COMMON else f" {COMMON}")
    out = []
    for item in spec.split():
        name, _, kind = item.rstrip("!").partition(":")
        out.append((name, kind or "str", not item.endswith("!")))
    return out


def primary_key(table: str) -> str:
    return fields(table)[0][0]


def time_column(table: str) -> str:
    """The column that orders a table's history."""
    names = [f[0] for f in fields(table)]
    return next(c for c in ("observed_at", "retrieved_at", "occurred_at") if c in names)


def spark_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k][0], null) for n, k, null in fields(table)])


def sql_ddl(table: str) -> str:
    lines = [f'  "{n}" {_TYPES[k][1]}{"" if null else " NOT NULL"}' for n, k, null in fields(table)]
    return f'CREATE TABLE "{table}" (\n' + ",\n".join(lines) + f',\n  PRIMARY KEY ("{primary_key(table)}")\n)'


def json_schema(table: str) -> dict:
    def kind(k: str, null: bool) -> dict:
        base: dict = {"type": [_TYPES[k][2], "null"] if null else _TYPES[k][2]}
        if k == "ts":
            base["format"] = "date-time"
        if k == "list":
            base["items"] = {"type": "string"}
        return base

    rows = fields(table)
    return {"title": table, "type": "object", "additionalProperties": False, "properties": {n: kind(k, null) for n, k, null in rows}, "required": [n for n, _, null in rows if not null]}


def _timestamp(value: Column, nullable: bool) -> Column:
    """ISO text to a timestamp; an all-zero year is null where the field may be null, other bad dates fail."""
    parsed = F.try_to_timestamp(value)
    zero = value.rlike("^0+-")
    bad = F.raise_error(F.concat(F.lit("bad timestamp: "), value)).cast("timestamp")
    out = F.when(value.isNull(), None)
    if nullable:
        out = out.when(zero, None)
    return out.when(parsed.isNotNull(), parsed).otherwise(bad)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Rows with exactly the table's columns: unknown columns refused, absent ones null, values coerced, required ones enforced."""
    known = {n for n, _, _ in fields(table)}
    if extra := [c for c in df.columns if c not in known]:
        raise ValueError(f"{table} has no fields {', '.join(sorted(extra))}")
    kinds = dict(df.dtypes)
    out = []
    for n, k, null in fields(table):
        spark_type = _TYPES[k][0]
        if n not in kinds:
            value = F.lit(None).cast(spark_type)
        elif k == "ts" and kinds[n] == "string":
            value = _timestamp(F.col(n), null)
        elif k in ("str", "json") and kinds[n].startswith(("struct", "array", "map")):
            value = F.to_json(F.col(n))
        else:
            value = F.col(n).cast(spark_type)
        if not null:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{table}.{n} is null")).cast(spark_type)).otherwise(value)
        out.append(value.alias(n))
    return df.select(out)


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(primary_key(table)).count().where(F.col("count") > 1)


def catalog() -> str:
    """All JSON Schemas and DDL statements as one JSON document."""
    return json.dumps({t: {"schema": json_schema(t), "ddl": sql_ddl(t)} for t in TABLES}, sort_keys=True, indent=1)
