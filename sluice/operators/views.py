"""The ten analysis views over the canonical tables, their audit, and the trace of a field to its source."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import rules

Tables = Mapping[str, DataFrame]

#: What each view may be used for, and whether features from after the decision are allowed in it. Fixed values.
CONTRACTS: dict[str, tuple[str, bool]] = {
    "entry_selection": ("decision_time", False),
    "stage_selection": ("decision_time", False),
    "evaluation_descriptive": ("evaluation_time", False),
    "portfolio_descriptive": ("descriptive_population", False),
    "stage_transitions": ("event_history", False),
    "lineage": ("time_ordered_lineage", False),
    "afterlife": ("downstream_outcome_only", True),
    "funding_evaluability": ("descriptive_population", False),
    "patent_examination": ("event_history", False),
    "licence_safe_content": ("content_availability", False),
}
#: Features that only exist after a decision. Fixed values.
AFTER_DECISION = ("final_version", "future_citation", "post_decision_identity")


def _graded(t: Tables, analysis: str, *more: str) -> DataFrame:
    """Gate events whose coverage has a grade that the analysis admits."""
    coverage = t["coverage_observation"].where(rules.admitted(F.col("observability_grade"), analysis)).select("coverage_observation_id", "observability_grade", *more)
    return t["candidate_gate_event"].join(coverage, "coverage_observation_id").select(*[F.col(c) for c in t["candidate_gate_event"].columns], "observability_grade", *more)


def entry_selection(t: Tables) -> DataFrame:
    """Events seen from the entry on."""
    return _graded(t, "entry_selection", "earliest_public_stage")


def stage_selection(t: Tables) -> DataFrame:
    """Events seen from a known stage on."""
    return _graded(t, "stage_selection", "earliest_public_stage")


def evaluation_descriptive(t: Tables) -> DataFrame:
    """Evaluations of events with an admitted grade: one row for each such event."""
    keys = ["candidate_version_id", "gate_cycle_id"]
    events = _graded(t, "evaluation").select(*keys, "observability_grade")
    e = t["evaluation"]
    return e.join(events, keys).select(*[F.col(c) for c in e.columns], "observability_grade")


def portfolio_descriptive(t: Tables) -> DataFrame:
    """Events of any known grade."""
    return _graded(t, "portfolio")


def stage_transitions(t: Tables) -> DataFrame:
    """Events with the decisions on their version in their cycle; events without one stay."""
    keys = ["candidate_version_id", "gate_cycle_id"]
    decided = ["stage_native", "stage_normalized", "outcome_native", "outcome_normalized", "decided_at"]
    events = _graded(t, "transitions")
    return events.join(t["decision_event"].select(*keys, *decided), keys, "left").select(*[F.col(c) for c in t["candidate_gate_event"].columns], *decided, "observability_grade")


def lineage(t: Tables) -> DataFrame:
    """Admitted edges with the dates of both versions: one table joined twice."""
    edges = t["lineage_edge"].where(rules.lineage_admitted(F.col("declared"), F.col("linkage_tier"), F.col("confidence")))
    version = lambda side: t["candidate_version"].select(F.col("candidate_version_id").alias(f"{side}_version_id"), F.col("created_at").alias(f"{side}_created_at"))
    joined = edges.join(version("source"), "source_version_id", "left").join(version("target"), "target_version_id", "left")
    return joined.select(*[F.col(c) for c in t["lineage_edge"].columns], "source_created_at", "target_created_at")


def afterlife(t: Tables) -> DataFrame:
    """Outcomes whose observation has a known end, with their candidate."""
    o = t["downstream_outcome"].where(F.col("censoring_date").isNotNull())
    c = t["candidate"].select("candidate_id", "canonical_title", "candidate_type")
    return o.join(c, "candidate_id").select(*[F.col(x) for x in t["downstream_outcome"].columns], "canonical_title", "candidate_type")


def _architecture(t: Tables, analysis: str, architecture: str) -> DataFrame:
    cycles = t["gate_cycle"].where(F.col("architecture") == architecture).select("gate_cycle_id")
    return _graded(t, analysis).join(cycles, "gate_cycle_id").select(*[F.col(c) for c in t["candidate_gate_event"].columns], "observability_grade")


def funding_evaluability(t: Tables) -> DataFrame:
    """Events of funding by lottery within a band."""
    return _architecture(t, "funding", "fundable_band_lottery")


def patent_examination(t: Tables) -> DataFrame:
    """Events of examination by prosecution."""
    return _architecture(t, "patent", "prosecution_examination")


def licence_safe_content(t: Tables) -> DataFrame:
    """Artifacts that may be passed on."""
    return t["content_artifact"].where(F.col("release_class") == "redistribute")


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    f.__name__: f for f in (entry_selection, stage_selection, evaluation_descriptive, portfolio_descriptive, stage_transitions, lineage, afterlife, funding_evaluability, patent_examination, licence_safe_content)
}
#: Tables that each view reads.
NEEDS: dict[str, tuple[str, ...]] = {
    "entry_selection": ("candidate_gate_event", "coverage_observation"),
    "stage_selection": ("candidate_gate_event", "coverage_observation"),
    "evaluation_descriptive": ("evaluation", "candidate_gate_event", "coverage_observation"),
    "portfolio_descriptive": ("candidate_gate_event", "coverage_observation"),
    "stage_transitions": ("candidate_gate_event", "coverage_observation", "decision_event"),
    "lineage": ("lineage_edge", "candidate_version"),
    "afterlife": ("downstream_outcome", "candidate"),
    "funding_evaluability": ("candidate_gate_event", "coverage_observation", "gate_cycle"),
    "patent_examination": ("candidate_gate_event", "coverage_observation", "gate_cycle"),
    "licence_safe_content": ("content_artifact",),
}


def install(tables: Tables) -> list[str]:
    """Temporary views analysis_<name> of every view whose tables are there."""
    made = [name for name, needs in NEEDS.items() if all(n in tables for n in needs)]
    for name in made:
        VIEWS[name](tables).createOrReplaceTempView(f"analysis_{name}")
    return made


def inadmissible(view: str, available_at: Column, decided_at: Column, role: Column) -> Column:
    """Whether a feature may not be used in a view: it is of a role from after the decision, or was there too late."""
    if view not in CONTRACTS:
        raise ValueError(f"analysis view has no temporal contract: {view}")
    if CONTRACTS[view][1]:
        return F.lit(False)
    return rules.leaks(available_at, decided_at, role, AFTER_DECISION)


def audit(t: Tables) -> DataFrame:
    """(issue, rows) of what the tables at hand lack: events without coverage or with several, traced fields without source or event."""
    found = []
    if {"candidate_gate_event", "coverage_observation"} <= set(t):
        keys = t["coverage_observation"].groupBy("coverage_observation_id").agg(F.count(F.lit(1)).alias("n"))
        events = t["candidate_gate_event"].join(keys, "coverage_observation_id", "left").groupBy("candidate_gate_event_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.count_if(F.col("n").isNull()).alias("orphans"))
        found.append(events.agg(F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphan_candidate_gate_coverage"), F.count_if(F.col("n") > 1).alias("ambiguous_candidate_gate_coverage")))
    if {"field_provenance", "source_object", "provenance_event"} <= set(t):
        for issue, table, key in (("orphan_field_source", "source_object", "source_object_id"), ("orphan_field_event", "provenance_event", "provenance_event_id")):
            found.append(t["field_provenance"].join(t[table].select(key), key, "left_anti").agg(F.count(F.lit(1)).alias(issue)))
    each = [df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("long"))])).alias("issue", "rows")) for df in found]
    return reduce(DataFrame.unionByName, each)


def trace_field(t: Tables, table: Column | str, record: Column | str, field: Column | str) -> DataFrame:
    """What is known of the origin of a field of a record: raw bytes, parser and hashes, in order of observation."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = t["field_provenance"].where((F.col("table_name") == lit(table)) & (F.col("record_id") == lit(record)) & (F.col("field_name") == lit(field)))
    return traced(t, rows).orderBy("observed_at")


def traced(t: Tables, rows: DataFrame) -> DataFrame:
    """Field observations with the source and the event that they come from."""
    source = t["source_object"].select("source_object_id", "byte_hash", "raw_pointer", "source_url")
    event = t["provenance_event"].select("provenance_event_id", "parser_name", "parser_version", "code_hash", "input_hash", "output_hash")
    out = rows.join(source, "source_object_id").join(event, "provenance_event_id")
    return out.select(*[F.col(c) for c in t["field_provenance"].columns], "byte_hash", "raw_pointer", "source_url", "parser_name", "parser_version", "code_hash", "input_hash", "output_hash")
