"""Keyed deduplication of normalised rows, and field-level last-write-wins merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.history import latest

#: Columns that differ between observations of the same record. Fixed values.
VOLATILE = ("source_object_id", "provenance_event_id", "observed_at", "record_version")
#: For each table the columns that may differ besides, and which observation then wins. Fixed values.
TOLERATED = {
    "candidate": ("first_observed_at", "canonical_title", "status"),
    "evaluation": ("forum_native_id",),
    "content_artifact": ("size_bytes", "local_pointer", "source_url"),
}


def semantic_digest(df: DataFrame, key: str, ignored: tuple[str, ...]) -> Column:
    """SHA-256 of all columns but the key and the ignored ones."""
    kept = [c for c in df.columns if c != key and c not in ignored]
    return F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256)


def deduplicate(df: DataFrame, table: str, key: str, order: list[str]) -> DataFrame:
    """One row a key, by the table's rule; keys whose other columns differ fail.

    Rows alike but for volatile columns keep the first observed. Candidates may differ in first
    date, title and status: the latest row wins, with the earliest date and the latest title
    and status that are known. Evaluations may differ in their forum: the earliest observed
    wins. Artifacts may differ in size and pointers: process artifacts keep the earliest, others
    the largest. Everything is one aggregation by key, combined before the shuffle.
    """
    extra = tuple(c for c in TOLERATED.get(table, ()) if c in df.columns)
    rows = df.withColumn("_digest", semantic_digest(df, key, VOLATILE + extra))
    position = F.struct(*order)
    whole = F.struct(*df.columns)
    aggs = [F.min("_digest").alias("_d0"), F.max("_digest").alias("_d1"), F.min_by(whole, position).alias("_first"), F.max_by(whole, position).alias("_last")]
    if table == "candidate":
        aggs.append(F.min("first_observed_at").alias("_date"))
        for c in ("canonical_title", "status"):
            aggs.append(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), position)).alias(f"_{c}"))
    if table == "content_artifact":
        aggs.append(F.max_by(whole, F.struct(F.coalesce("size_bytes", F.lit(-1).cast("long")), *order)).alias("_largest"))
    got = rows.groupBy(key).agg(*aggs)
    conflict = F.raise_error(F.concat(F.lit(f"conflicting rows of {table} with key "), F.col(key).cast("string"))).cast("boolean")
    got = got.where(F.when(F.col("_d0") == F.col("_d1"), True).otherwise(conflict))
    if table == "candidate":
        changed = {"first_observed_at": F.col("_date"), "canonical_title": F.col("_canonical_title"), "status": F.col("_status")}
        return got.select(*[changed.get(c, F.col(f"_last.{c}")).alias(c) for c in df.columns])
    if table == "content_artifact":
        process = F.col("_first.object_type").startswith("process")
        return got.select(*[F.when(process, F.col(f"_first.{c}")).otherwise(F.col(f"_largest.{c}")).alias(c) for c in df.columns])
    return got.select("_first.*")


def alias_conflicts(aliases: DataFrame, scheme: str = "scheme", value: str = "canonical_value", entity: str = "entity_id") -> DataFrame:
    """(scheme, value, entities) of identifiers that stand for several entities."""
    return aliases.where(F.col(value).isNotNull()).groupBy(scheme, value).agg(F.array_sort(F.collect_set(entity)).alias("entities")).where(F.size("entities") > 1)


def flag_conflicts(aliases: DataFrame, key: str = "identifier_alias_id", scheme: str = "scheme", value: str = "canonical_value", entity: str = "entity_id") -> DataFrame:
    """All aliases; those of several entities get their own keys and a conflict status."""
    bad = alias_conflicts(aliases, scheme, value, entity).select(scheme, value, F.lit(True).alias("_bad"))
    marked = aliases.join(bad, [scheme, value], "left")
    rekeyed = F.concat_ws(":", F.col(key), F.substring(F.sha2(F.col(entity), 256), 1, 16))
    return marked.withColumn(key, F.when(F.col("_bad"), rekeyed).otherwise(F.col(key))).withColumn("conflict_status", F.when(F.col("_bad"), "conflict").otherwise(F.col("conflict_status"))).select(*aliases.columns)


def merge_fields(edits: DataFrame, key: str, field: str, value: str, clock: list[str], deleted: str | None = None) -> DataFrame:
    """(key, field, value): the value of the greatest clock for each field; a deletion that wins removes the field.

    Edits may come in any order and more than once: the result is the same.
    """
    drop = F.col(deleted) if deleted else F.lit(False)
    won = edits.groupBy(key, field).agg(F.max_by(F.struct(F.col(value).alias("v"), drop.alias("d")), F.struct(*clock)).alias("w"))
    return won.where(~F.coalesce(F.col("w.d"), F.lit(False))).select(key, field, F.col("w.v").alias(value))


def materialize(fields: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """(key, state): the merged fields of each key as a map, by field name."""
    return fields.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("state"))


def exact_and_conflicting(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """One row: keys, rows, exact repeats and keys with conflicting payloads."""
    by = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(payload).alias("k"))
    return by.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.sum(F.col("n") - F.col("k")).alias("exact_repeats"), F.count_if(F.col("k") > 1).alias("conflicting_keys"))


def total_latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, the greatest by all other columns: a total order, so reruns agree."""
    return latest(df, keys, [c for c in df.columns if c not in keys])
