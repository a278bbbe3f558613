"""Point-in-time reads of append-only histories, and comparisons of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key by the given columns, all descending with nulls last.

    max_by over a struct aggregates partially before the shuffle, so one key with a third
    of all rows costs one row per task. Structs compare nulls as smallest, as "nulls last" in
    descending order does.
    """
    order_by = F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_by).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def current(history: DataFrame, key: str, time: str, version: str | None = "record_version", source: str | None = "source_id") -> DataFrame:
    """Current state: the greatest version, then the latest time, then the greatest source."""
    return latest(history, [key], [c for c in (version, time, source) if c])


def as_of(history: DataFrame, keys: list[str], cutoff: Column, time: str, ties: list[str], deleted: Column | None = None) -> DataFrame:
    """The state at a cutoff: latest row of each key up to it; a latest row already deleted then hides the key."""
    state = latest(history.where(F.col(time) <= cutoff), keys, [time, *ties])
    return state if deleted is None else state.where(~F.coalesce(deleted, F.lit(False)))


def change_from_previous(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Each row with the previous value of its key and whether it differs; the first row has no previous value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("changed", F.col("previous").isNotNull() & ~F.col(value).eqNullSafe(F.col("previous")))


def change_from_qualifying(df: DataFrame, keys: list[str], order: list[Column], value: str, qualifies: Column) -> DataFrame:
    """As change_from_previous, but only qualifying rows become "previous" and only they claim a change."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(qualifies, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w)
    marked = df.withColumn("_seen", seen)
    return marked.withColumn("previous", F.col("_seen.v")).withColumn("changed", qualifies & F.col("_seen").isNotNull() & ~F.col(value).eqNullSafe(F.col("_seen.v"))).drop("_seen")


def changed_fields(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The names of the columns that differ from the key's previous row, null-safe; null for its first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(*columns)).over(w)
    marked = df.withColumn("_before", before)
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_before.{c}")), F.lit(c)) for c in columns]))
    return marked.withColumn("changed_fields", F.when(F.col("_before").isNotNull(), names)).drop("_before")


def manifest_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, modified or unchanged for each key of two manifests."""
    b = before.select(*keys, F.col(value).alias("before_value"), F.lit(True).alias("_b"))
    a = after.select(*keys, F.col(value).alias("after_value"), F.lit(True).alias("_a"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("before_value").eqNullSafe(F.col("after_value")), "unchanged").otherwise("modified")
    return b.join(a, keys, "full").withColumn("status", status).select(*keys, "before_value", "after_value", "status")


def history_drift(history: DataFrame, key: str) -> DataFrame:
    """One row: rows of the history, distinct keys, and superseded rows."""
    return history.agg(F.count("*").alias("history_rows"), F.count_distinct(key).alias("current_rows")).withColumn("superseded", F.col("history_rows") - F.col("current_rows"))


def schema_fingerprint(df: DataFrame) -> str:
    """A digest of the column names and types."""
    import hashlib

    return hashlib.sha256("|".join(f"{n}:{t}" for n, t in df.dtypes).encode()).hexdigest()
