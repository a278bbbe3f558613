"""Flow of candidates through stages, audits of keys, and matching of policies to periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.identifiers import stable_id


def star(base: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """The base with each pre-aggregated side joined to it; sides are one row a key."""
    return reduce(lambda left, right: left.join(right, key, "left"), sides, base)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of the child whose key the parent lacks."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def flow_checks(received: Column, observable: Column, evaluated: Column, selected: Column, decided: Column) -> Column:
    """Names of the violated inequalities of a cycle's counts."""
    return F.array_compact(
        F.array(
            F.when(observable > received, F.lit("observable_gt_received")),
            F.when(evaluated > observable, F.lit("evaluated_gt_observable")),
            F.when(selected > observable, F.lit("selected_gt_observable")),
            F.when(decided > observable, F.lit("decided_gt_observable")),
        )
    )


def match_interval(periods: DataFrame, intervals: DataFrame, key: str, start: str, end: str, valid_from: str, valid_to: str, interval_id: str, declared: str | None = None) -> DataFrame:
    """Each period with the interval that governs it and how it was found.

    A declared interval wins; else of the key's intervals that overlap the period (open ends are
    null, both ends count) the last by start, then id; else none. The range condition rides on
    an equality join, and of each period's matches only the greatest is aggregated.
    """
    period_id = "_period"
    p = periods.withColumn(period_id, F.monotonically_increasing_id())
    i = intervals.select(F.col(key).alias("_k"), F.col(valid_from).alias("_from"), F.col(valid_to).alias("_to"), F.col(interval_id).alias("_id"))
    overlap = (F.col(key) == F.col("_k")) & (F.col(end).isNull() | F.col("_from").isNull() | (F.col("_from") <= F.col(end))) & (F.col(start).isNull() | F.col("_to").isNull() | (F.col("_to") >= F.col(start)))
    best = p.join(i, overlap).groupBy(period_id).agg(F.max(F.struct("_from", "_id")).alias("_best"))
    out = p.join(best, period_id, "left")
    found = F.col("_best._id")
    given = F.col(declared) if declared else F.lit(None)
    how = F.when(given.isNotNull(), "source_declared").when(found.isNotNull(), "interval_overlap").otherwise("explicit_unknown_pointer")
    return out.withColumn("matched_id", F.coalesce(given, found)).withColumn("match_method", how).drop(period_id, "_best")


def cycle_flows(cycles: DataFrame) -> DataFrame:
    """Cycles with the counts that hold, their violations, and the grade that is left.

    Declared counts (received, observable_declared, evaluated_declared, selected_declared) go before
    what the provider expects (expected) and what is found (observable, evaluated, selected, decided).
    A violation takes grades A and B away.
    """
    final = lambda declared, found: F.coalesce(declared, found)
    out = cycles.withColumns(
        {"received_final": final("received", "expected"), "observable_final": final("observable_declared", "observable"), "evaluated_final": final("evaluated_declared", "evaluated"), "selected_final": final("selected_declared", "selected")}
    )
    checks = flow_checks(F.col("received_final"), F.col("observable_final"), F.col("evaluated_final"), F.col("selected_final"), F.col("decided"))
    out = out.withColumn("violations", checks)
    lost = (F.size("violations") > 0) & F.col("grade").isin("A", "B")
    return out.withColumn("effective_grade", F.when(lost, "U").otherwise(F.col("grade")))


def policy_archive(cycles: DataFrame, policies: DataFrame, source: Column, cycle_id: str = "gate_cycle_id", **names: str) -> DataFrame:
    """Each cycle with its policy as match_interval finds it; a cycle without one points to a policy made up for it, that says it is unknown."""
    found = match_interval(cycles, policies, **names)
    made = stable_id("policy_version", source, F.concat(F.lit("unknown:"), F.col(cycle_id).cast("string")))
    return found.withColumn("policy_version_id", F.coalesce(F.col("matched_id").cast("string"), made)).withColumn("release_treatment", F.when(F.col("matched_id").isNull(), "pointer_only_unknown"))


def missing_numbers(df: DataFrame, key: str, number: str, first: int = 1) -> DataFrame:
    """Numbers from the first to each key's greatest that it lacks."""
    seen = df.groupBy(key).agg(F.collect_set(F.col(number).cast("long")).alias("seen"), F.max(F.col(number).cast("long")).alias("top"))
    whole = F.when(F.col("top") >= first, F.sequence(F.lit(first).cast("long"), F.col("top"))).otherwise(F.array().cast("array<bigint>"))
    return seen.select(key, F.array_sort(F.array_except(whole, "seen")).alias("missing"))


def chain_positions(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """position, left_censored (first) and right_censored (last) of each row in its chain."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    return df.withColumn("position", (F.row_number().over(w) - 1).cast("long")).withColumn("left_censored", F.col("position") == 0).withColumn("right_censored", F.col("position") == F.count("*").over(whole) - 1)


def non_decreasing(df: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """Whether each key's values never fall in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_prev", F.lag(value).over(w)).groupBy(key).agg(F.bool_and(F.col("_prev").isNull() | (F.col(value) >= F.col("_prev"))).alias("ordered"))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest SHA-256 of their key."""
    return df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).orderBy("_h").limit(n).drop("_h")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """n rows in turn from the strata, each in order of the SHA-256 of its keys."""
    h = F.sha2(F.col(key).cast("string"), 256)
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(h))
    # No stratum gives more than n rows, so the sort sees n rows a stratum at most.
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).orderBy("_rn", stratum).limit(n).drop("_rn")
