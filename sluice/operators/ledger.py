"""Claim ledgers over guarded SQL, budget ledgers, and release gates."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SELECT = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)
_OTHER = re.compile(r"\b(insert|update|delete|drop|create|alter|copy|attach|install|load|set|call|merge|truncate|refresh|cache)\b", re.IGNORECASE)


def guarded(sql: str) -> str:
    """The statement if it is one SELECT and nothing else; else an error."""
    text = sql.strip().rstrip(";")
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if ";" in bare or not _SELECT.match(bare) or _OTHER.search(bare):
        raise ValueError("a claim is a single SELECT")
    return text


def run_claims(spark: SparkSession, claims: list[dict]) -> DataFrame:
    """(claim_id, expected, found, passes, digest): each claim's SQL gives one value, compared as text with what is claimed."""
    rows = []
    for c in claims:
        result = spark.sql(guarded(c["sql"]))
        first = result.limit(2).collect()
        if len(first) != 1 or len(first[0]) != 1:
            raise ValueError(f"claim {c['claim_id']} must give one value")
        found = first[0][0]
        body = json.dumps([c["claim_id"], c["sql"], str(found)], sort_keys=True)
        rows.append((c["claim_id"], str(c["expected"]), str(found), str(c["expected"]) == str(found), hashlib.sha256(body.encode()).hexdigest()))
    return spark.createDataFrame(rows, "claim_id string, expected string, found string, passes boolean, digest string")


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: str, limit: float | None = None) -> DataFrame:
    """Each entry with its key's total so far and whether that is beyond the limit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("running", F.sum(amount).over(w))
    return out if limit is None else out.withColumn("beyond", F.col("running") > limit)


def reconciled(df: DataFrame, estimate: str, actual: str, tolerance: float = 0.25) -> DataFrame:
    """Relative error of an estimate, and whether a new forecast is due; null without an estimate."""
    error = F.when(F.col(estimate) != 0, F.abs(F.col(actual) - F.col(estimate)) / F.abs(F.col(estimate)))
    return df.withColumn("relative_error", error).withColumn("reforecast", F.col("relative_error") > tolerance)


def gate(required: DataFrame, evidence: DataFrame, key: str, passed: Column) -> DataFrame:
    """Required items without passing evidence."""
    return required.join(evidence.where(passed).select(key).distinct(), key, "left_anti")


def conflict_collapse(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key: exact repeats dropped; a column with several values becomes null where numeric, joined by | where text, and is flagged."""
    kinds = dict(df.dtypes)
    got = df.groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])
    out = []
    for c in columns:
        one = F.when(F.size(c) == 1, F.element_at(c, 1))
        out.append((one.otherwise(F.when(F.size(c) > 1, F.array_join(c, "|"))) if kinds[c] == "string" else one).alias(c))
        out.append((F.size(c) > 1).alias(f"{c}_conflict"))
    return got.select(*keys, *out)


def name_year_map(df: DataFrame, name: str, year: str) -> DataFrame:
    """(name, years): each name's counts by year as a map, years in order."""
    counts = df.groupBy(name, year).agg(F.count("*").alias("n"))
    return counts.groupBy(name).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(year, "n")))).alias("years"))
