"""Admissibility: observability grades, coverage rules and point-in-time visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grades that an analysis admits; U is never admitted. Fixed values.
ADMISSIBLE = {
    "entry_selection": ("A",),
    "stage_selection": ("A", "B"),
    "evaluation": ("A", "B", "C"),
    "portfolio": ("A", "B", "C", "D"),
    "transitions": ("A", "B", "C", "D"),
    "funding": ("A", "B", "C", "D"),
    "patent": ("A", "B"),
}


def admitted(grade: Column, analysis: str) -> Column:
    """Whether an analysis admits a grade; a null grade never."""
    return F.coalesce(grade.isin(*ADMISSIBLE[analysis]), F.lit(False))


def effective_grade(grade: Column, ratio: Column, violated: Column, least: float = 0.95) -> Column:
    """A and B fall to U without a coverage ratio, below the least one, or with violations."""
    return F.when(grade.isin("A", "B") & (F.coalesce(ratio < least, F.lit(True)) | F.coalesce(violated, F.lit(False))), "U").otherwise(grade)


def lineage_admitted(declared: Column, tier: Column, confidence: Column) -> Column:
    """Declared links, and those of the analysis tier from 0.97 on."""
    return F.coalesce(declared, F.lit(False)) | F.coalesce((tier == "analysis") & (confidence >= 0.97), F.lit(False))


def visible_at(moment: Column, audience: str, start: Column, end: Column, to: Column) -> Column:
    """Whether something is visible to an audience at a moment; open ends are null, both ends count."""
    return to.isin(audience, "public", "all") & (start.isNull() | (start <= moment)) & (end.isNull() | (moment <= end))


def leaks(feature_at: Column, decided_at: Column, role: Column, banned: tuple[str, ...] = ("final_version", "decision", "camera_ready")) -> Column:
    """Features from after the decision, or of a role that only exists after it."""
    return F.coalesce(feature_at > decided_at, F.lit(False)) | F.coalesce(role.isin(*banned), F.lit(False))


def require_no_leak(df: DataFrame, feature_at: str, decided_at: str, role: str) -> DataFrame:
    """The rows; reading one that leaks fails."""
    bad = leaks(F.col(feature_at), F.col(decided_at), F.col(role))
    return df.where(F.when(bad, F.raise_error(F.lit("feature is not available at the decision")).cast("boolean")).otherwise(True))


def reconciled_coverage(df: DataFrame, found: str, expected: list[str], grade: str, threshold: float = 0.95) -> DataFrame:
    """Expected = greatest known count; ratio = found over it, at most 1; A and B below the threshold become U."""
    known = F.greatest(*[F.col(c) for c in expected]) if len(expected) > 1 else F.col(expected[0])
    ratio = F.when(F.col("expected") > 0, F.least(F.lit(1.0), F.col(found) / F.col("expected")))
    return df.withColumn("expected", known).withColumn("ratio", ratio).withColumn("effective_grade", effective_grade(F.col(grade), F.col("ratio"), F.lit(False), threshold))
