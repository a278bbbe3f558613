"""Matching of references to works, resolution of aliases, crosswalks and mappings, and links between versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import text
from sluice.functions.identifiers import canonical_doi, canonical_identifier, extract_doi

#: Words of a title by which works are looked up: those of at least so many letters, the rarest first.
WORD, RAREST = 4, 6


def match_references(references: DataFrame, works: DataFrame, threshold: float = 0.94, margin: float = 0.03) -> DataFrame:
    """(reference_id, cited_identifier, candidate_id, method, confidence, raw_hash) of references (reference_id, doi, raw, title, year) to works (candidate_id, doi, title, year).

    A DOI that a work has decides. Else works of the same year (or of an unknown one) are compared
    by the matching share of their bibliography keys: the best one from the threshold on, unless
    another work comes within the margin. Works are looked up by the RAREST words of the
    reference's title that any work has, or by the first letters where it has none, so titles
    meet only where they share a word; a share of the threshold leaves room for a few changed
    letters, not for six words.

    Only distinct titles and years meet, so repeated ones cost nothing but their rows.
    """
    key = lambda c: text.bibliography_key(c)
    refs = references.select(
        "reference_id",
        F.coalesce(canonical_doi(F.col("doi")), extract_doi(F.col("raw"))).alias("doi"),
        key(F.coalesce(F.col("title"), F.col("raw"))).alias("title"),
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"),
        F.sha2(F.coalesce("raw", F.lit("")), 256).alias("raw_hash"),
    )
    known = works.select("candidate_id", canonical_doi(F.col("doi")).alias("doi"), key(F.col("title")).alias("title"), F.col("year").cast("string").alias("year"))
    by_doi = known.where(F.col("doi").isNotNull()).groupBy("doi").agg(F.min("candidate_id").alias("by_doi"))
    joined = refs.join(by_doi, "doi", "left")
    # References of one title and year are alike in all that follows, and so are works; of a class of works only the two last ids can matter.
    open_ = joined.where(F.col("by_doi").isNull() & (F.col("title") != "")).select("title", "year").distinct()
    titled = known.where(F.col("title") != "").select("candidate_id", F.col("title").alias("other"), F.col("year").alias("other_year"))
    same = F.col("other").eqNullSafe(F.col("_o")) & F.col("other_year").eqNullSafe(F.col("_y"))
    last = titled.groupBy("other", "other_year").agg(F.count(F.lit(1)).alias("rows"), F.max("candidate_id").alias("l1"), F.max(F.col("candidate_id").isNull()).alias("unnamed"))
    before = titled.join(last.select(F.col("other").alias("_o"), F.col("other_year").alias("_y"), "l1"), same).where(F.col("candidate_id") < F.col("l1")).groupBy("_o", "_y").agg(F.max("candidate_id").alias("l2"))
    ids = F.concat(F.array_compact(F.array("l1", "l2")), F.when(F.col("unnamed"), F.array(F.lit(None).cast(works.schema["candidate_id"].dataType))).otherwise(F.array().cast(T.ArrayType(works.schema["candidate_id"].dataType))))
    classes = last.join(before, same, "left").select("other", "other_year", "rows", F.slice(ids, 1, 2).alias("ids"))

    def tokens(title: Column) -> Column:
        long = F.array_distinct(F.filter(F.split(title, " "), lambda w: F.length(w) >= WORD))
        return F.when(F.size(long) > 0, long).otherwise(F.array(F.concat(F.lit("^"), F.substring(title, 1, WORD))))

    listed = classes.withColumn("token", F.explode(tokens(F.col("other"))))
    frequency = listed.groupBy("token").agg(F.sum("rows").alias("n"))
    asked = open_.select("*", F.explode(tokens(F.col("title"))).alias("token")).join(frequency, "token")
    rare = asked.withColumn("r", F.row_number().over(Window.partitionBy("title", "year").orderBy("n", "token"))).where(F.col("r") <= RAREST).drop("r", "n")
    same_year = (F.col("year") == "") | F.col("other_year").isNull() | (F.col("year") == F.col("other_year"))
    # No pair of lengths so different reaches the threshold less the margin.
    least = threshold - margin
    lengths = 2 * F.least(F.length("title"), F.length("other")) >= least * (F.length("title") + F.length("other"))
    pairs = rare.join(listed, "token").where(same_year & lengths).select("title", "year", "other", "ids").distinct()
    # Shares below the least decide nothing; the rounding of their difference is left room.
    scored = pairs.withColumn("share", text.matching_share(F.col("title"), F.col("other"), least - 1e-9)).where(F.col("share").isNotNull())
    named = scored.select("title", "year", "other", "share", F.explode("ids").alias("candidate_id")).distinct()
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("title", "year").orderBy(F.desc("share"), F.desc("candidate_id")))).where(F.col("r") <= 2)
    best = ranked.groupBy("title", "year").agg(F.max(F.when(F.col("r") == 1, F.col("share"))).alias("s1"), F.max(F.when(F.col("r") == 1, F.col("candidate_id"))).alias("c1"), F.max(F.when(F.col("r") == 2, F.col("share"))).alias("s2"))
    out = joined.join(best, ["title", "year"], "left")
    enough = F.col("s1") >= threshold
    ambiguous = F.coalesce(F.col("s1") - F.col("s2") < margin, F.lit(False))
    found = enough & ~ambiguous
    method = F.when(F.col("by_doi").isNotNull(), "structured_or_text_doi").when(found, "bibliographic_title_year").when(enough, "ambiguous_bibliographic_hash").otherwise("unresolved_text_hash")
    return out.select(
        "reference_id",
        F.when(F.col("by_doi").isNotNull() | ~F.coalesce(found, F.lit(False)), F.col("doi")).alias("cited_identifier"),
        F.coalesce("by_doi", F.when(found, F.col("c1"))).alias("candidate_id"),
        method.alias("method"),
        F.when(F.col("by_doi").isNotNull(), 1.0).when(found, F.col("s1")).otherwise(0.0).alias("confidence"),
        "raw_hash",
    )


def resolve_aliases(aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """(scheme, value, canonical_value, entity_ids, status, evidence_paths) of asked (scheme, value) among aliases (scheme, value, entity_id, evidence).

    An alias of several entities is quarantined, none of them wins; each path names the alias, its
    evidence and the entity.
    """
    known = aliases.select(F.lower("scheme").alias("s"), canonical_identifier(F.col("scheme"), F.col("value")).alias("c"), "entity_id", F.coalesce("evidence", F.lit("evidence:unrecorded")).alias("e")).where(F.col("c").isNotNull())
    paths = known.groupBy("s", "c").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"), F.array_sort(F.collect_list(F.struct("entity_id", "e"))).alias("p"))
    q = asked.select("scheme", "value", F.lower("scheme").alias("s"), canonical_identifier(F.col("scheme"), F.col("value")).alias("c"))
    status = F.when(F.col("c").isNull(), "invalid").when(F.col("entity_ids").isNull(), "unresolved").when(F.size("entity_ids") == 1, "resolved").otherwise("quarantined_conflict")
    path = F.transform("p", lambda x: F.concat_ws(" > ", F.concat_ws(":", "s", "c"), x["e"], x["entity_id"]))
    none = F.array().cast("array<string>")
    return q.join(paths, ["s", "c"], "left").select("scheme", "value", F.col("c").alias("canonical_value"), F.coalesce("entity_ids", none).alias("entity_ids"), status.alias("status"), F.coalesce(path, none).alias("evidence_paths"))


def crosswalk(left: DataFrame, right: DataFrame, key: str, dated: str, first: int, last: int, kept: list[str]) -> DataFrame:
    """The left rows with the right's kept columns and how they were reconciled: an exact match of the hashed key, else within or outside the years that the right covers."""
    other = right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"matched_{c}") for c in kept]).withColumn("_hit", F.lit(True))
    year = F.year(F.col(dated).try_cast("date"))
    state = F.when(F.col("_hit"), "exact_application_match").when(year.between(first, last), "within_year_boundary_not_present").otherwise("outside_filing_year_boundary")
    out = left.join(other, F.col(key) == F.col("_k"), "left")
    return out.withColumn("in_population", F.coalesce("_hit", F.lit(False))).withColumn("population_reconciliation_state", state).drop("_k", "_hit")


def map_native(rows: DataFrame, mapping: DataFrame, source: str, vocabulary: str, native: str) -> DataFrame:
    """Rows with normalized_value and mapped, by a mapping (source_id, vocabulary, native_value, normalized_value); what is not mapped says so."""
    m = mapping.select(F.col("source_id").alias("_s"), F.col("vocabulary").alias("_v"), F.col("native_value").alias("_n"), "normalized_value")
    out = rows.join(m, (F.col(source) == F.col("_s")) & (F.col(vocabulary) == F.col("_v")) & (F.col(native).cast("string") == F.col("_n")), "left")
    return out.withColumn("mapped", F.col("normalized_value").isNotNull()).drop("_s", "_v", "_n")


#: Features of a pair of versions, and of the labelled pairs those that train. Fixed values.
LINK_FEATURES = ("title_cosine", "title_similarity", "abstract_similarity", "same_source", "exact_normalized_title", "scaled_gap")


def link_features(pairs: DataFrame) -> DataFrame:
    """Pairs (left and right structs of title, abstract, source_id, created_at; title_cosine) with the features that a link is judged by."""
    gap = F.abs(F.unix_seconds("right.created_at") - F.unix_seconds("left.created_at")) / 86400.0
    x, y = text.title_key(F.coalesce("left.title", F.lit(""))), text.title_key(F.coalesce("right.title", F.lit("")))
    return (
        pairs.withColumn("title_similarity", text.title_similarity(F.col("left.title"), F.col("right.title")))
        .withColumn("abstract_similarity", text.title_similarity(F.col("left.abstract"), F.col("right.abstract")))
        .withColumn("same_source", F.col("left.source_id").eqNullSafe(F.col("right.source_id")))
        .withColumn("exact_normalized_title", (x != "") & (x == y))
        .withColumn("time_gap_days", gap)
        .withColumn("scaled_gap", F.log1p(F.coalesce("time_gap_days", F.lit(0.0))) / F.log1p(F.lit(3650.0)))
    )


def silver_labels(pairs: DataFrame, declared: Column, pair_id: str, ratio: int = 3) -> DataFrame:
    """Pairs with calibration_label: 1 for declared links, 0 for the hard negatives (alike in title, not in text, of other works) with the smallest ids, `ratio` a positive."""
    hard = ~declared & F.col("title_similarity").between(0.25, 0.8199999) & (F.col("abstract_similarity") < 0.75) & ~F.col("exact_normalized_title")
    marked = pairs.withColumn("_p", declared).withColumn("_h", hard)
    most = ratio * marked.where("_p").count()
    taken = marked.where("_h").orderBy(pair_id).limit(most).select(F.col(pair_id).alias("_id"), F.lit(0).alias("_zero"))
    out = marked.join(taken, F.col(pair_id) == F.col("_id"), "left")
    return out.withColumn("calibration_label", F.when(F.col("_p"), 1).otherwise(F.col("_zero"))).drop("_p", "_h", "_id", "_zero")


def fit_links(labelled: DataFrame, features: tuple[str, ...] = LINK_FEATURES, strength: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients and, last, the intercept of a class-balanced logistic regression with an L2 penalty, by Newton steps.

    Each step is one aggregation to a matrix of features squared, so the rows stay where they are.
    """
    names = [*features, "_one"]
    rows = labelled.where(F.col("calibration_label").isNotNull()).select(F.col("calibration_label").cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features], F.lit(1.0).alias("_one"))
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError("links are learnt from both classes")
    total = sum(counts.values())
    weight = F.when(F.col("_y") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    beta = np.zeros(len(names))
    penalty = np.diag([1.0 / strength] * len(features) + [0.0])
    for _ in range(rounds):
        margin = sum((F.lit(float(b)) * F.col(n) for b, n in zip(beta, names, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-margin))
        w = weight * p * (1 - p)
        sums = [F.sum(weight * (p - F.col("_y")) * F.col(n)) for n in names] + [F.sum(w * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
        got = list(rows.agg(*sums).first())
        gradient = np.array(got[: len(names)]) + penalty @ beta
        hessian = np.zeros((len(names), len(names)))
        hessian[np.triu_indices(len(names))] = got[len(names) :]
        hessian = hessian + np.triu(hessian, 1).T + penalty
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(names)), gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def scored_links(pairs: DataFrame, beta: np.ndarray, recall_at: float, features: tuple[str, ...] = LINK_FEATURES) -> DataFrame:
    """Pairs with match_probability and whether they pass the thresholds for recall (given), balance (0.5) and precision (0.9); no pair is merged."""
    margin = sum((F.lit(float(b)) * F.col(n).cast("double") for b, n in zip(beta, features, strict=False)), F.lit(float(beta[-1])))
    out = pairs.withColumn("match_probability", 1 / (1 + F.exp(-margin)))
    high = max(0.05, min(0.25, recall_at))
    for name, least in (("passes_high_recall_threshold", high), ("passes_balanced_threshold", 0.5), ("passes_high_precision_threshold", 0.9)):
        out = out.withColumn(name, F.col("match_probability") >= least)
    return out.withColumn("linkage_tier", F.lit("probabilistic_high_recall")).withColumn("canonical_merge_forced", F.lit(False))
