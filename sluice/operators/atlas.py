"""Parts of the report products: crosswalks of rubrics, outcome windows and bounds, panels of funding, votes and patents, audits and small guards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import json_text, text
from sluice.functions.identifiers import stable_id
from sluice.session import cut

#: Days after which an outcome counts as mature, and shares of outcomes that linkage may capture. Fixed values.
WINDOWS = (365, 730, 1095, 1825)
CAPTURES = (0.25, 0.50, 0.75, 1.00)


def rubric_crosswalk(policies: DataFrame, policy_id: str, rubric: str, source: Column) -> DataFrame:
    """A row for each leaf of each policy's rubric (JSON): its id, path, label, value, scale, and the constructs that the label names."""
    leaves = policies.select(F.col(policy_id).alias("policy_version_id"), source.alias("source_id"), F.explode(json_text.json_paths(F.col(rubric))).alias("leaf"))
    rows = leaves.select("policy_version_id", "source_id", F.col("leaf.path").alias("native_path"), json_text.last_label(F.col("leaf.path")).alias("native_label"), F.col("leaf.value").alias("native_value_json"))
    found = rows.withColumn("constructs", text.rubric_constructs(F.col("native_label")))
    status = F.when(F.size("constructs") == 0, "unmapped").when(F.size("constructs") > 1, "multi_mapped").otherwise("mapped")
    key = F.concat_ws("|", F.col("policy_version_id").cast("string"), "native_path")
    return found.withColumn("native_scale_json", F.when(F.col("native_value_json").startswith("["), F.col("native_value_json"))).withColumn("mapping_status", status).withColumn("rubric_field_id", stable_id("rubric_field", F.col("source_id"), key))


def outcome_windows(candidates: DataFrame, cutoff: Column, start: str, linked: Column, withdrawn_at: str) -> DataFrame:
    """Candidates by window: whether the follow-up is long enough, whether a publication is linked, and whether a withdrawal came first. A missing link is never a missing publication."""
    age = F.greatest(F.lit(0), F.datediff(cutoff, F.col(start)))
    rows = candidates.withColumn("window_days", F.explode(F.array(*map(F.lit, WINDOWS)))).withColumn("mature", F.coalesce(age >= F.col("window_days"), F.lit(False)))
    status = F.when(~F.col("mature"), "immature_excluded").when(linked, "relation_observed_timing_unknown").otherwise("no_relation_detected_right_censored")
    competing = F.col("mature") & F.coalesce(F.datediff(F.col(withdrawn_at), F.col(start)) <= F.col("window_days"), F.lit(False))
    return rows.withColumn("windowed_publication_status", status).withColumn("competing_withdrawal_by_window", competing).withColumn("linked", linked)


def linkage_bounds(windows: DataFrame, source: str) -> DataFrame:
    """Per source and window: the observed share of links, and the share if only part of the links were found; between the observed share and 1 without assumption."""
    mature = windows.where("mature").groupBy(source, "window_days").agg(F.count(F.lit(1)).alias("mature_candidates"), F.count_if("linked").alias("observed_declared_relations"))
    share = F.col("observed_declared_relations") / F.col("mature_candidates")
    rows = mature.withColumn("observed_relation_share", share).withColumn("assumed_linkage_capture_fraction", F.explode(F.array(*map(F.lit, CAPTURES))))
    return rows.withColumn("capture_adjusted_publication_share", F.least(F.lit(1.0), F.col("observed_relation_share") / F.col("assumed_linkage_capture_fraction")))


def citation_windows(works: DataFrame, work: str, year: str, counts: DataFrame, now: int, windows: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """Works by window of years: citations within it (counts: work, cited_year, n), 0 and not eligible where the window is still open."""
    rows = works.select(work, year).withColumn("window_years", F.explode(F.array(*map(F.lit, windows))))
    rows = rows.withColumn("mature", F.coalesce(F.lit(now) >= F.col(year) + F.col("window_years"), F.lit(False)))
    cited = counts.select(F.col(work).alias("_w"), "cited_year", "n")
    inside = F.col("mature") & (F.col("cited_year") >= F.col(year)) & (F.col("cited_year") <= F.col(year) + F.col("window_years"))
    total = rows.join(cited, (F.col(work) == F.col("_w")) & inside, "left").groupBy(work, year, "window_years", "mature").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("citation_count"))
    return total.withColumn("eligibility", F.when(F.col("mature"), "mature").otherwise("immature_excluded"))


def portfolio_series(awards: DataFrame, keys: list[str], award: str, amount: str, has_text: Column) -> DataFrame:
    """Awards, their sum and the share with text by programme, year and round; keys may be null."""
    return awards.groupBy(*keys).agg(F.count_distinct(award).alias("awards"), F.sum(amount).alias("total_awarded"), F.avg(has_text.cast("double")).alias("text_coverage"))


def repeat_recipients(awards: DataFrame, recipient: str, when: str, award: str) -> DataFrame:
    """Recipients of several awards: their number, the first and the last, and the years in between."""
    by = awards.groupBy(recipient).agg(F.count_distinct(award).alias("awards"), F.min(when).alias("first"), F.max(when).alias("last"))
    return by.where(F.col("awards") > 1).withColumn("years_between", F.year("last") - F.year("first"))


def votes(panels: DataFrame, keys: list[str], voters: list[str]) -> DataFrame:
    """One row a vote: columns of voters turned into rows, absent votes left out."""
    return panels.unpivot(keys, voters, "voter", "vote").where(F.col("vote").isNotNull())


def vote_panel(long: DataFrame, keys: list[str]) -> DataFrame:
    """Votes, their mean and range, and whether they are unanimous, by panel."""
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("votes"), F.avg("vote").alias("mean_vote"), (F.max("vote") - F.min("vote")).alias("range")).withColumn("unanimous", F.col("range") == 0)


def action_chain(actions: DataFrame, case: str, order: list[str], kind: str) -> DataFrame:
    """The actions of each case in order: position, the one before and days since, and whether it is the last."""
    w = Window.partitionBy(case).orderBy(*order)
    before = F.lag(kind).over(w)
    gap = F.datediff(F.col(order[0]), F.lag(order[0]).over(w))
    return actions.withColumn("position", F.row_number().over(w)).withColumn("previous", before).withColumn("days_since", gap).withColumn("last", F.lead(kind).over(w).isNull())


def prior_art(citations: DataFrame, case: str, art: str, examiner: Column) -> DataFrame:
    """Distinct cited works of each case, by who cited them; a work cited by both counts for the examiner."""
    each = citations.groupBy(case, art).agg(F.bool_or(examiner).alias("by_examiner"))
    return each.groupBy(case).agg(F.count(F.lit(1)).alias("cited"), F.count_if("by_examiner").alias("by_examiner"))


def capacity_panel(applications: DataFrame, unit: str, filed: str, granted: str, application: str, action: Column, least: int = 10) -> DataFrame:
    """Applications, median days to grant and mean of actions by unit and filing year; small cells lose their measures.

    The median comes from counts by day, cumulated within the cell, so no list of values is held.
    """
    rows = applications.select(F.col(unit).alias("unit"), F.year(filed).alias("filing_year"), F.col(application).alias("_a"), F.datediff(F.col(granted), F.col(filed)).alias("_days"), action.cast("double").alias("_action"))
    cell = ["unit", "filing_year"]
    base = rows.groupBy(*cell).agg(F.count_distinct("_a").alias("application_count"), F.avg("_action").alias("mean_action_count"))
    median = quantiles(rows, cell, "_days", {"median_pendency_days": 0.5})
    out = base.join(median, (base["unit"].eqNullSafe(median["unit"])) & (base["filing_year"].eqNullSafe(median["filing_year"])), "left").select(base["unit"], base["filing_year"], "application_count", "mean_action_count", "median_pendency_days")
    small = F.col("application_count") < least
    return out.select(*cell, "application_count", *[F.when(~small, F.col(c)).alias(c) for c in ("median_pendency_days", "mean_action_count")], small.alias("small_cell_suppressed"))


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation by key: values are counted first and cumulated in order, so a key's rows are never held at once."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    placed = counts.withColumn("_end", F.sum("_n").over(w)).withColumn("_total", F.sum("_n").over(whole)).withColumn("_begin", F.col("_end") - F.col("_n"))

    def at(position: Column) -> Column:
        # The value whose rows cover the position, counted from 0.
        return F.max(F.when((F.col("_begin") <= position) & (position < F.col("_end")), F.col(value).cast("double")))

    out = []
    for name, q in wanted.items():
        place = (F.col("_total") - 1) * q
        low = F.floor(place)
        out += [at(low).alias(f"_{name}_low"), at(F.least(low + 1, F.col("_total") - 1)).alias(f"_{name}_high"), F.max(place - low).alias(f"_{name}_part")]
    got = placed.groupBy(*keys).agg(*out)
    return got.select(*keys, *[(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n) for n in wanted])


def stage_outcome_audit(decisions: DataFrame, source: str, native: str, normalized: str) -> DataFrame:
    """By source and native outcome: decisions, whether the native text names an outcome by itself, and how many normalised outcomes agree with it."""
    expected = text.independent_outcome(F.col(native))
    exact = F.when(expected.isNotNull(), F.coalesce(F.col(normalized) == expected, F.lit(False))).otherwise(F.col(normalized).isNull())
    return decisions.groupBy(source, native).agg(F.count(F.lit(1)).alias("population"), F.bool_or(expected.isNotNull()).alias("mapping_supported"), F.count_if(exact).alias("exact")).withColumn("precision", F.col("exact") / F.col("population"))


def descriptive_atlas(cycles: DataFrame, platform: str, grade: str, denominator: Column, rate: Column, reviews: Column) -> DataFrame:
    """By platform: cycles, cycles of each grade (unknown: U), verified denominators, and cycles that allow rates of selection and of review."""
    g = F.coalesce(grade, F.lit("U"))
    return cycles.groupBy(platform).agg(
        F.count(F.lit(1)).alias("process_cycles"), *[F.count_if(g == x).alias(f"grade_{x}") for x in "ABCDU"], F.count_if(denominator).alias("verified_denominators"), F.count_if(rate).alias("selection_rate_cycles"), F.count_if(reviews).alias("review_rate_cycles")
    )


def moments(scores: DataFrame, value: str, z: str, distance: str, outcome: str) -> DataFrame:
    """(moment, value): pooled mean, root mean square of z, mean distance, share of rejections among decisions, and rejected cases."""
    rejected, selected = F.count_if(F.col(outcome) == "rejected"), F.count_if(F.col(outcome) == "selected")
    one = scores.agg(
        F.avg(value).alias("review_score_mean"),
        F.sqrt(F.avg(F.col(z) * F.col(z))).alias("review_score_cycle_z_sd"),
        F.avg(distance).alias("semantic_novelty_mean"),
        (rejected / F.greatest(rejected + selected, F.lit(1))).alias("observed_rejection_share"),
        rejected.cast("double").alias("rejected_afterlife_cases"),
    )
    return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("moment", "value"))


def set_digest(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, members, digest): SHA-256 of the sorted members' own digests, so that sets of any size compare as one text.

    Members are digested one by one and combined in order in slices by the first two digits, so that
    no single row holds a whole large set of long members.
    """
    one = df.select(*keys, F.sha2(F.col(member).cast("string"), 256).alias("_h")).distinct()
    slices = one.groupBy(*keys, F.substring("_h", 1, 2).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("_d"))
    return slices.groupBy(*keys).agg(F.sum("_n").alias("members"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_d"))), lambda x: x["_d"]), "\n"), 256).alias("digest"))


def id_digest(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, members, digest): SHA-256 of the sorted members joined by line ends, as published manifests have it; for sets that fit a row."""
    return df.groupBy(*keys).agg(F.count_distinct(member).alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), "\n"), 256).alias("digest"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join; a key that either side has twice fails."""
    for side in (left, right):
        if not (twice := side.groupBy(key).count().where(F.col("count") > 1)).isEmpty():
            raise ValueError(f"{key} is repeated, one is {twice.first()[0]}")
    return left.join(right, key)


def disjoint_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both frames' rows; a key that both have fails."""
    if not (both := a.select(key).join(b.select(key), key, "left_semi")).isEmpty():
        raise ValueError(f"{key} {both.first()[0]} is in both")
    return a.unionByName(b, allowMissingColumns=True)


def shard(df: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """The rows of shard k of n, by their position's or id's remainder."""
    return df.where(F.pmod(F.col(key), F.lit(n)) == k)


def valid_in_time(created: Column, observed: Column) -> Column:
    """Whether something was there when it was observed; without an observation it counts."""
    return F.coalesce(created <= observed, observed.isNull())


def first_examples(df: DataFrame, order: list[str], n: int, by: str | None = None) -> DataFrame:
    """The first n rows in a total order, of each group if one is given."""
    if by is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def distinct_first(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n keys in order, each by its first row."""
    first = df.groupBy(key).agg(F.min(F.struct(*order, *[c for c in df.columns if c not in (key, *order)])).alias("_f")).select(key, "_f.*")
    return first.orderBy(*order, key).limit(n).select(*df.columns)


def ranking_metrics(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: average precision over the distinct scores, and the Brier score of scores between 0 and 1.

    Scores are counted first; their running sums are taken in order within ranges, and ranges are
    summed over, so no task sees all rows.
    """
    by = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(truth).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    run = running_sums(by, score, ["_p", "_n"], descending=True)
    positives = by.agg(F.sum("_p").alias("_all"))
    precision = run.crossJoin(F.broadcast(positives)).agg((F.sum((F.col("_p") / F.col("_all")) * (F.col("_p_sum") / F.col("_n_sum")))).alias("average_precision"))
    brier = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).agg(F.avg(F.pow(F.col(score) - F.col(truth), 2)).alias("brier"))
    # One row each.
    return precision.crossJoin(F.broadcast(brier))


def running_sums(df: DataFrame, order: str, sums: list[str], parts: int = 64, descending: bool = False) -> DataFrame:
    """The rows with `<c>_sum`: the sum of c over all rows up to and with each row's place in the order.

    Rows are dealt by ranges of the order, summed within their range, and lifted by the totals of
    the ranges before, a row each.
    """
    position = F.desc(order) if descending else F.asc(order)
    ranged = cut(df.repartitionByRange(parts, position).withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy("_range").orderBy(position).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.select("*", *[F.sum(c).over(w).alias(f"{c}_sum") for c in sums])
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    lifted = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    out = inside.join(F.broadcast(lifted), "_range")
    return out.select(*df.columns, *[(F.col(f"{c}_sum") + F.col(f"_b_{c}")).alias(f"{c}_sum") for c in sums])


def principal_axes(df: DataFrame, columns: list[str], group: str | None = None, least: int = 100, components: int = 1) -> dict[object, dict]:
    """Principal components of standardised columns, by group (None: all rows): rows, loadings, explained shares and mean square of what they leave out.

    Sums and products of the columns are one aggregation; only matrices of columns squared reach the
    driver. Groups of fewer than `least` rows have their rows alone.
    """
    whole = df.dropna(subset=columns)
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]]
    rows = whole.groupBy(*([group] if group else [])).agg(*aggs).collect()
    out = {}
    for r in rows:
        name = r[group] if group else None
        out[name] = {"n": r["n"]}
        if r["n"] < least:
            continue
        k = len(columns)
        cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        sd = np.sqrt(np.diag(cov))
        corr = cov / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1))
        values, vectors = np.linalg.eigh(corr)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        out[name] |= {"loadings": vectors[:, :components].T, "explained": (values[:components] / values.sum()).tolist(), "left_out": float(values[components:].sum() / k)}
    return out


def congruence(df: DataFrame, columns: list[str], group: str, least: int = 100, bound: float = 0.90) -> DataFrame:
    """(group, n, loading_congruence, status): how far each group's first component is that of all rows; 1 is the same direction."""
    pooled = principal_axes(df, columns, None, least)[None]
    rows = []
    for name, fit in sorted(principal_axes(df, columns, group, least).items(), key=lambda x: str(x[0])):
        if "loadings" not in fit or "loadings" not in pooled:
            rows.append((str(name), fit["n"], None, "insufficient_for_invariance"))
            continue
        value = float(abs(fit["loadings"][0] @ pooled["loadings"][0]))
        rows.append((str(name), fit["n"], value, "invariant_at_0.90" if value >= bound else "invariance_failed_report_separately"))
    return df.sparkSession.createDataFrame(rows, "group string, n long, loading_congruence double, status string")


def vector_checksum(vector: Column) -> Column:
    """SHA-256 of a vector's components rounded to six digits as single-precision numbers, in order."""
    return F.sha2(F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x.cast("double"))), ","), 256)
