"""Statistics of panels: calibration within cells, reliability, comparison of sources, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import stats
from sluice.operators.atlas import quantiles, running_sums
from sluice.session import cut


def calibrated(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Rows with a value, with z (population deviation; 0 where that is 0) and percentile (share of values up to it) in their cell."""
    rows = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*cell)
    sd, mean = F.stddev_pop(value).over(w), F.avg(value).over(w)
    z = F.when(F.col("_sd") == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("_mean")) / F.col("_sd"))
    return rows.withColumn("_sd", sd).withColumn("_mean", mean).withColumn("z", z).withColumn("percentile", F.cume_dist().over(w.orderBy(value))).drop("_sd", "_mean")


def pct_rank(value: str, *partition: str) -> Column:
    """Average rank over the rows of the partition, between 0 and 1, ties alike."""
    w = Window.partitionBy(*partition)
    tie = F.count("*").over(Window.partitionBy(*partition, value))
    return (F.rank().over(w.orderBy(value)) + (tie - 1) / 2) / F.count("*").over(w)


def icc(df: DataFrame, outer: list[str], group: str, value: str) -> DataFrame:
    """One-way ICC(1) of the values by group, for each outer key: two aggregations, no list of values."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*outer, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where(F.col("n") >= 2)
    total = cells.groupBy(*outer).agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("values"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    value_ = stats.oneway_icc(F.col("groups"), F.col("values"), F.col("n2"), F.col("s2") - F.col("s1") * F.col("s1") / F.col("values"), F.col("within"))
    return total.withColumn("icc", value_).withColumn("ceiling", F.sqrt(F.greatest(F.col("icc"), F.lit(0.0)))).select(*outer, "groups", "values", "icc", "ceiling")


def transport(df: DataFrame, source: str, features: list[str], least_rows: int = 10, least_overlaps: int = 2, least_share: float = 0.10) -> DataFrame:
    """For each pair of sources: overlap of the 5 to 95 % ranges and standardised difference of each feature, and whether comparison is supported."""
    aggs = [F.count("*").alias("rows")]
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_m"), F.var_samp(f).alias(f"{f}_v"), F.count(f).alias(f"{f}_n")]
    each = df.groupBy(source).agg(*aggs)
    for f in features:
        each = each.join(quantiles(df, [source], f, {f"{f}_lo": 0.05, f"{f}_hi": 0.95}), source, "left")
    # A row a source, made once for both sides.
    each = cut(each)
    names = each.columns
    left, right = each.select([F.col(c).alias(f"l_{c}") for c in names]), each.select([F.col(c).alias(f"r_{c}") for c in names])
    # A few rows a source: the pairs are sources squared, not rows squared.
    pairs = left.join(right, F.col(f"l_{source}") < F.col(f"r_{source}"))
    out = pairs
    for f in features:
        out = out.withColumn(f"{f}_overlap", stats.range_overlap(F.col(f"l_{f}_lo"), F.col(f"l_{f}_hi"), F.col(f"r_{f}_lo"), F.col(f"r_{f}_hi")))
        out = out.withColumn(f"{f}_smd", stats.standardized_difference(F.col(f"l_{f}_m"), F.col(f"l_{f}_v"), F.col(f"l_{f}_n"), F.col(f"r_{f}_m"), F.col(f"r_{f}_v"), F.col(f"r_{f}_n")))
    overlaps = F.array_compact(F.array(*[F.col(f"{f}_overlap") for f in features]))
    supported = (F.least("l_rows", "r_rows") >= least_rows) & (F.size(overlaps) >= least_overlaps) & (F.array_min(overlaps) >= least_share)
    return out.withColumn("supported", supported).select(F.col(f"l_{source}").alias("left"), F.col(f"r_{source}").alias("right"), *[c for f in features for c in (f"{f}_overlap", f"{f}_smd")], "supported")


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: the four counts, precision, recall, F1, accuracy and Cohen's kappa."""
    t, g = truth.cast("boolean"), guess.cast("boolean")
    counts = df.where(truth.isNotNull() & guess.isNotNull()).agg(*[F.coalesce(F.sum((c).cast("long")), F.lit(0)).alias(n) for n, c in (("tp", t & g), ("fp", ~t & g), ("fn", t & ~g), ("tn", ~t & ~g))])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    agree = (tp + tn) / n
    return (
        counts.withColumn("precision", stats.share(tp, tp + fp))
        .withColumn("recall", stats.share(tp, tp + fn))
        .withColumn("f1", stats.share(2 * tp, 2 * tp + fp + fn))
        .withColumn("accuracy", agree)
        .withColumn("kappa", F.when(expected == 1, F.lit(1.0)).otherwise((agree - expected) / (1 - expected)))
    )


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: positives, negatives and ROC AUC. Counts by distinct score are cumulated over ranges of the score, so no task ranks all rows."""
    by = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("n"))
    by = by.withColumn("q", F.col("n") - F.col("p"))
    wins = running_sums(by, score, ["q"]).withColumn("below", F.col("q_sum") - F.col("q"))
    area = F.sum(F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2))
    return wins.agg(F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"), area.alias("area")).withColumn("auc", stats.share(F.col("area"), F.col("positives") * F.col("negatives"))).drop("area")


def spearman(df: DataFrame, x: str, y: str, *partition: str) -> DataFrame:
    """Rank correlation with average ranks, for each partition."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*partition, pct_rank(x, *partition).alias("_x"), pct_rank(y, *partition).alias("_y"))
    return ranked.groupBy(*partition).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("spearman"))


def suppressed(df: DataFrame, cell: list[str], metrics: dict[str, Column], least: int = 10) -> DataFrame:
    """Metrics by cell; cells of fewer rows than the least keep their count and lose their metrics."""
    out = df.groupBy(*cell).agg(F.count("*").alias("n"), *[m.alias(k) for k, m in metrics.items()])
    return out.select(*cell, "n", *[F.when(F.col("n") >= least, F.col(k)).alias(k) for k in metrics])


def missingness(df: DataFrame) -> DataFrame:
    """(column, rows, non_null) of each column, in one pass."""
    counts = df.agg(F.count("*").alias("rows"), F.create_map(*[x for c in df.columns for x in (F.lit(c), F.count(c))]).alias("m"))
    return counts.select("rows", F.explode("m").alias("column", "non_null")).select("column", "rows", "non_null")
