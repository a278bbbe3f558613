"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the total size by its weight, at most `most` times its own size;
what is cut off is reshared by weight among the others. Within a source documents have unequal
expected numbers of copies: level * weight, at most `most`, where the level is such that the
expected words of the source are its target, so what a document's cap cuts off goes to the others
of its source. The weight is a column, or by default the binary length of the document's size:
longer documents are likelier, far less than in proportion.

The whole part of the expected copies is allocated with certainty; for the fractional part p,
the inclusion probability of one more copy, documents are ranked by the odds of a fixed random
number over the inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the
source's words are used up, the last one where it brings the total nearer. u is a hash of the
row, so reruns agree.

All of it is DataFrame work. The level of a source comes from its words by weight (weights are
rounded to three digits, so that a source has few), and no source is sorted as a whole: ranks
fall into `BINS` bins, whose sizes are summed with partial aggregation; only the one bin of each
source where its words run out is ordered row by row. The table of the sources, a row each, is
ordered in one task.

Defined results: null texts have size 0 and are never taken, and so are documents with a weight
that is null, 0 or below; a source whose documents of positive weight cannot reach its target even
with `most` copies falls short of it; a very long text is one document, taken whole or not; a null
source is a source of its own, last in order; a null doc_id is a value like any other; repeated
rows share their rank and are taken one by one; an empty table gives an empty result; extra
columns pass through `mix` and never collide with its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import word_count
from sluice.session import cut

#: Bins of the rank; the largest bin of a source that is ordered row by row holds about 1 / BINS of it.
BINS = 4096
#: Sources up to so many are broadcast, a few dozen bytes each; with more the joins shuffle.
BROADCAST_SOURCES = 10_000
#: Weights of the sources in order, repeating, and the most copies of a source.
WEIGHTS = (1, 2, 3)
MOST = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, held to `most` times the size.

    A source is held down if its cap per unit of weight is below the level at which the rest is
    shared, so with sources in order of cap per weight one pass of running sums finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * most).cast("double")
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    return (
        sizes.withColumn("w", w)
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_w", F.sum("w").over(whole))
        .withColumn("level", level)
        # The final level is that of the first source that is not held down; behind it the formula only falls.
        .withColumn("level", F.coalesce(F.max(F.when(F.col("cap") > F.col("w") * F.col("level"), F.col("level"))).over(whole), F.lit(float("inf"))))
        .select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))
    )


def random_number(*keys: Column) -> Column:
    """A number between 0 and 1, exclusive, from the MD5 of the keys."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def rounded(weight: Column) -> Column:
    """A weight to three digits; 0 where it is null, not a number, or not positive."""
    scale = F.pow(F.lit(10.0), 2 - F.floor(F.log10(weight)))
    return F.when((weight > 0) & (weight < float("inf")), F.round(weight * scale) / scale).otherwise(0.0)


def _levelled(goals: DataFrame, levels: DataFrame, most: int) -> DataFrame:
    """The goals with the level of each source: expected copies are level * weight, at most `most`, and their words are the target.

    With weights in falling order, the level is that of the first weight that is not held down when all before it are.
    """
    other = goals.withColumnRenamed("source", "_s")
    both = levels.where(F.col("rel") > 0).join(other, F.col("source").eqNullSafe(F.col("_s")))
    by = Window.partitionBy("_s").orderBy(F.desc("rel"))
    held = F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum(F.col("words") * F.col("rel")).over(by.rowsBetween(0, Window.unboundedFollowing))
    tried = both.withColumn("level", F.when(rest > 0, (F.col("target") - held) / rest))
    found = tried.groupBy("_s").agg(F.coalesce(F.max(F.when(F.col("level") * F.col("rel") <= most, F.col("level"))), F.lit(float("inf"))).alias("level"))
    return goals.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def plan(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, weight: Column | None = None, seed: str = "mix", keep: bool = False) -> DataFrame:
    """Per row: doc_id, size, source_size, target and copies; with keep, the rows' own columns as the struct `row` too. weight: relative weights of the documents; None: the binary length of their sizes."""
    own = word_count(docs[text])
    rows = docs.select(
        docs[key].cast("long").alias("doc_id"),
        docs[source].cast("string").alias("source"),
        own.alias("size"),
        random_number(F.lit(seed), docs[key], F.md5(F.coalesce(docs[text], F.lit("")))).alias("u"),
        *([] if weight is None else [weight.cast("double").alias("w")]),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else []),
    )
    rows = rows.withColumn("rel", rounded(F.length(F.bin("size")).cast("double") if weight is None else F.col("w"))).drop("w")
    if not keep:
        rows = cut(rows)
    levels = cut(rows.groupBy("source", "rel").agg(F.sum("size").alias("words")))
    goals = targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goals = cut(_levelled(goals, levels, most))
    small = goals.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)

    def with_goal(df: DataFrame, goal: DataFrame) -> DataFrame:
        other = goal.withColumnRenamed("source", "_s")
        return df.join(hint(other), df["source"].eqNullSafe(other["_s"]), "left").drop("_s")

    expected = F.when((F.col("size") > 0) & (F.col("rel") > 0), F.least(F.lit(float(most)), F.col("level") * F.col("rel"))).otherwise(0.0)
    certain = F.floor(expected + 1e-12).cast("long")
    p = F.greatest(F.lit(0.0), expected - certain)
    u, odds = F.col("u"), F.col("p") / (1 - F.col("p"))
    ranked = (
        with_goal(rows, goals)
        .withColumn("certain", certain)
        .withColumn("p", p)
        # q / (1 + q) for the ranking variable q = (u / (1 - u)) / odds: the same order, between 0 and 1.
        .withColumn("rank", F.when(F.col("p") > 0, u / (u + (1 - u) * odds)))
        .withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))
    )
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("certain")).alias("sure"), F.first("target").alias("target"))
    bins = bins.groupBy("source").agg(F.sum("sure").alias("sure"), F.first("target").alias("target"), F.filter(F.array_sort(F.collect_list(F.struct("bin", "words"))), lambda b: b["bin"].isNotNull()).alias("bins"))
    need = F.greatest(F.lit(0.0), F.col("target") - F.col("sure"))
    # Running sum over the at most BINS bins of a source; the first bin that reaches the need is split row by row.
    walk = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("int").alias("edge")),
        lambda s, b: F.when(s["edge"].isNotNull(), s).when((s["below"] + b["words"]) >= F.col("need"), F.struct(s["below"].alias("below"), b["bin"].alias("edge"))).otherwise(F.struct((s["below"] + b["words"]).alias("below"), s["edge"].alias("edge"))),
    )
    edges = cut(bins.withColumn("need", need).withColumn("walk", walk).select("source", F.col("walk.edge").alias("edge"), (F.col("need") - F.col("walk.below")).alias("left")))
    placed = with_goal(ranked, edges)
    at_edge = (F.col("bin") == F.col("edge")) & F.col("edge").isNotNull()
    extra = F.when(F.col("bin").isNull(), 0).when(F.col("edge").isNull() | (F.col("bin") < F.col("edge")), 1).otherwise(0)
    own = ["row"] if keep else []
    out = ["doc_id", "size", "source_size", "target", *own]
    sure = placed.where(~F.coalesce(at_edge, F.lit(False))).select(*out, (F.col("certain") + extra).alias("copies"))
    within = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(within), F.lit(0))
    # Taken where that brings the total nearer: at least half of the document fits.
    split = placed.where(at_edge).withColumn("extra", F.when((before < F.col("left")) & (2 * (F.col("left") - before) >= F.col("size")), 1).otherwise(0)).select(*out, (F.col("certain") + F.col("extra")).alias("copies"))
    return sure.unionByName(split)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: the rows of docs, each as often as the plan takes it."""
    taken = plan(docs, keep=True, **options).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
