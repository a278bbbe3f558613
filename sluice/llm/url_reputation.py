"""URL filters: an ordered rule list, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Beta
priors shrink each level towards the one above it: the suffix towards the whole table, the
registered domain towards its suffix, the host towards its registered domain. The weight of
each prior is fitted to the data by the method of moments on that level's groups. A page
without a rule is blocked if the lower bound of its host's posterior for "bad" (mean minus
`Z` standard deviations of the beta posterior) is above `LIMIT`.

Only built-in functions are used. Counts are aggregated before any shuffle by host, so one
host with a third of the pages costs a row per task.

The host's name is what is left of it without user and port. Its public suffix is the last label,
or the last two where the last is of two letters (a country) and the one before is one of the
usual `SECOND_LEVEL` labels (`co.uk`, `com.br`); the registered domain is the suffix with one more
label. An address of numbers is its own registered domain under the suffix `ip`. Suffixes that are
run by a company or a city are not known as such: the rule stands in for a list of thousands.

Defined results: a null url, or one without `://`, has empty host and path and no rule; hosts
without labels get their parent's posterior mean and the width of the prior; an unlabelled
table allows all that no rule blocks; very long urls are taken whole; repeated pages are judged
alike, each in a row of its own; a null page_id is kept and has no label; an empty table gives an
empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import cut

#: (verdict, host, path): fixed by the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A page is blocked if its host is bad in more than LIMIT of its pages, Z standard deviations sure.
LIMIT, Z = 0.3, 1.645
#: Weight of a prior, in pages: between these, and the first where the data cannot tell.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0
#: Labels under which countries register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gv", "id", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_name(host_: Column) -> Column:
    """A host without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host_, "^.*@", ""), r"(?::[0-9]*)?\.?$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$")


def _two_labels(name: Column) -> Column:
    return name.rlike(rf"(?:^|\.)(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")


def registered_domain(name: Column) -> Column:
    """The suffix of a host's name with one more label, if it has one."""
    return F.when(_is_address(name), name).when(_two_labels(name), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix(name: Column) -> Column:
    """The public suffix of a host's name."""
    return F.when(_is_address(name), F.lit("ip")).when(_two_labels(name), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def rule(host_name: Column, path_name: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none fits."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host_name == h) | host_name.endswith(f".{h}")) & path_name.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _shrunk(level: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, parent, n, bad) with posterior alpha and beta, given the parents' posterior mean.

    The prior's weight m solves the beta-binomial moment equation: with residual
    r = n (bad / n - mean)^2 / (mean (1 - mean)), E[r] = (m + n) / (m + 1). A prior never counts
    for more pages than its parent's own posterior does.
    """
    rows = level.join(parents.select(F.col(parents.columns[0]).alias(parent), F.col("mean").alias("prior"), F.col("strength")), parent)
    v = F.col("prior") * (1 - F.col("prior"))
    labelled = (F.col("n") > 0) & (v > 0)
    excess = F.when(labelled, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) / v - 1)
    spread = F.when(labelled, F.col("n") - 1)
    fit = rows.agg(F.sum(excess).alias("excess"), F.sum(spread).alias("spread"), F.count_if(labelled).alias("groups"))
    rho = F.col("excess") / F.col("spread")
    weight = F.when((F.col("spread") > 0) & (F.col("groups") > 1), F.when(rho <= 0, F.lit(MOST_WEIGHT)).otherwise(F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), (1 - rho) / rho)))).otherwise(F.lit(LEAST_WEIGHT))
    alpha, beta = F.col("m") * F.col("prior") + F.col("bad"), F.col("m") * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    return (
        # One row: the fitted weight.
        rows.crossJoin(F.broadcast(fit.select(F.coalesce(weight, F.lit(LEAST_WEIGHT)).alias("m"))))
        .withColumn("m", F.least("m", "strength"))
        .withColumn("alpha", alpha)
        .withColumn("beta", beta)
        .withColumn("strength", F.col("alpha") + F.col("beta"))
        .select(key, "n", "bad", "alpha", "beta", "strength", (F.col("alpha") / F.col("strength")).alias("mean"))
    )


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad: 0, 1 or null if unlabelled) to one row per host: n, bad, alpha, beta, mean and lower bound."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = cut(counts.withColumn("domain", registered_domain(host_name(F.col("host")))).withColumn("suffix", suffix(host_name(F.col("host")))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("root", F.lit("all"))
    # Half a good and half a bad page keep the mean inside (0, 1).
    root = hosts.agg(F.lit("all").alias("root"), ((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mean"), (F.coalesce(F.sum("n"), F.lit(0)) + 1.0).alias("strength"))
    of_suffix = cut(_shrunk(suffixes, root, "suffix", "root"))
    of_domain = cut(_shrunk(domains, of_suffix, "domain", "suffix"))
    a, b = F.col("alpha"), F.col("beta")
    sd = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return _shrunk(hosts, of_domain, "host", "domain").withColumn("lower", F.col("mean") - Z * sd)


def judge(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """Per page: page_id, host, path, rule (null: none), verdict, and its host's posterior mean and lower bound for "bad".

    outcomes: (page_id, bad) of labelled pages, a page at most once.
    """
    base = pages.select(pages[page_id].cast("long").alias("page_id"), host(pages[url]).alias("host"), path(pages[url]).alias("path"))
    marks = outcomes.select(F.col("page_id").alias("_p"), F.col("bad"))
    labelled = base.select("page_id", "host").join(marks, F.col("page_id") == F.col("_p"), "left")
    known = cut(reputation(labelled.select("host", "bad"))).select(F.col("host").alias("_h"), "mean", "lower")
    fit = rule(F.col("host"), F.col("path"), rules)
    return (
        base.join(known, F.col("host") == F.col("_h"), "left")
        .withColumn("_rule", fit)
        .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.when(F.col("lower") > limit, "block").otherwise("allow")).alias("verdict"), F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower"))
    )
