"""Matching, linkage, components and guards against plain versions."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators import atlas, matching, views
from tests.test_whole import QUERIES


def test_reference_matching(spark):
    works = spark.createDataFrame([("w1", "10.1234/a", "Deep learning for graphs", 2020), ("w2", None, "A study of selection in open review platforms", 2021), ("w3", None, "A study of selection in open review platform", 2021), ("w4", None, "Unrelated methods entirely", 2021)], "candidate_id string, doi string, title string, year int")
    refs = [(1, None, "see doi:10.1234/A.", None, None), (2, None, "", "Unrelated methods entirelly", 2021), (3, None, "", "A study of selection in open review platforms", 2021), (4, "10.9999/none", "", "No such title here", 2021), (5, None, "", "Unrelated methods entirely", 1999), (6, None, None, None, None)]
    got = {r["reference_id"]: (r["candidate_id"], r["method"], r["cited_identifier"]) for r in matching.match_references(spark.createDataFrame(refs, "reference_id int, doi string, raw string, title string, year int"), works).collect()}
    assert got == {
        1: ("w1", "structured_or_text_doi", "10.1234/a"), 2: ("w4", "bibliographic_title_year", None), 3: (None, "ambiguous_bibliographic_hash", None), 4: (None, "unresolved_text_hash", "10.9999/none"), 5: (None, "unresolved_text_hash", None), 6: (None, "unresolved_text_hash", None),
    }


def test_reference_matching_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(3)
    pool = "graph neural review model selection random field study deep learning open peer panel".split()
    names = [" ".join(rng.choice(pool) for _ in range(5)) + f" {i % 4}x" for i in range(60)]
    works = [(f"w{i:02}", names[i], 2000 + i % 2) for i in range(60)]
    refs = [(i, names[i][: -rng.randrange(3) or None], 2000 + i % 2) for i in range(60)]
    found = matching.match_references(
        spark.createDataFrame([(i, None, "r", t, y) for i, t, y in refs], "reference_id int, doi string, raw string, title string, year int"), spark.createDataFrame([(c, None, t, y) for c, t, y in works], "candidate_id string, doi string, title string, year int")
    ).collect()
    for r in found:
        _, title, year = refs[r["reference_id"]]
        scored = sorted(((SequenceMatcher(None, title.strip(), t).ratio(), c) for c, t, y in works if y == year), reverse=True)
        near = scored[0][0] - scored[1][0] < 0.03
        want = scored[0][1] if scored[0][0] >= 0.94 and not near else None
        assert r["candidate_id"] == want, (title, scored[:2])


def test_repeated_titles_meet_once(spark, monkeypatch):
    # 4000 references of six titles to works that repeat them: pairs of rows would be millions, pairs of titles are few.
    names = ["small ring economy", "large ring economy", "small bolts promotional", "warm gear standards", "old plate of medium size", "hot widget of large size"]
    works = spark.range(4000).select(F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("candidate_id"), F.lit(None).cast("string").alias("doi"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 5 + 1).cast("int")).alias("title"), (F.lit(2000) + F.col("id") % 2).alias("year"))
    works = works.unionByName(spark.createDataFrame([("single", None, names[5], None), (None, None, "title of no candidate", 2000), ("v1", None, "one title in two years", 2000), ("v1", None, "one title in two years", 2001)], "candidate_id string, doi string, title string, year long"))
    refs = spark.range(4000).select(F.col("id").alias("reference_id"), F.lit(None).cast("string").alias("doi"), F.lit("r").alias("raw"), F.element_at(F.array(*map(F.lit, [n[:-1] for n in names])), (F.col("id") % 6 + 1).cast("int")).alias("title"), (F.lit(2000) + F.col("id") % 2).alias("year"))
    refs = refs.unionByName(spark.createDataFrame([(9001, None, "r", "one title in two years", None), (9002, None, "r", "title of no candidate", 2000)], "reference_id long, doi string, raw string, title string, year long"))
    seen = spark.sparkContext.accumulator(0)
    real = text.matching_share

    def share(a, b, least=0.0):
        count = F.udf(lambda x: seen.add(1) or x)
        return real(count(a), b, least)

    monkeypatch.setattr(text, "matching_share", share)
    got = {r["reference_id"]: (r["candidate_id"], r["method"]) for r in matching.match_references(refs, works).collect()}
    assert 0 < seen.value < 500
    assert all(got[i] == (("single", "bibliographic_title_year") if i % 6 == 5 else (None, "ambiguous_bibliographic_hash")) for i in range(4000))
    assert got[9001] == ("v1", "bibliographic_title_year") and got[9002] == (None, "bibliographic_title_year")


def test_linkage_learns_declared_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, bool(i % 3 == 0), *(float(x) for x in rng.normal((1.0 if i % 3 == 0 else 0.0), 0.6, 3)), bool(rng.integers(2)), False, float(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, declared boolean, title_cosine double, title_similarity double, abstract_similarity double, same_source boolean, exact_normalized_title boolean, scaled_gap double")
    labelled = df.withColumn("calibration_label", F.col("declared").cast("int"))
    beta = matching.fit_links(labelled)
    x = np.array([[r[2], r[3], r[4], float(r[5]), float(r[6]), r[7], 1.0] for r in rows])
    y = np.array([r[1] for r in rows], float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    slope = x.T @ (w * (1 / (1 + np.exp(-x @ beta)) - y)) + np.append(beta[:-1], 0)
    assert np.abs(slope).max() < 1e-5
    out = matching.scored_links(df, beta, 0.3).collect()
    assert np.mean([(r["match_probability"] >= 0.5) == r["declared"] for r in out]) > 0.85 and all(r["passes_high_recall_threshold"] >= r["passes_balanced_threshold"] for r in out)


def test_silver_labels_and_features(spark):
    pairs = [(1, "The same title", "x y z", "The same title", "x y z", 1.0), (2, "One title of a work", "abc", "Some other title now", "nothing alike at all here", 0.2), (3, "zzz", "q", "aaa", "w", 0.1)]
    side = lambda t, a: F.struct(F.col(t).alias("title"), F.col(a).alias("abstract"), F.lit("s").alias("source_id"), F.lit("2020-01-01").cast("timestamp").alias("created_at"))
    df = spark.createDataFrame(pairs, "id int, t1 string, a1 string, t2 string, a2 string, title_cosine double").select("id", "title_cosine", side("t1", "a1").alias("left"), side("t2", "a2").alias("right"))
    rows = {r["id"]: r for r in matching.silver_labels(matching.link_features(df), F.col("id") == 1, "id").collect()}
    assert rows[1]["exact_normalized_title"] and rows[1]["time_gap_days"] == 0
    assert {i: r["calibration_label"] for i, r in rows.items()} == {1: 1, 2: 0, 3: None}


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 3)) @ np.array([[1, 0.8, 0], [0, 0.5, 0.2], [0, 0, 1]])
    df = spark.createDataFrame([("g" if i % 4 else "h", *map(float, r)) for i, r in enumerate(a)], "g string, a double, b double, c double")
    fit = atlas.principal_axes(df, ["a", "b", "c"])[None]
    z = (a - a.mean(0)) / a.std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert abs(abs(fit["loadings"][0] @ vt[0]) - 1) < 1e-9 and np.isclose(fit["explained"][0], s[0] ** 2 / (s**2).sum())
    assert np.isclose(fit["left_out"], np.mean((z - np.outer(u[:, 0] * s[0], vt[0])) ** 2))
    out = {r["group"]: r for r in atlas.congruence(df, ["a", "b", "c"], "g", 150).collect()}
    assert out["h"]["status"] == "insufficient_for_invariance" and out["g"]["status"] == "invariant_at_0.90"


def test_quantiles_and_guards(spark):
    values = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)], "k string, v double")
    got = {r["k"]: (r["m"], r["p"]) for r in atlas.quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.9}).collect()}
    assert got == {"a": (2.0, pytest.approx(np.quantile([1, 2, 2, 3, 10], 0.9))), "b": (5.0, 5.0)}
    with pytest.raises(ValueError, match="repeated"):
        atlas.one_to_one(df.select("k"), spark.createDataFrame([("a",)], "k string"), "k")
    with pytest.raises(ValueError, match="is in both"):
        atlas.disjoint_union(df, df, "k")
    with pytest.raises(ValueError, match="no temporal contract"):
        views.inadmissible("unknown", F.lit(1), F.lit(1), F.lit("x"))
    one, other = (atlas.set_digest(spark.createDataFrame([("k", x) for x in order], "k string, m string"), ["k"], "m").first() for order in ("abca", "cab"))
    assert one["digest"] == other["digest"] and one["members"] == 3
    assert atlas.valid_in_time(F.lit(1), F.lit(2)) is not None and "construct_congruence" in QUERIES
