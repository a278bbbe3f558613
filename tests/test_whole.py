"""Queries that read whole tables and texts, against plain versions on small tables."""

import re
from collections import Counter

from sluice.plans import load

QUERIES, ORACLES = load()


def plain_units(text):
    words = [w for w in re.findall("[a-z][a-z0-9]{2,}", text.lower()) if w not in ("the", "and", "for", "was")]
    counts = Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a != b)
    return sorted(counts, key=lambda u: (-counts[u], -len(u.split()), u))[:12]


def test_units_come_from_the_whole_text(spark, tmp_path):
    early, late = " ".join(f"early{i % 40}" for i in range(400)), " ".join(f"late{i % 5} mark" for i in range(900))
    texts = [early + " " + late, "short text", "", None]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["unit"]) for r in QUERIES["lexical_units"](spark, str(tmp_path)).collect()}
    assert got == {(i, u) for i, t in enumerate(texts) for u in plain_units(t or "")}
    assert (0, "mark") in got and early.find("mark") == -1 and len(early) > 2000


def test_cycles_of_every_customer(spark, tmp_path):
    customers = [(k, k * k % 25) for k in range(1, 91)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    n = len(customers) * 3 // 4
    edges = {(k % n, (k * 7 + m) % n) for k, m in customers}
    paths = set(edges)
    while more := {(a, d) for a, b in paths for c, d in edges if b == c} - paths:
        paths |= more
    nodes = {a for a, b in paths if a == b}
    plain = {(a, min(b for b in nodes if b == a or {(a, b), (b, a)} <= paths)) for a in nodes}
    assert {(r["node"], r["root"]) for r in QUERIES["graph_cycles"](spark, str(tmp_path)).collect()} == plain
    assert max(nodes) >= 40
