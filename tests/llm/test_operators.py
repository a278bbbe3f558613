"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice import session
from sluice.llm import induced_sort, license_scan, mixing, ngram_join, quality_gbt, quality_rules, secret_scan, suffix_dedup, url_reputation, va_topk
from sluice.llm.common import sample_texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tid string, key string, score double"


def table(spark, texts, sources=None):
    """A documents table with columns whose names the operators use themselves."""
    rows = [(i, t, "en", (sources or ["a", "b", None])[i % 3 if sources is None else i], None, "x", "y", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [None, "", "   ", "\n\n", "one", "two words", "é🙂 ß", words(30), words(30), words(3000, 5)]


@pytest.fixture(scope="module")
def corpus():
    base = words(120, 1).split()
    near = [" ".join("CHANGED" if i == k else w for i, w in enumerate(base)) for k in (5, 60, 100)]
    passage = words(60, 9)
    return [*EDGE, " ".join(base), *near, words(80, 2) + " " + passage, words(80, 3) + " " + passage, "a b " * 200, "ab" * 700]


# 1: suffix-array dedup


def brute_spans(raw, length):
    where = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((d, i))
    marks = [bytearray(len(b)) for b in raw]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                marks[d][i : i + length] = b"\x01" * length
    return marks


@pytest.mark.parametrize(("length", "gram", "hot"), [(200, 96, 1024), (40, 12, 2)])
def test_suffix_dedup(spark, corpus, length, gram, hot):
    raw = [(t or "").encode() for t in corpus]
    found = suffix_dedup.remove(table(spark, corpus), length=length, gram=gram, hot=hot, shard=3000).collect()
    assert len(found) == len(corpus)
    for r in found:
        b, m = raw[r["doc_id"]], brute_spans(raw, length)[r["doc_id"]]
        kept = bytes(x for x, hit in zip(b, m, strict=True) if not hit)
        runs = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(m), runs, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    long = words(9000, 41)
    rows = [(1, long), (1, words(3, 2)), (None, long[500:900]), (None, None), (2, words(8000, 43) + long[2000:2300]), (2, "x" * 199), (3, "x" * 199)]
    docs = spark.createDataFrame([(i, t, 0, "k", "c") for i, t in rows], "doc_id long, text string, key int, content string, spans string")
    found = suffix_dedup.remove(docs).collect()
    raw = [(t or "").encode() for _, t in rows]
    marks = brute_spans(raw, 200)
    want = [(i, len(b), sum(m), hashlib.sha256(bytes(x for x, hit in zip(b, m, strict=True) if not hit)).hexdigest()) for (i, _), b, m in zip(rows, raw, marks, strict=True)]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"])) for r in found)


def test_a_production_shard_spills(tmp_path):
    rng = random.Random(8)
    pool = [words(60, i).encode() for i in range(300)]
    pieces = []
    while sum(map(len, pieces)) < suffix_dedup.SHARD:
        pieces.append(b" ".join(rng.choice(pool) for _ in range(3)))
    text, left = next(induced_sort.blocks(pieces))
    kept, disk = induced_sort.Scratch(), induced_sort.Scratch(str(tmp_path))
    for a, b in zip(induced_sort.repeated_windows(text, left, 200, kept), induced_sort.repeated_windows(text, left, 200, disk), strict=True):
        assert np.array_equal(a, b)
    assert kept.done["spills"] == 0 and disk.done["spills"] > 1 and disk.done["spilled"] > induced_sort.BUDGET
    assert disk.done["recursions"] > 0
    assert not list(tmp_path.iterdir())


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove(spark.createDataFrame([], DOCS)).count() == 0


def test_induced_sort_spills_and_carries_prefixes(monkeypatch, tmp_path):
    rng = random.Random(3)
    for _ in range(200):
        for name, values in (("BASE", (0, 1 << 22)), ("SMALL", (0, 512)), ("PACKED", (3, 24)), ("SHORT", (0, 1000)), ("STEP", (2, 1 << 15)), ("BUCKET", (1, 64))):
            monkeypatch.setattr(induced_sort, name, rng.choice(values))
        n, sigma = rng.randint(1, 50), rng.choice([1, 2, 4, 600])
        t = [rng.randrange(sigma) for _ in range(n)] * rng.randint(1, 3)
        sa, lcp = induced_sort.suffix_and_lcp(np.array(t), 9, induced_sort.Scratch(str(tmp_path), rng.choice([60, 1 << 20])))
        order = sorted(range(len(t)), key=lambda i: t[i:])

        def shared(a, b):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            return min(k, 9)

        assert sa.tolist() == order
        assert lcp.tolist() == [0] + [shared(a, b) for a, b in zip(order, order[1:])]


# 2: mixing


def test_prefixes_are_compared_by_words():
    rng = np.random.default_rng(5)
    for top, cap in ((1, 200), (3, 7), (257, 200), (1 << 20, 50)):
        text = np.tile(rng.integers(0, top + 1, 300), 3)
        text[rng.integers(0, 900, 3)] = top
        a, b = rng.integers(0, 900, (2, 400))
        a, b = a[a != b], b[a != b]
        plain = [next((k for k in range(cap) if max(x, y) + k >= 900 or text[x + k] != text[y + k]), cap) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        assert induced_sort._compared(text, a, b, cap).tolist() == plain
    # A comparison reads words, not characters: the rounds are few however long the prefixes are.
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            reads.append(at)
            return super().__getitem__(at)

    long = np.zeros(1000, np.int64)
    x = np.arange(100).view(Counted)
    assert (induced_sort._compared(long + 257, x, np.arange(100) + 200, 200) == 200).all() and len(reads) < 100


def test_mix_targets_and_copies(spark):
    texts = [words(20 + i % 37, i) for i in range(600)] + ["", None]
    sources = [("big", "mid", "small", None)[min(i % 7, 3)] for i in range(602)]
    docs = table(spark, texts, sources)
    plan = mixing.plan(docs).collect()
    again = {(r["doc_id"], r["copies"]) for r in mixing.plan(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in plan} and len(plan) == 602
    size = {}
    for r in plan:
        size.setdefault(sources[r["doc_id"]], [0, 0, r["target"]])
        size[sources[r["doc_id"]]][0] += r["size"]
        size[sources[r["doc_id"]]][1] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    order = sorted([s for s in size if s is not None]) + [None]
    weight, total = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(v[0] for v in size.values())
    open_, rest, target = set(order), total, {}
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s][0]}
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s][0]
            rest -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    for s, (_, taken, own) in size.items():
        assert math.isclose(own, target[s], rel_tol=1e-9)
        assert abs(taken - own) <= 60
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)


def plain_mix(rows, weight=None, weights=(1, 2, 3), most=3):
    """[(doc_id, source, text)] to (target by source, copies by position), written plainly."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    rel = [len(bin(n)) - 2 if weight is None else weight(i) for n, (i, _, _) in zip(size, rows, strict=True)]
    order = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in order}
    share = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, rest, target = set(order), sum(own.values()), {}
    while open_:
        level = rest / sum(share[s] for s in open_)
        over = {s for s in open_ if level * share[s] > most * own[s]}
        if not over:
            break
        for s in over:
            target[s] = most * own[s]
            rest -= target[s]
        open_ -= over
    target |= {s: level * share[s] for s in open_}
    copies = [0] * len(rows)
    for s in order:
        at = [k for k, r in enumerate(rows) if r[1] == s and size[k] and rel[k] > 0]
        held = set()
        while len(held) < len(at):
            level = (target[s] - most * sum(size[k] for k in held)) / sum(size[k] * rel[k] for k in at if k not in held)
            over = {k for k in at if k not in held and level * rel[k] > most}
            if not over:
                break
            held |= over
        left, drawn = target[s], []
        for k in at:
            x = most if k in held else level * rel[k]
            copies[k] = int(x + 1e-12)
            left -= copies[k] * size[k]
            if (p := x - copies[k]) > 1e-12:
                i, _, t = rows[k]
                text = f"mix\x1f{chr(0) if i is None else i}\x1f{hashlib.md5((t or '').encode()).hexdigest()}"
                u = (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                drawn.append(((u / (1 - u)) / (p / (1 - p)), -1 if i is None else i, size[k], k))
        for _, _, n, k in sorted(drawn):
            if left > 0 and 2 * left >= n:
                copies[k] += 1
            left -= n
    return target, copies


def test_mix_equals_a_plain_version(spark):
    rng = random.Random(17)
    texts = [words(rng.choice((0, 1, 3, 20, 60, 500)), i) for i in range(400)] + [None, ""]
    sources = [rng.choice(("big", "big", "big", "mid", "small", None)) for _ in texts]
    docs = table(spark, texts, sources).union(table(spark, texts[:1], sources[:1]))
    rows = [(i, s, t) for i, (s, t) in enumerate(zip(sources, texts, strict=True))]
    target, copies = plain_mix([*rows, rows[0]])
    got = mixing.plan(docs).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r[0], c) for r, c in zip([*rows, rows[0]], copies, strict=True))
    assert all(math.isclose(r["target"], target[sources[r["doc_id"]]], rel_tol=1e-9) for r in got)


def test_mix_of_nothing_and_of_weights(spark):
    assert mixing.plan(spark.createDataFrame([], DOCS)).count() == 0
    docs = table(spark, [words(10, i) for i in range(300)], ["a"] * 150 + ["b"] * 150)
    # Source b is to give twice its words, and a tenth of it is wanted a hundred times more: three copies each, and the rest fills up.
    weigh = lambda i: 100.0 if i % 10 == 0 else (0.0 if i % 10 == 1 else 1.0)
    column = F.when(F.col("doc_id") % 10 == 0, 100.0).when(F.col("doc_id") % 10 == 1, None).otherwise(1.0)
    plan = mixing.plan(docs, weights=(1, 3), weight=column).collect()
    rows = [(i, "a" if i < 150 else "b", words(10, i)) for i in range(300)]
    target, copies = plain_mix(rows, weigh, (1, 3))
    assert sorted((r["doc_id"], r["copies"]) for r in plan) == list(enumerate(copies))
    for s, own in target.items():
        assert abs(sum(r["size"] * r["copies"] for r in plan if rows[r["doc_id"]][1] == s) - own) <= 10
    assert {r["copies"] for r in plan if r["doc_id"] % 10 == 1} == {0} and {r["copies"] for r in plan if r["doc_id"] % 10 == 0} == {3}


# 3: quality rules


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def plain_kept(text):
    w, (n, chars, symbols, dup, repeat) = re.findall(r"[^\x20\x09-\x0D]+", text or ""), plain_counts(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    raw = (text or "").encode()
    return bool(
        n >= 20 and 100 * repeat <= 30 * n and symbols <= 0.2 * n and dup <= 0.6 * max(lines, 1) and 2 <= chars / n <= 16 and sum("A" <= c <= "Z" for c in text) <= 0.4 * chars and text.count("!") <= 0.3 * n
        and max(w.count(x) for x in set(w)) <= 0.35 * n and sum(a == b for a, b in zip(w, w[1:])) <= 0.3 * n and (len(raw) < 512 or len(zlib.compress(raw, 1)) >= 0.12 * len(raw))
    )


def test_quality_verdicts_equal_a_plain_version(spark):
    rng = random.Random(5)
    texts = [None, "", words(4000, 6)]
    for i in range(80):
        w = words(rng.randrange(10, 60), i, rng.choice((1, 3, 30, 400))).split()
        tail = rng.choice(("", "!", "#*", "UPPER", "é" * 20, "\nsame line\nsame line\nsame line"))
        texts.append(" ".join(x + (tail if rng.random() < 0.5 else "") for x in w) * rng.choice((1, 1, 6)))
    docs = table(spark, texts).union(spark.createDataFrame([(None, texts[5], "en", "a", None, "", "", 0.0)], DOCS))
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(texts) + 1 and {r["kept"] for r in got} == {True, False}
    for r in got:
        text = texts[5 if r["doc_id"] is None else r["doc_id"]]
        assert r["kept"] == plain_kept(text) and r["kept"] == (r["rejected_by"] is None)
    again = {(r["doc_id"], r["rejected_by"]) for r in quality_rules.judge(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["rejected_by"]) for r in got}
    assert sorted(str(r["doc_id"]) for r in quality_rules.keep(docs).collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_sample_is_of_bounded_size_and_free_of_layout(spark):
    docs = table(spark, [words(50, i) for i in range(100)] + [None, ""])
    one = sample_texts(docs, "text", 20, 10**6)
    assert len(one) == 20 and one == sample_texts(docs.repartition(9), "text", 20, 10**6)
    assert sum(map(len, sample_texts(docs, "text", 20, 1000))) <= 1000


def test_quality_counts_and_verdicts(spark):
    texts = [*EDGE[:-1], "x y\nx y\n x y\nz\nz", " ".join(["a b c d e f g h i"] * 4), " ".join(f"{w}***" for w in words(60).split()), " ".join(f"SHOUT{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60)), " word word \x0bv\x0cf\r"]
    got = {r["doc_id"]: r for r in quality_rules.judge(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, plain = got[i], plain_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain
        assert r["base_failed"] == (plain[0] < 20 or 100 * plain[4] > 30 * plain[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {i for i, r in got.items() if r["kept"]}
    assert kept == {7, 8}
    docs = table(spark, texts)
    clean = quality_rules.keep(docs)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == kept
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_rule_order_does_not_change_verdicts():
    texts = [words(40, i) for i in range(20)] + [" ".join(f"{w}%%" for w in words(40, i).split()) for i in range(5)]
    raw = [t.encode() for t in texts]
    view = quality_rules.View(raw)
    at = np.arange(len(raw))
    ordered = quality_rules.order_rules(texts)
    assert ordered[0].name == "symbol_density" and quality_rules.order_rules(texts, quality_rules.RULES[::-1]) == ordered
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1], ordered):
        assert (quality_rules.cascade(view, at, rules) == len(rules)).tolist() == [True] * 20 + [False] * 5


# 4: license scan


def test_licenses(spark):
    mit = license_scan.TEMPLATES[3][1]
    texts = [*EDGE, words(50) + " Released under the MIT License. " + words(50), mit.upper().replace(" ", "\n "), "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "Licensed under the", " ".join(mit.split()[:-4])]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(table(spark, texts)).collect()}
    n = len(EDGE)
    assert got == {**{i: "" for i in range(n)}, n: "MIT", n + 1: "MIT", n + 2: "Apache-2.0,MIT", n + 3: "", n + 4: "MIT"}
    assert license_scan.miss_probability() < 1 / 20_000


def plain_licenses(text):
    def grams(t):
        w = t.lower().translate({ord(c): None for c in license_scan.DROPPED}).split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    own, sets, held = grams(text or ""), [set(grams(t)) for _, t in license_scan.TEMPLATES], {}
    for i, t in enumerate(sets):
        stride = 1 << license_scan.size_class(len(t))
        share = max((len(t & set(own[a : a + 2 * stride])) / len(t) for a in range(0, max(len(own), 1), stride)), default=0)
        if share >= 0.8:
            held[i] = share
    better = lambda i, o: len(sets[i] & sets[o]) >= 0.8 * len(sets[i]) and (held[o] > held[i] or (held[o] == held[i] and len(sets[o]) > len(sets[i])))
    return ",".join(sorted({license_scan.TEMPLATES[i][0] for i in held if not any(better(i, o) for o in held if o != i)}))


def test_licenses_equal_a_plain_version(spark):
    rng = random.Random(9)
    texts = [None, "", words(20000, 3) + " " + license_scan.TEMPLATES[4][1] + " " + words(50, 4)]
    for i, (_, t) in enumerate(license_scan.TEMPLATES):
        w = t.split()
        texts.append(words(rng.randrange(40), i) + " " + t + " " + words(rng.randrange(40), i + 1))
        # Around the least containment: one word in so many changed.
        for changed in (1, max(1, len(w) // 40), max(1, len(w) // 25)):
            own = list(w)
            for k in rng.sample(range(len(w)), changed):
                own[k] = "other"
            texts.append(words(30, i) + "\n" + " ".join(own) + "\n" + words(30, i + 2))
    found = {r["doc_id"]: r["licenses"] for r in license_scan.scan(table(spark, texts)).collect()}
    assert found == {i: plain_licenses(t) for i, t in enumerate(texts)}
    assert {x for v in found.values() for x in v.split(",")} >= {n for n, _ in license_scan.TEMPLATES}
    tagged = spark.createDataFrame([(None, "// SPDX-License-Identifier: MIT\nx SPDX-License-Identifier: GPL-2.0-only", 1)], "doc_id long, text string, tags int")
    assert [list(r["spdx_tags"]) for r in license_scan.scan(tagged).collect()] == [["GPL-2.0-only", "MIT"]]


def test_no_licenses_of_nothing(spark):
    assert license_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


# 5: quality trees


def test_trees_equal_a_scalar_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 1] > 0) ^ (x[:, 4] > 0.5)).astype(float)
    trees = quality_gbt.train(x, y)
    fresh = rng.normal(size=(200, 6))
    for row, score in zip(fresh, trees.score(fresh), strict=True):
        total = trees.base
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = int(trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node])
            total += trees.value[node]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-12)
    held = ((fresh[:, 1] > 0) ^ (fresh[:, 4] > 0.5)) == (trees.score(fresh) > 0.5)
    assert held.mean() > 0.9


def test_a_repeated_doc_id_trains_once(spark):
    docs = table(spark, [words(30, i) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(7, 0, 0)], "doc_id long, quality int, toxic int")
    x, y = quality_gbt.training_rows(docs.union(docs).union(docs), labels)
    own, marks = quality_gbt.training_rows(docs, labels)
    assert np.array_equal(x, own) and np.array_equal(y, marks) and 0 < len(y) < 40


def test_trees(spark):
    good = [words(60 + i % 40, i) for i in range(150)]
    bad = [" ".join(f"{w}{'*%$'[i % 3]}" for w in words(60, i).split()) for i in range(150)]
    docs = table(spark, [t for pair in zip(good, bad) for t in pair] + EDGE)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 0), (9999, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_gbt.classify(docs, labels).collect()
    assert len(got) == 300 + len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] < 300 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.95
    assert quality_gbt.classify(docs, labels.limit(0)).count() == len(got)
    assert quality_gbt.classify(docs.limit(0), labels).count() == 0


# 6: secret scan


def test_secrets(spark):
    key = "9f8A7xQ2mZ0pL4tYw6RsK1vBnE3uHc5J"
    texts = [*EDGE, 'x password = "hunter2hunter2" y', "TOKEN:abcdefghijkl secret=short", "AKIA" + "B" * 14 + " AKIA12", "deadbeefdeadbeef 0123", f"see {key} now", "token=secret = abcdefghijklmnopq", "getUserNameFromConfigService internationalization_of_documents"]
    n = len(EDGE)
    got = {r["doc_id"]: r for r in secret_scan.scan(table(spark, texts)).collect()}
    assert all(got[i]["spans"] == "" and got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest() for i in range(n))
    spans = [got[n + i]["spans"] for i in range(7)]
    assert spans == ["assign:2:28", "assign:0:18", "access:0:18", "hex:0:16", "random:4:36", "", ""]
    assert got[n]["base_sha256"] == hashlib.sha256(b"assign:2:28").hexdigest()
    assert secret_scan.scan(spark.createDataFrame([], DOCS)).count() == 0
    both = spark.createDataFrame([(None, texts[n + 4], 1), (None, texts[n + 4], 2)], "doc_id long, text string, spans int")
    assert [(r["doc_id"], r["n_random"]) for r in secret_scan.scan(both).collect()] == [(None, 1)] * 2
    docs = table(spark, texts)
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by[n] == 'x <assign>" y' and by[n + 4] == "see <random> now" and all(by[i] == texts[i] for i in range(n))


def plain_base(text):
    found = []
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[i : i + len(name)].lower() == name and text[i : i + len(name)].isascii():
                k = i + len(name)
                k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "="):
                    continue
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
                end = k
                while end < len(text) and text[end] in word:
                    end += 1
                if end > k:
                    if end - k >= 12:
                        found.append((i, 0, end))
                    i = end - 1
                    break
        i += 1
    for kind, begin, letters, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), (2, "", "0123456789abcdef", 16)):
        i = 0
        while i < len(text):
            k = i + len(begin)
            if text.startswith(begin, i) and text[k : k + 1] != "" and text[k] in letters:
                while k < len(text) and text[k] in letters:
                    k += 1
                if k - i >= least:
                    found.append((i, kind, k))
                i = k
            else:
                i += 1
    return sorted(found)


def test_base_spans_equal_a_plain_scan():
    rng = random.Random(12)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", " : ", "=", ":", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef", "0123456789", "abc", "é", "-", "\n", "token=secret="]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert secret_scan.base_spans(text) == plain_base(text), text


def test_markov_precision_and_recall():
    model = secret_scan.train([w for i in range(50) for w in re.findall("[a-z]+", words(30, i))])
    positive, negative = secret_scan.samples(["alpha", "beta", "gamma", "description", "windows", "filter"], seed=99)
    precision, recall = secret_scan.measure(model, positive, negative)
    assert precision > 0.99 and recall > 0.97
    rng = random.Random(1)
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=32)) for _ in range(500)]
    assert secret_scan.measure(model, letters, [])[1] > 0.95


def test_all_spans_take_time_in_proportion():
    model = secret_scan.train([])
    text = " ".join(f"token=abcdefghijkl{i:05d} getUserNameFromConfigService" for i in range(20000))
    spans = secret_scan.all_spans(text, secret_scan.base_spans(text), model)
    assert len(spans) == 20000


# 8: top-k


def test_top_k_of_large_components_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.3, (90, 8))
    v[7, 2], v[20, 2], v[33], v[60, 0] = 1e9, -3e4, 1e30, 2.0**60
    ids = [*range(80), 20, 20, 20, 5, 5, 40, 40, 41, 41, 41]
    df = spark.createDataFrame([(i, [float(x) for x in row], 0, 0) for i, row in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, cid int, qid int")
    got = {}
    for r in va_topk.top_k(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    whole = [[int(x * 64 // 1) if abs(x) < 1e12 else int(x) * 64 for x in row.tolist()] for row in v]
    want = {}
    for q, a in zip(ids, whole, strict=True):
        if q % 20 == 0:
            scores = [(min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1), i) for i, b in zip(ids, whole, strict=True) if i != q]
            want[q] = sorted([*want.get(q, []), *scores], key=lambda s: (-s[0], s[1]))[:10]
    assert got == want


def test_approximation_bounds_hold():
    rng = np.random.default_rng(6)
    v = np.floor(rng.normal(0, 20, (500, 16)))
    v[3, 1] = 6e10
    bounds, cells = va_topk.Page.make(v)
    assert len(cells) == -(-500 * 16 * va_topk.BITS // 8)
    low, high = va_topk.Page(16, bounds, cells, 500).bounds(v[:50])
    exact = v[:50] @ v.T
    assert (low <= exact + 1e-6 * abs(exact)).all() and (high >= exact - 1e-6 * abs(exact)).all()


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.2, (300, 12)).astype(np.float32)
    v[100:180] = v[0]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(300)]
    rows += [(300, None, 1), (301, [float("nan")] * 12, 1), (302, [None] + [0.0] * 11, 1), (303, [0.5] * 5, 1), (320, [float("inf")] * 12, 1), (None, [0.1] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in va_topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = np.floor(64 * v.astype(np.float64)).astype(np.int64)
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        scores = whole @ whole[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert found == [(i, scores[i]) for i in best]
    few = va_topk.top_k(df.where("vec_id in (0, 1, 303)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 1)]
    assert va_topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 9: url reputation


def test_urls(spark):
    urls = [None, "no scheme", "https://WWW.Example.com/en/1?x#y", "http://a.example.com/en/", "http://example.com/fr/x", "http://x.net/es/1", "http://x.net/en/1", "http://bad.org/a", "http://com/", "http://dotcom/x", "://h", "http://a.com", *[f"http://bad.org/{i}" for i in range(60)], *[f"http://ok.org/{i}" for i in range(60)]]
    pages = spark.createDataFrame([(i, u, "h", "q") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    bad = [(i, int(u.startswith("http://bad."))) for i, u in enumerate(urls) if u and ".org/" in u]
    got = {r["page_id"]: r for r in url_reputation.judge(pages, spark.createDataFrame(bad, "page_id long, bad long")).collect()}
    assert len(got) == len(urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(12)] == [
        ("", "", None), ("", "", None), ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/", "example.com/en/"), ("example.com", "/fr/x", "com/"), ("x.net", "/es/1", "net/es/"),
        ("x.net", "/en/1", None), ("bad.org", "/a", None), ("com", "/", "com/"), ("dotcom", "/x", None), ("h", "", None), ("a.com", "", None),
    ]
    assert [got[i]["verdict"] for i in range(8)] == ["allow", "allow", "allow", "block", "allow", "block", "allow", "block"]
    assert got[len(urls) - 1]["verdict"] == "allow"
    names = ["a.b.co.uk", "co.uk", "x.example.com", "com", "10.0.0.1", "a.b.io", "", "[::1]"]
    split = spark.createDataFrame([(n,) for n in names], "n string").select("n", url_reputation.registered_domain(F.col("n")), url_reputation.suffix(F.col("n"))).collect()
    assert [tuple(r) for r in split] == [("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.example.com", "example.com", "com"), ("com", "com", "com"), ("10.0.0.1", "10.0.0.1", "ip"), ("a.b.io", "b.io", "io"), ("", "", ""), ("[::1]", "[::1]", "ip")]
    bare = spark.createDataFrame([("u@h.com:8080",), ("h.com.",), ("h.com",)], "n string").select(url_reputation.host_name(F.col("n"))).collect()
    assert {r[0] for r in bare} == {"h.com"}
    twice = pages.where("page_id = 7").union(spark.createDataFrame([(7, "http://bad.org/a", "h", "q"), (None, "http://bad.org/a", "h", "q")], pages.schema))
    again = url_reputation.judge(twice, spark.createDataFrame(bad, "page_id long, bad long")).collect()
    assert sorted(str(r["page_id"]) for r in again) == ["7", "7", "None"] and len({(r["host"], r["bad_mean"]) for r in again}) == 1
    none = url_reputation.judge(pages, spark.createDataFrame([], "page_id long, bad long"))
    assert {r["verdict"] for r in none.where("rule is null").collect()} == {"allow"}
    assert url_reputation.judge(pages.limit(0), spark.createDataFrame([], "page_id long, bad long")).count() == 0


# 10: n-gram join


def plain_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(texts, percent=85, k=4):
    sets = [plain_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("block", "hot", "group"), [(256, 8, 4000), (3, 1, 5)])
def test_ngram_join(spark, corpus, block, hot, group, monkeypatch):
    rng = random.Random(4)
    chain = words(150, 77).split()
    texts = list(corpus)
    small = block < 10  # many units: fewer texts
    for _ in range(12 if small else 40):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    hub = words(100, 78).split()
    texts += [" ".join(f"h{k}" if i in (3 * k % 100, (7 * k + 50) % 100) else w for i, w in enumerate(hub)) for k in range(8 if small else 25)]
    for name, value in (("BLOCK", block), ("HOT", hot), ("GROUP", group)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = table(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    assert got == plain_components(texts)


def test_ngram_join_edges(spark):
    assert ngram_join.join(spark.createDataFrame([], DOCS)).count() == 0
    docs = table(spark, EDGE).union(spark.createDataFrame([(None, words(30), "en", "a", None, "", "", 0.0), (3, "other text of the same id here", "en", "a", None, "", "", 0.0), (9, EDGE[9], "en", "a", None, "", "", 0.0)], DOCS))
    got = ngram_join.join(docs).collect()
    assert len(got) == len(EDGE) + 3
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect())
    assert ids == [-1, 0, 1, 2, 3, 3, 4, 5, 6, 7, 9]


def test_keep_first_knows_rows_by_id_and_text(spark):
    a, b, c = words(60, 100), words(60, 101), words(60, 102)
    near = a.replace(a.split()[3], "other")
    rows = [(3, a), (7, a), (7, b), (9, c), (11, b), (3, near), (None, a), (12, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, _gone int, _doc int, mark int, root int")
    kept = ngram_join.keep_first(docs, words=5, percent=80)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    one = [(3, a)] if (3, a) in got else [(3, near)]
    assert got == sorted([*one, (7, b), (9, c), (None, a), (12, "")], key=str)


@pytest.mark.parametrize(("hot", "slots"), [(2, 1 << 22), (1, 4)])
def test_ngram_join_of_one_key_in_most_rows(spark, monkeypatch, hot, slots):
    # With four slots nearly every row is dealt, some keys only in part.
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "SLOTS", slots)
    base = words(60, 200).split()
    texts = [" ".join([*base, f"x{i}"]) for i in range(120)] + [words(50, 300 + i) for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(table(spark, texts)).collect()}
    assert got == plain_components(texts)


def test_shared_units_link_no_class_with_itself(spark, monkeypatch):
    # A class that is asked for by one center and asks for others itself.
    chain = words(100, 400).split()
    texts = []
    for i in range(30):
        chain = list(chain)
        chain[3 * i] = f"c{i}"
        texts.append(" ".join(chain))
    links = []
    real = ngram_join._search

    def search(units, sets, percent):
        links.append(real(units, sets, percent))
        return links[-1]

    monkeypatch.setattr(ngram_join, "_search", search)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(table(spark, texts)).collect()}
    assert got == plain_components(texts)
    assert all(found.where("a <= b").isEmpty() for found in links)


def test_ngram_join_in_rounds_leaves_no_sets_on_disk(spark, tmp_path, monkeypatch):
    # Rounds and slices of a few rows each; the shared folder ends without shingles, sketches' copies or routes.
    monkeypatch.setattr(ngram_join, "ROUND", 1)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 15)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    texts = []
    for k in range(4):
        chain = words(80, 500 + k).split()
        for i in range(10):
            chain = list(chain)
            chain[(7 * i) % 80] = f"d{k}_{i}"
            texts.append(" ".join(chain))
    rounds = []
    real = ngram_join.cut

    def cut(df):
        rounds.append(df.columns)
        return real(df)

    monkeypatch.setattr(ngram_join, "cut", cut)
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    docs = table(spark, [*texts, *texts[:5]])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    kept = sorted(r["doc_id"] for r in ngram_join.keep_first(docs).collect())
    plain = plain_components([*texts, *texts[:5]])
    assert got == plain and kept == sorted({c for _, c in plain.values()})
    assert rounds.count(["a", "b"]) > 20 and ["cls", "grams"] in rounds
    left = [spark.read.parquet(str(f)).columns for f in tmp_path.iterdir()]
    assert left and not any({"grams", "lo", "unit"} & set(c) or c == ["cls", "n", "sketch"] for c in left)


def test_a_written_stage_uses_small_batches_and_its_files_can_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    keys = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(4000).select(F.repeat(F.lit("x"), 20_000).alias("t")).coalesce(1)
    out = session.cut(rows.mapInArrow(sizes, "n long"))
    assert sum(r["n"] for r in out.collect()) > 80_000_000 and max(r["n"] for r in out.collect()) < 1.5 * session.ARROW_BYTES
    assert [spark.conf.get(k) for k in keys] == before
    session.release(out)
    assert not list(tmp_path.glob("cut-*"))


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(2)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 150, replace=False), rng.integers(1000, 5000, rng.integers(1, 40)).astype(np.uint64)])) for _ in range(60)]
    sets += [np.unique(np.append(s[:-3], s[:1])) for s in sets[:20]]
    index = ngram_join.Index(sets)
    for s in sets:
        plain = [i for i, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))]
        assert sorted(index.search(s).tolist()) == plain


@pytest.mark.parametrize("percent", [80, 85])
def test_packed_histograms_lose_no_link_and_leave_few_pairs(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for n in [1, 3, 40, 400, 500, 520, 700, 1000, 1100, 2000, 2300, 5000, 9000] * 6:
        s = rng.integers(0, 2**64, n, np.uint64)
        # Its kin differ from it by just about what a link allows: shingles left out, changed, or repeated bins.
        sets += [s, s[: -(-n * percent // 100)], np.append(s[: n - n * (100 - percent) // (100 + percent)], rng.integers(0, 2**64, n * (100 - percent) // (100 + percent), np.uint64))]
    sets += [np.arange(0, 2048 * n, 2048).astype(np.uint64) for n in (600, 650, 30)]
    sizes = np.array([len(s) for s in sets])
    packs = [ngram_join.packed(s) for s in sets]
    got = set(zip(*(x.tolist() for x in ngram_join.near_packed(packs, packs, sizes, sizes, percent)), strict=True))
    held = [set(s.tolist()) for s in sets]
    links = {(i, j) for i, a in enumerate(held) for j, b in enumerate(held) if 5 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b)}
    assert links <= got and len(links) > 3 * len(sets) - 100
    # The rest is small sets that a histogram cannot tell apart.
    assert sum(min(len(held[i]), len(held[j])) > 3 for i, j in got - links) < 0.01 * len(sets) ** 2
    assert all(4 * len(p) <= len(ngram_join.sketch(s)) for p, s in zip(packs, sets, strict=True))
