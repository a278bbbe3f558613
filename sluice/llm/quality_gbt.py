"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training bins every statistic at quantiles of the training rows and grows depth-limited trees
on gradient histograms (logistic loss, Newton leaf values). The trained trees are flattened
into arrays of feature, threshold, children and value, and scored for a whole batch of
documents at once, one array step per tree level.

The trees learn from a bounded sample of labelled rows (`TRAIN_ROWS`, a documented parameter):
the labelled documents with the smallest hash shares. Everything else covers all rows.

Defined results: null and empty texts are scored from their (zero) statistics, very long ones from
those of the whole text; rows without doc_id are scored and count as held out; a document with
several different labels trains on the smallest one, and a doc_id with several rows trains once, on
the row of the least statistics; with no or one class of labels the score is the smoothed share of
label 1; ties in a split go to the first statistic and the lowest threshold; repeated rows each get
their own row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import chunks, map_arrow
from sluice.llm.text_stats import stats

#: Labelled rows that the trees learn from, at most about so many.
TRAIN_ROWS = 20_000
#: A document is predicted good from this score on: fixed by the contract.
CUT = 0.3
FOLDS = 5

_CLASSES = np.stack(
    [np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"!", b".", b",", b"\n", b"\"'()[]{}:;=@/_-", bytes(range(128, 256)))], 1
).astype(np.float64)
FEATURES = (
    "log_bytes log_words mean_word upper lower digits hash star dollar percent amp bar angle bang dot comma newline punct high symbols dup_lines repeats distinct common stutter"
).split()


def features(texts: list[str | None]) -> np.ndarray:
    """A row of statistics for each text; nothing but the text enters."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    s = stats(raw)
    count = np.stack([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in raw]) @ _CLASSES
    words, lines = np.maximum(s.n_words, 1), np.maximum(s.n_lines, 1)
    per_word = np.empty((len(raw), 3))
    for i in range(len(raw)):
        own = s.words.hashes[s.words.first[i] : s.words.last[i]]
        each = np.unique(own, return_counts=True)[1]
        per_word[i] = len(each), each.max(initial=0), np.count_nonzero(own[1:] == own[:-1])
    columns = [np.log1p(s.n_bytes), np.log1p(s.n_words), s.word_chars / words, *(count / words[:, None]).T, s.n_symbols / words, s.n_dup_lines / lines, s.n_repeat_words / words, *(per_word / words[:, None]).T]
    return np.stack(columns, 1)


@dataclass
class Trees:
    """All trees, end to end; a leaf is its own child. Going left means feature <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, penalty: float = 1.0) -> Trees:
    """Boost trees on histograms of gradients; deterministic."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    empty = np.zeros(0, np.int64)
    if n == 0 or y.min() == y.max():
        return Trees(empty, np.zeros(0), empty, empty, np.zeros(0), empty, 0, base)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def add(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(value))
        right.append(len(value))
        value.append(v)
        return len(value) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        root = add(-rate * g.sum() / (h.sum() + penalty))
        roots.append(root)
        level = [(root, np.arange(n))]
        for _ in range(depth):
            following = []
            for node, rows in level:
                best = (1e-6, 0, 0)
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(d):
                    c = code[rows, j]
                    gl = np.cumsum(np.bincount(c, g[rows], bins))[:-1]
                    hl = np.cumsum(np.bincount(c, h[rows], bins))[:-1]
                    hr = hs - hl
                    gain = np.where((hl >= least / 10) & (hr >= least / 10), gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hr + penalty) - gs**2 / (hs + penalty), 0)
                    gain[len(edges[j]) :] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                gain, j, k = best
                if gain <= 1e-6 or not len(edges[j]):
                    continue
                goes = code[rows, j] <= k
                feature[node], threshold[node] = j, edges[j][k]
                for side, part in ((left, rows[goes]), (right, rows[~goes])):
                    side[node] = add(-rate * g[part].sum() / (h[part].sum() + penalty))
                    following.append((side[node], part))
            level = following
        f, t, lo, hi, v = map(np.array, (feature, threshold, left, right, value))
        margin += Trees(f, t, lo, hi, v, np.array([root]), depth, 0.0).value[_walk(f, t, lo, hi, root, depth, x)]
    f, t, lo, hi, v = map(np.array, (feature, threshold, left, right, value))
    return Trees(f, t, lo, hi, v, np.array(roots), depth, base)


def _walk(feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, root: int, depth: int, x: np.ndarray) -> np.ndarray:
    node, rows = np.full(len(x), root), np.arange(len(x))
    for _ in range(depth):
        node = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
    return node


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0, and rows without doc_id, are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample of labelled documents."""
    usable = labels.where(~held_out(F.col(doc_id)) & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    n = usable.count()
    if not n:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    space = 1 << 30
    few = usable.where(F.pmod(F.xxhash64("_id"), F.lit(space)) < int(space * min(1.0, rows / n)))
    # About `rows` rows of 12 bytes, whatever the size of the labels.
    texts = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].alias("_text")).join(F.broadcast(few), "_id").select("_id", "_text", "_y")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = batch.column(1).to_pylist()
        for a, b in chunks(every):
            x = features(every[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "_y", "x"])

    once = map_arrow(texts, run, "_id long, _y int, x array<double>").groupBy("_id", "_y").agg(F.min("x").alias("x"))
    found = sorted(map(tuple, once.collect()))
    return np.array([r[2] for r in found]).reshape(len(found), len(FEATURES)), np.array([r[1] for r in found], np.float64)


def score(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (probability of label 1) and predicted."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = batch.column(1).to_pylist()
        for a, b in chunks(every):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(trees.score(features(every[a:b])))], names=["doc_id", "score"])

    scored = map_arrow(docs.select(docs[doc_id].cast("long").alias("doc_id"), text), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled sample, then score every row."""
    x, y = training_rows(docs, labels)
    return score(docs, train(x, y))
