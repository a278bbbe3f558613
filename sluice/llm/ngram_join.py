"""N-gram Jaccard self-join by T-occurrence search, and the components of its links.

A document's set holds the distinct `WORDS`-word shingles of its whole, A-Z lower-cased text as
64-bit hashes. Two documents link when 100 * |A & B| >= PERCENT * |A | B|.

1. Documents with equal sets form one class; only one row a class goes on.
2. Routing, without loss: sizes fall into intervals such that two sets that link lie in one
   interval or in neighbours. For each pair of neighbouring intervals the shingles are dealt by
   hash to more parts than two linked sets can differ in (their symmetric difference is at most
   (100 - P) / (100 + P) of their summed sizes), so two linked sets agree on a whole part. Each
   non-empty part's content is a routing key; sets that share no key cannot link. Common lines
   and passages do not bring documents together, as whole parts must be equal.
3. Candidates are compared by histograms of their shingles' hashes first: two histograms differ
   in no more places than the sets do, so a pair beyond the bound is no link, at a sixteenth of
   the bytes moved. Before that, by packed histograms of half a byte a bin and about eight
   shingles a bin, which make most pairs' histograms of full size needless to move.
   T-occurrence search (DivideSkip) then runs in units of bounded size, each with the sets of
   many candidates and their many queries: one inverted index a unit, asked by every query of
   the unit; the query's longest lists are set aside, the short ones heap-merged, and what
   occurs often enough there is looked up in the long lists by binary search until the
   required overlap is reached or out of reach. Whatever links in a unit is retained.
4. Components. Links are first sought between each class and the first one that it shares a
   key with, then between each key's first and last class and its members of other components.
   Keys whose members are then still in several components are searched again: what is
   outside the largest component against one block of the rest, then whatever is left
   against every block. Pairs within one component need no test, so a group of near copies
   costs searches in proportion to its size, yet no link between components is missed.
5. Disk. Texts are never shuffled; shingles are written only of classes in pairs that the
   histograms let pass, made again from the texts for each search. Units are dealt to rounds,
   one after the other, so that what is shuffled at a time stays in proportion to the sets,
   however many candidates each has; what a step no longer reads is deleted.

All rows of documents are covered; no list, group or key is capped. A key that a task meets more
than `HOT` times has its further rows dealt by class over `SALTS` partitions, whose least and
greatest classes are then combined, so that a key of a third of all rows fills no single task.

Defined results: null and empty texts, and texts without words, have no shingles, link with
nothing and are their own component; texts of fewer than WORDS words have one shingle; very long
texts are sets like any other, as a whole; rows without doc_id have no component; repeated rows
each get their own row; rows of one doc_id with different texts are judged each by its own text;
an empty table gives an empty result; extra columns are ignored by `join` and kept by
`keep_first`, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import chunks, free_name, map_arrow, trim
from sluice.llm.text_stats import mix, split_words
from sluice.session import cut, release

#: Words in a shingle and the least similarity in percent: fixed by the contract.
WORDS, PERCENT = 4, 85
#: Sets in one unit's index.
BLOCK = 256
#: Parts beyond those that two linked sets can differ in; sets with more empty parts route those too.
SPARE = 2
#: Class representatives whose texts are picked at a time, and rows left out at a time, by broadcast (16 bytes each).
BROADCAST_ROWS = 500_000
#: Rows of one key that a task sends to one partition before it deals the rest over SALTS of them; rows are counted in SLOTS by hash, anew after as many rows.
HOT, SALTS, SLOTS = 8, 64, 1 << 22
#: Rows of units that are handed to Python at a time: to compare histograms, and to search sets.
GROUP, SEARCHED = 4000, 500
#: Bytes that one round of units shuffles at least; more where the sets themselves have more.
ROUND = 256 << 20
#: Bins of a set's histogram, and of the finer one of sets with more shingles than LONG.
BINS, FINE, LONG = 256, 2048, 1000
#: Bins of a packed histogram at least and at most, and shingles a bin up to which it has the least.
PACKED, MOST_PACKED, A_BIN = 64, 1024, 8
_STEP = np.uint64(0x100000001B3)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    if not raw:
        return []
    _, _, _, w = split_words(raw)
    hashes = w.hashes
    whole = np.full(max(0, len(hashes) - words + 1), words, np.uint64)
    for k in range(words):
        whole = whole * _STEP + hashes[k : k + len(whole)]
    whole = mix(whole)
    out = []
    for a, b in zip(w.first, w.last, strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            key = np.uint64(b - a)
            for h in hashes[a:b]:
                key = np.uint64((int(key) * int(_STEP) + int(h)) % 2**64)
            out.append(mix(np.array([key], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """One number for equal sets."""
    sums = np.array([int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets], np.uint64)
    return mix(sums + np.array([len(s) for s in sets], np.uint64) * _STEP).view(np.int64)


class Sizes:
    """Intervals of set sizes, and how many shingles two linked sets of neighbouring intervals can differ in."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.ends: list[int] = []

    def interval(self, n: int) -> int:
        """The number of the interval that n lies in."""
        while not self.ends or self.ends[-1] < n:
            low = self.ends[-1] + 1 if self.ends else 1
            self.ends.append(low * 100 // self.percent)
        return int(np.searchsorted(self.ends, n))

    def parts(self, i: int) -> int:
        """Parts for pairs within interval i or of i and i + 1."""
        while len(self.ends) < i + 2:
            self.interval(self.ends[-1] + 1 if self.ends else 1)
        differ = (self.ends[i] + self.ends[i + 1]) * (100 - self.percent) // (100 + self.percent)
        return differ + 1 + (SPARE if differ else 0)


def routing_keys(sets: list[np.ndarray], sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(position of the set, key) for each set's part contents."""
    at, level, parts = [], [], []
    for i, s in enumerate(sets):
        if not len(s):
            continue
        own = sizes.interval(len(s))
        for k in (own - 1, own) if own else (own,):
            at.append(i)
            level.append(k)
            parts.append(sizes.parts(k))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = np.array(parts)
    base = np.concatenate([[0], np.cumsum(m)])
    flat = np.concatenate([sets[i] for i in at])
    copies = np.array([len(sets[i]) for i in at])
    part = np.repeat(base[:-1], copies) + ((flat >> np.uint64(17)) % np.repeat(m, copies).astype(np.uint64)).astype(np.int64)
    value = mix(flat + np.uint64(0x2545F4914F6CDD1D))
    count = np.bincount(part, minlength=base[-1])
    low = np.bincount(part, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(np.uint64)
    high = np.bincount(part, (value >> np.uint64(32)).astype(np.float64), base[-1]).astype(np.uint64)
    owner = np.repeat(np.arange(len(at)), m)
    number = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
    key = mix(mix(low + (high << np.uint64(32))) + number * _STEP + np.array(level, np.uint64)[owner] * np.uint64(0x9E3779B97F4A7C15))
    empty = np.bincount(owner, count == 0, len(at))
    sent = (count > 0) | (empty[owner] > SPARE)
    return np.array(at)[owner[sent]], key[sent].view(np.int64)


class Index:
    """An inverted index over a block of sets, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.tokens, first = np.unique(flat[order], return_index=True)
        self.postings = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.at = np.append(first, len(flat))

    def search(self, query: np.ndarray) -> np.ndarray:
        """Positions of the sets that link with the query."""
        p, n = self.percent, len(query)
        k = np.searchsorted(self.tokens, query)
        k = k[(k < len(self.tokens)) & (self.tokens[np.minimum(k, len(self.tokens) - 1)] == query)]
        # The least overlap with the smallest set that can link.
        least = -(-p * n // 100)
        if len(k) < least:
            return np.zeros(0, np.int64)
        k = k[np.argsort(self.at[k + 1] - self.at[k], kind="stable")]
        longest = int(self.at[k[-1] + 1] - self.at[k[-1]])
        n_long = min(least - 1, int(least / (0.0085 * math.log2(longest + 1) + 1)))
        short, long = k[: len(k) - n_long], k[len(k) - n_long :]
        count: dict[int, int] = {}
        for i in heapq.merge(*[self.postings[self.at[x] : self.at[x + 1]].tolist() for x in short]):
            count[i] = count.get(i, 0) + 1
        ids = np.array([i for i, c in count.items() if c >= least - n_long], np.int64)
        found = np.array([count[i] for i in ids.tolist()], np.int64)
        need = -(-p * (n + self.sizes[ids]) // (100 + p))
        fits = (100 * self.sizes[ids] >= p * n) & (100 * n >= p * self.sizes[ids]) & (found + n_long >= need)
        ids, found, need = ids[fits], found[fits], need[fits]
        for left, x in zip(range(n_long - 1, -1, -1), long.tolist(), strict=True):
            if not len(ids):
                break
            own = self.postings[self.at[x] : self.at[x + 1]]
            place = np.minimum(np.searchsorted(own, ids), len(own) - 1)
            found = found + (own[place] == ids)
            open_ = found + left >= need
            ids, found, need = ids[open_], found[open_], need[open_]
        return ids[found >= need]


def _documents(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc_id, mark, n_shingles, cls, sketch, packed) of every row; mark is a hash of the text, cls is null without shingles."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = batch.column(2).to_pylist()
        for a, b in chunks(every):
            sets = shingle_sets(every[a:b], words)
            n = np.array([len(s) for s in sets], np.int64)
            columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(class_ids(sets), mask=n == 0), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([packed(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_shingles", "cls", "sketch", "packed"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("mark"), docs[text].alias("text"))
    return map_arrow(rows, run, "doc_id long, mark long, n_shingles long, cls long, sketch binary, packed binary")


def _salts(key: np.ndarray, cls: np.ndarray, seen: np.ndarray, hot: int) -> np.ndarray:
    """0 for the first `hot` rows of a key that a task meets, then a number by class; seen counts the rows by slot."""
    if not len(key):
        return np.zeros(0, np.int32)
    slot = (key.view(np.uint64) % np.uint64(len(seen))).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    first = np.append(True, np.diff(slot[order]) != 0)
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(order)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(start, size)
    beyond = place + seen[slot] >= hot
    seen[slot[order[start]]] += size.astype(seen.dtype)
    dealt = 1 + (mix(cls.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32)
    return np.where(beyond, dealt, 0).astype(np.int32)


def _routes(docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(key, salt, cls) of every row, a class at most once a task while it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        slots, counted = np.zeros(SLOTS, np.int32), 0
        sizes = Sizes(percent)
        for batch in batches:
            every = batch.column(0).to_pylist()
            for a, b in chunks(every):
                sets = shingle_sets(every[a:b], words)
                cls = class_ids(sets)
                fresh = []
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh.append(i)
                if len(seen) > 1_000_000:
                    seen.clear()
                at, key = routing_keys([sets[i] for i in fresh], sizes)
                own = cls[np.array(fresh, np.int64)][at]
                if (counted := counted + len(key)) > SLOTS:
                    slots[:], counted = 0, len(key)
                salt = _salts(key, own, slots, HOT)
                # One of a key's salted rows goes without salt as well, so that rows without meet it whoever sends them.
                dealt = np.flatnonzero(salt)
                also = dealt[np.unique(key[dealt], return_index=True)[1]]
                columns = (np.append(key, key[also]), np.append(salt, np.zeros(len(also), np.int32)), np.append(own, own[also]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "salt", "cls"])
        trim()

    return docs.select(docs[text].alias("text")).mapInArrow(run, "key long, salt int, cls long")


def _with(rows: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The rows joined with a side of one row a key: broadcast while its counted size allows, so that a hot key is not gathered in one task."""
    side = cut(side)
    return rows.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, on, how)


def _members(routed: DataFrame) -> DataFrame:
    """(key, cls, lo, hi) of the keys that several classes share, with the key's least and greatest class."""
    by = Window.partitionBy("key", "salt")
    local = routed.select("key", "salt", "cls", F.min("cls").over(by).alias("lo"), F.max("cls").over(by).alias("hi"))
    # Of a key with salts a row without is left out only where no other class is among those, and then the class is among the salted ones.
    part = cut(local.where((F.col("lo") < F.col("hi")) | (F.col("salt") > 0)).distinct())
    hot = part.where(F.col("salt") > 0).select("key").distinct()
    if hot.isEmpty():
        return part
    ends = _with(part, hot, "key", "left_semi").groupBy("key").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    joined = _with(part, ends, "key", "left").select("key", "cls", F.coalesce("least", "lo").alias("lo"), F.coalesce("most", "hi").alias("hi"))
    whole = cut(joined.where(F.col("lo") < F.col("hi")).distinct())
    release(part)
    return whole


def _slices(rows: DataFrame, *by: str) -> Iterator[DataFrame]:
    """The rows in parts that can be broadcast."""
    parts = -(-rows.count() // BROADCAST_ROWS)
    for k in range(parts):
        yield F.broadcast(rows.where(F.pmod(F.xxhash64(*by, F.lit(13)), F.lit(parts)) == k))


def _sketches(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, n, sketch, packed) of the wanted (doc_id, cls), once each."""
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = cut(rows.join(side, ["doc_id", "cls"]).select("cls", F.col("n_shingles").alias("n"), "sketch", "packed"))
    # Repeated rows give the same set again; only then are sketches moved to drop them.
    if found.groupBy("cls").count().where(F.col("count") > 1).isEmpty():
        return found
    once = cut(found.dropDuplicates(["cls"]))
    release(found)
    return once


def _grams(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int) -> list[DataFrame]:
    """(cls, grams) of the wanted (doc_id, cls), once each: cut parts, none of them made by a shuffle of texts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every, cls = batch.column(1).to_pylist(), batch.column(0).to_numpy()
        for a, b in chunks(every):
            sets = shingle_sets(every[a:b], words)
            # Another text may share the id.
            same = np.flatnonzero(class_ids(sets) == cls[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(cls[a:b][same]), pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))], names=["cls", "grams"])

    every = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].alias("_text"))
    parts = []
    for side in _slices(wanted, "cls"):
        rows = every.join(side.select(F.col("doc_id").alias("_id"), F.col("cls").alias("_cls")), "_id").select("_cls", "_text")
        found = cut(map_arrow(rows, run, "cls long, grams array<long>"))
        if not found.groupBy("cls").count().where(F.col("count") > 1).isEmpty():
            once = cut(found.dropDuplicates(["cls"]))
            release(found)
            found = once
        parts.append(found)
    return parts


def sketch(grams: np.ndarray) -> bytes:
    """Shingles in each bin, up to 255, as bytes; long sets have FINE bins, which fold to BINS by their number modulo BINS."""
    bins = FINE if len(grams) > LONG else BINS
    return np.minimum(np.bincount((grams % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def near(asked: list[bytes], block: list[bytes], asked_sizes: np.ndarray, block_sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose sets may link by their sizes and histograms."""

    def folded(sketches: list[bytes]) -> np.ndarray:
        if len(joined := b"".join(sketches)) == BINS * len(sketches):
            return np.frombuffer(joined, np.uint8).reshape(-1, BINS).astype(np.int32)
        return np.stack([np.minimum(np.frombuffer(x, np.uint8).reshape(-1, BINS).sum(0, dtype=np.int32), 255) for x in sketches])

    q, x = folded(asked), folded(block)
    both = asked_sizes[:, None] + block_sizes[None, :]
    ok = (100 * np.minimum(asked_sizes[:, None], block_sizes) >= percent * np.maximum(asked_sizes[:, None], block_sizes)).astype(bool)
    for i in range(len(q)):
        at = np.flatnonzero(ok[i])
        ok[i, at] = (100 + percent) * np.abs(x[at] - q[i]).sum(1) <= (100 - percent) * both[i, at]
    i, j = np.nonzero(ok)
    fine = np.array([len(asked[a]) == FINE and len(block[b]) == FINE for a, b in zip(i, j, strict=True)], bool)
    for k in np.flatnonzero(fine):
        apart = np.abs(np.frombuffer(asked[i[k]], np.uint8).astype(np.int32) - np.frombuffer(block[j[k]], np.uint8)).sum()
        fine[k] = (100 + percent) * apart > (100 - percent) * both[i[k], j[k]]
    return i[~fine], j[~fine]


def packed(grams: np.ndarray) -> bytes:
    """Shingles in each bin, up to 15, two bins a byte; the bins double with the set until at most A_BIN shingles fall to one, up to MOST_PACKED bins."""
    bins = PACKED
    while len(grams) > A_BIN * bins and bins < MOST_PACKED:
        bins *= 2
    count = np.minimum(np.bincount((grams % np.uint64(bins)).astype(np.int64), minlength=bins), 15).astype(np.uint8)
    return (count[::2] | count[1::2] << 4).tobytes()


def near_packed(asked: list[bytes], block: list[bytes], asked_sizes: np.ndarray, block_sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose sets may link by their sizes and packed histograms; of two with unlike numbers of bins the larger is folded."""

    def by_length(packs: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        length = np.array([len(p) for p in packs])
        out = {}
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            pairs = np.frombuffer(b"".join([packs[i] for i in at.tolist()]), np.uint8).reshape(-1, n)
            out[2 * n] = at, np.stack([pairs & 15, pairs >> 4], 2).reshape(-1, 2 * n).astype(np.int16)
        return out

    both = asked_sizes[:, None] + block_sizes[None, :]
    ok = (100 * np.minimum(asked_sizes[:, None], block_sizes) >= percent * np.maximum(asked_sizes[:, None], block_sizes)).astype(bool)
    own, other = by_length(asked), by_length(block)
    for n, (rows, q) in own.items():
        for m, (columns, x) in other.items():
            bins = min(n, m)
            # What is folded is bounded again, as the counts that it meets are.
            q_bins, x_bins = (np.minimum(y.reshape(len(y), -1, bins).sum(1), 15) for y in (q, x))
            for i, mine in zip(rows.tolist(), q_bins, strict=True):
                fits = np.flatnonzero(ok[i, columns])
                at = columns[fits]
                ok[i, at] = (100 + percent) * np.abs(x_bins[fits] - mine).sum(1) <= (100 - percent) * both[i, at]
    return np.nonzero(ok)


class Sets(NamedTuple):
    """The sketches (cls, n, sketch, packed) of all classes that share a key, and how to get the shingles of some."""

    sketches: DataFrame
    grams: Callable[[DataFrame], list[DataFrame]]


def _search(units: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links (a > b) between the queries (role 0) and the index (role 1) of each unit."""

    def by(column: str, test: Callable[..., tuple[np.ndarray, np.ndarray]]) -> Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray]]:
        def compare(asked: pd.DataFrame, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            i, j = test(asked[column].tolist(), block[column].tolist(), asked["n"].to_numpy(np.int64), block["n"].to_numpy(np.int64), percent)
            center, cls = asked["cls"].to_numpy()[i], block["cls"].to_numpy()[j]
            return center[center != cls], cls[center != cls]

        return compare

    def search(asked: pd.DataFrame, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        cls = block["cls"].to_numpy()
        index = Index([np.asarray(x, np.int64).view(np.uint64) for x in block["grams"]], percent)
        found = [(me, cls[index.search(np.asarray(grams, np.int64).view(np.uint64))]) for me, grams in zip(asked["cls"], asked["grams"], strict=True)]
        other, me = np.concatenate([o for _, o in found]), np.repeat([m for m, _ in found], [len(o) for _, o in found])
        other, me = other[other != me], me[other != me]
        return np.maximum(other, me), np.minimum(other, me)

    likely = _by_unit(units, sets.sketches.select("cls", "n", "packed"), F.octet_length("packed") + 32, by("packed", near_packed), "center", "cls", GROUP)
    pairs = _by_unit(_shared_units(likely), sets.sketches.select("cls", "n", "sketch"), F.octet_length("sketch"), by("sketch", near), "center", "cls", GROUP)
    release(likely)
    named = pairs.select(F.explode(F.array("center", "cls")).alias("cls")).distinct()
    parts = sets.grams(named)
    if not parts:
        return pairs.select(F.col("center").alias("a"), F.col("cls").alias("b"))
    links = _by_unit(_shared_units(pairs), reduce(DataFrame.unionByName, parts), 8 * F.size("grams"), search, "a", "b", SEARCHED)
    release(pairs, *parts)
    return links


def _by_unit(units: DataFrame, data: DataFrame, size: Column, fn: Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray]], a: str, b: str, rows: int) -> DataFrame:
    """fn of the queries and the index of each unit, distinct and cut; several units of together about so many rows are handed over at once, and as many in a round as the bytes of their data (size a row) allow."""
    units = cut(units)
    needed = cut(units.groupBy("cls").count())
    few = needed.count() <= BROADCAST_ROWS
    # Only what the units ask for is shuffled.
    data = data.join(F.broadcast(needed.select("cls")) if few else needed.select("cls"), "cls", "left_semi")
    held = data.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("n")).first()
    count = units.count()
    rounds = max(1, -(-count * held["all"] // max(1, held["n"]) // max(ROUND, held["all"])))
    groups = max(1, -(-count // (rows * rounds)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unit", "role"], kind="stable", ignore_index=True)
        unit, role = rows["unit"].to_numpy(), rows["role"].to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(rows))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            split = start + int(np.searchsorted(role[start:stop], 1))
            if start < split < stop:
                out.append(fn(rows.iloc[start:split], rows.iloc[split:stop]))
        return pd.DataFrame({a: np.concatenate([x for x, _ in out]), b: np.concatenate([y for _, y in out])})

    def made(part: DataFrame) -> DataFrame:
        return cut(part.join(data, "cls").groupBy(F.pmod("unit", F.lit(groups))).applyInPandas(run, f"{a} long, {b} long").distinct())

    if rounds == 1:
        found = made(units)
    else:
        parts = [made(units.where(F.pmod(F.xxhash64("unit", F.lit(11)), F.lit(rounds)) == k)) for k in range(rounds)]
        found = cut(reduce(DataFrame.unionByName, parts).distinct())
        release(*parts)
    release(units, needed)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a > b); root is the smallest node of the component.

    Each node hooks its greater neighbours' other ends to its smallest one until every node has
    one smaller neighbour; pointers are then doubled. Only aggregates and joins, cut each time.
    """
    edges = cut(links.select("a", "b").distinct())
    while True:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("n"))
        if least.where(F.col("n") > 1).isEmpty():
            break
        joined = edges.join(least, "a")
        hooked = joined.where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(hooked.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    while True:
        up = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
        doubled = cut(edges.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
        moved = not doubled.where("moved").isEmpty()
        edges = doubled.select("a", "b")
        if not moved:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _unit(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def link_classes(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the classes that link with another class."""
    members = _members(_routes(docs, text, words, percent))
    classes = rows.select("doc_id", "cls").where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    wanted = cut(classes.join(members.select("cls").distinct(), "cls", "left_semi"))
    sketches = _sketches(rows, wanted)

    def grams(classes: DataFrame) -> list[DataFrame]:
        some = cut(wanted.join(classes, "cls", "left_semi"))
        parts = _grams(docs, some, doc_id, text, words)
        release(some)
        return parts

    sets = Sets(sketches, grams)

    def found(units: DataFrame, before: DataFrame | None = None) -> DataFrame:
        more = _search(units, sets, percent)
        return more if before is None else cut(before.unionByName(more).distinct())

    # Each class against the first class that it shares a key with.
    nearest = cut(members.groupBy("cls").agg(F.min("lo").alias("center")).where(F.col("center") < F.col("cls")))
    links = found(_star_units(nearest))
    # The first and last class of each key against members that are still in other components.
    roots = cut(components(links))
    ends = members.select(F.explode(F.array("lo", "hi")).alias("center"), "cls").where(F.col("center") != F.col("cls")).distinct()
    links = found(_star_units(cut(_apart(ends.join(nearest, ["center", "cls"], "left_anti"), roots))), links)
    # What keys of four or more classes have left.
    for every in (False, True):
        left = _unresolved(members, cut(components(links)), every)
        if not left.isEmpty():
            links = found(_more_units(left, every), links)
    release(members, sketches)
    return components(links)


def _rooted(classes: DataFrame, roots: DataFrame, cls: str, root: str) -> DataFrame:
    """The rows with the component's root of the class in one column; a class without links is its own."""
    known = roots.select(F.col("node").alias(cls), F.col("root").alias("_root"))
    return classes.join(known, cls, "left").withColumn(root, F.coalesce("_root", cls)).drop("_root")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of classes of different components."""
    both = _rooted(_rooted(pairs, roots, "center", "r0"), roots, "cls", "r1")
    return both.where(F.col("r0") != F.col("r1")).select("center", "cls")


def _blocks(pairs: DataFrame) -> DataFrame:
    """The pairs with the number of blocks that their center's classes need."""
    many = pairs.groupBy("center").agg(F.ceil(F.count("cls") / BLOCK).alias("blocks")).where(F.col("blocks") > 1)
    if many.isEmpty():
        return pairs.withColumn("blocks", F.lit(1).cast("long"))
    return _with(pairs, many, "center", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))


def _roles(dealt: DataFrame) -> DataFrame:
    """(unit, cls, role) of (unit, center, cls): centers ask, the others are the index."""
    both = F.array(F.struct("cls", F.lit(1).alias("role")), F.struct(F.col("center").alias("cls"), F.lit(0).alias("role")))
    return dealt.select("unit", F.explode(both).alias("r")).select("unit", "r.cls", "r.role").distinct()


def _star_units(pairs: DataFrame) -> DataFrame:
    """Units that ask for each center in blocks of the classes paired with it."""
    return _roles(_blocks(pairs).select(_unit("center", F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("unit"), "center", "cls"))


def _shared_units(pairs: DataFrame) -> DataFrame:
    """Units of many centers with the classes paired with them, about a block of pairs each; a center with more classes than a block has units of its own."""
    units = max(1, -(-pairs.count() // BLOCK))
    own = _unit("center", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    return _roles(_blocks(pairs).select(F.when(F.col("blocks") > 1, own).otherwise(F.pmod(F.xxhash64("center", F.lit(5)), F.lit(units))).alias("unit"), "center", "cls"))


def _unresolved(members: DataFrame, roots: DataFrame, large: bool) -> DataFrame:
    """(grp, cls, root) of the keys with pairs left to test: between the first and last class lie members of several components.

    Keys with the same members count once; large: only those of more than one block, as the others have been searched whole.
    """
    between = members.where((F.col("cls") != F.col("lo")) & (F.col("cls") != F.col("hi"))).select("key", "cls")
    known = _rooted(between, roots, "cls", "root")
    hashed = F.xxhash64("cls").bitwiseXOR(F.lit(0x5DEECE66D))
    groups = known.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("cls").alias("n"), F.bit_xor(hashed).alias("x"), F.sum(F.shiftright(hashed, 24)).alias("s"))
    groups = groups.where((F.col("r0") < F.col("r1")) & (F.col("n") > (BLOCK if large else 1)))
    once = groups.groupBy("n", "x", "s").agg(F.min("key").alias("key"))
    return cut(_with(known, once.select("key"), "key", "left_semi").select(F.col("key").alias("grp"), "cls", "root"))


def _more_units(left: DataFrame, every: bool) -> DataFrame:
    """Units that ask for each class outside its group's largest component: one block of the group, or all of them."""
    count = left.groupBy("grp", "root").agg(F.count("cls").alias("n"))
    main = count.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    placed = _with(left, main, "grp").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    index = placed.select("grp", "block", "cls", F.lit(1).alias("role"))
    asked = placed.where(F.col("root") != F.col("main"))
    where = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1) if every else F.array(F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")))
    queries = asked.select("grp", F.explode(where).alias("block"), "cls", F.lit(0).alias("role"), F.pmod(F.xxhash64("cls", F.lit(9)), F.lit(1 << 20)).alias("part"))
    crowd = queries.groupBy("grp", "block").agg(F.ceil(F.count("cls") / BLOCK).alias("parts"))
    crowd = cut(crowd)
    q = _with(queries, crowd, ["grp", "block"]).select(_unit("grp", "block", F.pmod("part", F.col("parts"))).alias("unit"), "cls", "role")
    i = _with(index, crowd, ["grp", "block"]).select("grp", "block", "cls", "role", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
    return q.unionByName(i.select(_unit("grp", "block", "p").alias("unit"), "cls", "role"))


def _rows(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, mark, n_shingles, root (null without shingles) and component_id, the smallest doc_id that links reach."""
    rows = cut(_documents(docs, doc_id, text, words))
    roots = link_classes(docs, rows, doc_id, text, words, percent)
    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    named = cut(rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("cls", "root", "component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return rows.join(named, "cls", "left").select("doc_id", "mark", "n_shingles", "root", component)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    return _rows(docs, doc_id, text, words, percent).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that with the smallest doc_id and, of several texts of this id, the least text hash.

    A row is known by its doc_id and its text together. Rows without doc_id or words stay; equal
    rows (by doc_id and text) stay once.
    """
    found = cut(_rows(docs, doc_id, text, words, percent).where(F.col("doc_id").isNotNull() & F.col("root").isNotNull()).select("doc_id", "mark", "root").distinct())
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    beyond = _with(found, first, "root").where(F.struct("doc_id", "mark") != F.col("first"))
    d, m = free_name(docs, "_doc"), free_name(docs, "_mark")
    gone = cut(beyond.select(F.col("doc_id").alias(d), F.col("mark").alias(m)))
    kept = docs
    for side in _slices(gone, d, m):
        kept = kept.join(side, (docs[doc_id].cast("long") == F.col(d)) & (F.xxhash64(docs[text]) == F.col(m)), "left_anti")
    twice = docs.where(docs[doc_id].isNotNull()).groupBy(docs[doc_id], F.xxhash64(docs[text])).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if twice.isEmpty():
        return kept
    once = kept.where(kept[doc_id].isNotNull()).dropDuplicates([doc_id, text])
    return once.unionByName(kept.where(kept[doc_id].isNull()))
