"""Exact top-k search by inner product with a vector-approximation file.

Every vector's components are floor(scale * x). The approximation file holds, for each distinct
vector, one cell of `BITS` bits a component and nothing else: it is packed into pages of about
`PAGE` vectors, each page with the bounds of its own cells (quantiles of the page's components,
closed by their least and greatest value). The search then has two phases:

1. Scan. Pages meet blocks of queries. Cells give a lower and an upper bound of every inner
   product; of each query only candidates are passed on whose upper bound reaches the k-th
   greatest lower bound, first within the unit, then over all units.
2. Read. Exact vectors are joined to the candidates that are left, in order of their bounds:
   the `FIRST * k` candidates of the greatest upper bounds first; their exact scores raise the
   k-th result, and only candidates whose upper bound still reaches it are read after that. No
   other vector can be among the k best, so the result is certain.

Equal vectors share one cell row and one exact read; of their rows those with the k + 1 smallest
ids can be among the k best, found by a limit within each task before any shuffle.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part; every finite component is allowed: where products leave the exact range of floating point,
bounds are widened and exact scores come from Python's integers, and a score beyond a long is
given as the greatest or least long; vectors only meet vectors of their own length, however
long; a row never meets rows of its own id, but equal rows with other ids do; rows without id
take no part; of rows with the same id each counts; with fewer than k candidates all are
returned; ties go to the smaller id; an empty table gives an empty result; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import map_arrow
from sluice.session import cut

K, SCALE = 20, 64.0
#: Bits of a cell.
BITS = 6
#: Vectors of a page, pages of a unit and queries of a unit.
PAGE, PAGES, QUERIES = 8192, 32, 1024
#: Exact vectors read at first for one query, in multiples of k.
FIRST = 3
#: Widening of bounds for rounding, relative to the greatest possible sum of absolute products.
EPSILON = 1e-12
_LONG = (-(2**63), 2**63 - 1)


def packed(x: np.ndarray, scale: float) -> bytes:
    """The integers floor(scale * x) as bytes: two a component where they fit, else as floating-point numbers, which hold them exactly."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale) + 0.0
    if np.abs(v).max() < 1 << 15:
        return v.astype("<i2").tobytes()
    if np.isfinite(v).all():
        return v.astype("<f8").tobytes()
    # Beyond the greatest floating-point number: the components themselves, scaled when they are read.
    return x.astype("<f8").tobytes() + b"s"


def unpacked(data: bytes, dim: int, scale: float) -> np.ndarray:
    """The integers as floating-point numbers; infinite where they exceed those."""
    if len(data) == 2 * dim:
        return np.frombuffer(data, "<i2").astype(np.float64)
    v = np.frombuffer(data[: 8 * dim], "<f8")
    if len(data) == 8 * dim:
        return v
    with np.errstate(over="ignore"):
        return np.floor(v * scale)


def integers(data: bytes, dim: int, scale: float) -> list[int]:
    """The integers themselves."""
    if len(data) == 2 * dim:
        return np.frombuffer(data, "<i2").tolist()
    v = np.frombuffer(data[: 8 * dim], "<f8").tolist()
    if len(data) == 8 * dim:
        return [int(x) for x in v]
    return [int(Fraction(x) * Fraction(scale) // 1) for x in v]


def matrix(data: list[bytes], dim: int, scale: float) -> np.ndarray:
    """The vectors as rows."""
    if all(len(d) == 2 * dim for d in data):
        return np.frombuffer(b"".join(data), "<i2").reshape(-1, dim).astype(np.float64)
    return np.stack([unpacked(d, dim, scale) for d in data])


def participants(vectors: DataFrame, is_query: Column, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, is_query, dim, v): the rows that take part, with packed integers."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, out, dims = [], [], []
        for i, x in enumerate(batch.column(2).to_pylist()):
            if not x or None in x:
                continue
            own = np.array(x, np.float64)
            if np.isfinite(own).all():
                at.append(i)
                out.append(packed(own, scale))
                dims.append(len(x))
        rows = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "is_query", "dim", "v"])

    base = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), vectors[vector].cast("array<double>").alias("x")).where("vec_id is not null")
    return map_arrow(base, run, "vec_id long, is_query boolean, dim int, v binary")


class Page:
    """The cells of some vectors, and what bounds inner products from them."""

    def __init__(self, dim: int, bounds: bytes, cells: bytes, n: int):
        self.edges = np.frombuffer(bounds, "<f8").reshape(2, dim, 1 << BITS)
        bits = np.unpackbits(np.frombuffer(cells, np.uint8), count=n * dim * BITS).reshape(n * dim, BITS)
        code = (bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).reshape(n, dim)
        column = np.arange(dim)
        self.low, self.high = self.edges[0][column, code], self.edges[1][column, code]
        self.most = np.maximum(np.abs(self.edges[0]), np.abs(self.edges[1])).max(1)

    @staticmethod
    def make(vectors: np.ndarray) -> tuple[bytes, bytes]:
        """(bounds, cells) of the vectors: each component's cells lie between quantiles of its values."""
        n, dim = vectors.shape
        size = 1 << BITS
        low, high, code = np.empty((dim, size)), np.empty((dim, size)), np.empty((n, dim), np.uint8)
        for j in range(dim):
            x = np.sort(vectors[:, j])
            starts = np.unique(x[np.arange(size) * n // size])
            c = np.searchsorted(starts, vectors[:, j], "right") - 1
            code[:, j] = c
            last = np.searchsorted(x, np.append(starts[1:], np.inf), "left") - 1
            last[-1] = n - 1
            low[j], high[j] = starts[-1], x[-1]
            low[j, : len(starts)], high[j, : len(starts)] = starts, x[last]
        bits = (code[:, :, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1
        return np.stack([low, high]).astype("<f8").tobytes(), np.packbits(bits.ravel()).tobytes()

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each query's product with each vector."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        with np.errstate(invalid="ignore", over="ignore"):
            low, high = up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T
            slack = EPSILON * (np.abs(queries) @ self.most)[:, None]
            return np.nan_to_num(low - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(high + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def scan(pages: pd.DataFrame, queries: pd.DataFrame, k: int, scale: float) -> pd.DataFrame:
    """(query_id, qid, cid, lower, upper) of the candidates of a unit whose upper bound reaches the query's k-th greatest lower bound.

    Vectors that only rows of the query's own id have are no candidates.
    """
    dim, me = int(queries["dim"].iloc[0]), queries["vec_id"].to_numpy(np.int64)
    asked = matrix(queries["v"].tolist(), dim, scale)
    held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(len(asked))]
    sure = np.full((len(asked), k), -np.inf)
    for bounds, cells, cids, one, single in zip(pages["bounds"], pages["cells"], pages["cids"], pages["one"], pages["single"], strict=True):
        numbers, one, single = np.asarray(cids, np.int64), np.asarray(one, np.int64), np.asarray(single, bool)
        page = Page(dim, bounds, cells, len(numbers))
        for at in range(0, len(asked), 128):
            low, high = page.bounds(asked[at : at + 128])
            own = (me[at : at + 128, None] == one[None, :]) & single
            low[own] = high[own] = -np.inf
            best = low if low.shape[1] <= k else np.partition(low, low.shape[1] - k, 1)[:, -k:]
            for i in range(len(low)):
                known = sure[at + i] = np.sort(np.concatenate([sure[at + i], best[i]]))[-k:]
                some = np.flatnonzero((high[i] >= known[0]) & ~own[i])
                if len(some):
                    held[at + i].append((numbers[some], low[i, some], high[i, some]))
    out = []
    for i, parts in enumerate(held):
        cid, low, high = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        some = high >= sure[i, 0]
        out.append((np.full(int(some.sum()), i), cid[some], low[some], high[some]))
    at, cid, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"query_id": me[at], "qid": queries["qid"].to_numpy(np.int64)[at], "cid": cid, "lower": low, "upper": high})


def _pages(candidates: DataFrame, scale: float) -> DataFrame:
    """(dim, block, bounds, cells, cids, one, single): the approximation file, a row a page; one and single: the vector's least id, and whether it is its only one."""
    blocks = max(1, -(-candidates.count() // PAGE))
    dealt = candidates.select("dim", F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("block"), "cid", "v", F.col("ids")[0]["vec_id"].alias("one"), (F.size("ids") == 1).alias("single"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid")
        bounds, cells = Page.make(matrix(rows["v"].tolist(), int(key[0]), scale))
        whole = {c: [rows[c].to_numpy()] for c in ("one", "single")}
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "bounds": [bounds], "cells": [cells], "cids": [rows["cid"].to_numpy(np.int64)], **whole})

    return dealt.groupBy("dim", "block").applyInPandas(run, "dim int, block long, bounds binary, cells binary, cids array<long>, one array<long>, single array<boolean>")


def _scored(read: DataFrame, scale: float) -> DataFrame:
    """(query_id, qid, score, ids) of candidates joined with the exact vectors of both sides."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims, q, x = batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        score = np.zeros(len(q), np.int64)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            a, b = (matrix([side[i] for i in at], int(dim), scale) for side in (q, x))
            with np.errstate(invalid="ignore", over="ignore"):
                exact = np.abs(a).max(1) * np.abs(b).max(1) * dim < 2.0**52
                score[at] = np.where(exact, np.einsum("ij,ij->i", a, b), 0).astype(np.int64)
            for i in at[~exact]:
                whole = sum(u * v for u, v in zip(integers(q[i], int(dim), scale), integers(x[i], int(dim), scale), strict=True))
                score[i] = min(max(whole, _LONG[0]), _LONG[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), batch.column(5)], names=["query_id", "qid", "score", "ids"])

    return map_arrow(read.select("query_id", "qid", "dim", "q", "v", "ids"), run, "query_id long, qid long, score long, ids array<struct<vec_id:long,n:int>>")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best other rows."""
    base = cut(participants(vectors, is_query, vec_id, vector, scale))
    queries = cut(base.where("is_query").select("vec_id", "dim", "v", F.monotonically_increasing_id().alias("qid")))
    # Rows of one vector and id, up to k; then the k + 1 smallest ids of each vector.
    counted = base.groupBy("dim", "v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    grouped = first.groupBy("dim", "v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    candidates = cut(grouped.withColumn("cid", F.monotonically_increasing_id()))
    pages = _pages(candidates, scale)
    groups = max(1, -(-queries.count() // QUERIES))
    stripes = max(1, -(-candidates.count() // (PAGE * PAGES)))
    left = pages.select("dim", F.pmod("block", F.lit(stripes)).alias("stripe"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "bounds", "cells", "cids", "one", "single")
    right = queries.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("stripe"), F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("group"), "qid", "vec_id", "v")
    empty = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query_id", "int64"), ("qid", "int64"), ("cid", "int64"), ("lower", "float64"), ("upper", "float64"))})

    def unit(file: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return scan(file, asked, k, scale) if len(file) and len(asked) else empty

    near = cut(left.groupBy("dim", "stripe", "group").cogroup(right.groupBy("dim", "stripe", "group")).applyInPandas(unit, "query_id long, qid long, cid long, lower double, upper double"))
    near = _reaching(near, near.select("qid", F.col("lower").alias("at_least")), k)

    # Exact vectors in order of their bounds: the greatest first, then whatever can still reach the k-th result.
    order = Window.partitionBy("qid").orderBy(F.desc("upper"), "cid")
    numbered = cut(near.withColumn("place", F.row_number().over(order)))
    begun = numbered.where(F.col("place") <= FIRST * k)
    scored = cut(_read(begun, queries, candidates, scale))
    rest = _reaching(numbered.where(F.col("place") > FIRST * k), scored.select("qid", F.col("score").cast("double").alias("at_least")), k)
    every = scored.unionByName(_read(rest, queries, candidates, scale))
    rows = every.select("query_id", "score", F.explode("ids").alias("i")).where(F.col("i.vec_id") != F.col("query_id"))
    rows = rows.select("query_id", "score", F.col("i.vec_id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.col("i.n"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reaching(near: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The candidates whose upper bound reaches the k-th greatest known score of their query; all, where fewer are known."""
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("at_least")))).where(F.col("r") <= k)
    limit = ranked.groupBy("qid").agg(F.min("at_least").alias("limit"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("qid", "limit")
    # A sum in floating point may lie below the integer that it stands for, by less than its last places.
    return near.join(limit, "qid", "left").where(F.col("limit").isNull() | (F.col("upper") + F.abs("upper") * EPSILON >= F.col("limit") - F.abs("limit") * EPSILON)).drop("limit")


def _read(near: DataFrame, queries: DataFrame, candidates: DataFrame, scale: float) -> DataFrame:
    """(query_id, qid, score, ids) of candidates by their exact vectors."""
    asked = queries.select("qid", F.col("v").alias("q"))
    read = near.join(candidates.select("cid", "dim", "v", "ids"), "cid").join(asked, "qid")
    return _scored(read, scale)
