"""Suffix-array removal of byte strings that repeat anywhere in the table.

Every byte covered by a string of `LENGTH` bytes that also starts anywhere else, in the same
text or another, is marked. Texts are UTF-8 bytes, taken whole; strings never cross texts.

1. Texts are cut into the runs of windows that share a minimizer. Equal windows have equal
   minimizers, so only runs whose minimizer occurs twice can hold repeats; counting minimizers
   needs one narrow shuffle. Runs whose minimizer always stands in the same content are copies
   of each other and are marked whole.
2. The distinct contents of all other repeated minimizers are dealt to shards of bounded size,
   each minimizer to one shard. A shard's suffix and LCP arrays come from induced sorting with
   disk-backed priority queues that carry common-prefix values; windows whose neighbours share
   `LENGTH` bytes are repeats. Queues hold `induced_sort.BUDGET` bytes, far less than a shard's
   tuples, and write the rest to the folder that all executors share.
3. A minimizer with more than `HOT` distinct contents is spread over several shards. Each shard
   then also gives one 64-bit hash for each class of equal windows of such minimizers; windows
   that are alone in their shard are repeats if another shard has their class.

Contents and classes are known by their minimizer and a hash of their bytes, 64 bits each, and are
only ever compared within one minimizer; texts by 64 bits.

Defined results: null and empty texts have no bytes and no spans; texts below LENGTH bytes have
no spans; very long texts are cut into runs like any other, whole; each row counts, so repeated
rows repeat each other; rows without doc_id are kept, and rows that share a doc_id are each
judged by their own text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import chunks, map_arrow
from sluice.llm.induced_sort import Scratch, blocks, repeated_windows
from sluice.llm.substrings import GRAM, runs
from sluice.llm.text_stats import mix, powers
from sluice.session import cut, shared_dir

#: Bytes of a repeated string: fixed by the contract.
LENGTH = 200
#: Bytes of a shard aimed at, and distinct contents of one minimizer in one shard.
SHARD, HOT = 2_000_000, 8192
#: Texts up to so many are picked by broadcasting their numbers (8 bytes each), beyond by a shuffle.
BROADCAST_ROWS = 500_000
_SPANS = "array<struct<a:int,b:int>>"


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(tid, text): equal texts have one tid; null is empty."""
    own = F.coalesce(docs[text], F.lit(""))
    return docs.select(F.xxhash64(own).alias("tid"), own.alias("text"))


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tid, every = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for a, b in chunks(every):
            r = runs([t.encode("utf-8", "surrogatepass") for t in every[a:b]], length, gram)
            columns = (tid[a:b][r.text], r.start.astype(np.int32), r.windows.astype(np.int32), r.key, r.content, r.double)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tid", "start", "windows", "key", "content", "twice"])

    return map_arrow(rows, run, "tid long, start int, windows int, key long, content long, twice boolean")


def _picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tid, text) joined with the wanted rows (one a tid); only texts that are wanted are shuffled while their number is small."""
    if wanted.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(wanted.select("tid")), "tid", "left_semi")
    return rows.join(wanted, "tid")


def _pieces(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """(key, content, piece): the bytes of each content, cut from the text it was first seen in."""
    wanted = cut(contents.groupBy(F.col("at.tid").alias("tid")).agg(F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("at.bytes").alias("bytes"), "key", "content")).alias("cuts")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, names, pieces = [], [], []
        for text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for c in cuts:
                keys.append(c["key"])
                names.append(c["content"])
                pieces.append(raw[c["start"] : c["start"] + c["bytes"]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(pieces, pa.binary())], names=["key", "content", "piece"])

    # Copies of a text give the same pieces.
    return map_arrow(_picked(rows, wanted).select("text", "cuts"), run, "key long, content long, piece binary").groupBy("key", "content").agg(F.first("piece").alias("piece"))


def _spans(offsets: np.ndarray, length: int) -> list[dict[str, int]]:
    """Covered intervals of windows at the given sorted offsets."""
    if not len(offsets):
        return []
    split = np.flatnonzero(np.diff(offsets) > length)
    a = np.append(offsets[0], offsets[split + 1])
    b = np.append(offsets[split], offsets[-1]) + length
    return [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _sorted_shards(pieces: DataFrame, length: int, scratch: str | None) -> DataFrame:
    """Repeats of each shard: (key, content, spans); of spread minimizers also (key, class) a class, and (key, content, class, offset) a window alone in its shard."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        text, left = next(blocks(rows["piece"].tolist()))
        sa, group, more = repeated_windows(text, left, length, Scratch(scratch))
        sizes = rows["piece"].str.len().to_numpy() + 1
        begin = np.cumsum(sizes) - sizes
        which = np.searchsorted(begin, sa, "right") - 1
        key, content, spread, copies = rows["key"].to_numpy(), rows["content"].to_numpy(), rows["spread"].to_numpy(bool), rows["copies"].to_numpy()
        repeat = more | (copies[which] > 1)
        out = []
        hit = np.flatnonzero(repeat)
        hit = hit[np.argsort(sa[hit], kind="stable")]
        edges = np.append(np.flatnonzero(np.diff(which[hit], prepend=-1)), len(hit)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            w = which[hit[a]]
            out.append((key[w], content[w], _spans(sa[hit[a:b]] - begin[w], length), None, None))
        wide = np.flatnonzero(spread[which])
        if len(wide):
            power, inverse = powers(len(text) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], dtype=np.uint64)])
            at = sa[wide].astype(np.int64)
            name = mix((total[at + length] - total[at]) * inverse[at]).view(np.int64)
            own = key[which[wide]]
            first = np.unique(group[wide], return_index=True)[1]
            out += [(k, None, None, h, None) for k, h in zip(own[first].tolist(), name[first].tolist(), strict=True)]
            alone = ~repeat[wide]
            n = int(alone.sum())
            out += list(zip(own[alone].tolist(), content[which[wide]][alone].tolist(), [None] * n, name[alone].tolist(), (at - begin[which[wide]])[alone].tolist(), strict=True))
        whole = {"key": "int64", "content": "Int64", "spans": object, "class": "Int64", "offset": "Int32"}
        return pd.DataFrame({c: [x[i] for x in out] if c == "spans" else pd.array([x[i] for x in out], t) for i, (c, t) in enumerate(whole.items())})

    return pieces.groupBy("shard").applyInPandas(run, f"key long, content long, spans {_SPANS}, class long, offset int")


def _merged(spans: DataFrame) -> DataFrame:
    """(tid, spans) with maximal spans in order, and their number and bytes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for spans in batch.column(1).to_pylist():
            ordered = np.array(sorted((s["a"], s["b"]) for s in spans))
            a, reach = ordered[:, 0], np.maximum.accumulate(ordered[:, 1])
            new = np.append(True, a[1:] > reach[:-1])
            out.append([{"a": x, "b": y} for x, y in zip(a[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist(), strict=True)])
        n = [len(x) for x in out]
        size = [sum(s["b"] - s["a"] for s in x) for x in out]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["tid", "spans", "n_spans", "n_removed"])

    return map_arrow(spans, run, f"tid long, spans {_SPANS}, n_spans long, n_removed long")


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(tid, spans, n_spans, n_removed) of each text with a repeat: byte intervals, end exclusive, maximal and in order."""
    rows = texts(docs, text)
    # Read twice, made once.
    found = cut(_runs(rows, length, gram))
    keys = found.groupBy("key").agg(F.count("key").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("twice").alias("any_twice"))
    keys = keys.where((F.col("n") > 1) | F.col("any_twice")).select("key", ((F.col("lo") != F.col("hi")) | F.col("any_twice")).alias("mixed"))
    # Runs that can hold repeats; where a minimizer has one content, all of them are copies.
    kept = cut(found.drop("twice").join(keys, "key"))
    at = F.struct("tid", "start", (F.col("windows") + length - 1).alias("bytes"))
    contents = cut(kept.where("mixed").groupBy("content", "key").agg(F.count("key").alias("copies"), F.min(at).alias("at")))
    # Few minimizers have more contents than a shard: their number comes to the rows by broadcast, so no task gathers them.
    many = cut(contents.groupBy("key").agg(F.ceil(F.count("key") / hot).alias("salts")).where(F.col("salts") > 1))
    total = contents.agg(F.coalesce(F.sum("at.bytes"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    salted = contents.join(F.broadcast(many) if many.count() <= BROADCAST_ROWS else many, "key", "left")
    dealt = salted.select("key", "content", "copies", (salts > 1).alias("spread"), F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("content"), salts)), F.lit(shards)).alias("shard"))
    marked = cut(_sorted_shards(dealt.join(_pieces(rows, contents), ["key", "content"]), length, shared_dir(docs.sparkSession)))
    shared = marked.where(F.col("class").isNotNull() & F.col("content").isNull()).groupBy("key", "class").count().where(F.col("count") > 1)
    alone = marked.where(F.col("offset").isNotNull()).select("key", "class", "content", "offset").join(shared.select("key", "class"), ["key", "class"], "left_semi")
    by_content = marked.where(F.col("spans").isNotNull()).select("key", "content", F.explode("spans").alias("s")).unionByName(alone.select("key", "content", F.struct(F.col("offset").alias("a"), (F.col("offset") + length).alias("b")).alias("s")))
    by_content = by_content.groupBy("key", "content").agg(F.collect_list("s").alias("s"))
    whole = kept.where(~F.col("mixed")).select("tid", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + length - 1).alias("b")).alias("s")).distinct()
    inside = kept.where("mixed").select("tid", "start", "key", "content").distinct().join(by_content, ["key", "content"]).select("tid", "start", F.explode("s").alias("s"))
    inside = inside.select("tid", F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b")).alias("s"))
    return _merged(whole.unionByName(inside).groupBy("tid").agg(F.collect_list("s").alias("spans")))


def _kept_digest(rows: DataFrame) -> DataFrame:
    """(tid, kept): the SHA-256 of each text's bytes outside its spans."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, done, digest = text.encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
            for s in spans:
                digest.update(raw[done : s["a"]])
                done = s["b"]
            digest.update(raw[done:])
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["tid", "kept"])

    return map_arrow(rows.select("tid", "text", "spans"), run, "tid long, kept string").dropDuplicates(["tid"])


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans."""
    own = F.coalesce(docs[text], F.lit(""))
    spans = cut(repeats(docs, text, **options))
    every = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.octet_length(own).cast("long").alias("n_bytes"), F.sha2(own, 256).alias("sha"), F.xxhash64(own).alias("tid"))
    digests = cut(_kept_digest(_picked(texts(docs, text), spans.select("tid", "spans"))))
    # Written first, so that copies of one text, which share a tid, can be split over tasks when rows are joined.
    found = cut(spans.join(digests, "tid"))
    joined = every.join(found, "tid", "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
