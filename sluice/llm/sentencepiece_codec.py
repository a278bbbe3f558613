"""SentencePiece models run by the tokenizers library.

The model's protobuf is read here field by field; its normaliser, whitespace marker, scores
and byte fallback are rebuilt as a tokenizers pipeline (unigram scores as a Unigram model, BPE
scores as ranked merges). Batches are encoded by several threads. Parity with the
sentencepiece library is verified when the codec is built, on texts that exercise every
rebuilt part, and on sampled rows while encoding: any difference raises.

A text without runs of spaces is encoded by its words where the model lets no piece span two of
them (checked on its vocabulary): each distinct word goes to the batch encoder once. All other
texts go to it whole.

Defined results: a null text encodes as the empty text, to no pieces; a text decodes to its
normalised self, which for a model with an identity normaliser is the text itself; very long texts
are encoded whole; a null doc_id is kept and repeated rows each get their own row; an empty table
gives an empty result; all columns are kept, and where the names of the new ones are taken, they
get underscores in front.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import chunks, free_name, map_arrow, slices

#: Threads that encode one batch.
THREADS = 2
#: One row in so many, by a hash of its text, is encoded by the sentencepiece library too.
PARITY_EVERY = 64
#: Distinct words whose pieces a process remembers; beyond them it starts anew.
CACHED_WORDS = 300_000
#: Words, and characters of whole texts, that are encoded at once: until it is read, a word's result takes about a kilobyte.
WORDS_AT_ONCE, CHARS_AT_ONCE = 4096, 250_000
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts for the parity test at build time.
PROBES = ("", " ", "  two  spaces ", "a\tb\nc\r\n", "naïve café ▁mark", "日本語と한국어 🙂👍🏽", "<s></s><unk><0x41>", "x" * 50, "1234567890 3.14", "\u0000﻿ ", "é ﬁ Ⅷ")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message in wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What of a SentencePiece model decides encoding and decoding."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    space_as_suffix: bool = False


def parse_model(data: bytes) -> Model:
    """Read the protobuf of a SentencePiece model."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.space_as_suffix = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_spaces = bool(v)
                elif n == 5:
                    model.escape_spaces = bool(v)
    return model


def ranked_merges(model: Model) -> list[tuple[str, str]]:
    """BPE merges in the order of the scores of the pieces that they make."""
    rank = {p: (-score, i) for i, (p, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    merges = [(rank[p], k, p[:k], p[k:]) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [(a, b) for _, _, a, b in sorted(merges)]


def build_tokenizer(model: Model):
    """The same codec as a tokenizers pipeline."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind not in (UNIGRAM, BPE) or model.space_as_suffix or not model.escape_spaces or any(k == USER for _, _, k in model.pieces):
        raise ValueError("only unigram and BPE models with escaped leading spaces and no user-defined pieces are rebuilt")
    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, ranked_merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    identity = not model.charsmap and model.dummy_prefix and not model.remove_extra_spaces
    if identity and all(MARK not in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL):
        # No piece has the marker after another character, so no piece spans such a place: words can be encoded, and cached, apart.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


class Codec:
    """Encodes and decodes batches; verified against the sentencepiece library.

    Pieces never span the place before a whitespace marker (checked on the vocabulary), so the
    distinct words are encoded and decoded once each, remembered, and put together by number.
    Texts with runs of spaces, and models without that property, go through whole.
    """

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = build_tokenizer(parse_model(data))
        self.by_word = self.tokenizer.pre_tokenizer is not None
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        # Words arrive normalised and split, so their encoder needs the model alone.
        self.words = Tokenizer(self.tokenizer.model)
        self._forget()
        self.verify(list(PROBES), *self.encode(list(PROBES)))

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.back: list[str] = []

    def _learn(self) -> None:
        """Encode and decode the words that were numbered since the last call."""
        fresh = list(itertools.islice(self.number, len(self.back), None))
        if not fresh:
            return
        flat, sizes = [self.flat], []
        for i in range(0, len(fresh), WORDS_AT_ONCE):
            words = fresh[i : i + WORDS_AT_ONCE]
            coded = [e.ids for e in self.words.encode_batch_fast([MARK + w for w in words], add_special_tokens=False)]
            self.back += [w if w == back else back for w, back in zip(words, self.decode(coded), strict=True)]  # one string, not two equal ones
            sizes += [len(x) for x in coded]
            flat.append(np.fromiter(itertools.chain.from_iterable(coded), np.int32))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate(flat)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Piece ids of each text, and the text that they decode to."""
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        decoded = [""] * len(texts)
        split: list[tuple[int, np.ndarray]] = []
        whole: list[int] = []
        if len(self.number) > CACHED_WORDS:
            self._forget()
        number = self.number
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.by_word and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
                split.append((i, np.array([number.setdefault(w, len(number)) for w in text.split(" ")])))
            else:
                whole.append(i)
        self._learn()
        flat, at, back = self.flat, self.at, self.back
        for i, n in split:
            size = at[n + 1] - at[n]
            ends = np.cumsum(size)
            ids[i] = flat[np.repeat(at[n] - ends + size, size) + np.arange(ends[-1])]
            decoded[i] = " ".join([back[k] for k in n.tolist()])
        for a, b in chunks([texts[i] for i in whole], CHARS_AT_ONCE):
            for i, x in zip(whole[a:b], self._batch([texts[i] for i in whole[a:b]]), strict=True):
                ids[i] = np.array(x, np.int32)
                decoded[i] = self.decode([x])[0]
        return ids, decoded

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def verify(self, texts: list[str], ids: list[np.ndarray], decoded: list[str]) -> None:
        """Raise where the sentencepiece library gives other pieces, or decodes them to another text."""
        for text, own, back in zip(texts, ids, decoded, strict=True):
            if own.tolist() != self.reference.encode(text):
                raise ValueError(f"encoding differs from the sentencepiece library on a text of {len(text)} characters: {text[:80]!r}")
            if back != self.reference.decode(own.tolist()):
                raise ValueError(f"decoding differs from the sentencepiece library on a text of {len(text)} characters: {text[:80]!r}")


_codecs: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    """The codec of a model, built once a process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def new_names(docs: DataFrame, ids: str = "piece_ids", decoded: str = "decoded") -> tuple[str, str]:
    """The names that encode gives to its two columns."""
    return free_name(docs, ids), free_name(docs, decoded)


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """The rows with two more columns, named as by new_names: the pieces of each text, and the text they decode to."""
    at = docs.columns.index(text)
    names = [*docs.columns, *new_names(docs, ids, decoded)]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[-2], T.ArrayType(T.IntegerType(), False)), T.StructField(names[-1], T.StringType())])

    def coded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in slices(batch, at):
            texts = [t or "" for t in part.column(at).to_pylist()]
            pieces, back = own.encode(texts)
            probe = [i for i, t in enumerate(texts) if zlib.crc32(t.encode("utf-8", "surrogatepass")) % PARITY_EVERY == 0]
            own.verify([texts[i] for i in probe], [pieces[i] for i in probe], [back[i] for i in probe])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pieces])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pieces), pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(back, pa.string())], names=names)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # Millions of small objects and no cycles; the worker's setting returns with the batch.
        was = gc.isenabled()
        gc.disable()
        try:
            yield from coded(batch)
        finally:
            if was:
                gc.enable()

    return map_arrow(docs, run, schema)


def digest(encoded: DataFrame, ids: str = "piece_ids", text: str = "text", decoded: str = "decoded") -> DataFrame:
    """Per row: doc_id, the number of pieces, the SHA-256 of the comma-joined ids, and whether decoding gives the text back."""
    return encoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size(ids).cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col(decoded) == F.coalesce(F.col(text), F.lit(""))).alias("round_trip"),
    )
