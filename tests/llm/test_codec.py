import os

import pyarrow as pa
import pytest

from sluice.llm import secret_scan
from sluice.llm import sentencepiece_codec as codec
from sluice.llm.common import CHUNK, slices

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = [None, "", " ", "a", "  lead", "trail  ", "two  spaces", "tab\tand\nline", "日本語 🙂", "mark ▁ here", "<s> </s> <0x41>", "word " * 3000, "x" * 20000]

pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


def test_parity_and_round_trip():
    sentencepiece = pytest.importorskip("sentencepiece")
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = codec.codec(codec.read_model(PATH))
    texts = [t or "" for t in TEXTS]
    ids, decoded = own.encode(texts)
    assert [i.tolist() for i in ids] == reference.encode(texts)
    assert decoded == [reference.decode(i.tolist()) for i in ids]


def test_operator(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a", 1)], "doc_id long, text string, n_pieces int")
    out = codec.encode(docs, codec.read_model(PATH))
    assert out.columns == ["doc_id", "text", "n_pieces", "piece_ids", "decoded"]
    rows = codec.digest(out).collect()
    assert len(rows) == len(TEXTS) + 1
    assert [r["doc_id"] for r in rows if not r["round_trip"]] == [9]
    assert codec.encode(docs.limit(0), codec.read_model(PATH)).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, decoded string, Piece_Ids int")
    coded = codec.encode(clash, codec.read_model(PATH))
    assert coded.columns == [*clash.columns, *codec.new_names(clash)] == [*clash.columns, "_piece_ids", "_decoded"]
    assert [(r["decoded"], r["Piece_Ids"], r["_decoded"]) for r in coded.collect()] == [("x", 2, "a b")]


def test_unigram_model_is_rebuilt(tmp_path):
    pieces = [("<unk>", 0.0, codec.UNKNOWN), ("▁", -3.0, codec.NORMAL), ("a", -4.0, codec.NORMAL), ("b", -4.0, codec.NORMAL), ("▁ab", -2.0, codec.NORMAL)] + [(f"<0x{i:02X}>", -9.0, codec.BYTE) for i in range(256)]
    model = codec.Model(pieces, codec.UNIGRAM, byte_fallback=True, remove_extra_spaces=False)
    tokenizer = codec.build_tokenizer(model)
    ids = tokenizer.encode("ab ba", add_special_tokens=False).ids
    assert [pieces[i][0] for i in ids] == ["▁ab", "▁", "b", "a"]
    assert tokenizer.decode(ids) == "ab ba"


class Recorded:
    """A tokenizer that notes how many texts and characters it is given at once."""

    def __init__(self, own):
        self.own, self.seen = own, []

    def encode_batch_fast(self, texts, **how):
        self.seen.append((len(texts), sum(map(len, texts))))
        return self.own.encode_batch_fast(texts, **how)

    def __getattr__(self, name):
        return getattr(self.own, name)


def test_few_words_and_whole_texts_are_encoded_at_once():
    own = codec.Codec(codec.read_model(PATH))
    own._forget()
    own.words, own.tokenizer = Recorded(own.words), Recorded(own.tokenizer)
    texts = [" ".join(f"w{k}x" for k in range(i, i + 6000)) for i in range(0, 24000, 6000)] + [f"two  spaces {i} " * 8000 for i in range(9)] + ["", "a b"]
    ids, decoded = own.encode(texts)
    assert len(own.number) == 24002 and max(n for n, _ in own.words.seen) <= codec.WORDS_AT_ONCE
    assert sum(n for n, _ in own.tokenizer.seen) == 9 and max(n for _, n in own.tokenizer.seen) <= codec.CHARS_AT_ONCE
    own.verify(texts, ids, decoded)
    assert decoded == texts


class Captured:
    """Stands for a table; keeps the function that its rows would go through."""

    def __init__(self, docs):
        self.columns, self.schema = docs.columns, docs.schema

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_batches_go_through_in_slices(spark):
    texts = [None, "", "é" * CHUNK, *(f"{i} word " * 20_000 for i in range(20)), 'token = "0123456789abcdef0123"', None]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    parts = list(slices(batch, 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= CHUNK for p in parts)
    assert not list(slices(batch.slice(0, 0), 1)) and [p.num_rows for p in slices(batch.slice(0, 2), 1)] == [2]
    table = Captured(spark.createDataFrame([], "doc_id long, text string"))
    out = list(secret_scan.redact(table, secret_scan.train([]))(iter([batch])))
    assert len(out) == len(parts) and [t for p in out for t in p["text"].to_pylist()] == [*texts[:-2], '<assign>"', None]
    out = list(codec.encode(table, codec.read_model(PATH))(iter([batch])))
    assert len(out) == len(parts) and [t for p in out for t in p["decoded"].to_pylist()] == [t or "" for t in texts]
    assert [i for p in out for i in p["doc_id"].to_pylist()] == list(range(len(texts)))
