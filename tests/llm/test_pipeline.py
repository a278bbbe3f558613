"""The pipeline against a plain version of its stages."""

import os

import pytest

import corpus_pipeline
from sluice.llm import secret_scan
from tests.llm.test_operators import plain_components, plain_mix, words

pytestmark = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="no tokenizer files")


def test_pipeline(spark, tmp_path):
    texts = [words(60 + i % 30, i) for i in range(60)] + [words(60, 0), words(60, 1) + " end", "short", None, "", " ".join(f"{w}***" for w in words(50, 3).split())]
    texts[5] += ' token = "0123456789abcdef0123456789abcdef" x'
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        held = docs.collect()
        if name == "quality rules":
            assert {r["doc_id"] for r in held} == set(range(62))
        if name == "n-gram Jaccard join":
            comps = plain_components(texts[:62], 80, 5)
            assert {r["doc_id"] for r in held} == {c for _, c in comps.values()} == set(range(60))
        if name == "secret scans":
            changed = {r["doc_id"] for r in held if r["text"] != texts[r["doc_id"]]}
            assert changed == {5} and all(r["n_chars"] == len(r["text"]) for r in held)
            model = secret_scan.train([])
            assert not any(secret_scan.all_spans(r["text"], secret_scan.base_spans(r["text"]), model) for r in held)
        if name == "mixing sources":
            assert {(r["doc_id"], r["text"]) for r in held} <= before
            _, copies = plain_mix(kept)
            assert sorted(r["doc_id"] for r in held) == sorted(i for (i, _, _), n in zip(kept, copies, strict=True) for _ in range(n))
        before = {(r["doc_id"], r["text"]) for r in held}
        kept = [(r["doc_id"], r["source"], r["text"]) for r in held]
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    text = dict(before)
    assert all(list(r["piece_ids"]) == reference.encode(text[r["doc_id"]]) and r["n_pieces"] == len(r["piece_ids"]) for r in out)


def test_pipeline_of_odd_rows(spark, tmp_path):
    long = words(40, 1)
    rows = [(None, long, "en", "a", 1, 7), (1, long, "en", "a", None, 7), (1, long, "en", "a", None, 7), (1, words(45, 2), "en", None, 3, 7), (2, None, None, "a", 0, 7), (3, "", "", "", 0, 7), (4, words(5000, 9), "de", "b", 1, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, decoded int").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {None, 1, 4} and out
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "decoded"]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
