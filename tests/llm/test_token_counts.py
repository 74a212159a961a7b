import shutil

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from deltascope.llm import byte_bpe  # noqa: E402
from deltascope.llm import token_counts as t  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "it's we'll 'tis ''s x'", "\n\n x\n", "日本語 текст 12²", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", " <|endoftext| >", "x" * 9000, "ab " * 40_000, None, "same words", "same words", "x\u1c89y \U00010d41"]


def library(path, text):
    return len(tokenizers.Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


def test_words_are_cut_as_the_library_cuts_them():
    """Every character of the first planes that Python's tables know; texts with others are counted whole."""
    points = [x for x in range(0x33000) if not 0xD800 <= x < 0xE000 and not t.unassigned()[x]]
    pre = tokenizers.Tokenizer.from_file(PATH).pre_tokenizer
    for lo in range(0, len(points), 4096):
        text = "".join(f"a{chr(x)}1{chr(x)}! {chr(x)}" for x in points[lo : lo + 4096])
        data = np.frombuffer(text.encode(), np.uint8)
        at, _ = byte_bpe.pretokens(*byte_bpe.code_points(data, np.array([0, len(data)])))
        assert at.tolist() == [a for _, (a, _) in pre.pre_tokenize_str(text)], lo


def test_counts_are_the_librarys(spark, tmp_path):
    docs = spark.createDataFrame([(i if i else None, x, "?", 1) for i, x in enumerate(ODD)], "doc_id long, text string, digest string, n_tokens int").repartition(3)
    rows = t.count_tokens(docs, PATH, f"{tmp_path}/cache").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r.doc_id or 0] or ""
        n = library(PATH, text)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024), text[:30]
    assert t.count_tokens(docs.limit(0), PATH, f"{tmp_path}/cache").count() == 0


def cached(spark, path, version):
    return {bytes(r.digest): r.n_tokens for r in spark.read.parquet(f"{path}/tokenizer={version}").collect()}


def test_only_misses_are_encoded(spark, tmp_path):
    cache, version = f"{tmp_path}/cache", t.TokenizerFile(PATH).version
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "doc_id long, text string")
    t.count_tokens(first, PATH, cache).collect()
    stored = spark.read.parquet(f"{cache}/tokenizer={version}")
    assert stored.count() == 2  # a row a content
    # what is stored is believed, not counted again
    spark.createDataFrame([(r.digest, 77) for r in stored.collect()], "digest binary, n_tokens long").write.mode("append").parquet(f"{cache}/tokenizer={version}")
    more = spark.createDataFrame([(4, "three"), (5, "four five six"), (6, "four five six")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in t.count_tokens(more, PATH, cache).collect()}
    assert got == {4: 77, 5: library(PATH, "four five six"), 6: library(PATH, "four five six")}
    assert len(cached(spark, cache, version)) == 3


def test_another_tokenizer_has_counts_of_its_own(spark, tmp_path):
    texts = ["The  Same\nwords", "the same words", "été <|endoftext|> A", "été <|endoftext|> a", "<|ENDOFTEXT|>", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    changed = f"{tmp_path}/changed.json"
    shutil.copy(PATH, changed)
    with open(changed, "a") as f:
        f.write("\n")
    for path in (PATH, public_tokenizers.path("word_bpe_49k.json"), changed):
        got = {r.doc_id: r.n_tokens for r in t.count_tokens(docs, path, f"{tmp_path}/cache").collect()}
        assert got == {i: library(path, x) for i, x in enumerate(texts)}, path
    words = cached(spark, f"{tmp_path}/cache", t.TokenizerFile(public_tokenizers.path("word_bpe_49k.json")).version)
    assert len(words) == 4  # what the tokenizer reads alike is one content
    assert len({t.TokenizerFile(p).version for p in (PATH, changed)}) == 2


def test_sentencepiece_files(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in t.count_tokens(docs, path, f"{tmp_path}/cache").collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == {i: len(model.encode(x or "")) for i, x in enumerate(ODD)}


def test_query_over_all_documents(spark):
    data = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n_tokens for r in t.query(spark, data).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert got == {i: library(PATH, x) for i, x in texts.items()}
