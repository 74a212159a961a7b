import hashlib

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

import numpy as np  # noqa: E402

from deltascope.llm import byte_bpe as b  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = b.load_ranks(PATH)
VOCABULARY = b.Vocabulary(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  a", "a  b", "it's we'll 'tis ''s x'", " 's", "don'tx you'rex I'Ve", "\n\n x\n", "é½Ⅷ 12²a", "a\x1cb \x85c", "ａ　b", "'", "'ll", "l'r", "x" * 300, "ab " * 400, "日本語 текст", "<|endoftext|>", "\t\t", "a  b", "é'd"]


def cut(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    points, edges = b.code_points(data, offsets)
    at, first = b.pretokens(points, edges)
    ends = np.r_[at[1:], len(points)]
    whole = "".join(texts)
    out = []
    for i in range(len(texts)):
        out.append([whole[at[j] : ends[j]] for j in range(first[i], first[i + 1])])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'strevlmd 1.\n\té ½"), max_size=14), max_size=5))
def test_pretokens_are_the_patterns_matches(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert cut(texts) == [pattern.findall(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_ids_are_the_librarys(text):
    encode = b.word_encoder(VOCABULARY)
    ids = [i for w in cut([text])[0] for i in encode(w)]
    assert ids == LIBRARY.encode_ordinary(text)


def test_query_on_odd_rows(spark):
    texts = [*ODD, None, ODD[4], ODD[4]]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, block int").repartition(3)
    got = {r.doc_id: r for r in b.encode(docs, PATH, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids), t
        assert bytes(got[i].decoded) == (t or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert b.encode(docs.limit(0), PATH).count() == 0


def test_blocks_with_equal_ids_stay_apart(spark, tmp_path):
    rows = {"a": [(1, "hello world of words"), (2, "foo of corge"), (None, "x"), (None, "y z")], "b": [(1, "more of foo"), (2, "hello words"), (None, "x"), (None, "q")]}
    for name, own in rows.items():
        spark.createDataFrame(own, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    docs = spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b").unionByName(spark.read.parquet(f"{tmp_path}/a"))
    got = sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in b.encode(docs, PATH).collect())
    assert got == sorted((i or 0, t) for name in "aba" for i, t in rows[name])


def test_two_vocabularies_in_one_session(spark, tmp_path):
    import base64

    path = tmp_path / "bytes.tiktoken"  # every byte its own token
    path.write_bytes(b"\n".join(base64.b64encode(bytes([x])) + b" %d" % x for x in range(256)))
    docs = spark.createDataFrame([(1, "hello été"), (2, "a" * 70000)], "doc_id long, text string")
    for _ in range(2):
        for vocabulary in (str(path), PATH):
            rows = b.encode(docs, vocabulary).collect()
            assert {bytes(r.decoded).decode() for r in rows} == {"hello été", "a" * 70000}
            assert ({r.n_tokens for r in rows} == {11, 70000}) == (vocabulary != PATH)


def test_blocks_and_tables_of_empty_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()) for i, _ in rows]
    assert sorted(tuple(r) for r in b.digests(docs.coalesce(1)).collect()) == want
    docs.coalesce(1).write.parquet(f"{tmp_path}/empty")
    spark.createDataFrame([(4, "some words")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/some")
    got = {r.doc_id: r for r in b.encode(spark.read.parquet(f"{tmp_path}/empty", f"{tmp_path}/some"), PATH).collect()}
    assert [bytes(got[i].decoded) for i in (1, 2, 3, 4)] == [b"", b"", b"", b"some words"] and not got[1].ids and not got[2].n_tokens


def test_a_very_long_text(spark):
    text = "long words of a text, été 日本 " * 150_000 + "x" * 300_000
    [row] = b.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    assert bytes(row.decoded).decode() == text and row.n_tokens == len(row.ids)
