import hashlib
import random

import numpy as np
import pytest

from deltascope.llm import suffix_dedup as d


def brute(docs):
    """(removed, spans, kept) of each row, with a plain dictionary of all strings."""
    least = {}
    raw = [(d.c.LAST if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - d.LENGTH + 1):
            s = b[p : p + d.LENGTH]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - d.LENGTH + 1):
            if least[b[p : p + d.LENGTH]] < i:
                gone[p : p + d.LENGTH] = b"\1" * d.LENGTH
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def random_docs(seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "a", "abcdé", "abcdefghijklmnop \n"])
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 160))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 5)))) for i in range(rng.randint(1, 60))]
    docs += [(900 + i, docs[i % len(docs)][1]) for i in range(5)] + [(990, None), (3, "a" * 200), (991, "b" * 49), (992, "b" * 300), (None, docs[0][1] + "end"), (None, "b" * 90), (None, None)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(6))
def test_rows_are_those_of_brute_force(spark, seed):
    docs = random_docs(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, block int").repartition(3)
    got = d.dedupe(df, ("n_bytes", "n_removed", "n_spans", "kept_sha256")).collect()
    assert sorted((d.c.LAST if r[0] is None else r[0], *r[1:]) for r in got) == brute(docs)


def test_suffix_array_is_sorted_and_classes_are_whole():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 3, 20):
        windows = rng.integers(1, 60, 40)
        size = windows + d.LENGTH - 1
        begin = np.r_[0, np.cumsum(size)[:-1]]
        text = rng.integers(97, 97 + kinds, size.sum()).astype(np.uint8)
        for i in range(0, 40, 3):  # copies
            j = (i + 7) % 40
            n = min(size[i], size[j])
            text[begin[j] : begin[j] + n] = text[begin[i] : begin[i] + n]
        order = d.suffix_array(text, begin, windows)
        strings = [text[p : p + d.LENGTH].tobytes() for p in order]
        assert len(order) == windows.sum() and len(set(order.tolist())) == len(order)
        assert strings == sorted(strings)
        assert d.same_as_before(text, order).sum() == len(strings) - len(set(strings))


def test_a_very_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    df = spark.createDataFrame([(1, long, "x", "y"), (2, "new " + long[1000:], "x", "y")], "doc_id long, text string, spans string, kept string")
    got = {r.doc_id: r for r in d.dedupe(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 399_000 and bytes(got[2].kept) == b"new "


def test_empty_table(spark):
    assert d.dedupe(spark.createDataFrame([], "doc_id long, text string")).count() == 0
