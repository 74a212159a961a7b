import random
import re

import numpy as np
import pytest

from deltascope.llm import decontaminate as d


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(tuple(w[i : i + n]), item) for i in range(len(w) - n + 1) if n]
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for win, item in windows:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= {str(item)} if item is not None else set()
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("bits", [16, 26])
def test_hits_are_those_of_brute_force(spark, bits):
    rng = random.Random(8)
    pool = ["Ab", "b", "C1", "dé", "e", "f"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 7, 9, 10, 11, 20]))) for i in range(2, 25)] + [(1, None), (None, text(12)), (3, text(10))]
    docs = []
    for i in range(60):
        body = text(rng.randint(0, 40))
        if rng.random() < 0.5:
            body += " " + (rng.choice(items)[1] or "") + " " + text(3)
        docs.append((i, body))
    docs += [(100, None), (101, ""), (101, ""), (102, items[3][1] or "x"), (102, items[3][1] or "x")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    rows = d.scan(df, it, bits).collect()
    want = brute(docs, items)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, sum(b - a for a, b in r.spans), list(r.items)) == want[r.doc_id], r.doc_id
    clean = d.drop_contaminated(df, it, bits)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[1]}
    assert d.scan(df.limit(0), it).count() == 0 and all(not r.spans for r in d.scan(df, it.limit(0)).collect())


def test_fingerprints_cover_every_window():
    rng = np.random.default_rng(2)
    word = rng.integers(0, 4, 200).astype(np.uint64)
    first = np.array([0, 3, 3, 120, 200])
    start, place, full = d.picks(word, first, 10)
    assert start.tolist() == [*range(3, 111), *range(120, 191)]
    for s, p in zip(start.tolist(), place.tolist(), strict=True):
        grams = full[s : s + 6].tolist()
        assert p == s + max(j for j in range(6) if grams[j] == min(grams))
    assert len(set(place.tolist())) < len(start)  # neighbours share their fingerprint


def test_rows_without_id_and_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(14))
    long = " ".join(f"w{i % 977}" for i in range(200_000)) + " " + item
    docs = spark.createDataFrame([(None, long, 1, 1), (None, "a b", 1, 1), (7, item, 1, 1)], "doc_id long, text string, size int, row int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, [list(x) for x in r.spans]) for r in d.scan(docs, items).collect())
    assert got == [(0, 2, []), (0, 200_014, [[200_000, 200_014]]), (7, 14, [[0, 14]])]
    assert [r.text for r in d.drop_contaminated(docs, items).collect()] == ["a b"]
