import math
import random
import re

import numpy as np
import pytest

from deltascope.llm import toxicity as t

BAD = ["idiotic", "scummy", "trashy"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * rng.randint(1, 8)):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        docs.append((i, " ".join(text), 0.5))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_grades_and_odd_rows(spark):
    docs, labels = corpus(1200, 1)
    d = spark.createDataFrame([*docs, (5000, None, 0.5), (5001, "", 0.5), (5001, "", 0.5)], "doc_id long, text string, severity double")
    known = spark.createDataFrame([*labels[:800], (7000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = t.train(d, known)
    assert (np.diff(model.threshold) > 0).all()
    rows = t.score(d, model).collect()
    got = {r.doc_id: r for r in rows}
    held = labels[800:]
    right = sum(got[i].toxic == bool(y) for i, _, y in held)
    assert right / len(held) > 0.97
    mean = lambda low, high: np.mean([got[i].severity for i, text, _ in docs if low <= sum(text.count(b) for b in BAD) <= high])
    assert mean(0, 0) < mean(1, 2) < mean(3, 5) < mean(6, 8)
    assert len(rows) == 1203 and not got[5000].toxic and got[5000].severity == got[5001].severity


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_without_both_kinds_of_label_nothing_is_toxic(spark, labels):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    model = t.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [r.severity for r in t.score(d, model).collect()] == [0.0, 0.0]
    assert t.score(d.limit(0), model).count() == 0


def test_likelihood_gradient_finds_the_planted_thresholds():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 4000).astype(float)
    p = 1 / (1 + np.exp(-(1.5 * x[:, None] - np.array([2.0, 4.0, 6.0]))))
    grade = (rng.random(4000)[:, None] < p).sum(1)
    w, cuts = t.fit_ordinal(np.arange(4000), np.zeros(4000, int), x, grade, 1)
    assert abs(w[0] - 1.5) < 0.2 and np.abs(cuts - [2, 4, 6]).max() < 0.5


def plain_features(text):
    """Features of a text one word at a time."""
    out = []
    for word in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        raw = word.encode()
        out += [("w", raw), *([("b", raw[:5])] if len(raw) > 5 else [])]
    return out


def test_scores_are_those_of_plain_python(spark):
    texts = ["Idiotic idiotic trashy thing, éé-naïve", None, "", "trashyness", "a b c", "word " * 5000 + "scummy"]
    names = {("w", b"idiotic"): 2.0, ("b", b"trash"): 1.0, ("w", b"scummy"): 3.0, ("w", b"a"): -1.0}

    def hashed(kind, raw):
        data = np.frombuffer(raw, np.uint8)
        h = t.c.span_hashes(t._VALUES[data], np.array([0]), np.array([len(raw)]))
        return int((h ^ np.uint64(0x1234567) if kind == "b" else h).view(np.int64)[0])

    order = sorted(names, key=lambda k: hashed(*k))
    model = t.Model(np.array([hashed(*k) for k in order]), np.array([names[k] for k in order]), np.array([1.0, 1.5, 2.5]))
    df = spark.createDataFrame([(i, x, 9, 0.1) for i, x in enumerate(texts)], "doc_id long, text string, grade int, severity double").repartition(2)
    got = {r.doc_id: r for r in t.score(df, model).collect()}
    for i, text in enumerate(texts):
        found = plain_features(text)
        score = sum(w * math.log1p(found.count(k)) for k, w in names.items())
        chances = [1 / (1 + math.exp(x - score)) for x in (1.0, 1.5, 2.5)]
        assert abs(got[i].severity - sum(chances)) < 1e-9 and got[i].grade == sum(p >= 0.5 for p in chances), text


def test_ties_and_repeated_rows(spark):
    docs, labels = corpus(300, 2)
    d = spark.createDataFrame([(i % 150, x, z) for i, x, z in docs] + [(i, None, 0.1) for i in range(3)], "doc_id long, text string, severity double")
    known = spark.createDataFrame([*labels, *labels, (0, 0, 1 - labels[0][2])], "doc_id long, quality int, toxic int")
    first, again = (t.score(d, t.train(d.repartition(n), known.repartition(n))).collect() for n in (2, 5))
    key = lambda r: (r.doc_id, round(r.severity, 5))
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == 303
