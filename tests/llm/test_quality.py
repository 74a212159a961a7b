import math
import random
import re

import numpy as np

from deltascope.llm import quality_classifier as qc
from deltascope.llm import quality_rules as q

GOOD = "The small house stood near a quiet lake, and the people of that town knew its story well. Nobody had lived there for many years."


def test_rules_on_odd_rows(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "one\ntwo\none\n\none", "x# y* $z %", GOOD, GOOD, "é ü\xa0ß"]
    df = spark.createDataFrame([(i, t, "h" if i % 2 else None, 9, i) for i, t in enumerate(texts)], "doc_id long, text string, source string, kept int, n_words int")
    got = {r.doc_id: r for r in q.judge(df).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_words for i in range(3)] == [0, 0, 0] and all(got[i].base_failed and not got[i].kept for i in range(3))
    assert got[3].n_repeat_words == 10 and got[4].n_dup_lines == 2 and got[5].n_symbols == 4
    assert not got[6].base_failed and got[6].kept and got[8].n_words == 2 and got[8].word_chars == 4
    assert q.judge(df.limit(0)).count() == 0


def test_a_bad_host_goes_with_its_good_documents(spark):
    rows = [(i, "junk" if i % 10 else GOOD, "bad", 1) for i in range(300)] + [(1000 + i, GOOD if i % 10 else "junk", f"good{i % 30}", 1) for i in range(900)] + [(5000, GOOD, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host_rejected int")
    kept = {r.doc_id for r in q.judge(df).where("kept").collect()}
    assert kept == {1000 + i for i in range(900) if i % 10} | {5000}
    stay = q.keep_good(df)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect()} == kept


def test_estimated_accuracies_are_near_the_true_ones():
    rng = np.random.default_rng(2)
    n, voters = 20_000, len(qc.VOTERS)
    good = rng.random(n) < 0.8
    right = np.linspace(0.75, 0.95, voters)
    vote = np.where(rng.random((n, voters)) < right, np.where(good[:, None], qc.GOOD, qc.BAD), np.where(good[:, None], qc.BAD, qc.GOOD))
    vote[rng.random((n, voters)) < 0.3] = qc.ABSTAIN
    patterns, counts = np.unique(vote @ 3 ** np.arange(voters), return_counts=True)
    _, table, share = qc.estimate(patterns, counts.astype(float))
    accuracy = table[1, :, qc.GOOD] / (table[1, :, qc.GOOD] + table[1, :, qc.BAD])
    assert np.abs(accuracy - right).max() < 0.03 and abs(share - 0.8) < 0.03


def test_scorer_tells_junk_from_prose(spark):
    rng = random.Random(4)
    words = GOOD.lower().replace(".", "").replace(",", "").split()
    docs = []
    for i in range(600):
        text = " ".join(rng.choice(words) for _ in range(60)).capitalize() + ". " + " ".join(rng.choice(words) for _ in range(20)) + "."
        text = text.replace(" the ", ". The ").replace(" and ", ", and ")
        if i % 5 == 0:
            text = rng.choice([" ".join(w + "###" for w in text.split()), " ".join(w.upper() + "!!" for w in text.split()), " ".join([rng.choice(words)] * 80)])
        docs.append((i, text, 1.0))
    df = spark.createDataFrame([*docs, (9000, None, 1.0), (9001, "", 1.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.kept for r in qc.score(df, *qc.train(df)).collect()}
    assert len(got) == 602 and sum(got[i] == (i % 5 != 0) for i in range(600)) > 590
    assert qc.score(df.limit(0), *qc.train(df.limit(0))).count() == 0


def plain_score(text, weight, bias):
    """The score of a text, one word at a time."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    total, last = 0.0, None
    for word in words:
        raw = word.encode()
        data = np.frombuffer(raw, np.uint8)
        h = int(qc.c.span_hashes(qc._VALUES[data], np.array([0]), np.array([len(raw)]))[0])
        total += weight[h % qc.WORD_BUCKETS]
        shape = int(qc._SHAPE[raw[0]]) * qc.SHAPES + int(qc._SHAPE[raw[-1]])
        total += weight[qc.WORD_BUCKETS + shape + (qc.SHAPES * qc.SHAPES if h == last else 0)]
        last = h
    band = min(15, int(math.log2(len(words) + 1)))
    return 1 / (1 + math.exp(-(total / max(1, len(words)) + weight[qc.SHAPE_END + band] + bias)))


def test_classifier_scores_are_those_of_plain_python(spark):
    weight = np.random.default_rng(3).normal(0, 1, qc.DIMENSION)
    texts = ["A plain text, with words words Words and 3 numbers.", None, "", "x", "é ü\nñ !!! ###", "w " * 3000, "A plain text, with words words Words and 3 numbers."]
    df = spark.createDataFrame([(i, t, 0.5, True) for i, t in enumerate(texts)], "doc_id long, text string, score double, kept boolean").repartition(3)
    got = {r.doc_id: r for r in qc.score(df, weight, 0.25).collect()}
    for i, text in enumerate(texts):
        want = plain_score(text, weight, 0.25)
        assert abs(got[i].score - want) < 1e-9 and got[i].kept == (want >= qc.KEEP_FROM), text
    assert qc.score(df.limit(0), weight, 0.0).count() == 0


def test_classifier_on_ties_repeats_and_nothing(spark):
    good = "This is a plain sentence of quite ordinary words. It goes on for a while, and then it ends.\nAnother line follows here, with other words in it."
    bad = "### $$$ ### buy buy buy buy buy ###"
    rows = [(i % 40, [good, bad][i % 2] + (f" word{i}." if i % 3 else ""), 1.0, False) for i in range(160)] + [(None, good, 1.0, False), (7, None, 1.0, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, kept boolean")
    first, again = (qc.score(df, *qc.train(df.repartition(n))).collect() for n in (2, 5))
    key = lambda r: (r.doc_id or -1, round(r.score, 4))
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == 162
    empty = df.limit(0)
    assert qc.score(empty, *qc.train(empty)).count() == 0


def test_other_columns_of_documents_may_have_any_names(spark):
    from deltascope.llm import quality_rules

    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    schema = "doc_id long, text string, source string, host string, part int, __part int, __source string, salt int, n_words long, kept boolean"
    rows = [(i, bad if i % 10 else good, "bad host", "x", 1, 2, "y", 3, 4, True) for i in range(200)] + [(500 + i, good, "good host", "x", 1, 2, "y", 3, 4, False) for i in range(200)]
    df = spark.createDataFrame(rows, schema)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {500 + i for i in range(200)}
    assert quality_rules.keep_good(df.limit(0)).count() == 0
