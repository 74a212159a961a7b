import math
import random

import numpy as np

from deltascope.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, extra string, n int, score long"


def plain(rows):
    """All results by sorting all scores."""
    use = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        use.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for anchor in [min((x for x in use if x[0] == i), key=lambda x: x[1:]) for i in sorted({x[0] for x in use if x[0] % 100 == 0})]:
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], x[2])), x[0], x[1]) for x in use if x[0] != anchor[0])
        for s, pos, _ in [x for x in scored if x[2] == anchor[1]][:5]:
            near = [x for x in scored if x[2] != anchor[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(anchor[0], pos, i, x[1], -s, -x[0]) for i, x in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*x, "?", 1, 2) for x in rows], SCHEMA).repartition(4)
    use = h.usable(df)
    from pyspark.sql import functions as F

    use = use.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(tuple(r) for r in h.mine(use, use.where("vec_id % 100 = 0")).collect())


def vectors(rng, n, dims=6):
    return [(i, [rng.gauss(0.3, 0.4) for _ in range(dims)], rng.randrange(10)) for i in range(n)]


def test_equals_sorting_everything(spark):
    rows = vectors(random.Random(1), 700)
    assert mined(spark, rows) == plain(rows) != []


def test_every_digit_is_used(spark, monkeypatch):
    monkeypatch.setattr(h, "FEW", 0)  # no window is gathered before its last digit
    rng = random.Random(2)
    rows = [(i * 37 - 400, [rng.choice([0.25, 0.5]) for _ in range(3)], rng.randrange(3)) for i in range(300)]  # many ties
    assert mined(spark, rows) == plain(rows) != []


def test_a_common_vector_is_counted_not_gathered(spark):
    rng = random.Random(3)
    rows = vectors(rng, 400) + [(1000 + i, [0.4] * 6, i % 2) for i in range(1200)]
    rng.shuffle(rows)
    assert mined(spark, rows) == plain(rows) != []


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = vectors(rng, 150, 3)
    rows += [(None, [0.1] * 3, 1), (200, None, 1), (201, [0.1, None, 0.2], 1), (202, [0.1, float("nan"), 0.2], 1), (203, [0.1, float("inf"), 0.2], 2), (204, [0.5] * 3, None), (300, [0.0] * 3, 1), (400, [-0.5] * 3, 1), (500, [], 2), (-100, [0.4] * 3, 4)]
    rows += [(600, [300.0] * 3, 5), (601, [250.0] * 3, 5), (602, [260.0] * 3, 6)]
    assert mined(spark, rows) == plain(rows) != []
    assert mined(spark, rows[:0]) == mined(spark, [(5, [0.1], 1)]) == mined(spark, [(100, [0.1], 1)]) == []


def test_repeated_rows_count_and_anchors_once(spark):
    rows = [(100, [0.5, 0.5], 1)] * 2 + [(1, [0.5, 0.4], 1)] * 2 + [(2, [0.5, 0.38], 2)] * 3 + [(3, [0.4, 0.4], 2)]
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) == 8


def test_few_anchors_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(h, "ANCHORS", 2)
    rows = vectors(random.Random(6), 650)
    assert mined(spark, rows) == plain(rows)


def test_scores_are_exact():
    a, b = np.array([[1 << 23, -(1 << 23)] * 50]), np.array([[1 << 23, 3] * 50, [1, 2] * 50])
    assert h.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(a[0], r)) for r in b]]
