import pytest
from pyspark.sql import functions as F

from deltascope.functions import predicates as p
from deltascope.functions import scoring as s


def levels(spark, rows):
    df = spark.createDataFrame(rows, "change string, class string, blast long, deps long, public boolean, structural boolean, total long")
    c = F.col
    score = s.risk_score(c("class"), c("change"), c("public"), c("blast"), c("total"), c("deps"), c("structural"))
    return [(r.score, r.level) for r in df.select(score.alias("score"), s.risk_level(score).alias("level")).collect()]


def test_levels_of_known_changes(spark):
    got = levels(spark, [("modified", "text", 0, 0, False, False, 10), ("deleted", "functional", 8, 5, True, True, 10), ("added", "functional", 0, 0, False, None, 10), ("modified", "functional", 0, 0, False, True, 100), ("modified", "functional", 5, 8, True, True, 100)])
    assert [x[1] for x in got[:4]] == ["low", "critical", "low", "medium"] and got[4][0] >= 0.5


def test_without_graph_signals_nothing_is_high_and_scores_are_bounded(spark):
    rows = [(c, k, b, d, pub, st, 50) for c in s.CHANGE_WEIGHT for k in s.CLASS_WEIGHT for b, d in ((0, 0), (3, 2), (50, 900)) for pub in (True, False) for st in (True, False, None) if c != "deleted" or k == "functional"]  # a deletion has no lines to class
    for row, (score, level) in zip(rows, levels(spark, rows)):
        assert 0 <= score <= 1
        if row[2] == 0:
            assert score < 0.5 and level in ("low", "medium")


def test_cosmetic_is_false_only(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "x boolean")
    assert [r[0] for r in df.select(p.is_cosmetic(F.col("x"))).collect()] == [False, True, False]


@pytest.mark.parametrize("before,after,structural,want", [
    ("fn foo() {\n    // old comment\n    x + 1\n}", "fn foo() {\n    // new comment\n    x + 1\n}", False, "text"),
    ("fn foo() {\n    x + 1\n}", "fn foo() {\n    x + 2\n}", True, "functional"),
    ("fn foo() {\n    // a\n    x + 1\n}", "fn foo() {\n    // b\n    x + 2\n}", True, "text+functional"),
    ("a\nb", "b\na", True, "functional"),
    ("a\n\nb", "  a\nb\n", None, "functional"),
    ("a\nb\n", "a\nb", None, "text"),
    ("", "x", None, "functional"),
    (None, "x", None, "functional"),
    ("#[derive]\nx", "#[test]\nx", None, "functional"),
    ("def f():\nx", "def g():\nx", None, "syntax"),
])
def test_classes(spark, before, after, structural, want):
    df = spark.createDataFrame([(before, after, structural)], "a string, b string, s boolean")
    assert df.select(s.classify(F.col("a"), F.col("b"), F.col("s"))).first()[0] == want


def test_noise_and_paths(spark):
    noisy = ["yarn.lock", "a/b/Cargo.lock", "x.min.js", "y.map", "dist/a.js", ".next/b", "build/c", "__generated__/d.ts"]
    clean = ["src/main.rs", "src/dist/a.js"]
    df = spark.createDataFrame([(x,) for x in noisy + clean], "path string")
    assert [r[0] for r in df.select(p.is_noise(F.col("path"))).collect()] == [True] * 8 + [False] * 2
    assert [r[0] for r in df.select(p.is_web_noise(F.col("path"))).collect()][-1]
    pairs = [("src/a.py", "a.py", True), ("/src/a.py", "src\\a.py", True), ("", "a.py", False), ("b.py", "a.py", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(p.same_path(F.col("a"), F.col("b")), "want").collect())
    ranges = [(10, 12, 22, 22, True), (10, 12, 23, 23, False), (0, 0, 5, 5, False), (None, 12, 1, 2, True), (10, 12, 0, None, False), (3, 0, 13, 0, True)]
    df = spark.createDataFrame(ranges, "a long, b long, c long, d long, want boolean")
    assert all(r[0] == r[1] for r in df.select(p.lines_overlap(*(F.col(x) for x in "abcd")), "want").collect())


def test_level_names(spark):
    df = spark.createDataFrame([("low",), ("HIGH",), ("critical",), ("what",), (None,)], "x string")
    assert [r[0] for r in df.select(p.risk_rank(F.col("x"))).collect()] == [0, 2, 3, 0, 0]
