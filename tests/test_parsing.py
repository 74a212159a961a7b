from pyspark.sql import functions as F

from deltascope.functions import parsing as g
from deltascope.operators import reviewer
from deltascope.sources import files


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return df.select(column).first()[0]


def test_issues_of_model_answers(spark):
    for text, n in (('{"issues": ["a", "b"]}', 2), ('{"issues": [{"issue": "x", "severity": "high"}, {"issue": ""}]}', 1), ('```json\n{"issues": ["a"]}\n```', 1), ('Sure: {"issues": ["q"]} bye', 1), ("nothing", 0), ('{"issues": ["a", {"issue": "b", "file": "f"}]}', 2)):
        assert len(value(spark, g.issues(F.col("t")), t=text)) == n, text
    assert value(spark, g.issues(F.col("t")), t='{"issues": [{"issue": "x", "severity": "high"}]}')[0].severity == "high"


def test_findings_and_reports(spark):
    got = value(spark, g.findings(F.col("t")), t='ok [{"path": "a.py", "from_line": 3, "message": "m"}, 7, {"file": "b", "line": "x", "confidence": 5}] end')
    assert [tuple(x) for x in got] == [("a.py", 3, 0, "m", 3), ("b", 0, 0, "", 5)]
    text = "intro\nFile: src/a.ts\nLine: 13 to 15\nType: potential_issue\n\nComment:\nBad thing\nhere.\n\nMore.\nFile: b.py\nLine: 4\n\nComment:\nOther"
    got = value(spark, g.report_blocks(F.col("t")), t=text)
    assert [tuple(x) for x in got] == [("src/a.ts", 13, 15, "[potential_issue] Bad thing\nhere."), ("b.py", 4, 4, "Other")]


def test_references_and_values(spark):
    assert tuple(value(spark, g.pull_request(F.col("u")), u="https://github.com/o/r/pull/12/files")) == ("o", "r", 12)
    assert value(spark, g.pull_request(F.col("u")), u="x") is None
    assert tuple(value(spark, g.repo_parts(F.col("u")), u="o/r/s")) == ("o", "r/s")
    assert [value(spark, g.scope(F.col("s")).getField("kind"), s=x) for x in ("working", "a..b", "abc")] == ["working", "range", "commit"]
    assert value(spark, g.scope(F.col("s")).getField("to"), s="a...b") == ".b"
    assert value(spark, g.balanced_object(F.col("t")), t="a {b {c} \"}\" d} {e}") == "{b {c} \"}"
    assert value(spark, g.balanced_object(F.col("t")), t="{{x}") is None and value(spark, g.balanced_object(F.col("t")), t="none") is None
    assert [value(spark, g.file_status(F.col("s")), s=x) for x in ("added", "removed", "copied")] == ["added", "deleted", "modified"]
    assert value(spark, g.decoded_content(F.col("s")), s="aGV\nsbG8=") == "hello"
    df = spark.range(1).select(g.clamp_lines(F.array(F.lit(3), F.lit(9), F.lit(12)), F.lit(4), F.lit(10)).alias("x"), g.short_number(F.lit(1234)).alias("k"), g.cost(F.lit(1000000), F.lit(0)).alias("c"))
    row = df.first()
    assert tuple(row.x) == (9, 9) and row.k == "1.2K" and abs(row.c - 0.2) < 1e-12


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"path": "a", "line": 1}, {"path": "b", "line": 2, "body": "x"}]')
    assert [r.body for r in files.comments(spark, str(tmp_path / "c.json")).orderBy("line").collect()] == [files.DEFAULT_BODY, "x"]
    (tmp_path / "g.json").write_text('[{"pr_title": "T", "comments": [{"comment": "c", "severity": "High"}, {"comment": "d"}]}]')
    assert files.golden_comments(spark, str(tmp_path / "g.json")).count() == 2
    log = spark.createDataFrame([("abc first commit",), ("def",)], "value string")
    assert [tuple(r) for r in files.commits(log).collect()] == [("abc", "first commit")]
    pulls = files.pull_requests(spark.createDataFrame([("r\t1\tFix the thing",), ("bad",)], "value string"))
    gold = spark.createDataFrame([(2, "Fix the thing"), (1, "Fix the thing and more than forty characters of text"), (3, "Other")], "gold_id long, title string")
    assert [r.gold_id for r in files.match_titles(pulls, gold).collect()] == [1]
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "repo string, ord long")
    assert [r.ord for r in files.round_robin_sample(items, 3).collect()] == [1, 3, 2]


def test_reviews_prompts_and_budget(spark):
    rows = [(f"e{i}", f"n{i}", "function", "f", "modified", "text", "low", 0, 0) for i in range(4)]
    df = spark.createDataFrame(rows, "entity_id string, entity_name string, entity_type string, file_path string, change_type string, classification string, risk_level string, blast_radius long, dependent_count long")

    def stub(text):
        if "n2" in text:
            raise RuntimeError
        return '{"verdict": "approve"}' if "n1" in text else "???"

    got = reviewer.review(df, stub)
    assert {(r.entity_id, r.verdict) for r in got.collect()} == {("e0", "comment"), ("e1", "approve"), ("e3", "comment")}
    assert reviewer.lens_calls(df).count() == 36
    xs = spark.createDataFrame([(1, "a", 9.0, 1, 8000), (1, "b", 8.0, 2, 9000), (1, "c", 7.0, 3, 6000)], "pr_id long, entity_id string, triage_score double, change_seq long, size long")
    assert [r.entity_id for r in reviewer.snippets(xs).orderBy("ord").collect()] == ["a", "c"]
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    found = spark.createDataFrame([("u1", 1, "i", "f", 2)], "url string, pos long, issue string, file string, line long")
    assert {r.url: len(r.candidates) for r in reviewer.candidates(urls, found).collect()} == {"u1": 1, "u2": 0}
    assert [r.url for r in reviewer.remaining(urls, found).collect()] == ["u2"]
