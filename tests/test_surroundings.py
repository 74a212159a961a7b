"""What surrounds the engine: extraction, scopes, the host, sinks, reports, calls."""

import base64
import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from deltascope.operators import agent, extract, funnel, render, reviewer
from deltascope.sinks import outputs
from deltascope.sources import files, history, host
from deltascope.streaming import jobs

FILES = "file_path string, before_content string, after_content string"


def entities(spark, before, after, extractor=extract.outline):
    return extract.changed_entities(spark.createDataFrame([("m.py", before, after)], FILES), extractor).collect()


def test_an_added_function_is_one_added_entity(spark):
    got = entities(spark, None, "fn hello() {\n    say()\n}\n")
    assert [(r.entity_name, r.entity_type, r.change_type, r.start_line, r.end_line) for r in got] == [("hello", "function", "added", 1, 3)]
    assert got[0].before_content is None and got[0].structural_change is None


def test_an_empty_diff_has_no_entities(spark):
    text = "def a():\n    return 1\n"
    assert entities(spark, text, text) == [] and entities(spark, None, None) == [] and entities(spark, "", "") == []


def test_changes_inside_and_around_entities(spark):
    before = "class A:\n    def x(self):\n        return 1\n\n    def y(self):\n        return 2\n\ndef old_name():\n    return 3\n"
    after = "class A:\n    def x(self):\n        # why\n        return 1\n\ndef new_name():\n    return 3\n"
    got = {r.entity_name: (r.change_type, r.structural_change) for r in entities(spark, before, after)}
    assert got == {"A": ("modified", True), "A::x": ("modified", False), "A::y": ("deleted", None), "new_name": ("renamed", True)}


def test_an_extractor_that_fails_has_no_entities(spark):
    def broken(path, text):
        raise ValueError(path)

    assert entities(spark, None, "def a(): 1", broken) == []
    whole = lambda path, text: [("all", "chunk", 1, text.count("\n") + 1, text)]
    assert [r.entity_type for r in entities(spark, None, "x\ny", whole)] == ["chunk"]


def test_scopes_of_a_history(spark):
    rows = [(1, "a", "f", "added", None, "1"), (2, "b", "f", "changed", "1", "2"), (3, "c", "f", "changed", "2", "1"), (3, "c", "g", "added", None, "x"), (4, "d", "g", "removed", "x", None), (5, None, "h", "changed", "p", "q")]
    df = spark.createDataFrame(rows, "seq long, sha string, file_path string, status string, before_content string, after_content string")
    names = lambda scope: sorted((r.file_path, r.status) for r in history.changed_files(df, scope).collect())
    assert names("c") == [("f", "modified"), ("g", "added")] and names("working") == [("h", "modified")] and names("d") == [("g", "deleted")]
    assert names("a..b") == [("f", "modified")] and names("a..d") == [] and names("a..c") == [("g", "added")] and names("nowhere") == []
    assert history.parse_scope("a...b") == ("range", "a", ".b")


def test_the_host_answers_from_files(spark, tmp_path):
    put = lambda request, value: (tmp_path / host.file_name(request)).write_text(value if isinstance(value, str) else json.dumps(value))
    put("repos/o/r/pulls/1", {"title": "T", "head": {"ref": "h", "sha": "1"}, "base": {"ref": "b", "sha": "0"}, "state": "open", "additions": 3})
    put("repos/o/r/pulls/1/files?per_page=100&page=1", [{"filename": f"f{i}", "status": "added", "patch": "@@"} for i in range(100)])
    put("repos/o/r/pulls/1/files?per_page=100&page=2", [{"filename": "last"}])
    put("repos/o/r/pulls/1.diff", "diff --git a/x b/x")
    put("repos/o/r/contents/a.py?ref=main", {"content": base64.b64encode("é\n".encode()).decode()})
    put("search/code?q=foo%20repo%3Ao/r%20path%3Asrc&per_page=100", {"items": [{"path": "s.py", "text_matches": [{"fragment": "foo"}, {"fragment": "foo\nbar"}]}, {"path": "t.py"}]})
    spark.dataSource.register(host.HostSource)
    read = lambda kind, requests: spark.read.format("review_host").option("kind", kind).option("requests", requests).option("fixture", str(tmp_path)).load()
    assert read("pulls", "o/r#1").first().head_ref == "h"
    got = read("files", "o/r#1")
    assert got.count() == 101 and got.where("filename = 'last' and status = 'modified' and patch is null").count() == 1
    assert read("diff", "o/r#1").first().diff == "diff --git a/x b/x"
    assert [r.content for r in read("contents", "o/r@main:a.py,o/r@main:missing.py").collect()] == ["é\n"]
    assert sorted((r.file, r.fragment) for r in read("search", "o/r?foo&src").collect()) == [("s.py", 0), ("s.py", 1)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"\nc', None), (2, "", "x")], "id long, t string, u string")
    outputs.write_csv(rows, str(tmp_path / "csv"))
    back = files.evaluation_rows(spark, str(tmp_path / "csv"))
    assert back.columns == ["id", "t", "u"] and {r.t for r in back.where("id = 1").collect()} == {'a "b"\nc'}
    outputs.write_json(rows, str(tmp_path / "json"))
    assert sorted(len(json.loads(r.value)) for r in spark.read.text(str(tmp_path / "json")).collect()) == [2, 3]
    log = str(tmp_path / "log")
    for seq, status in enumerate(("pending", "reviewing", "complete")):
        outputs.append(spark.sql(f"SELECT 7L AS job_id, '{status}' AS status, timestamp'2024-01-01 00:00:0{seq}' AS at, {seq}L AS seq"), log)
    assert [(r.job_id, r.status) for r in jobs.latest_status(spark.read.parquet(log)).collect()] == [(7, "complete")]
    assert outputs.latest_rows(spark.read.parquet(log), "job_id", ["seq"]).first().status == "complete"
    comments = spark.createDataFrame([("o/r", 1, "f", 3, "b"), ("o/r", 1, "a", 1, "c"), ("o/r", 2, "f", 3, "b")], "repo string, number long, path string, line long, body string")
    payloads = outputs.review_payloads(comments)
    body = json.loads(payloads.where("number = 1").first().payload)
    assert body["event"] == "COMMENT" and [x["path"] for x in body["comments"]] == ["a", "f"]

    def post(repo, number, payload):
        if number == 2:
            raise OSError("refused")
        return "ok"

    assert {(r.number, r.answer, r.error) for r in outputs.post_reviews(payloads, post).collect()} == {(1, "ok", None), (2, None, "refused")}


ENTITY = dict(entity_name="x", entity_type="function", file_path="a.py", change_type="added", classification="functional", risk_score=0.75, risk_level="critical", blast_radius=3, dependent_count=2, dependency_count=1, is_public_api=True, structural_change=False)


def test_reports():
    rows = [Row(**ENTITY), Row(**ENTITY | {"risk_level": "low", "entity_name": "quiet", "is_public_api": False, "structural_change": True})]
    group = Row(group_id=0, label="src/", size=2)
    text = render.markdown(rows, "requires_review", [group], {"total_ms": 7, "diff_ms": 2})
    assert "Groups" not in text and "| CRITICAL | function | `x` | `a.py` | 0.75 |" in text and "### x (critical)" in text and "### quiet" not in text and "7 ms" in text
    assert "## Groups (2)" in render.markdown(rows, "v", [group, group])
    text = render.terminal(rows, "v", [group, group], context=True)
    assert "  + CRITICAL function x (a.py)" in text and "deps: 1/2" in text and "public API" in text and "2 logical groups" in text and ">>> 2 dependents" in text
    assert render.markdown([], "v") == render.terminal([], "v") == "No entity-level changes found." and render.matches([]) == "No matches found."


def test_prompts_and_entity_json(spark):
    deps = [Row(name=f"d{i}", file="f") for i in range(12)]
    rows = [Row(entity_id="e", risk_rank=3, before_content=None, after_content="z" * 3000, dependents=deps, **ENTITY), Row(entity_id="q", risk_rank=0, before_content="b", after_content="a", dependents=None, **ENTITY | {"structural_change": None})]
    df = spark.createDataFrame(rows, "entity_id string, risk_rank int, before_content string, after_content string, dependents array<struct<name:string,file:string>>, entity_name string, entity_type string, file_path string, change_type string, classification string, risk_score double, risk_level string, blast_radius long, dependent_count long, dependency_count long, is_public_api boolean, structural_change boolean")
    texts = {r.entity_id: r.p for r in df.select("entity_id", reviewer.prompt(df).alias("p")).collect()}
    assert "d9 (f)" in texts["e"] and "d10 (f)" not in texts["e"] and "after:\n```\nzzz" in texts["e"] and "before:" not in texts["e"]
    assert "before:\n```\nb\n```" in texts["q"] and "dependents:" not in texts["q"]
    got = {r.entity_id: json.loads(r.json) for r in reviewer.entity_json(df).collect()}
    assert "after_content" not in got["e"] and len(got["e"]["dependents"]) == 10 and got["e"]["risk_score"] == "0.75" and got["q"]["after_content"] == "a"
    assert reviewer.entity_json(df, "high").count() == 1


def test_validation_falls_back_to_the_first_candidates(spark):
    rows = spark.createDataFrame([(c, 0, i, f"i{i}") for c in (1, 2) for i in range(9)], "pr_id long, lens_idx int, pos long, issue string")
    answers = spark.createDataFrame([(1, "kept")], "pr_id long, issue string")
    got = reviewer.validated(rows, answers).collect()
    assert sorted(r.issue for r in got if r.pr_id == 2) == [f"i{i}" for i in range(7)] and [r.issue for r in got if r.pr_id == 1] == ["kept"]


def test_enrichment_summary_and_triggers(spark):
    found = spark.createDataFrame([(1, "f", 15, "bug"), (2, "f", 90, "other")], "pos long, file string, line long, issue string")
    known = spark.createDataFrame([("f", 10, 20, ["aa", "longest", "mid"]), ("f", 12, 14, ["no"])], "file string, start_line long, end_line long, ids array<string>")
    assert {r.pos: r.issue for r in reviewer.enrich(found, known, 2).collect()} == {1: "bug longest mid", 2: "other"}
    runs = spark.createDataFrame([(None, 2, 1.0), ("x", 0, 9.0), (None, 3, 2.0)], "error string, n_findings long, seconds double")
    assert tuple(reviewer.run_summary(runs).first()) == (2, 1, 5, 1.5)
    events = spark.createDataFrame([("pull_request", "opened", "me"), ("pull_request", "opened", "x[bot]"), ("push", "opened", "me"), ("pull_request", "closed", None), ("pull_request", "synchronize", None)], "event string, action string, sender string")
    assert jobs.triggers(events).count() == 2


def test_joins_of_files_and_their_texts(spark):
    listed = spark.createDataFrame([(1, "a", "added"), (1, "b", "removed"), (1, "c", "modified")], "pr_id long, filename string, status string")
    texts = spark.createDataFrame([(1, "base", "a", "0"), (1, "head", "a", "1"), (1, "base", "b", "2"), (1, "head", "b", "3"), (1, "base", "c", "4")], "pr_id long, ref string, path string, content string")
    assert {(r.filename, r.before, r.after) for r in files.file_pairs(listed, texts).collect()} == {("a", None, "1"), ("b", "2", None), ("c", "4", None)}
    patches = spark.createDataFrame([(1, "a", "@@")], "pr_id long, file string, patch string")
    assert {(r.filename, r.patch) for r in files.with_patches(listed, patches).collect()} == {("a", "@@"), ("b", None), ("c", None)}
    assert [r.path for r in files.source_files(spark.createDataFrame([("x.PY",), ("y.txt",)], "path string")).collect()] == ["x.PY"]


def test_the_agent_keeps_what_it_names(spark):
    known = spark.createDataFrame([("e1", "foo", "a.py", "body"), ("e2", "m::foo", "b.py", "other"), ("e3", "bar", "c.py", "z")], "entity_id string, entity_name string, file_path string, content string")
    edges = spark.createDataFrame([("e3", "e1")], "src string, dst string")
    texts = spark.createDataFrame([("a.py", "foo\nbar")], "file string, text string")
    tools = agent.Tools(known, edges, texts)
    script = iter(['{"tool": "entity", "args": {"name": "foo", "file": "a"}}', 'x {"tool": "dependents", "args": {"name": "foo"}}', '{"tool": "search", "args": {"pattern": "BAR"}}', '{"tool": "file", "args": {"path": "a.p"}}', "no step", '{"keep": [2, 9, "x", 1]}'])
    heard = []

    def ask(said):
        heard[:] = said
        return next(script)

    assert agent.challenge(["one", "two"], ask, tools) == ["two", "one"]
    assert heard[1:] == ["foo (a.py)\nbody", "bar (c.py)", "a.py:2:bar", "foo\nbar", "unknown step"]
    assert agent.challenge(["one"], lambda said: '{"tool": "entity", "args": {"bad": 1}}', tools) == ["one"]
    assert agent.challenge(["one"], lambda said: "?", tools) == ["one"]


def test_the_last_result_is_computed_once(spark):
    calls, cache = [], agent.LastResult()

    def compute():
        calls.append(1)
        return spark.range(3)

    for target in ("a", "a", "b", "a"):
        assert cache.get("repo", target, compute).count() == 3
    assert len(calls) == 3


def test_context_takes_names_across_issues(spark):
    known = spark.createDataFrame([(1, "a", "Foo", "function", None, "x"), (1, "b", "foo", "chunk", "x", "x"), (1, "c", "foo", "field", "", None), (1, "d", "x y", "field", "1", None)], "pr_id long, entity_id string, entity_name string, entity_type string, before_content string, after_content string")
    issues = spark.createDataFrame([(1, 0, 1, "the FOO x"), (1, 0, 2, "Y fails")], "pr_id long, lens_idx int, pos long, issue string")
    assert sorted(r.entity_id for r in funnel.validation_context(known, issues).collect()) == ["a", "d"]
    kinds = spark.createDataFrame([("added",), ("moved",)], "change_type string")
    assert funnel.code_changes(kinds).count() == 1
    assert spark.range(1).select(F.lit(len(funnel.identifiers("value fooBar x1 the")))).first()[0] == 1


def test_agents_of_many_changes_answer_as_one_by_one(spark):
    """The same scripted agent at the driver, change by change, and for all changes at once."""
    entities = [(pr, f"{pr}{i}", name, f"src/{i}.rs", f"body {i}") for pr in (1, 2, 3, 4) for i, name in enumerate(("A::run", "run", "Run", "x.A::run", "walk"))]
    edges = [(pr, f"{pr}{a}", f"{pr}{b}") for pr in (1, 2, 3) for a, b in ((0, 4), (1, 4), (4, 2))]
    texts = [(pr, f"f{i}.rs", f"fn walk() {{}}\nlet RUN = {i};\n") for pr in (1, 2, 3) for i in range(3)]
    scripts = {
        1: ['{"tool": "entity", "args": {"name": "run"}}', '{"tool": "entity", "args": {"name": "A::run", "file": "src/0"}}', '{"keep": [2, 9, 1]}'],
        2: ['{"tool": "dependents", "args": {"name": "walk"}}', '{"tool": "dependencies", "args": {"name": "walk"}}', '{"tool": "search", "args": {"pattern": "run"}}', '{"tool": "nothing"}', '{"keep": []}'],
        3: ['{"tool": "file", "args": {"path": "f1"}}', '{"tool": "file", "args": {"path": "none"}}', '{"tool": "search", "args": {"pattern": "none"}}', "no step"],
        4: ['{"tool": "dependents", "args": {"name": "walk"}}', "fail"],
    }

    def ask(said):
        pr = int(said[0].split(" of ")[1][0])
        step = scripts[pr][len(said) - 1] if len(said) <= len(scripts[pr]) else "still nothing"
        if step == "fail":
            raise OSError("down")
        if "keep" in step and pr == 1:
            return '{"keep": [%d]}' % (len("|".join(said[1:])) % 2 + 1)
        return step

    heard = {}

    def telling(said):
        heard[int(said[0].split(" of ")[1][0])] = list(said)
        return ask(said)

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    e, g, f = frame(entities, "pr_id long, entity_id string, entity_name string, file_path string, content string"), frame(edges, "pr_id long, src string, dst string"), frame(texts, "pr_id long, file string, text string")
    want = {}
    for pr in scripts:
        own = lambda df: df.where(F.col("pr_id") == pr).drop("pr_id")  # noqa: B023, E731
        want[pr] = agent.challenge([f"one of {pr}", f"two of {pr}"], telling, agent.Tools(own(e), own(g), own(f)))
    changes = frame([(pr, [f"one of {pr}", f"two of {pr}"]) for pr in scripts], "pr_id long, candidates array<string>")

    def checked(said):
        pr = int(said[0].split(" of ")[1][0])
        assert list(said) == seen[pr][: len(said)], (said, seen[pr])
        return ask(said)

    seen = dict(heard)
    got = {r.pr_id: r.kept for r in agent.challenge_all(changes, checked, e, g, f).collect()}
    assert got == want and want[4] == ["one of 4", "two of 4"] and want[2] == []
    assert agent.challenge_all(changes.limit(0), ask, e, g, f).count() == 0
