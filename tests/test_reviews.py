"""From files to a ranked review: tokens, changed entities, scopes, scores."""

import random

import pytest
from pyspark.sql import functions as F

from deltascope.functions import lexing
from deltascope.operators import extract, review, symbols
from deltascope.plans import catalog

FILES = "file_path string, before_content string, after_content string"


@pytest.mark.parametrize(
    ("path", "one", "other", "same"),
    [
        ("a.py", 'g("a#1")', 'g("a#2"); drop()', False),
        ("a.py", "x = 1  # one", "x = 1  # two", True),
        ("a.py", "u = 'http://a#b'", "u = 'http://a#c'", False),
        ("a.py", "x = a // b", "x = a // c", False),
        ("a.py", 's = """# no\n comment"""', 's = """# no\n remark"""', False),
        ("a.py", "if a:\n    b()\nc()", "if a:\n    b()\n    c()", False),
        ("a.py", "if a:\n    b()\n\n    # why\n    c()", "if a:\n  b()\n  c()", True),
        ("a.py", "f(a,\n  b)", "f(a,\n        b)", True),
        ("a.js", 'get("http://x") // y', 'get("http://x") /* z */', True),
        ("a.js", 'get("http://x")', 'get("http://y")', False),
        ("a.js", "s = `// ${a}`", "s = `// ${b}`", False),
        ("a.rs", "fn f<'a>(x: &'a str) { g('\"') } // b", "fn f<'a>(x: &'a str) { g('\"') }", True),
        ("a.rs", '#[test]\nfn a() {}', "#[bench]\nfn a() {}", False),
        ("a.rs", 'r#"a "quoted" // b"#', 'r#"a "quoted" // c"#', False),
        ("a.c", "#include <a.h>", "#include <b.h>", False),
        ("a.go", "a := 'x' /* b\n c */ + 1", "a := 'x' + 1", True),
        ("a.c", "x = 1; /* open", "x = 1;", True),
        ("", 'x # c', "x // d", True),
        ("a.py", "it's # broken", "it's # cut", True),
    ],
)
def test_comments_and_strings(path, one, other, same):
    assert (lexing.tokens(one, path) == lexing.tokens(other, path)) == same


def entities(spark, before, after, extractor=extract.outline, path="m.py"):
    return extract.changed_entities(spark.createDataFrame([(path, before, after)], FILES), extractor).collect()


def test_a_change_inside_a_string_is_structural(spark):
    got = entities(spark, 'fn f() {\n    g("a#1");\n}\n', 'fn f() {\n    g("a#2"); drop_all();\n}\n', path="m.rs")
    assert [(r.change_type, r.structural_change) for r in got] == [("modified", True)]
    got = entities(spark, "fn f() {\n    g(1); // a\n}\n", "fn f() {\n    // b \"\n    g(1);\n}\n", path="m.rs")
    assert [(r.change_type, r.structural_change) for r in got] == [("modified", False)]


BODY = "    total = 0\n    for row in rows:\n        total += row.price * row.count\n    if total > limit:\n        raise ValueError('too much')\n    return total\n"


def test_renames_with_a_changed_line(spark):
    changed = BODY.replace("> limit", ">= limit + 1")
    other = "    return [x for x in names if x]\n"
    got = {r.entity_name: r for r in entities(spark, f"def first(rows):\n{BODY}\ndef gone(names):\n{other}", f"def second(rows):\n{changed}\ndef new(a):\n    print(a)\n")}
    assert {k: r.change_type for k, r in got.items()} == {"second": "renamed", "new": "added", "gone": "deleted"}
    assert got["second"].structural_change and got["second"].before_content.startswith("def first") and got["gone"].after_content is None


def test_overloads_are_compared_one_by_one(spark):
    one, two = "fn f(a: i32) {\n    one(a);\n}\n", "fn f(b: u8, c: u8) {\n    two(b);\n}\n"
    got = entities(spark, one + two, one + two.replace("two(b)", "two(c)"), path="m.rs")
    assert [(r.entity_id, r.change_type) for r in got] == [("m.rs::function::f#2", "modified")]
    got = entities(spark, one + two, "fn f() {\n    none();\n}\n" + one + two, path="m.rs")
    assert [(r.entity_id, r.change_type, r.start_line) for r in got] == [("m.rs::function::f", "added", 1)]
    got = entities(spark, one + two, two, path="m.rs")
    assert [(r.change_type, r.before_content) for r in got] == [("deleted", one.rstrip("\n"))]


def test_pairs_are_those_of_comparing_all():
    rng = random.Random(4)

    def side(words):
        return extract._Side(("n", "function", 1, 1, " ".join(words)), "x.js")

    for _ in range(60):
        old = [side([rng.choice("abcde") for _ in range(rng.randint(1, 9))]) for _ in range(rng.randint(0, 6))]
        new = [side(rng.choice(old).entity[4].split(" ") + [rng.choice("abcde")]) if old and rng.random() < 0.7 else side([rng.choice("abcde") for _ in range(6)]) for _ in range(rng.randint(0, 6))]
        want, gone, come = [], set(), set()
        for score, i, j in sorted((-x.alike(y), i, j) for i, x in enumerate(old) for j, y in enumerate(new)):
            if -score >= 0.5 and i not in gone and j not in come:
                want.append((i, j))
                gone.add(i)
                come.add(j)
        got = extract._most_alike(old, new, 0.5)
        assert [(old.index(x), new.index(y)) for x, y in got] == want


def test_moves_between_files(spark):
    rows = [("c1", "a.py", f"def f(rows):\n{BODY}", ""), ("c1", "b.py", "", f"def f(rows):\n{BODY}# end\n"), ("c2", "c.py", "", f"def f(rows):\n{BODY}")]
    files = spark.createDataFrame(rows, "sha string, " + FILES)
    changed = extract.changed_entities(files, keys=["sha"])
    assert sorted((r.sha, r.change_type) for r in changed.collect()) == [("c1", "added"), ("c1", "deleted"), ("c2", "added")]
    got = extract.moved_between(changed, ["sha"]).collect()
    assert sorted((r.sha, r.file_path, r.change_type, r.structural_change) for r in got) == [("c1", "b.py", "moved", False), ("c2", "c.py", "added", None)]
    assert next(r for r in got if r.sha == "c1").before_content.startswith("def f")


# ---------------------------------------------------------------- a review of a change


def test_an_added_function_is_reviewed_as_functional(spark):
    files = spark.createDataFrame([("main.rs", "", 'fn hello() {\n    println!("hello");\n}\n')], FILES)
    [row] = review.review_change(files).collect()
    assert (row.change_type, row.classification, row.entity_name, row.review_rank, row.group_id) == ("added", "functional", "hello", 1, 0)
    assert round(row.risk_score, 6) == 0.24 and row.risk_level == "low" and not row.is_public_api


def test_an_empty_change_has_no_reviews(spark):
    text = "fn hello() {}\n"
    files = spark.createDataFrame([("main.rs", text, text), ("b.rs", None, None), ("c.rs", "", "")], FILES)
    assert review.review_change(files).count() == 0
    assert review.review_change(files.limit(0)).count() == 0


def test_lower_case_entities_are_public_by_their_text(spark):
    texts = {"a.rs": "pub fn a() {\n    x()\n}", "b.rs": "pub(crate) fn b() {\n    x()\n}", "c.ts": "export function c() {\n  x()\n}", "d.rs": "fn d() {\n    pub_()\n}", "e.go": "func Run() {\n    x()\n}"}
    files = spark.createDataFrame([(k, None, v) for k, v in texts.items()], FILES)
    got = {r.file_path: (r.is_public_api, round(r.risk_score, 6)) for r in review.review_change(files).collect()}
    assert got == {"a.rs": (True, 0.36), "b.rs": (True, 0.36), "c.ts": (True, 0.36), "d.rs": (False, 0.24), "e.go": (True, 0.36)}


def test_cosmetic_changes_count_a_fifth(spark):
    files = spark.createDataFrame([("a.rs", "pub fn a() {\n    x() // one\n}", "pub fn a() {\n    x() // two\n}")], FILES)
    [row] = review.review_change(files).collect()
    assert row.structural_change is False and row.classification == "text" and round(row.risk_score, 6) == round((0.0 + 0.08 + 0.12) * 0.2, 6)


REPOSITORY = {
    "app/main.py": "from app.util import helper\n\ndef start(x):\n    return helper(x)\n\ndef stop(x):\n    return start(x)\n",
    "app/util.py": "def helper(x):\n    return x\n",
    "lib/util.py": "def helper(x):\n    return -x\n\ndef use(x):\n    return helper(x)\n",
    "lib/deep/job.py": "def job(x):\n    return helper(x)\n",
}


def test_a_review_in_the_graph_of_its_repository(spark):
    files = spark.createDataFrame([("app/util.py", "def helper(x):\n    return x + 1\n", REPOSITORY["app/util.py"]), ("app/main.py", REPOSITORY["app/main.py"].replace("return start(x)", "return None"), REPOSITORY["app/main.py"])], FILES)
    repository = spark.createDataFrame(list(REPOSITORY.items()), "file_path string, content string")
    rows = review.review_repository(files, repository).collect()
    got = {r.entity_name: r for r in rows}
    assert [r.review_rank for r in rows] == [1, 2] and set(got) == {"helper", "stop"}
    assert (got["helper"].dependent_count, got["helper"].blast_radius, got["helper"].dependency_count) == (1, 2, 0)
    assert (got["stop"].dependent_count, got["stop"].dependency_count) == (0, 1)
    assert (got["stop"].start_line, got["stop"].end_line) == (6, 7)
    assert got["helper"].group_id != got["stop"].group_id  # start, which ties them, isn't changed


def test_a_file_that_fails_is_no_unchanged_file(spark, tmp_path, monkeypatch):
    def broken(path, text):
        if "d2" in path:
            raise ValueError("cut off")
        return extract.outline(path, text)

    files = spark.createDataFrame([(f"d{i}.py", None, "def a():\n    return 1\n") for i in (1, 2)], FILES)
    with pytest.raises(Exception, match=r"file_path='d2.py': ValueError\('cut off'\)"):
        review.review_change(files, extractor=broken)
    assert [r.file_path for r in review.review_change(files.where("file_path = 'd1.py'"), extractor=broken).collect()] == ["d1.py"]
    repository = files.selectExpr("file_path", "after_content AS content")
    with pytest.raises(Exception, match="file_path='d2.py'"):
        review.review_repository(files.where("file_path = 'd1.py'"), repository, broken)
    with pytest.raises(Exception, match="sha='c1', file_path='d2.py'"):
        extract.changed_entities(files.selectExpr("'c1' AS sha", "*"), broken, ["sha"], skip_failed=False).collect()

    spark.createDataFrame([(1, "def a():\n    return 1\n"), (2, "def b():\n    return 2\n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    changed = extract.changed_entities
    monkeypatch.setattr(extract, "changed_entities", lambda rows, extractor=None, **kw: changed(rows, broken, **kw))
    for name in ("review_files", "extracted_entities"):
        with pytest.raises(Exception, match="file_path='(src/)?d2"):
            catalog.QUERIES[name](spark, str(tmp_path)).collect()


# ---------------------------------------------------------------- scopes


def test_names_resolve_by_file_then_import_then_folder(spark):
    repository = spark.createDataFrame(list(REPOSITORY.items()), "file_path string, content string")
    known = extract.entities(repository)
    edges = {(r.src, r.dst): r.found for r in symbols.scoped_edges(known, symbols.imports(repository)).collect()}
    name = lambda file, x: f"{file}::function::{x}"
    assert edges == {
        (name("app/main.py", "start"), name("app/util.py", "helper")): symbols.IMPORTED,
        (name("app/main.py", "stop"), name("app/main.py", "start")): symbols.OWN,
        (name("lib/util.py", "use"), name("lib/util.py", "helper")): symbols.OWN,
        (name("lib/deep/job.py", "job"), name("lib/util.py", "helper")): symbols.NEAREST,
    }


IMPORTING = {
    "src/a/x.py": "from . import y\nfrom ..b.z import Q\nimport os, sys\nimport pkg.deep.mod as m\n",
    "src/a/y.py": "", "src/b/z.py": "", "src/a/__init__.py": "", "lib/pkg/deep/mod.py": "",
    "web/app.ts": "import { a } from './parts/one';\nimport b from \"../shared\";\nconst c = require('./two.js');\n",
    "web/parts/one.tsx": "", "shared/index.ts": "", "web/two.js": "",
    "core/lib.rs": "mod graph;\nuse crate::graph::walk;\nuse std::fmt;\n", "core/graph.rs": "", "core/other.rs": "",
    "c/main.c": '#include "c/util.h"\n#include <stdio.h>\n', "c/util.h": "",
}


def test_imports_of_several_languages(spark):
    files = spark.createDataFrame(list(IMPORTING.items()), "file_path string, content string")
    got = {}
    for r in symbols.imports(files).collect():
        got.setdefault(r.file_path, set()).add(r.target_path)
    assert got == {
        "src/a/x.py": {"src/a/__init__.py", "src/b/z.py", "lib/pkg/deep/mod.py"},
        "web/app.ts": {"web/parts/one.tsx", "shared/index.ts", "web/two.js"},
        "core/lib.rs": {"core/graph.rs"},
        "c/main.c": {"c/util.h"},
    }
    assert symbols.imports(files.limit(0)).count() == 0


def test_scopes_of_odd_entities(spark):
    rows = [("1", None, None, None), ("2", "", "a.py", "foo"), ("3", "foo", "a.py", ""), ("4", "X::foo", "b/a.py", "foo foo"), ("5", "bar", "", "foo bar"), ("5", "bar", "", "foo bar")]
    df = spark.createDataFrame(rows, "entity_id string, entity_name string, file_path string, content string")
    got = {(r.src, r.dst, r.found) for r in symbols.scoped_edges(df).collect()}
    assert got == {("2", "3", symbols.OWN), ("5", "3", symbols.NEAREST)}
    assert symbols.scoped_edges(df.limit(0)).count() == 0


def test_ancestors(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("c.py",), ("a/c.py",)], "p string").select(symbols.ancestors(symbols.folder(F.col("p"))).alias("x"))
    assert [r.x for r in df.collect()] == [["a/b", "a", ""], [""], ["a", ""]]
