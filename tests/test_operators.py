import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from deltascope.functions import scoring
from deltascope.operators import diff, funnel, graph, judge, render, triage
from deltascope.streaming import jobs


def test_groups_of_a_chain_and_of_none(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.components(nodes, none).select("component").distinct().count() == 3
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert {r.component for r in graph.components(nodes, chain).collect()} == {"a"}


def test_components_and_reach_of_random_graphs(spark):
    rng = random.Random(2)
    ids = [f"n{i}" for i in range(40)]
    edges = {(rng.choice(ids), rng.choice(ids)) for _ in range(30)}
    edges = {(a, b) for a, b in edges if a != b} | {("n0", "n1"), ("n1", "n0")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in ids], "entity_id string")

    def reach(start, pairs):
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if b == x and a not in seen:
                    seen.add(a)
                    todo.append(a)
        return seen - {start}

    both = edges | {(b, a) for a, b in edges}
    got = {r.entity_id: r.component for r in graph.components(nodes, df).collect()}
    assert got == {x: min(reach(x, both) | {x}) for x in ids}
    blast = {r.entity_id: r.blast_radius for r in graph.blast_radius(df, nodes).collect()}
    assert blast == {x: len(reach(x, edges)) for x in ids if reach(x, edges)}
    assert max(r.blast_radius for r in graph.blast_radius(df, nodes, cap=2).collect()) <= 2


def reach_of(ids, edges):
    step = {}
    for a, b in edges:
        step.setdefault(b, set()).add(a)
    out = {}
    for x in ids:
        seen, todo = set(), [x]
        while todo:
            new = step.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[x] = len(seen - {x})
    return out


def graphs():
    rng = random.Random(6)
    ring = [(f"r{i}", f"r{(i + 1) % 14}") for i in range(14)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(4)]
    two = [(f"s{i}", f"s{(i + 1) % 9}") for i in range(9)] + [("s0", "r3"), ("r5", "c0"), ("x", "s4"), ("y", "y")]
    some = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)]
    fan = [(f"f{i}", "hub") for i in range(40)] + [("hub", f"g{i}") for i in range(10)]
    return {"chain of rings": (ring + chain + two, [(4, 10_000), (5, 12)]), "random": (some, [(64, 10)]), "fan": (fan, [(5, 12)]), "none": ([], [(4, 10)])}


@pytest.mark.parametrize("name", graphs())
def test_reach_equals_brute_force_for_any_sketch_and_cap(spark, name):
    edges, settings = graphs()[name]
    ids = sorted({x for e in edges for x in e} | {"alone"})
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in ids], "entity_id string")
    want = {k: v for k, v in reach_of(ids, edges).items() if v}
    for k, cap in settings:
        got = {r.entity_id: r.blast_radius for r in graph.blast_radius(df, nodes, cap=cap, k=k).collect()}
        assert got == {x: min(n, cap) for x, n in want.items()}, (k, cap)


def test_reach_in_one_cycle_writes_no_pairs(spark, monkeypatch):
    """A ring of 400 with a tail: all pairs would be 160,000 rows."""
    edges = [(f"r{i}", f"r{(i * 7 + 1) % 400}") for i in range(400)] + [(f"r{i}", f"r{(i + 1) % 400}") for i in range(400)] + [("t", "r1")]
    rows, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(x,) for x in ids], "entity_id string")
    got = {r.entity_id: r.blast_radius for r in graph.blast_radius(spark.createDataFrame(edges, "src string, dst string"), nodes, k=8).collect()}
    assert got == {k: v for k, v in reach_of(ids, edges).items() if v} and max(rows) <= 8 * 401
    assert sum(rows) < 80_000


def test_operators_leave_one_table(spark):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    before = len(list(folder.iterdir()))
    assert {r.entity_id: r.blast_radius for r in graph.blast_radius(edges, nodes).collect()} == {"b": 1, "c": 2}
    assert len(list(folder.iterdir())) == before + 1
    graph.components(nodes, edges).collect()
    assert len(list(folder.iterdir())) == before + 2


def test_a_hubs_neighbours_are_the_first_by_name(spark):
    edges = spark.createDataFrame([(f"e{i}", "hub") for i in range(200)], "src string, dst string")
    entities = spark.createDataFrame([(f"e{i}", f"name{i:03}", "f") for i in range(200)], "entity_id string, entity_name string, file_path string")
    [row] = graph.neighbours(edges, entities, incoming=True, limit=10).collect()
    assert [x.name for x in row.neighbours] == [f"name{i:03}" for i in range(10)]


PATCHES = [(1, "@@ -10,3 +10,4 @@\n a\n-b\n+c\n+d\n e"), (2, "noise\n@@ -1,2 +1,3 @@ fn\n x\n+y\n z\n@@ -20 +21,2 @@\n p\n+q"), (3, "@@ -0,0 +1,3 @@\n+a\n+b\n+c\n\\ No newline")]


def test_patch_lines(spark):
    df = spark.createDataFrame(PATCHES, "patch_id long, patch string")
    parsed = diff.parse_patch(df)
    lines = {r.patch_id: list(r.lines) for r in diff.commentable_lines(parsed).collect()}
    assert lines[1] == [10, 11, 12, 13] and lines[2] == [1, 2, 3, 21, 22] and lines[3][:3] == [1, 2, 3]
    old = [r.old_line for r in parsed.where("patch_id = 1").orderBy("pos").collect()]
    assert old == [10, 11, None, None, 12]


def test_raw_diff_drops_deleted_files(spark):
    raw = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/y b/y\ndeleted file mode 1\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-q"
    df = spark.createDataFrame([(1, raw)], "pr_id long, diff string")
    assert [(r.file, r.patch) for r in diff.parse_raw_diff(df).collect()] == [("x", "@@ -1 +1 @@\n-a\n+b")]


def test_grep_counts_bytes_and_clamps_context(spark):
    df = spark.createDataFrame([("f", "é Foo\nb\nfoo foo")], "file string, text string")
    got = [tuple(r) for r in diff.grep(df, "foo", context=1).orderBy("line").collect()]
    assert got == [("f", 1, 4, "é Foo", "", "b"), ("f", 3, 1, "foo foo", "b", "")]


def words_of(text):
    plain = set("the and for not but with this that from are was were been being have has had does did will would could should may might can shall must need null undefined error function method class variable parameter return value type file line code issue bug check missing unused added removed changed instead when where which what there here also only".split())
    return {w for w in re.findall(r"[A-Za-z0-9_]+", text) if len(w) > 2 and not w[0].isdigit() and w not in plain}


def test_greedy_merge_takes_the_first_kept_finding_that_fits(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), f"f{rng.randint(0, 1)}", rng.choice([None, *range(0, 900)]), i, rng.choice([None, "", "e1", "e2"]) if i % 5 == 0 else None, " ".join(rng.choice(["alphaOne", "betaTwo", "gamma_x", "the", "zz", "deltaFour", "line", "x9y"]) for _ in range(rng.randint(0, 5)))) for i in range(240)]
    df = spark.createDataFrame(rows, "pr_id long, file string, line long, pos long, entity_name string, issue string")
    want, merged_by_entity = [], 0
    for key in {(r[0], r[1]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (r[2] or 0, r[3])):
            fits = []
            for k in kept:
                near, shared = abs((k[2] or 0) - (r[2] or 0)) < 21, len(words_of(k[5]) & words_of(r[5])) > 1
                merged_by_entity += bool(r[4]) and r[4] == k[4] and not near and not shared
                fits.append(near or shared or (bool(r[4]) and r[4] == k[4]))
            if True not in fits:
                kept.append(r)
            elif len(r[5]) > len(kept[fits.index(True)][5]):
                kept[fits.index(True)] = r
        want += [(r[0], r[1], r[2] or 0, r[3], r[5], r[4] or "") for r in kept]
    assert merged_by_entity
    assert sorted(tuple(r) for r in funnel.dedup_greedy(df).collect()) == sorted(want)
    assert funnel.dedup_greedy(df.drop("entity_name").limit(0)).count() == 0


def taken_turns(queues, limit):
    """Who is served, one turn at a time."""
    queues, out, turn = [list(q) for q in queues], [], 0
    while queues and len(out) < limit:
        at = turn % len(queues)
        if queues[at]:
            out.append(queues[at].pop(0))
            turn += 1
        else:
            del queues[at]
    return out


def test_turns_over_files(spark):
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(0, 7) for _ in range(rng.randint(0, 7))]
        limit = rng.choice([0, 3, 9, 30])
        queues = [[(q, n) for n in range(size)] for q, size in enumerate(sizes)]
        got = funnel.turn_ranks(sizes, limit)
        assert [x[:2] for x in got] == taken_turns(queues, limit) and [x[2] for x in got] == list(range(len(got)))
    rows = [(1, "a1", "A", 0.9, 1), (1, "a2", "A", 0.8, 2), (1, "b1", "B", 0.7, 3), (1, "a3", "A", 0.6, 4), (2, "z", "Z", 0.1, 5)]
    df = spark.createDataFrame(rows, "pr_id long, entity_id string, file_path string, risk_score double, change_seq long")
    assert [(r.entity_id, r.rank) for r in funnel.round_robin_exact(df).where("pr_id = 1").orderBy("rank").collect()] == [("a1", 1), ("b1", 2), ("a2", 3), ("a3", 4)]
    assert [r.entity_id for r in funnel.round_robin(df).where("pr_id = 1").orderBy("rank").collect()] == ["a1", "b1", "a2", "a3"]


def test_identifiers(spark):
    df = spark.createDataFrame([("The `my var` in FooBar.baz calls getUser and 'x-y' with snake_case",)], "t string")
    assert set(df.select(judge.identifiers(F.col("t"))).first()[0]) == {"my var", "FooBar.baz", "baz", "getUser", "x-y", "snake_case", "calls", "var"}


def test_latest_status_in_batch_and_stream(spark, tmp_path):
    rows = [(1, "pending", "2024-01-01 00:00:00", 1), (1, "complete", "2024-01-01 00:05:00", 2), (2, "failed", "2024-01-01 00:00:00", 4), (2, "pending", "2024-01-01 00:00:00", 3)]
    df = spark.createDataFrame(rows, "job_id long, status string, at string, seq long").withColumn("at", F.to_timestamp("at"))
    want = {(1, "complete"), (2, "failed")}
    assert {(r.job_id, r.status) for r in jobs.latest_status(df).collect()} == want
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = jobs.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    run.processAllAvailable()
    run.stop()
    assert {(r.job_id, r.status) for r in spark.table("latest").collect()} == want
    assert jobs.windowed_counts(df).count() == 3


def test_groups_have_labels_of_any_length(spark):
    deep = "d/" * 400
    rows = [("a", "x", deep + "p.py", 0.9, 1), ("b", "y", deep + "q.py", 0.8, 2), ("c", "solo", "m.py", 0.7, 3), ("e", "u", "k.py", 0.1, 4), ("f", "v", "z.py", 0.2, 5)]
    df = triage.ranked(spark.createDataFrame(rows, "entity_id string, entity_name string, file_path string, risk_score double, change_seq long"))
    assert [r.entity_id for r in df.orderBy("review_rank").collect()] == ["a", "b", "c", "f", "e"]
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("e", "e"), ("f", "e")], "entity_id string, component string")
    assert [(r.group_id, r.label, r.size) for r in graph.groups(df, members).orderBy("group_id").collect()] == [(0, deep, 2), (1, "2 entities", 2), (2, "solo", 1)]


def test_truncated_text_keeps_whole_characters(spark):
    part = lambda name, body: f"diff --git a/{name} b/{name}\n--- a/{name}\n+++ b/{name}\n@@ -1 +1 @@\n{body}"
    small, large = part("a.py", "+x"), part("b.py", "+" + "é" * 500)
    df = spark.createDataFrame([(1, small), (2, small + "\n" + large), (3, large)], "pr_id long, diff string")
    for limit in (150, 151):
        got = {r.pr_id: (r.kind, r.text) for r in diff.truncated_text(df, limit).collect()}
        assert got[1] == ("whole", small) and got[2] == ("parts", small + "\n")
        assert got[3][0] == "prefix" and large.startswith(got[3][1]) and limit - 1 <= len(got[3][1].encode()) <= limit


def test_patterns_outside_the_change(spark):
    change = spark.createDataFrame([("a.py", "x\nfoo")], "file string, text string")
    fragments = spark.createDataFrame([("a.py", 0, "foo"), ("b.py", 0, "no\nFoo"), ("b.py", 1, "foo"), ("dist/c.js", 0, "foo")], "file string, fragment int, text string")
    got = diff.grep_everywhere(change, fragments, "foo")
    assert sorted((r.file, r.line) for r in got.collect()) == [("a.py", 2), ("b.py", 1), ("b.py", 2)]
    assert render.matches(diff.first_matches(got, 2).collect()) == "a.py:2:foo\n\nb.py:1:foo\n\n2 matches across 2 files"
    around = diff.grep(change, "foo", context=1).collect()
    assert render.matches(around) == "a.py:1- x\na.py:2:foo\na.py:3- \n\n1 matches across 1 files" or render.matches(around).startswith("a.py:1- x\na.py:2:foo")


def test_white_space_of_any_script_is_trimmed(spark):
    df = spark.createDataFrame([("\u00a0 a\u3000\t", "a")], "b string, a string")
    assert df.select(scoring.classify(F.col("b"), F.col("a"), F.lit(None).cast("boolean"))).first()[0] == "text"
