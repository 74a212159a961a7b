"""What grows with the input neither passes through the driver nor is made twice."""

import os

import pytest

from deltascope.operators import extract, graph, review, reviewer, symbols, triage
from deltascope.plans import catalog

DATA = "/root/testdata/sf0.001"


def plans(spark, run):
    """The plans that ran during ``run``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    known = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = store.executionsList(int(known), 100_000)
    return [new.apply(i).physicalPlanDescription() for i in range(new.size())]


def test_components_send_no_labels_through_the_driver(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "entity_id string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("e", "f"), ("f", "e")], "src string, dst string")
    found = {}
    ran = plans(spark, lambda: found.update((r.entity_id, r.component) for r in graph.components(nodes, graph.changed_edges(edges, nodes)).collect()))
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e"}
    assert ran and not [x for x in ran if "BroadcastExchange" in x]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_scores_make_the_edges_once(spark):
    catalog._SCORED.clear()
    ran = plans(spark, lambda: catalog.scored(spark, DATA))
    assert len([x for x in ran if "lineitem.parquet" in x]) == 1


def test_commit_metrics_count_entities_that_come_twice_once(spark):
    row = lambda sha, x, file, group: (sha, x, file, group, False, 2, 3, 1)
    rows = [row(1, "a", "f", "g"), row(1, "a", "f", "g"), row(1, "b", "f", "h"), row(1, "c", None, "g"), row(2, "a", "f", "g")]
    touched = spark.createDataFrame(rows, "sha long, entity_id string, file_path string, component string, structural_change boolean, risk_rank int, blast_radius long, dependent_count long")
    got = {r.sha: r for r in triage.commit_bench(touched).collect()}
    assert (got[1].entity_count, got[1].file_count, got[1].group_count, got[1].cosmetic_count, got[1].with_dependents) == (3, 1, 2, 3, 3)
    assert (got[2].entity_count, got[2].file_count, got[2].group_count, got[2].max_blast_radius) == (1, 1, 1, 3)


def test_scoped_edges_take_texts_apart_once(spark, tmp_path):
    rows = [("a", "alpha", "s/x.py", "alpha beta gamma"), ("b", "beta", "s/y.py", "beta alpha alpha"), ("c", "gamma", "t/z.py", "nothing")]
    spark.createDataFrame(rows, "entity_id string, entity_name string, file_path string, content string").write.parquet(f"{tmp_path}/texts")
    found = {}
    ran = plans(spark, lambda: found.update(((r.src, r.dst), r.found) for r in symbols.scoped_edges(spark.read.parquet(f"{tmp_path}/texts")).collect()))
    assert found == {("a", "b"): symbols.NEAREST, ("a", "c"): symbols.NEAREST, ("b", "a"): symbols.NEAREST}
    # once for the definitions and once for the words, each in the first and the final plan
    assert sum(x.count(f"{tmp_path}/texts") for x in ran) <= 4


def test_texts_of_a_review_stay_behind(spark):
    files = spark.createDataFrame([(f"f{i}.py", f"def a{i}():\n    return {i}\n", f"def a{i}():\n    return {i + 1}\n") for i in range(5)], "file_path string, before_content string, after_content string")
    found = []
    ran = plans(spark, lambda: found.extend(review.review_change(files).collect()))
    assert {(r.file_path, r.before_content[:6], r.after_content[-2:]) for r in found} == {(f"f{i}.py", f"def a{i}", f" {i + 1}") for i in range(5)}
    written = [x for x in ran if "InsertIntoHadoopFsRelationCommand" in x and "before_content" in x]
    assert len(written) == 1


def test_equal_entities_are_not_taken_apart(monkeypatch):
    asked = []
    monkeypatch.setattr(extract.lexing, "tokens", lambda text, path="": asked.append(text) or text.split())
    assert extract.compare("a.py", "def a():\n    x\ndef b():\n    y", "def a():\n    x\ndef b():\n    z", extract.outline)[0][4] == "modified"
    assert sorted(asked) == ["def b():\n    y", "def b():\n    z"]


def test_words_of_files_are_gathered_once(spark):
    found = spark.createDataFrame([(1, "a.py", "bug", 1), (1, "b.py", "x", 2)], "pr_id long, file string, issue string, pos long")
    known = spark.createDataFrame([(1, "src/a.py", "Loader", "", "parse_row(this)"), (1, "b/a.py", None, "older_text", None), (1, "b.py", None, None, "1")], "pr_id long, file_path string, entity_name string, before_content string, after_content string")
    got = {}
    ran = plans(spark, lambda: got.update((r.pos, r.issue) for r in reviewer.enrich_by_file(found, known).collect()))
    assert got == {1: "bug [ctx: older_text, parse_row, Loader]", 2: "x"}
    assert len([x for x in ran if "regexp_extract_all" in x]) == 1
