"""Queries that must take in whole tables."""

import os
import re

import pytest

from deltascope.operators import judge
from deltascope.plans import catalog

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables here")


def test_triage_has_every_entity_at_medium_or_above(spark):
    want = {r.entity_id for r in catalog.QUERIES["risk_score"](spark, LARGER).where("risk_rank >= 1").collect()}
    got = catalog.QUERIES["triage"](spark, LARGER).collect()
    assert len(want) > 200 and len(got) == len(want) and {r.entity_id for r in got} == want
    assert [r.risk_score for r in got] == sorted((r.risk_score for r in got), reverse=True)


def identifiers(text):
    found = [x for p in (*judge.IDENTIFIER_PATTERNS, *judge.QUOTED_PATTERNS) for x in re.findall(p, text or "")]
    return sorted({x for x in found if len(x) >= 3 and x.lower() not in judge.STOP_WORDS})


def test_identifiers_of_documents_in_any_script(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, "ärger_x getÜber fooBar été_val Éclair snake_case 'naïve x'"), (-3, ""), (-4, "日本foo foo日本 x²bar `日本 x`")], "doc_id long, text string")
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    assert any(not r.text.isascii() for r in rows if r.text and r.doc_id >= 0)
    got = {r.doc_id: (r.n, r.ids) for r in catalog.QUERIES["extract_identifiers"](spark, str(tmp_path)).collect()}
    want = {r.doc_id: identifiers(r.text) for r in rows}
    assert got == {i: (len(x), ",".join(x)) for i, x in want.items()}


def test_names_come_from_all_findings(spark, tmp_path):
    rows = [(1, 1, "purchase", 95.0), (37, 1, "purchase", 5.0), (2, 2, "view", 10.0), (74, 2, "click", 5.0), (111, 3, "click", 5.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.gold_id: r.verdict for r in catalog.QUERIES["judge_names"](spark, str(tmp_path)).collect()}
    assert got == {37: "match", 74: "partial", 111: "miss"}
