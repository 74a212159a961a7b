"""Joins on ends, ranges and parts against comparing all pairs; signatures; jobs; the search index; the review sink."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from deltascope.functions import signing
from deltascope.operators import diff, funnel, judge, matching, reviewer, search
from deltascope.streaming import jobs

# ---------------------------------------------------------------- signatures

# RFC 4231: key, data, HMAC-SHA-256.
RFC = [
    ("0b" * 20, b"Hi There".hex(), "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe".hex(), b"what do ya want for nothing?".hex(), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    ("aa" * 20, "dd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (bytes(range(1, 26)).hex(), "cd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
    ("aa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First".hex(), "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    ("aa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.".hex(), "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
]


def test_hmac_of_the_standard_and_of_odd_keys(spark):
    rows = [(bytes.fromhex(k), bytes.fromhex(d), m) for k, d, m in RFC]
    rng = random.Random(1)
    rows += [(k, d, hmac.new(k, d, hashlib.sha256).hexdigest()) for k, d in ((rng.randbytes(n), rng.randbytes(n * 3)) for n in (0, 1, 63, 64, 65, 200))]
    df = spark.createDataFrame(rows, "k binary, d binary, m string")
    assert df.where(signing.hmac_sha256(F.col("k"), F.col("d")) != F.col("m")).count() == 0
    assert spark.createDataFrame([(None, "x")], "k string, d string").select(signing.hmac_sha256(F.col("k"), F.col("d"))).first()[0] is None


def test_only_right_signatures_pass(spark):
    right = "sha256=" + hmac.new(b"key", "é{}".encode(), hashlib.sha256).hexdigest()
    heads = {right: True, right.upper().replace("SHA", "sha"): True, right[7:]: False, right[:-1]: False, right + "0": False, right[:-1] + ("0" if right[-1] != "0" else "1"): False, "sha1=" + right[7:]: False, "": False, None: False}
    df = spark.createDataFrame([(x, ok) for x, ok in heads.items()], "h string, ok boolean")
    got = df.select("ok", signing.is_signed(F.lit("é{}"), F.col("h"), F.lit("key")).alias("is")).collect()
    assert all(r.ok == r["is"] for r in got)
    assert not df.select(signing.is_signed(F.lit("é{}"), F.col("h"), F.lit("other")).alias("is")).where("is").count()
    assert not df.select(signing.is_signed(F.lit(None).cast("string"), F.col("h"), F.lit("key")).alias("is")).where("is").count()


# ---------------------------------------------------------------- ends, ranges, parts


def texts(rng, n):
    return ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 5))) for _ in range(n)] + [None, "", "😀a", "a😀a"]


@pytest.mark.parametrize("end", [True, False])
def test_ends_and_starts_equal_all_pairs(spark, end):
    rng = random.Random(3)
    a, b = ([(rng.randrange(2), x) for x in texts(rng, 60)] for _ in range(2))
    meet = matching.ends_meet if end else matching.starts_meet
    got = sorted(tuple(r) for r in meet(spark.createDataFrame(a, "k int, a string"), spark.createDataFrame(b, "k int, b string"), ["k"], "a", "b").collect())
    test = str.endswith if end else str.startswith
    assert got == sorted({(k, x, y) for k, x in a for j, y in b if k == j and x and y and (test(x, y) or test(y, x))})


def test_no_join_of_a_change_has_only_its_number_as_key(spark):
    rows = spark.createDataFrame([(1, "a/f.py", 90)], "pr_id long, file string, chunk_len int")
    plan = funnel.gap_files(rows, spark.createDataFrame([(1, "f.py")], "pr_id long, path string"))._jdf.queryExecution().analyzed().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and all("path#" in x or "file#" in x for x in joins)


def test_points_and_ranges_equal_all_pairs(spark):
    rng = random.Random(5)
    points = [(rng.choice("xy"), i, rng.randrange(200)) for i in range(120)]
    ranges = [(rng.choice("xy"), i, a, a + rng.randrange(-2, 150)) for i, a in enumerate(rng.randrange(200) for _ in range(60))]
    p, r = spark.createDataFrame(points, "k string, p long, at long"), spark.createDataFrame(ranges, "k string, r long, low long, high long")
    got = sorted((x.p, x.r) for x in matching.points_in_ranges(p, r, ["k"], "at", "low", "high").collect())
    assert got == sorted((i, j) for k, i, at in points for m, j, a, b in ranges if k == m and a <= at <= b)
    q = r.select("k", F.col("r").alias("q"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    got = sorted((x.r, x.q) for x in matching.ranges_meet(r, q, ["k"], ("low", "high"), ("l2", "h2")).collect())
    assert got == sorted((i, j) for k, i, a, b in ranges for m, j, c, d in ranges if k == m and a <= b and c <= d and a <= d and c <= b)


def test_a_file_of_a_hundred_thousand_findings(spark):
    found = spark.range(100_000).selectExpr("'big.py' AS file", "id AS pos", "id % 50000 AS line", "'bug' AS issue")
    known = spark.range(10_000).selectExpr("'big.py' AS file", "id * 5 + 1 AS start_line", "id * 5 + 4 AS end_line", "array('w' || id) AS ids")
    words = reviewer.enrich(found, known).where("issue <> 'bug'")
    assert words.count() == 100_000
    wrong = words.where("line % 5 <> 0 AND line > 0").withColumn("want", F.concat(F.lit("bug w"), F.floor((F.col("line") - 1) / 5).cast("string"))).where("issue <> want")
    assert wrong.count() == 0


def test_parts_equal_all_pairs(spark):
    rng = random.Random(7)
    a = [(rng.randrange(2), "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for _ in range(80)] + [(0, None), (0, "x😀yz")]
    b = [(rng.randrange(2), "".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))) for _ in range(40)] + [(0, None), (0, "😀yz"), (0, "")]
    got = sorted(tuple(r) for r in matching.parts_found(spark.createDataFrame(a, "k int, t string"), spark.createDataFrame(b, "k int, p string"), ["k"], "t", "p").collect())
    assert got == sorted({(k, x, y) for k, x in a for j, y in b if k == j and x is not None and y is not None and y in x})


def test_ten_thousand_names_in_one_change(spark):
    """Each name has one identifier inside it: as many pairs as names, not their square."""
    names = spark.range(10_000).selectExpr("1L AS k", "'handle_' || lpad(hex(xxhash64(id)), 16, '0') || '_end' AS t")
    asked = spark.range(10_000).selectExpr("1L AS k", "lpad(hex(xxhash64(id)), 16, '0') AS p")
    assert matching.parts_found(names, asked, ["k"], "t", "p").count() == 10_000


def test_names_judge_as_before(spark):
    gold = [(1, 1, "calls parseRow wrongly"), (2, 1, "the Loader is slow"), (3, 1, "nothing else here: zebra"), (4, 2, "some text"), (5, 3, "some text"), (6, 1, "see src_file name")]
    rows = [(1, ["row"], ["loader"], ["lib/src_file.py"], 3), (2, None, None, None, 2), (3, [], [], [], 0)]
    golden = spark.createDataFrame(gold, "gold_id long, pr_id long, note string")
    known = spark.createDataFrame(rows, "pr_id long, hc_names array<string>, all_names array<string>, hc_files array<string>, entity_count long")
    got = {r.gold_id: r.verdict for r in judge.judge_by_names(golden, known).collect()}
    assert got == {1: "match", 2: "match", 3: "partial", 4: "partial", 5: "miss", 6: "partial"}


def test_words_of_a_whole_file(spark):
    found = spark.createDataFrame([(1, "a.py", "bug", 1), (1, "none.py", "x", 2), (2, "a.py", None, 3)], "pr_id long, file string, issue string, pos long")
    known = spark.createDataFrame([(1, "src/a.py", "Loader", None, "def load(this, LIMIT): return parse_row(this) or it"), (1, "src/a.py", "", "older_text_here", ""), (2, "b/a.py", None, None, None)], "pr_id long, file_path string, entity_name string, before_content string, after_content string")
    got = {r.pos: r.issue for r in reviewer.enrich_by_file(found, known, limit=3).collect()}
    assert got == {1: "bug [ctx: older_text_here, parse_row, Loader]", 2: "x", 3: None}


# ---------------------------------------------------------------- the search index


def test_the_index_finds_what_a_search_finds(spark):
    rows = [(1, "Alpha beta\ngamma"), (2, "ALPHA\nbet a"), (3, None), (4, ""), (5, "x😀yz alphabet"), (6, "ab")]
    df = spark.createDataFrame(rows, "file long, text string")
    with search.index(df, buckets=16) as index:
        for pattern in ("alpha", "bet", "ab", "a", "😀yz", "none", "a\tb"):
            for exact in (False, True):
                key = lambda r: (r.file, r.line, r.col, r.text)
                assert sorted(map(key, index.grep(pattern, case_sensitive=exact).collect())) == sorted(map(key, diff.grep(df, pattern, case_sensitive=exact).collect())), pattern
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else buckets are left out without a word
        plan = index.candidates("alp")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert "SelectedBucketsCount: 1 out of 16" in plan
    assert not spark.catalog.tableExists(index.table)


def test_the_index_has_few_rows_and_loses_none(spark, monkeypatch):
    """A row for each gram of a piece of texts, not for each gram of a text; a text may be longer than a piece, and given in parts."""
    monkeypatch.setattr(search, "PIECE_BYTES", 1000)
    rows = [(str(i), "the same words in all of them, " * 3 + f"no {i}") for i in range(500)] + [("long", "x" * 5000 + "Needle" + "y" * 5000), ("parts", "one need"), ("parts", "le, no: needle")]
    df = spark.createDataFrame(rows, "file string, text string").coalesce(1)
    with search.index(df, buckets=4) as index:
        assert {(r.file, r.col) for r in index.grep("needle").collect()} == {("long", 5001), ("parts", 9)}
        assert {r.file for r in index.grep("no 499").collect()} == {"499"}
    monkeypatch.setattr(search, "PIECE_BYTES", 1 << 20)
    with search.index(df, buckets=4) as index:
        assert spark.table(index.table).count() < 1000  # a row for each text and gram was over 10,000


# ---------------------------------------------------------------- jobs

EVENTS = "job_id long, status string, at timestamp, seq long"


def fold(events, now, timeout):
    out = {}
    for job in {e[0] for e in events}:
        status, illegal, at = None, 0, None
        for _, new, when, _ in sorted((e for e in events if e[0] == job), key=lambda e: (e[2], e[3])):
            at = when
            if new in jobs.NEXT[status]:
                status = new
            elif new != status:
                illegal += 1
        out[job] = (status, illegal, status not in jobs.ENDED and (now - at).total_seconds() > timeout)
    return out


def some_events(rng, n):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    out = []
    for job in range(n):
        at = start + timedelta(minutes=rng.randrange(600))
        way = list(jobs.STATUSES[: rng.randint(1, 4)]) + ([] if rng.random() < 0.5 else ["failed"])
        if rng.random() < 0.4:
            way.insert(rng.randrange(len(way) + 1), rng.choice(jobs.STATUSES))
        for i, status in enumerate(way):
            at += timedelta(seconds=rng.randrange(0, 90))
            out += [(job, status, at, i)] * (2 if rng.random() < 0.2 else 1)
    return out


def test_states_equal_a_plain_fold(spark):
    events = some_events(random.Random(2), 60)
    rng = random.Random(9)
    rng.shuffle(events)
    now = max(e[2] for e in events)
    got = {r.job_id: (r.status, r.illegal, r.timed_out) for r in jobs.states(spark.createDataFrame(events, EVENTS), "1 hour").collect()}
    assert got == fold(events, now, 3600)
    assert jobs.states(spark.createDataFrame([], EVENTS), "1 hour").count() == 0


def test_the_stream_gives_the_states_of_the_fold(spark, tmp_path):
    """Files in order of time, with repeated rows and one file far too late; jobs that never end are given up."""
    from datetime import timedelta

    events = sorted(some_events(random.Random(4), 25), key=lambda e: (e[2], e[3]))
    last = events[-1][2]
    late = (0, "failed", events[0][2] - timedelta(days=2), 99)
    closing = (999, "pending", last + timedelta(days=1), 0)  # moves the watermark past all timers
    source, key = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {}
    (tmp_path / "in").mkdir()

    def keep(batch, _):
        for r in batch.collect():
            got[r.job_id] = (r.status, r.illegal, r.timed_out)

    try:
        stream = jobs.state_stream(spark.readStream.schema(EVENTS).parquet(source), 3_600_000)
        third = len(events) // 3
        for i, rows in enumerate((events[:third], events[third : 2 * third], events[2 * third :], [late], [closing], [(998, "pending", closing[2], 0)])):
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
            query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(240)
            assert query.exception() is None, i
    finally:
        spark.conf.set(key, before)
    want = fold(events, closing[2], 3600)
    assert {k: v for k, v in got.items() if k < 900} == want


# ---------------------------------------------------------------- the review sink


def arrived(root):
    import collections
    import json

    return collections.Counter((f.parent.name, json.loads(f.read_text())["comments"][0]["body"]) for f in root.glob("*-*/*.json"))


def written(tmp_path):
    import json

    return sorted((x["state"], x["sent"], x["known"], len(x["failed"])) for x in (json.loads(f.read_text()) for f in (tmp_path / "log").glob("*.json")))


def test_each_review_arrives_once(spark, tmp_path):
    """A worker dies after posting; the task, or the whole write, runs again."""
    from deltascope.sinks import outputs, posted

    root = tmp_path / "host"
    root.mkdir()
    comments = spark.createDataFrame([("o/r", n, "f.py", 1, f"text {n}") for n in range(12)], "repo string, number long, path string, line long, body string")
    payloads = outputs.review_payloads(comments).repartition(3)
    spark.dataSource.register(posted.PostedSink)
    write = lambda **options: payloads.write.format("review_posts").options(client="tests.posting_host:FolderHost", root=str(root), log=str(tmp_path / "log"), **options).mode("append").save()
    for _ in range(12):
        try:
            write(fail_after_posting="4")
            break
        except Exception:  # noqa: BLE001  a local master doesn't run a failed task again
            continue
    assert sum(arrived(root).values()) == 12 and set(arrived(root).values()) == {1}
    write()
    assert set(arrived(root).values()) == {1} and ("committed", 0, 12, 0) in written(tmp_path)


def test_reviews_that_fail_are_told(spark, tmp_path):
    from deltascope.sinks import posted

    root = tmp_path / "host"
    root.mkdir()
    body = '{"event": "COMMENT", "comments": [{"body": "x"}]}'
    rows = spark.createDataFrame([("down/down", 1, body), ("o/r", 2, body), ("o/r", 2, body)], "repo string, number long, payload string").coalesce(1)
    spark.dataSource.register(posted.PostedSink)
    sink = rows.write.format("review_posts").options(client="tests.posting_host:FolderHost", root=str(root), log=str(tmp_path / "log")).mode("append")
    sink.save()
    assert written(tmp_path) == [("committed", 1, 1, 1)] and sum(arrived(root).values()) == 1
    with pytest.raises(Exception, match="weren't sent"):
        sink.option("fail_on_error", "true").save()
    assert [x[0] for x in written(tmp_path)] == ["aborted", "committed"]
