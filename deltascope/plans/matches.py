"""Queries of signed events, joins on ends and ranges, enrichment by file, jobs as state machines, indexed search."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from deltascope.functions import signing
from deltascope.operators import agent, matching, reviewer, search
from deltascope.plans.catalog import FOUND, GOLD, query
from deltascope.sources import files
from deltascope.sources import tables as t
from deltascope.streaming import jobs

SECRET = "a secret that is longer than one block of the hash, so that it is hashed itself"


def _pad(byte: int) -> str:
    key = SECRET.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    return bytes(x ^ byte for x in key.ljust(64, b"\0")).hex()


_PAYLOAD = "'{\"id\": ' || CAST(event_id AS VARCHAR(12)) || ', \"action\": \"' || event_type || '\"}'"
_HMAC = f"sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(payload))))"


@query(f"WITH e AS (SELECT event_id, {_PAYLOAD} AS payload FROM events), s AS (SELECT event_id, {_HMAC} AS mac FROM e) SELECT event_id, mac, event_id % 7 NOT IN (0, 1, 2, 3) AS valid FROM s")
def webhook_signatures(spark, sf_dir):
    """Payloads with right signatures, and with missing, cut, foreign and bare ones."""
    e = t.table(spark, sf_dir, "events").selectExpr("event_id", f"{_PAYLOAD} AS payload").withColumn("mac", signing.hmac_sha256(F.lit(SECRET), F.col("payload")))
    kind, right = F.col("event_id") % 7, F.concat(F.lit("sha256="), "mac")
    other = F.concat(F.lit("sha256="), signing.hmac_sha256(F.lit("other"), F.col("payload")))
    header = F.when(kind == 0, None).when(kind == 1, F.left(right, F.lit(70))).when(kind == 2, other).when(kind == 3, F.col("mac")).when(kind == 4, F.concat(F.lit("sha256="), F.upper("mac"))).otherwise(right)
    return e.select("event_id", "mac", signing.is_signed(F.col("payload"), header, F.lit(SECRET)).alias("valid"))


# ---------------------------------------------------------------- ends and ranges

_TITLE = "replace(p_name, ' ', '  ') || CASE p_partkey % 3 WHEN 0 THEN ' and a longer end of this title' ELSE '' END"
_PULLS = f"SELECT p_brand AS repo, p_partkey AS number, CASE p_partkey % 10 WHEN 0 THEN substr({_TITLE}, 1, 12) ELSE {_TITLE} END AS title FROM part"
_SETS = f"SELECT p_partkey AS gold_id, CASE p_partkey % 4 WHEN 0 THEN {_TITLE} || ' more' WHEN 1 THEN substr({_TITLE}, 1, 20) ELSE {_TITLE} END AS title FROM part WHERE p_size % 2 = 0"


@query(f"WITH p AS ({_PULLS}), g AS ({_SETS}) SELECT repo, number, p.title, min(gold_id) AS gold_id FROM p JOIN g ON p.title = g.title OR starts_with(p.title, substr(g.title, 1, 40)) OR starts_with(g.title, substr(p.title, 1, 40)) GROUP BY repo, number, p.title")
def title_matches(spark, sf_dir):
    """Pull requests and the first golden set of their title."""
    part = t.table(spark, sf_dir, "part")
    part.createOrReplaceTempView("part_titles")
    pulls, sets = (spark.sql(x.replace("FROM part", "FROM part_titles")) for x in (_PULLS, _SETS))
    return files.match_titles(pulls, sets)


@query(f"WITH f AS ({FOUND}), g AS ({GOLD}) SELECT f.pos, g.gold_id FROM f JOIN g ON f.pr_id = g.pr_id AND g.path = 'src/' || f.file AND f.line BETWEEN g.from_line AND g.to_line")
def findings_in_ranges(spark, sf_dir):
    """Findings whose line lies in a golden range of the same file."""
    found = t.findings(spark, sf_dir).withColumn("path", F.concat(F.lit("src/"), "file")).select("pr_id", "path", "pos", "line")
    return matching.points_in_ranges(found, t.golden(spark, sf_dir).select("pr_id", "path", "gold_id", "from_line", "to_line"), ["pr_id", "path"], "line", "from_line", "to_line").select("pos", "gold_id")


@query(f"WITH g AS ({GOLD}), h AS (SELECT gold_id, 'x' || CAST(gold_id % 3 AS VARCHAR(9)) AS k, from_line, to_line + gold_id % 40 AS to_line FROM g) SELECT a.gold_id AS a, b.gold_id AS b FROM h a JOIN h b ON a.k = b.k AND a.gold_id % 2 = 0 AND b.gold_id % 2 = 1 AND a.from_line <= b.to_line AND b.from_line <= a.to_line")
def overlapping_ranges(spark, sf_dir):
    """Pairs of golden ranges with a line in common."""
    rows = t.golden(spark, sf_dir).select("gold_id", F.concat(F.lit("x"), (F.col("gold_id") % 3).cast("string")).alias("k"), "from_line", (F.col("to_line") + F.col("gold_id") % 40).alias("to_line"))
    side = lambda n, x: rows.where(F.col("gold_id") % 2 == n).select("k", F.col("gold_id").alias(x), F.col("from_line").alias(f"{x}_low"), F.col("to_line").alias(f"{x}_high"))
    return matching.ranges_meet(side(0, "a"), side(1, "b"), ["k"], ("a_low", "a_high"), ("b_low", "b_high")).select("a", "b")


_KNOWN = "SELECT user_id AS pr_id, 'src/f' || CAST(event_id % 9 AS VARCHAR(9)) || '.py' AS file_path, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type || 'Of' || CAST(event_id % 11 AS VARCHAR(9)) END AS entity_name, CASE event_id % 5 WHEN 0 THEN NULL ELSE 'return self.value' || CAST(event_id % 23 AS VARCHAR(9)) || '(MAXIMUM, it, class_' || event_type || ')' END AS before_content, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'static ' || event_type || '_after' || CAST(event_id % 13 AS VARCHAR(9)) || ' + none' END AS after_content FROM events"


@query(f"""WITH f AS ({FOUND}), k AS ({_KNOWN}),
w AS (SELECT DISTINCT pr_id, file_path, unnest(list_concat(list_filter(regexp_extract_all(coalesce(nullif(after_content, ''), nullif(before_content, ''), ''), '\\b[a-zA-Z_][a-zA-Z0-9_]{{3,}}\\b'), lambda x: upper(x) <> x AND x NOT IN {reviewer.COMMON_WORDS}), CASE WHEN coalesce(entity_name, '') <> '' THEN [entity_name] ELSE [] END)) AS word FROM k),
top AS (SELECT *, row_number() OVER (PARTITION BY pr_id, file ORDER BY length(word) DESC, word) AS rn FROM (SELECT DISTINCT f.pr_id, f.file, word FROM (SELECT DISTINCT pr_id, file FROM f) f JOIN w ON w.pr_id = f.pr_id AND ends_with(w.file_path, f.file))),
txt AS (SELECT pr_id, file, string_agg(word, ', ' ORDER BY rn) AS words FROM top WHERE rn <= 20 GROUP BY pr_id, file)
SELECT pos, issue || CASE WHEN words IS NULL THEN '' ELSE ' [ctx: ' || words || ']' END AS issue FROM f LEFT JOIN txt USING (pr_id, file)""")
def enrich_by_file(spark, sf_dir):
    """Findings with the twenty longest identifiers of their file."""
    t.table(spark, sf_dir, "events").createOrReplaceTempView("events_known")
    known = spark.sql(_KNOWN.replace("FROM events", "FROM events_known"))
    return reviewer.enrich_by_file(t.findings(spark, sf_dir), known).select("pos", "issue")


# ---------------------------------------------------------------- jobs

_STATUS = "CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'analyzing' WHEN 2 THEN 'reviewing' WHEN 3 THEN 'complete' ELSE CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'pending' END END"


@query(f"""WITH e AS (SELECT user_id AS job_id, list(list_position(['pending', 'analyzing', 'reviewing', 'complete', 'failed'], {_STATUS}) ORDER BY ts, event_id) AS l, max(ts) AS last FROM events GROUP BY user_id),
r AS (SELECT job_id, last, list_reduce(list_prepend(0, l), lambda a, x: CASE WHEN a % 10 = x THEN a WHEN (a % 10 < 4 AND x = a % 10 + 1 AND x < 5) OR (a % 10 BETWEEN 1 AND 3 AND x = 5) THEN a - a % 10 + x ELSE a + 10 END) AS z FROM e)
SELECT job_id, [NULL, 'pending', 'analyzing', 'reviewing', 'complete', 'failed'][z % 10 + 1] AS status, (z // 10)::BIGINT AS illegal, z % 10 NOT IN (4, 5) AND last + INTERVAL 1 DAY < (SELECT max(ts) FROM events) AS timed_out FROM r""")
def job_states(spark, sf_dir):
    """Each job's state after all its events, events that its state didn't allow, and whether it was given up."""
    events = t.table(spark, sf_dir, "events").selectExpr("user_id AS job_id", f"{_STATUS} AS status", "ts AS at", "event_id AS seq")
    return jobs.states(events, "1 day").select("job_id", "status", "illegal", "timed_out")


# ---------------------------------------------------------------- search


@query("SELECT doc_id AS file, line, text FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(lower(text), 'ation of')")
def indexed_grep(spark, sf_dir):
    """A search that reads the texts only of the files whose grams allow a hit."""
    rows = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    with search.index(rows) as index:
        return t.cut(index.grep("ation of").select("file", "line", "text"))


# ---------------------------------------------------------------- agents

_AGENT_FILES = "SELECT doc_id % 20 AS pr_id, 'd' || CAST(doc_id AS VARCHAR(12)) AS file, text FROM documents"


def _agent(said: list[str]) -> str:
    """An offline agent: looks for a word, then for the dependents of a name, and keeps by what it heard."""
    if len(said) == 1:
        return '{"tool": "search", "args": {"pattern": "The And"}}'
    if len(said) == 2:
        return 'I ask: {"tool": "dependents", "args": {"name": "hub"}}'
    heard = said[1].count("\n") + (said[1] != "no matches"), said[2] != "none"
    return '{"keep": [%s]}' % ("2, 1" if heard[0] > 3 and heard[1] else "1" if heard[1] else "2")


@query(f"""WITH f AS ({_AGENT_FILES}), c AS (SELECT DISTINCT user_id % 25 AS pr_id FROM events),
n AS (SELECT pr_id, count(*) AS hits FROM (SELECT pr_id, unnest(string_split(text, chr(10))) AS line FROM f) WHERE contains(lower(line), 'the and') GROUP BY pr_id)
SELECT pr_id, CASE WHEN coalesce(hits, 0) > 3 AND pr_id % 3 <> 0 THEN 'second,first' WHEN pr_id % 3 <> 0 THEN 'first' ELSE 'second' END AS kept, 3::BIGINT AS steps FROM c LEFT JOIN n USING (pr_id)""")
def agents(spark, sf_dir):
    """The agents of all changes at once, over the documents as their files."""
    events, docs = t.table(spark, sf_dir, "events"), t.table(spark, sf_dir, "documents")
    changes = events.select((F.col("user_id") % 25).alias("pr_id")).distinct().withColumn("candidates", F.array(F.lit("first"), F.lit("second")))
    files_ = docs.select((F.col("doc_id") % 20).alias("pr_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "text")
    entities = changes.select("pr_id", F.explode(F.array(F.struct(F.lit("h").alias("entity_id"), F.lit("Core::hub").alias("entity_name")), F.struct(F.lit("u").alias("entity_id"), F.lit("user").alias("entity_name")))).alias("x")).select("pr_id", "x.*", F.lit("a.rs").alias("file_path"), F.lit("").alias("content"))
    edges = changes.where("pr_id % 3 <> 0").select("pr_id", F.lit("u").alias("src"), F.lit("h").alias("dst"))
    rows = agent.challenge_all(changes, _agent, entities, edges, files_)
    return rows.select("pr_id", F.array_join("kept", ",").alias("kept"), F.col("steps").cast("long").alias("steps"))
