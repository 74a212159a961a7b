"""Further queries of the catalogue: scopes, lookups, lists, parsed summaries, breakdowns, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltascope.functions import parsing
from deltascope.operators import diff, extract, funnel, graph, judge, reviewer, triage
from deltascope.plans import catalog as q
from deltascope.plans.catalog import CHANGES, EDGES, FOUND, GOLD, KEYS, REV, SCORED, query
from deltascope.sinks import outputs
from deltascope.sources import history
from deltascope.sources import tables as t

# ---------------------------------------------------------------- scopes, lines, names

HISTORY = {
    "seq": "event_id",
    "sha": "CASE WHEN event_id % 50 = 7 THEN NULL ELSE 'c' || CAST(event_id AS VARCHAR(12)) END",
    "file_path": "'src/f' || CAST(user_id % 40 AS VARCHAR(9)) || '.py'",
    "status": "CASE event_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'changed' END",
    "before_content": "CASE WHEN event_id % 4 <> 0 THEN 'v' || CAST(event_id % 5 AS VARCHAR(9)) END",
    "after_content": "CASE WHEN event_id % 4 <> 1 THEN 'v' || CAST(event_id % 3 AS VARCHAR(9)) END",
}
_HISTORY = t.sql(HISTORY, "events")


def _history(spark, sf_dir):
    return t.table(spark, sf_dir, "events").selectExpr(*t.columns(HISTORY))


@query(f"""WITH h AS ({_HISTORY}), n AS (SELECT file_path, first(before_content ORDER BY seq) AS b, last(after_content ORDER BY seq) AS a FROM h WHERE seq > 100 AND seq <= 800 GROUP BY file_path)
SELECT file_path, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'deleted' ELSE 'modified' END AS status, b AS before_content, a AS after_content FROM n WHERE a IS DISTINCT FROM b""")
def changed_files_range(spark, sf_dir):
    return history.changed_files(_history(spark, sf_dir), "c100..c800")


@query(f"SELECT file_path, CASE status WHEN 'added' THEN 'added' WHEN 'removed' THEN 'deleted' ELSE 'modified' END AS status, before_content, after_content FROM ({_HISTORY}) WHERE sha IS NULL")
def changed_files_working(spark, sf_dir):
    return history.changed_files(_history(spark, sf_dir), "working")


@query(f"SELECT c.entity_id, coalesce(g.p_size, 0)::BIGINT AS start_line, coalesce(g.p_size + g.p_partkey % 50, 0)::BIGINT AS end_line FROM ({CHANGES}) c LEFT JOIN part g ON g.p_partkey = c.change_seq AND g.p_partkey % 3 <> 0")
def entity_lines(spark, sf_dir):
    known = t.table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr("'e' || CAST(p_partkey AS STRING) AS entity_id", "CAST(p_size AS BIGINT) AS start_line", "p_size + p_partkey % 50 AS end_line")
    return graph.with_lines(t.changes(spark, sf_dir), known).select("entity_id", "start_line", "end_line")


_ALL = t.sql(t.CHANGES, "part")


def _neighbours_sql(here: str, there: str, limit: int) -> str:
    return f"SELECT entity_id, string_agg(name || ' (' || file || ')', ', ' ORDER BY name, file) AS names FROM (SELECT {here} AS entity_id, entity_name AS name, file_path AS file, row_number() OVER (PARTITION BY {here} ORDER BY entity_name, file_path, {there}) AS rn FROM ({EDGES}) e JOIN ({_ALL}) a ON a.entity_id = e.{there}) WHERE rn <= {limit} GROUP BY entity_id"


def _neighbours(spark, sf_dir, incoming: bool, limit: int):
    rows = graph.neighbours(t.edges(spark, sf_dir), t.all_entities(spark, sf_dir), incoming, limit)
    return rows.select("entity_id", F.array_join(F.transform("neighbours", lambda x: F.concat(x["name"], F.lit(" ("), x["file"], F.lit(")"))), ", ").alias("names"))


@query(_neighbours_sql("dst", "src", 10))
def dependent_names(spark, sf_dir):
    return _neighbours(spark, sf_dir, True, 10)


@query(_neighbours_sql("src", "dst", 10))
def dependency_names(spark, sf_dir):
    return _neighbours(spark, sf_dir, False, 10)


@query(f"WITH {SCORED} SELECT entity_id, entity_name, file_path FROM ranked WHERE entity_name = 'small_widget' AND ends_with(file_path, '.rs') ORDER BY review_rank LIMIT 1")
def find_entity(spark, sf_dir):
    return graph.find(q.scored(spark, sf_dir), "small_widget", ".rs").select("entity_id", "entity_name", "file_path")


_MEMBER = "CASE change_seq % 3 WHEN 0 THEN 'Outer::' || entity_name WHEN 1 THEN 'mod.' || entity_name ELSE entity_name END"


@query(f"SELECT entity_id, n AS entity_name FROM (SELECT *, {_MEMBER} AS n FROM ({CHANGES})) WHERE (n = 'small_widget' OR ends_with(n, '::small_widget') OR ends_with(n, '.small_widget')) AND contains(file_path, 'brand1')")
def agent_lookup(spark, sf_dir):
    rows = t.changes(spark, sf_dir).withColumn("entity_name", F.expr(_MEMBER))
    return graph.lookup(rows, "small_widget", "brand1").select("entity_id", "entity_name")


_TEXT = "CASE change_seq % 6 WHEN 0 THEN 'pub fn x' WHEN 1 THEN 'pub(crate) y' WHEN 2 THEN 'export z' WHEN 3 THEN 'module.exports = 1' WHEN 4 THEN ' pub indented' END || chr(10) || 'pub on the second line'"


@query(f"SELECT entity_id, coalesce(regexp_matches(string_split(a, chr(10))[1], '^(pub |pub\\(crate\\)|export |module\\.exports)'), false) OR {q.PUBLIC} AS is_public FROM (SELECT *, {_TEXT} AS a FROM ({CHANGES}))")
def public_api_text(spark, sf_dir):
    rows = t.changes(spark, sf_dir)
    return rows.select("entity_id", q.p.is_public(F.col("entity_type"), F.col("entity_name"), F.expr(_TEXT)).alias("is_public"))


@query(f"SELECT entity_id, change_type FROM ({CHANGES}) WHERE change_type IN ('modified', 'added', 'deleted')")
def code_triage_set(spark, sf_dir):
    return funnel.code_changes(t.changes(spark, sf_dir)).select("entity_id", "change_type")


_CONTEXT = {
    "pr_id": "user_id",
    "entity_id": "'e' || CAST(event_id AS VARCHAR(12))",
    "entity_name": "CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN 'F' || CAST(event_id % 9 AS VARCHAR(9)) || '.py' WHEN 2 THEN '' ELSE 'absent' END",
    "entity_type": "CASE WHEN event_id % 5 = 0 THEN 'chunk' ELSE 'function' END",
    "before_content": "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE 'x' END",
    "after_content": "CASE WHEN event_id % 7 = 0 THEN 'y' END",
}


@query(f"WITH e AS ({t.sql(_CONTEXT, 'events')}), f AS (SELECT pr_id, string_agg(lower(issue), ' ' ORDER BY lens_idx, pos) AS combined FROM ({FOUND}) GROUP BY pr_id) SELECT pr_id, entity_id FROM e JOIN f USING (pr_id) WHERE entity_name <> '' AND entity_type <> 'chunk' AND (coalesce(before_content, '') <> '' OR coalesce(after_content, '') <> '') AND contains(combined, lower(entity_name))")
def validation_context(spark, sf_dir):
    entities = t.table(spark, sf_dir, "events").selectExpr(*t.columns(_CONTEXT))
    return funnel.validation_context(entities, t.findings(spark, sf_dir)).select("pr_id", "entity_id")


@query("WITH d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS w FROM documents), n AS (SELECT w[1] AS word, min('d' || doc_id::VARCHAR) AS dst FROM d WHERE len(w) > 0 GROUP BY 1), r AS (SELECT DISTINCT 'd' || doc_id::VARCHAR AS src, unnest(w) AS word FROM d) SELECT DISTINCT src, dst FROM r JOIN n USING (word) WHERE src <> dst")
def reference_edges(spark, sf_dir):
    """Edges of a graph of documents, each named by its first word."""
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0)
    rows = t.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("entity_id"), F.get(words, F.lit(0)).alias("entity_name"), F.col("text").alias("content"))
    return graph.references(rows)


@query()
def extracted_entities(spark, sf_dir):
    """Entities of the documents' texts before and after; an extractor is code, tests hold it on fixtures."""
    files = q._texts(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.col("before").alias("before_content"), F.col("after").alias("after_content"))
    return extract.changed_entities(files, skip_failed=False).select("file_path", "entity_name", "change_type", "start_line", "end_line")


# ---------------------------------------------------------------- summaries and lists


@query(f"WITH {SCORED} SELECT file_path, array_to_string(list_sort(list_distinct(list(lower(entity_name)))), ',') AS names FROM scored GROUP BY file_path")
def summary_names(spark, sf_dir):
    """Names read back from a summary text of each file."""
    part = F.concat("entity_name", F.lit(" ("), F.initcap("risk_level"), F.lit(")"))
    texts = q.scored(spark, sf_dir).groupBy("file_path").agg(F.array_join(F.collect_list(part), ", ").alias("text"))
    return texts.select("file_path", F.array_join(parsing.summary_names(F.col("text")), ",").alias("names"))


@query(f"WITH {SCORED} SELECT entity_type, array_to_string(list_sort(list_distinct(list(lower(entity_name)))), ',') AS names, array_to_string(list_sort(list_distinct(list(lower(file_path)))), ',') AS files FROM ranked WHERE risk_rank >= 1 GROUP BY entity_type")
def risky_summary(spark, sf_dir):
    """Names and files read back from a list of the riskier entities of each type."""
    part = F.concat("entity_type", F.lit("::"), "entity_name", F.lit(" ("), "file_path", F.lit(") ["), "risk_level", F.lit(", score=1]"))
    texts = q.scored(spark, sf_dir).where("risk_rank >= 1").groupBy("entity_type").agg(F.array_join(F.collect_list(part), " | ").alias("text"))
    return texts.select("entity_type", F.array_join(parsing.risky_names(F.col("text")), ",").alias("names"), F.array_join(parsing.risky_files(F.col("text")), ",").alias("files"))


@query(f"SELECT pos, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(issue, '\\b[a-zA-Z_][a-zA-Z0-9_]{{2,}}\\b')), lambda w: w NOT IN {tuple(sorted(funnel.PLAIN_WORDS))})), ',') AS words FROM ({FOUND})")
def description_identifiers(spark, sf_dir):
    return t.findings(spark, sf_dir).select("pos", F.array_join(funnel.identifier_column(F.col("issue")), ",").alias("words"))


@query(f"WITH {SCORED} SELECT file_path, string_agg(entity_name, ', ' ORDER BY rn) AS names FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY review_rank) AS rn FROM ranked) WHERE rn <= 3 GROUP BY file_path")
def first_names_by_file(spark, sf_dir):
    return triage.first_by_file(q.scored(spark, sf_dir)).select("file_path", F.array_join("names", ", ").alias("names"))


@query(f"WITH {SCORED} SELECT total, reviewed, CASE WHEN total > 0 THEN floor((total - reviewed)::DOUBLE / total * 100)::BIGINT ELSE 0 END AS reduction_pct FROM (SELECT count(*) AS total, least(count(*) FILTER (WHERE risk_rank >= 2), 10) AS reviewed FROM ranked)")
def review_selection(spark, sf_dir):
    return triage.selection(q.scored(spark, sf_dir))


@query(f"WITH {SCORED}, e2 AS ({EDGES}), {q._COMPONENTS.replace('FROM e ', 'FROM e2 ')} SELECT (SELECT count(*) FROM scored) AS total, (SELECT count(*) FROM scored WHERE risk_level = 'high') AS n_high, count(DISTINCT component) AS n_groups FROM comp")
def review_totals(spark, sf_dir):
    return triage.stats_with_groups(q.scored(spark, sf_dir), q._membership(spark, sf_dir)).select("total", "n_high", "n_groups")


_SLOTS = f"WITH {SCORED}, x AS (SELECT *, change_seq % 5 AS pr_id FROM ranked), h AS (SELECT DISTINCT pr_id, file_path FROM x WHERE risk_rank >= 1), tk AS (SELECT pr_id, count(*) AS taken FROM x WHERE risk_rank >= 1 GROUP BY pr_id), l AS (SELECT *, row_number() OVER (PARTITION BY pr_id, file_path ORDER BY risk_score DESC, change_seq) AS rn FROM x WHERE risk_rank = 0 AND (pr_id, file_path) NOT IN (SELECT pr_id, file_path FROM h)), mm AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY risk_score DESC, change_seq) AS place FROM l WHERE rn = 1)"


@query(f"{_SLOTS} SELECT pr_id, file_path, entity_id FROM mm LEFT JOIN tk USING (pr_id) WHERE place <= 60 - coalesce(taken, 0)")
def fill_slots(spark, sf_dir):
    rows = q._per_file(spark, sf_dir)
    return funnel.fill_uncovered(rows.where("risk_rank >= 1"), rows.where("risk_rank = 0"), slots=60)


@query(f"SELECT pr_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY pr_id) AS n, row_number() OVER (PARTITION BY pr_id ORDER BY lens_idx, pos) AS rn FROM ({q._STRUCT})) WHERE n <= {funnel.SHORTCUT} OR rn <= {funnel.MAX_RAW}")
def funnel_raw_cap(spark, sf_dir):
    return funnel.capped(q._structural(spark, sf_dir), funnel.MAX_RAW).select("pr_id", "pos")


@query(f"SELECT entity_id, json_object('entity_id', entity_id, 'entity_name', entity_name, 'file_path', file_path, 'change_type', change_type, 'blast_radius', change_seq) AS json FROM ({CHANGES}) WHERE structural_change IS NULL UNION ALL SELECT entity_id, json_object('entity_id', entity_id, 'entity_name', entity_name, 'file_path', file_path, 'change_type', change_type, 'blast_radius', change_seq, 'after_content', entity_type) FROM ({CHANGES}) WHERE structural_change IS NOT NULL")
def result_json(spark, sf_dir):
    """Entities as JSON; content that is missing is no key."""
    rows = t.changes(spark, sf_dir)
    content = F.when(F.col("structural_change").isNotNull(), F.col("entity_type")).alias("after_content")
    return rows.select("entity_id", F.to_json(F.struct("entity_id", "entity_name", "file_path", "change_type", F.col("change_seq").alias("blast_radius"), content)).alias("json"))


# ---------------------------------------------------------------- diffs and search


@query(f"WITH {q._PARTS} SELECT pr_id, part_no::BIGINT AS part_no, regexp_extract(string_split(part, chr(10))[1], ' b/(.+)$', 1) AS path, bytes::BIGINT AS bytes FROM pc")
def diff_chunks(spark, sf_dir):
    return diff.diff_parts(t.raw_diffs(spark, sf_dir)).select("pr_id", F.col("part_no").cast("long").alias("part_no"), "path", F.col("bytes").cast("long").alias("bytes"))


@query(f"""WITH {q._PARTS}, so AS (SELECT *, sum(bytes + 11) OVER (PARTITION BY pr_id ORDER BY weight DESC, part_no) AS so_far FROM pw JOIN (SELECT pr_id, part_no, part FROM pc) USING (pr_id, part_no)),
j AS (SELECT pr_id, count(*) AS parts, string_agg('diff --git ' || part, '' ORDER BY weight DESC, part_no) AS joined FROM so WHERE so_far <= 4000 GROUP BY pr_id)
SELECT pr_id, CASE WHEN strlen(diff) <= 4000 THEN 'whole' WHEN parts > 0 THEN 'parts' ELSE 'prefix' END AS kind, CASE WHEN strlen(diff) <= 4000 THEN sha256(diff) WHEN parts > 0 THEN sha256(joined) END AS digest FROM ({t.DIFF_SQL}) LEFT JOIN j USING (pr_id)""")
def truncated_text(spark, sf_dir):
    """What a prompt gets of each diff; a prefix has no digest here, tests hold its text."""
    rows = diff.truncated_text(t.raw_diffs(spark, sf_dir), 4000)
    return rows.select("pr_id", "kind", F.when(F.col("kind") != "prefix", F.sha2("text", 256)).alias("digest"))


_PLACE = "CASE doc_id % 5 WHEN 0 THEN 'dist/f' WHEN 1 THEN 'src/a' ELSE 'src/b' END || CAST(doc_id AS VARCHAR(12)) || '.rs'"


@query(f"WITH m AS ({q._GREP.replace('doc_id AS file', f'{_PLACE} AS path, doc_id AS file')}) SELECT path AS file, line, text FROM m WHERE file % 7 = 0 OR file % 5 <> 0")
def grep_everywhere(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").selectExpr(f"{_PLACE.replace('VARCHAR(12)', 'STRING')} AS file", "doc_id AS fragment", "text")
    own = docs.where("fragment % 7 = 0").select("file", "text")
    return diff.grep_everywhere(own, docs, "the an").select("file", "line", "text")


# ---------------------------------------------------------------- judging and accounts

_DIMS = {"category": "CASE gold_id % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'style' END", "language": "'lang' || CAST(pr_id % 4 AS VARCHAR(9))", "repo": "'repo' || CAST(pr_id % 5 AS VARCHAR(9))"}
_DIM_SQL = " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS value, verdict FROM judged JOIN (SELECT gold_id, pr_id FROM g) USING (gold_id)" for k, v in (_DIMS | {"severity": "severity", "high_critical": "CASE WHEN severity IN ('critical', 'high') THEN 'yes' END"}).items())


@query(f"WITH {q._JUDGED} SELECT dimension, value, count(*) AS n, count(*) FILTER (WHERE verdict = 'match') AS matches, round(count(*) FILTER (WHERE verdict = 'match') / count(*) * 100, 6) AS recall FROM ({_DIM_SQL}) WHERE value IS NOT NULL GROUP BY dimension, value")
def judge_breakdowns(spark, sf_dir):
    rows = q._judged(spark, sf_dir).join(t.golden(spark, sf_dir).select("gold_id", "pr_id"), "gold_id")
    return judge.breakdowns(rows.withColumns({k: F.expr(v.replace("VARCHAR(9)", "STRING")) for k, v in _DIMS.items()}), [*_DIMS, "severity"])


_ENTITY_OF = "CASE pos % 5 WHEN 0 THEN 'Purchase' WHEN 1 THEN 'signup' WHEN 2 THEN '' END"
_NAMED = q._JUDGED.replace("f AS (" + FOUND + ")", f"f AS (SELECT *, {_ENTITY_OF} AS entity_name, line + 2 AS end_line FROM ({FOUND}))").replace("f.line, f.issue", "f.line, f.end_line, f.issue, coalesce(f.entity_name, '') AS entity_name").replace("- 10) <= line AND", "- 10) <= end_line AND")
_NAMED = _NAMED.replace(q._LOWSET("pm.issue"), f"list_append({q._LOWSET('pm.issue')}, lower(entity_name))")


@query(f"WITH {_NAMED} SELECT * FROM judged")
def judge_entity_names(spark, sf_dir):
    """Findings with a line range and the name of their entity, which counts as an identifier."""
    found = t.findings(spark, sf_dir).withColumns({"entity_name": F.expr(_ENTITY_OF), "end_line": F.expr("CASE WHEN line <> 0 THEN line + 2 ELSE 0 END")})
    return judge.judge_by_path(t.golden(spark, sf_dir), found)


@query(f"WITH {q._JUDGED}, v AS (SELECT CASE WHEN pr_id % 11 = 0 THEN 'error' ELSE verdict END AS verdict FROM judged JOIN (SELECT gold_id, pr_id FROM g) USING (gold_id)) SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM v) * 100, 6) AS share FROM v GROUP BY verdict")
def judge_with_errors(spark, sf_dir):
    """Changes that could not be run: their rows are errors and stay in the denominator."""
    golden = t.golden(spark, sf_dir).select("gold_id", "pr_id")
    rows = judge.with_errors(q._judged(spark, sf_dir).join(golden, "gold_id"), golden.where("pr_id % 11 = 0"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counts = rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).join(total, how="cross")  # four rows and one
    return counts.select("verdict", "n", F.round(F.col("n") / F.col("total") * 100, 6).alias("share"))


@query(f"SELECT sum(c)::BIGINT AS findings, count(*) AS changes FROM (SELECT pr_id % 3 AS repo, pr_id, max_by(gold_id % 7, gold_id) AS c FROM ({GOLD}) GROUP BY 1, 2)")
def findings_once(spark, sf_dir):
    rows = t.golden(spark, sf_dir).selectExpr("pr_id % 3 AS repo", "pr_id", "gold_id AS row_num", "gold_id % 7 AS finding_count")
    return judge.findings_once(rows)


_CALLS = {"job_id": "user_id", "ok": "event_type <> 'error'", "input_tokens": "CAST(floor(value * 10) AS BIGINT)", "output_tokens": "event_id % 100"}


@query(f"SELECT job_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS calls FROM ({t.sql(_CALLS, 'events')}) WHERE ok GROUP BY job_id")
def token_accounting(spark, sf_dir):
    return judge.token_totals(t.table(spark, sf_dir, "events").selectExpr(*t.columns(_CALLS)))


@query(f"SELECT status AS verdict, count(*) AS n, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM ({REV}) GROUP BY status")
def review_token_counts(spark, sf_dir):
    return reviewer.verdict_counts(t.reviews(spark, sf_dir).selectExpr("status AS verdict", "input_tokens + output_tokens AS tokens"))


_OWNED = f"SELECT key_id, key_id % 20 AS user_id, request_count, revoked, key_id % 13 AS created_at FROM ({KEYS})"


@query(f"SELECT key_id, created_at FROM ({_OWNED}) WHERE user_id = 3 AND NOT revoked ORDER BY created_at DESC, key_id DESC")
def user_keys(spark, sf_dir):
    keys = t.api_keys(spark, sf_dir).selectExpr("key_id", "key_id % 20 AS user_id", "request_count", "revoked", "key_id % 13 AS created_at")
    return judge.keys_of(keys, 3).select("key_id", "created_at")


@query(f"SELECT review_id, user_id, status FROM ({REV}) WHERE review_id = 33 AND user_id = (SELECT min(user_id) FROM ({REV}) WHERE review_id = 33)")
def review_by_id(spark, sf_dir):
    reviews = t.reviews(spark, sf_dir)
    owner = reviews.where("review_id = 33").agg(F.min("user_id")).first()[0]
    return judge.review_of(reviews, 33, -1 if owner is None else owner).select("review_id", "user_id", "status")


@query("SELECT user_id AS key_id, count(*) AS request_count, max(ts)::VARCHAR AS last_used_at FROM events GROUP BY user_id")
def api_usage(spark, sf_dir):
    log = t.table(spark, sf_dir, "events").selectExpr("user_id AS key_id", "ts AS used_at")
    return outputs.usage_counts(log).withColumn("last_used_at", F.col("last_used_at").cast("string"))


@query(f"SELECT user_id, max_by(status, struct_pack(a := created_at, b := review_id)) AS status, max_by(review_id, struct_pack(a := created_at, b := review_id)) AS review_id FROM ({REV}) GROUP BY user_id")
def latest_review_rows(spark, sf_dir):
    """The current row of a log of row versions."""
    log = t.reviews(spark, sf_dir).select("user_id", "review_id", "status", "created_at")
    return outputs.latest_rows(log, "user_id", ["created_at", "review_id"]).select("user_id", "status", "review_id")
