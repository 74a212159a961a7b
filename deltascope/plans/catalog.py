"""Named queries over the driver tables, with their SQL counterparts.

Each query has one counterpart of the same name and columns; floats are rounded on
both sides after any bucketing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.functions import parsing
from deltascope.functions import predicates as p
from deltascope.functions import scoring as s
from deltascope.operators import diff, funnel, graph, judge, reviewer, triage
from deltascope.operators.skew import merged
from deltascope.sources import tables as t
from deltascope.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _or(column: str, test: str, values: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{test}({column}, '{v}')" for v in values) + ")"


def _case(column: str, values: dict[str, float]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0.0 END"


# ---------------------------------------------------------------- SQL building blocks

CHANGES = t.sql(t.CHANGES, "part", t.CHANGED)
EDGES, HUBS = t.edges_sql(), t.edges_sql(hubs=True)
PUBLIC = "(entity_type IN ('function', 'method', 'struct', 'interface') AND regexp_matches(entity_name, '^\\p{Lu}'))"
_WEIGHT = f"CAST({_case('classification', s.CLASS_WEIGHT)} AS DOUBLE) + CAST({_case('change_type', s.CHANGE_WEIGHT)} AS DOUBLE)"
SCORED = f"""RECURSIVE c AS ({CHANGES}), e AS ({HUBS}),
dep AS (SELECT dst AS entity_id, count(*) AS dependent_count FROM e GROUP BY dst),
dcy AS (SELECT src AS entity_id, count(*) AS dependency_count FROM e GROUP BY src),
r(origin, x) AS (SELECT c.entity_id, e.src FROM c JOIN e ON e.dst = c.entity_id UNION SELECT r.origin, e.src FROM r JOIN e ON e.dst = r.x),
bl AS (SELECT origin AS entity_id, least(count(*), {graph.BLAST_CAP}) AS blast_radius FROM r WHERE x <> origin GROUP BY origin),
n AS (SELECT count(*) AS total FROM part),
j AS (SELECT c.*, coalesce(dependent_count, 0)::BIGINT AS dependent_count, coalesce(dependency_count, 0)::BIGINT AS dependency_count, coalesce(blast_radius, 0)::BIGINT AS blast_radius, {PUBLIC} AS is_public_api
  FROM c LEFT JOIN dep USING (entity_id) LEFT JOIN dcy USING (entity_id) LEFT JOIN bl USING (entity_id)),
k AS (SELECT j.*, {_WEIGHT} + CASE WHEN is_public_api THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN total > 0 AND blast_radius > 0 THEN sqrt(blast_radius::DOUBLE / total::DOUBLE) * 0.30::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN dependent_count > 0 THEN ln(1.0::DOUBLE + dependent_count) * 0.15::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM j, n),
m AS (SELECT *, least(CASE WHEN structural_change IS NOT DISTINCT FROM false THEN raw * 0.2::DOUBLE ELSE raw END, 1.0::DOUBLE) AS risk_score FROM k),
scored AS (SELECT *, CASE WHEN risk_score >= 0.7::DOUBLE THEN 'critical' WHEN risk_score >= 0.5::DOUBLE THEN 'high' WHEN risk_score >= 0.3::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level FROM m),
ranked AS (SELECT *, CASE risk_level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS risk_rank, row_number() OVER (ORDER BY risk_score DESC, change_seq) AS review_rank FROM scored)"""
_TRIAGE = f"(risk_score + least(blast_radius, 20) * 0.02::DOUBLE + CASE WHEN is_public_api THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CAST({_case('entity_type', s.TYPE_BONUS)} AS DOUBLE) + CASE WHEN change_type = 'modified' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + least(dependent_count, 10) * 0.03::DOUBLE + least(after_len, 3000) * 0.0001::DOUBLE)"
_COMPONENTS = """ce AS (SELECT src, dst FROM e WHERE src IN (SELECT entity_id FROM c) AND dst IN (SELECT entity_id FROM c)),
ue AS (SELECT src AS a, dst AS b FROM ce UNION SELECT dst, src FROM ce),
w(a, b) AS (SELECT a, b FROM ue UNION SELECT w.a, ue.b FROM w JOIN ue ON w.b = ue.a),
comp AS (SELECT c.entity_id, least(c.entity_id, coalesce(min(w.b), c.entity_id)) AS component FROM c LEFT JOIN w ON w.a = c.entity_id GROUP BY c.entity_id)"""


_SCORED: dict[tuple, DataFrame] = {}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored entities of a folder: written once a session, as the last result that all views read.

    A folder whose files have changed since, or whose table is gone, is scored anew.
    """
    parts, items = t.table(spark, sf_dir, "part"), t.table(spark, sf_dir, "lineitem")
    state = tuple(sorted(f"{x} {_modified(spark, x)}" for x in (*parts.inputFiles(), *items.inputFiles())))
    key = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""), sf_dir, state
    known = _SCORED.get(key)
    if known is None or not all(_modified(spark, x) for x in known.inputFiles()):
        rows = triage.score(t.changes(spark, sf_dir), t.cut(t.edges(spark, sf_dir, hubs=True)), parts.count())
        for old in [x for x in _SCORED if x[:3] == key[:3] or x[0] != key[0]]:
            del _SCORED[old]
        known = _SCORED[key] = t.cut(rows)
    return known


def _modified(spark: SparkSession, path: str) -> int:
    """When a file was written last; 0 if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(at).getModificationTime() if system.exists(at) else 0


# ---------------------------------------------------------------- predicates


@query(f"SELECT path_id, path, regexp_extract(path, '[^/]*$') IN {p.NOISE_FILES} OR {_or('path', 'ends_with', p.NOISE_SUFFIXES)} OR {_or('path', 'starts_with', p.NOISE_FOLDERS)} AS is_noise FROM ({t.sql(t.PATHS, 'part')})")
def noise_filter(spark, sf_dir):
    return t.paths(spark, sf_dir).withColumn("is_noise", p.is_noise(F.col("path")))


@query(f"SELECT path_id FROM ({t.sql(t.PATHS, 'part')}) WHERE NOT regexp_matches(path, '{p.WEB_NOISE}')")
def noise_filter_web(spark, sf_dir):
    return t.paths(spark, sf_dir).where(~p.is_web_noise(F.col("path"))).select("path_id")


@query(f"SELECT path_id, path FROM ({t.sql(t.PATHS, 'part')}) WHERE regexp_matches(lower(path), '\\.({'|'.join(p.GRAPH_EXTENSIONS)})$')")
def source_file_scan(spark, sf_dir):
    return t.paths(spark, sf_dir).where(p.is_source_file(F.col("path")))


@query(f"SELECT entity_id, {PUBLIC} AS is_public FROM ({CHANGES})")
def public_api(spark, sf_dir):
    return t.changes(spark, sf_dir).select("entity_id", p.is_public(F.col("entity_type"), F.col("entity_name")).alias("is_public"))


def _comment(x: str) -> str:
    return f"(regexp_matches({x}, '^(//|/\\*|\\*|\"\"\")') OR (starts_with({x}, '#') AND NOT starts_with({x}, '#[')))"


def _signature(x: str) -> str:
    return f"({_or(x, 'starts_with', p.SIGNATURE_STARTS)} OR {_or(x, 'contains', p.SIGNATURE_PARTS)})"


@query(f"SELECT CASE WHEN {_comment('after')} THEN 'comment' WHEN {_signature('after')} THEN 'signature' ELSE 'code' END AS kind, count(*) AS n FROM ({t.LINES_SQL}) GROUP BY 1")
def line_kinds(spark, sf_dir):
    line = F.col("after")
    kind = F.when(p.is_comment(line), "comment").when(p.is_signature(line), "signature").otherwise("code")
    return t.document_lines(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_CLASSIFIED = f"""l AS ({t.LINES_SQL}),
a AS (SELECT DISTINCT doc_id, regexp_replace(before, '^\\s+|\\s+$', '', 'g') AS x FROM l), b AS (SELECT DISTINCT doc_id, regexp_replace(after, '^\\s+|\\s+$', '', 'g') AS x FROM l),
d AS (SELECT * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)),
k AS (SELECT doc_id, bool_or({_comment('x')}) AS t, bool_or(NOT {_comment('x')} AND {_signature('x')}) AS s, bool_or(NOT {_comment('x')} AND NOT {_signature('x')}) AS f FROM d WHERE x <> '' GROUP BY doc_id),
whole AS (SELECT doc_id, string_agg(before, chr(10) ORDER BY i) AS before, string_agg(after, chr(10) ORDER BY i) AS after FROM l GROUP BY doc_id),
classified AS (SELECT whole.doc_id, CASE WHEN before = '' OR after = '' THEN 'functional' WHEN k.doc_id IS NULL THEN CASE WHEN regexp_replace(before, '^\\s+|\\s+$', '', 'g') <> regexp_replace(after, '^\\s+|\\s+$', '', 'g') THEN 'functional' ELSE 'text' END
  ELSE concat_ws('+', CASE WHEN t THEN 'text' END, CASE WHEN s THEN 'syntax' END, CASE WHEN f THEN 'functional' END) END AS classification FROM whole LEFT JOIN k USING (doc_id))"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after of each document, rebuilt inside its row."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    whole = lambda expr: F.expr(f"array_join(transform(l, (line, k) -> {expr.replace('(i ', '((k + 1) ')}), '\n')")
    return docs.select("doc_id", whole(t.BEFORE).alias("before"), whole(t.AFTER).alias("after"))


@query(f"WITH {_CLASSIFIED} SELECT * FROM classified")
def classify_change(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", s.classify(F.col("before"), F.col("after"), F.lit(None).cast("boolean")).alias("classification"))


@query(f"WITH {_CLASSIFIED} SELECT classification, count(*) AS n FROM classified GROUP BY classification")
def classify_breakdown(spark, sf_dir):
    return classify_change(spark, sf_dir).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scores and graph

_TRIAGE_COLUMNS = ["entity_id", "entity_name", "file_path", "change_type", "classification", "risk_level", "blast_radius", "dependent_count", "dependency_count", "is_public_api"]


@query(f"WITH {SCORED} SELECT {', '.join(_TRIAGE_COLUMNS)}, round(risk_score, 6) AS risk_score FROM ranked WHERE risk_rank >= 1 ORDER BY review_rank")
def triage_query(spark, sf_dir):
    rows = scored(spark, sf_dir).where(p.at_least(F.col("risk_rank"), "medium")).orderBy(F.desc("risk_score"), "change_seq")
    return rows.select(*_TRIAGE_COLUMNS, F.round("risk_score", 6).alias("risk_score"))


QUERIES["triage"], ORACLES["triage"] = QUERIES.pop("triage_query"), ORACLES.pop("triage_query")


@query(f"WITH {SCORED} SELECT entity_id, round(risk_score, 6) AS risk_score, risk_level, risk_rank FROM ranked")
def risk_score(spark, sf_dir):
    return scored(spark, sf_dir).select("entity_id", F.round("risk_score", 6).alias("risk_score"), "risk_level", "risk_rank")


@query(f"WITH {SCORED} SELECT risk_level, count(*) AS n FROM scored GROUP BY risk_level")
def risk_level_counts(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT entity_id, round(x, 6) AS risk_score FROM (SELECT entity_id, least(CASE WHEN structural_change IS NOT DISTINCT FROM false THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END * ({_WEIGHT} + CASE WHEN {PUBLIC} THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END), 1.0::DOUBLE) AS x FROM ({CHANGES}))")
def remote_risk_score(spark, sf_dir):
    return triage.remote_score(t.changes(spark, sf_dir)).select("entity_id", F.round("risk_score", 6).alias("risk_score"))


@query(f"WITH {SCORED}, x AS (SELECT *, {_TRIAGE} AS ts FROM scored WHERE change_type IN ('modified', 'added') AND entity_type <> 'chunk' ORDER BY ts DESC, change_seq LIMIT 20) SELECT entity_id, file_path, round(ts, 6) AS triage_score, round(max(ts) OVER (PARTITION BY file_path), 6) AS file_score FROM x")
def triage_score_topk(spark, sf_dir):
    rows = triage.triage_by_file(scored(spark, sf_dir))
    return rows.select("entity_id", "file_path", F.round("triage_score", 6).alias("triage_score"), F.round("file_score", 6).alias("file_score"))


@query(f"SELECT dst AS entity_id, count(*) AS dependent_count FROM ({EDGES}) GROUP BY dst")
def direct_dependents(spark, sf_dir):
    return graph.dependents(t.edges(spark, sf_dir))


@query(f"SELECT src AS entity_id, count(*) AS dependency_count FROM ({EDGES}) GROUP BY src")
def direct_dependencies(spark, sf_dir):
    return graph.dependencies(t.edges(spark, sf_dir))


@query(f"WITH {SCORED} SELECT * FROM bl")
def blast_radius(spark, sf_dir):
    return graph.blast_radius(t.edges(spark, sf_dir, hubs=True), t.changes(spark, sf_dir))


@query(f"WITH c AS ({CHANGES}), e AS ({EDGES}) SELECT src, dst FROM e WHERE src IN (SELECT entity_id FROM c) AND dst IN (SELECT entity_id FROM c)")
def changed_edges(spark, sf_dir):
    return graph.changed_edges(t.cut(t.edges(spark, sf_dir)), t.changes(spark, sf_dir))


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = t.changes(spark, sf_dir)
    return graph.components(changes, graph.changed_edges(t.cut(t.edges(spark, sf_dir)), changes))


@query(f"WITH RECURSIVE c AS ({CHANGES}), e AS ({EDGES}), {_COMPONENTS} SELECT * FROM comp")
def untangle_components(spark, sf_dir):
    return _membership(spark, sf_dir)


@query(f"""WITH {SCORED.replace(HUBS, HUBS)}, e2 AS ({EDGES}), {_COMPONENTS.replace('FROM e ', 'FROM e2 ')},
g AS (SELECT component, count(*) AS size, min(review_rank) AS first, min_by(entity_name, review_rank) AS name, min(file_path) AS lo, max(file_path) AS hi FROM ranked JOIN comp USING (entity_id) GROUP BY component),
h AS (SELECT *, substr(lo, 1, coalesce((SELECT min(q) FROM range(1, 500) AS z(q) WHERE substr(lo, q, 1) <> substr(hi, q, 1)), 501) - 1) AS pre FROM g),
i AS (SELECT *, CASE WHEN contains(pre, '/') THEN regexp_extract(pre, '^(.*/)', 1) ELSE pre END AS folder FROM h)
SELECT component, row_number() OVER (ORDER BY size DESC, first) - 1 AS group_id, CASE WHEN size = 1 THEN name WHEN folder <> '' THEN folder ELSE size::VARCHAR || ' entities' END AS label, size FROM i""")
def untangle_groups(spark, sf_dir):
    reviews = triage.ranked(scored(spark, sf_dir))
    return graph.groups(reviews, _membership(spark, sf_dir)).withColumn("group_id", F.col("group_id").cast("long"))


# ---------------------------------------------------------------- views and aggregates

_COUNT = lambda cond, name: f"count(*) FILTER (WHERE {cond}) AS {name}"


@query(f"WITH {SCORED} SELECT count(*) AS total, {', '.join(_COUNT(f'risk_level = {x!r}', f'n_{x}') for x in p.RISK_ORDER)}, {', '.join(_COUNT(f'change_type = {x!r}', f'n_{x}') for x in ('added', 'modified', 'deleted', 'moved', 'renamed'))}, {', '.join(_COUNT(f'classification = {x!r}', f'n_{x}') for x in ('text', 'syntax', 'functional'))}, {_COUNT('contains(classification, ' + repr('+') + ')', 'n_mixed')} FROM scored")
def review_stats(spark, sf_dir):
    return triage.stats(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT CASE WHEN count(*) FILTER (WHERE risk_level = 'critical') > 0 THEN 'requires_careful_review' WHEN count(*) FILTER (WHERE risk_level = 'high') > 0 THEN 'requires_review' WHEN count(*) > 0 AND bool_and(structural_change IS NOT DISTINCT FROM false) THEN 'likely_approvable' ELSE 'standard_review' END AS verdict, count(*) AS n_entities FROM scored")
def verdict(spark, sf_dir):
    return triage.verdict(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT file_path, count(*) AS entities, round(max(risk_score), 6) AS max_score, max_by(risk_level, risk_score) AS max_level, {_COUNT(repr('critical') + ' = risk_level', 'critical')}, {_COUNT(repr('high') + ' = risk_level', 'high')}, {_COUNT('is_public_api', 'public')} FROM scored GROUP BY file_path")
def risk_map(spark, sf_dir):
    return triage.risk_map(scored(spark, sf_dir)).withColumn("max_score", F.round("max_score", 6))


@query(f"WITH {SCORED} SELECT entity_id, risk_level FROM ranked WHERE risk_rank >= 2")
def min_risk_view(spark, sf_dir):
    return scored(spark, sf_dir).where(p.at_least(F.col("risk_rank"), "High")).select("entity_id", "risk_level")


@query(f"WITH {SCORED} SELECT entity_id, file_path FROM ranked WHERE ends_with(file_path, '1.ts')")
def file_view(spark, sf_dir):
    return scored(spark, sf_dir).where(p.in_file(F.col("file_path"), "1.ts")).select("entity_id", "file_path")


@query(f"WITH {SCORED} SELECT entity_name, entity_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY review_rank) AS rn FROM ranked) WHERE rn = 1")
def entity_view(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.groupBy("entity_name").agg(F.min_by(F.struct("entity_id", "file_path"), F.struct(-F.col("risk_score"), "change_seq")).alias("x")).select("entity_name", "x.entity_id", "x.file_path")


@query(f"WITH RECURSIVE c AS ({CHANGES}), e AS ({EDGES}), {_COMPONENTS} SELECT c.entity_id, entity_name, component FROM c JOIN comp USING (entity_id) WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) > 1)")
def group_view(spark, sf_dir):
    members = _membership(spark, sf_dir)
    large = members.groupBy("component").count().where("count > 1").select("component")
    return t.changes(spark, sf_dir).join(merged(members.join(merged(large), "component", "left_semi")), "entity_id").select("entity_id", "entity_name", "component")


_TOUCHED = f"WITH {SCORED}, e2 AS ({EDGES}), {_COMPONENTS.replace('FROM e ', 'FROM e2 ')}, touched AS (SELECT l.l_orderkey AS sha, ranked.*, component FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN ranked ON change_seq = l_partkey JOIN comp USING (entity_id)), bench AS (SELECT sha, count(*) AS entity_count, count(DISTINCT file_path) AS file_count, count(DISTINCT component) AS group_count, {_COUNT('structural_change IS NOT DISTINCT FROM false', 'cosmetic_count')}, {_COUNT('risk_rank >= 2', 'high_critical_count')}, max(blast_radius) AS max_blast_radius, {_COUNT('dependent_count > 0', 'with_dependents')} FROM touched GROUP BY sha)"


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("change_seq", "entity_id", "file_path", "structural_change", "risk_rank", "blast_radius", "dependent_count")
    rows = rows.join(merged(_membership(spark, sf_dir)), "entity_id")
    lines = t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("change_seq"))
    return lines.join(merged(rows), "change_seq")


@query(_TOUCHED + " SELECT * FROM bench")
def commit_bench(spark, sf_dir):
    return triage.commit_bench(_touched(spark, sf_dir))


def _share(a: str, b: str) -> str:
    return f"CASE WHEN sum({b}) > 0 THEN round(sum({a}) / sum({b}), 6) ELSE 0.0 END"


@query(_TOUCHED + f""" SELECT count(*) AS commits, sum(entity_count)::BIGINT AS entity_count, max(max_blast_radius) AS max_blast_radius,
CASE WHEN sum(entity_count) < sum(file_count) THEN round(1 - sum(entity_count) / sum(file_count), 6) ELSE {_share('cosmetic_count', 'entity_count')} END AS noise_reduction,
round(sum(group_count) / count(*), 6) AS avg_groups, round(count(*) FILTER (WHERE group_count > 1) / count(*), 6) AS tangled_ratio, round(sum(file_count) / count(*), 6) AS avg_files, round(sum(entity_count) / count(*), 6) AS avg_entities,
{_share('high_critical_count', 'entity_count')} AS high_critical_ratio, {_share('with_dependents', 'entity_count')} AS with_dependents_ratio FROM bench""")
def repo_rollup(spark, sf_dir):
    return triage.repo_rollup(commit_bench(spark, sf_dir))


@query("SELECT l_partkey AS entity, sum(l_linenumber)::BIGINT + sum(CAST(l_quantity AS BIGINT))::BIGINT AS change_size, count(*) AS touches FROM lineitem GROUP BY l_partkey")
def web_file_triage(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("entity")).agg((F.sum("l_linenumber") + F.sum(F.col("l_quantity").cast("long"))).alias("change_size"), F.count(F.lit(1)).alias("touches"))


# ---------------------------------------------------------------- diffs and search

_PARSED = f"""pl AS (SELECT patch_id, unnest(range(0, len(x))) AS pos, unnest(x) AS raw FROM (SELECT patch_id, string_split(patch, chr(10)) AS x FROM ({t.PATCH_SQL}))),
hh AS (SELECT *, sum(starts_with(raw, '@@')::INT) OVER (PARTITION BY patch_id ORDER BY pos) AS hunk FROM pl),
h0 AS (SELECT *, first_value(regexp_extract(raw, '^@@ -(\\d+)', 1)) OVER (PARTITION BY patch_id, hunk ORDER BY pos)::BIGINT AS old0, first_value(regexp_extract(raw, '\\+(\\d+)', 1)) OVER (PARTITION BY patch_id, hunk ORDER BY pos)::BIGINT AS new0 FROM hh WHERE hunk > 0),
kk AS (SELECT *, CASE substr(raw, 1, 1) WHEN '+' THEN 'add' WHEN '-' THEN 'delete' ELSE 'context' END AS kind FROM h0 WHERE NOT starts_with(raw, '@@')),
parsed AS (SELECT patch_id, hunk, pos, kind, CASE WHEN kind <> 'add' THEN old0 + coalesce(sum((kind <> 'add')::INT) OVER w, 0) END::BIGINT AS old_line, CASE WHEN kind <> 'delete' THEN new0 + coalesce(sum((kind <> 'delete')::INT) OVER w, 0) END::BIGINT AS new_line,
  CASE WHEN kind <> 'context' OR substr(raw, 1, 1) = ' ' THEN substr(raw, 2) ELSE raw END AS content, kind <> 'delete' AS commentable FROM kk WINDOW w AS (PARTITION BY patch_id, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {_PARSED} SELECT patch_id, hunk::BIGINT AS hunk, pos::BIGINT AS pos, kind, old_line, new_line, content, commentable FROM parsed")
def parse_patch(spark, sf_dir):
    return diff.parse_patch(t.patches(spark, sf_dir)).withColumns({"hunk": F.col("hunk").cast("long"), "pos": F.col("pos").cast("long")})


@query(f"WITH {_PARSED} SELECT patch_id, string_agg(new_line::VARCHAR, ',' ORDER BY new_line) AS lines FROM parsed WHERE commentable GROUP BY patch_id")
def commentable_lines(spark, sf_dir):
    rows = diff.commentable_lines(diff.parse_patch(t.patches(spark, sf_dir)))
    return rows.select("patch_id", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query(f"""WITH {_PARSED}, f AS (SELECT min(patch_id) AS patch_id, file FROM ({t.PATCH_SQL}) GROUP BY file), cm AS (SELECT event_id AS comment_id, 'src/m' || (event_id % 60)::VARCHAR || CASE event_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' ELSE '_test.py' END AS file, event_id % 40 AS line FROM events),
ok AS (SELECT DISTINCT patch_id, new_line AS line FROM parsed WHERE commentable)
SELECT comment_id, cm.file, cm.line, CASE WHEN f.patch_id IS NULL THEN 'file not in change' WHEN ok.line IS NULL THEN 'line not in diff' END AS problem FROM cm LEFT JOIN f ON f.file = cm.file LEFT JOIN ok ON ok.patch_id = f.patch_id AND ok.line = cm.line""")
def validate_comments(spark, sf_dir):
    patches = t.patches(spark, sf_dir)
    files = patches.groupBy("file").agg(F.min("patch_id").alias("patch_id"))
    name = "'src/m' || CAST(event_id % 60 AS STRING) || CASE event_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' ELSE '_test.py' END AS file"
    comments = t.table(spark, sf_dir, "events").selectExpr("event_id AS comment_id", name, "event_id % 40 AS line")
    return diff.check_comments(comments, diff.parse_patch(patches), files)


_RAW = f"""dl AS (SELECT pr_id, unnest(range(0, len(x))) AS pos, unnest(x) AS raw FROM (SELECT pr_id, string_split(diff, chr(10)) AS x FROM ({t.DIFF_SQL}))),
df AS (SELECT *, last_value(CASE WHEN starts_with(raw, '+++ b/') THEN substr(raw, 7) WHEN starts_with(raw, 'diff --git ') OR starts_with(raw, '+++ /dev/null') THEN '' END IGNORE NULLS) OVER (PARTITION BY pr_id ORDER BY pos) AS file FROM dl)"""


@query(f"WITH {_RAW} SELECT pr_id, file, string_agg(raw, chr(10) ORDER BY pos) AS patch FROM df WHERE file <> '' AND NOT {_or('raw', 'starts_with', ('diff --git ', '--- ', '+++ ', 'index ', 'new file', 'deleted file', 'old mode', 'new mode', 'similarity index', 'rename ', 'Binary '))} GROUP BY pr_id, file")
def parse_raw_diff(spark, sf_dir):
    return diff.parse_raw_diff(t.raw_diffs(spark, sf_dir))


@query(f"WITH {_RAW} SELECT DISTINCT pr_id, regexp_extract(raw, '^(?:\\+\\+\\+ b|--- a)/(.+)$', 1) AS path, regexp_extract(raw, '[^/]*$') AS base FROM df WHERE regexp_matches(raw, '^(?:\\+\\+\\+ b|--- a)/(.+)$')")
def diff_files(spark, sf_dir):
    return diff.diff_files(t.raw_diffs(spark, sf_dir))


_PARTS = f"""pt AS (SELECT pr_id, unnest(range(0, len(x))) AS part_no, unnest(x) AS part FROM (SELECT pr_id, string_split(diff, 'diff --git ') AS x FROM ({t.DIFF_SQL}))),
pc AS (SELECT *, strlen(part) AS bytes, lower(string_split(part, chr(10))[1]) AS first, len(regexp_extract_all(part, '\\n\\+')) - len(regexp_extract_all(part, '\\n\\+\\+\\+')) AS adds, len(regexp_extract_all(part, '\\n-')) - len(regexp_extract_all(part, '\\n---')) AS dels FROM pt WHERE trim(part) <> ''),
pw AS (SELECT pr_id, part_no, bytes, (greatest(adds, 0) + greatest(dels, 0) + 2 * least(greatest(adds, 0), greatest(dels, 0)))::DOUBLE {' '.join(f"* CASE WHEN {_or('first', 'contains', names)} THEN {factor}::DOUBLE ELSE 1.0::DOUBLE END" for names, factor in diff.PART_WEIGHTS)} AS weight FROM pc)"""


@query(f"""WITH {_PARTS}, so AS (SELECT *, sum(bytes + 11) OVER (PARTITION BY pr_id ORDER BY weight DESC, part_no) AS so_far FROM pw)
SELECT so.pr_id, so.part_no::BIGINT AS part_no, round(weight, 6) AS weight FROM so JOIN ({t.DIFF_SQL}) d ON d.pr_id = so.pr_id WHERE strlen(diff) <= 12000 OR so_far <= 12000""")
def truncate_diff(spark, sf_dir):
    return diff.truncate_diff(t.raw_diffs(spark, sf_dir), 12_000).select("pr_id", F.col("part_no").cast("long").alias("part_no"), F.round("weight", 6).alias("weight"))


_GREP = "SELECT doc_id AS file, line, lower(text) AS low, text, l FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(lower(text), 'the an')"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")


@query(f"SELECT file, line, (strlen(substr(low, 1, instr(low, 'the an') - 1)) + 1)::BIGINT AS col, text FROM ({_GREP})")
def grep(spark, sf_dir):
    return diff.grep(_files(spark, sf_dir), "the an").select("file", "line", "col", "text")


@query(f"SELECT file, line, array_to_string(l[greatest(line - 2, 1):line - 1], chr(10)) AS before, array_to_string(l[line + 1:line + 2], chr(10)) AS after FROM ({_GREP})")
def grep_context(spark, sf_dir):
    return diff.grep(_files(spark, sf_dir), "the an", context=2).select("file", "line", "before", "after")


@query(f"SELECT count(*) AS matches, count(DISTINCT file) AS files FROM ({_GREP}) WHERE file % 7 <> 0")
def grep_repo_wide(spark, sf_dir):
    """Matches outside the files of a change (every seventh), with the total beside any shown limit."""
    files = _files(spark, sf_dir)
    change = files.where("file % 7 = 0").select("file")
    return diff.grep(files, "the an").join(change, "file", "left_anti").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("file").alias("files"))


# ---------------------------------------------------------------- findings

#: The entity that a finding is about.
ENTITY_OF = "CASE WHEN pos % 3 = 0 THEN 'e' || CAST(pos % 17 AS VARCHAR(9)) END"
FOUND, GOLD = t.sql(t.FINDINGS, "events", "event_id % 37 <> 0"), t.sql(t.GOLDEN, "events", "event_id % 37 = 0")


@query(f"SELECT pr_id, lens_idx, pos, issue FROM ({FOUND}) WHERE lens_idx <> 4")
def merge_lenses(spark, sf_dir):
    """Lens outputs in one table; a failed lens (here the fifth) adds nothing."""
    return t.findings(spark, sf_dir).where("lens_idx <> 4").select("pr_id", "lens_idx", "pos", "issue")


@query(f"SELECT pr_id, lens_idx, pos, issue FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, left(lower(issue), {funnel.DEDUP_PREFIX}) ORDER BY lens_idx, pos) AS rn FROM ({FOUND})) WHERE rn = 1")
def dedup_findings_prefix(spark, sf_dir):
    return funnel.first_of_prefix(t.findings(spark, sf_dir)).select("pr_id", "lens_idx", "pos", "issue")


_CHANGED_FILES = "SELECT DISTINCT user_id AS pr_id, 'src/f' || CAST(event_id % 3 AS VARCHAR(9)) || '.py' AS path FROM events WHERE user_id % 4 <> 0"
_STRUCT = f"SELECT * FROM ({FOUND}) f WHERE NOT EXISTS (SELECT 1 FROM ({_CHANGED_FILES}) c WHERE c.pr_id = f.pr_id) OR regexp_extract(issue, 'in (f\\d+\\.py)', 1) IN (SELECT regexp_extract(path, '[^/]*$') FROM ({_CHANGED_FILES}) c WHERE c.pr_id = f.pr_id)"


def _structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.table(spark, sf_dir, "events").where("user_id % 4 <> 0").selectExpr("user_id AS pr_id", "'src/f' || CAST(event_id % 3 AS STRING) || '.py' AS path").distinct()
    return funnel.structural_filter(t.findings(spark, sf_dir), files)


@query(f"SELECT pr_id, pos FROM ({_STRUCT})")
def structural_filter(spark, sf_dir):
    return _structural(spark, sf_dir).select("pr_id", "pos")


@query(f"SELECT pr_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY pr_id) AS n, row_number() OVER (PARTITION BY pr_id ORDER BY lens_idx, pos) AS rn FROM ({_STRUCT})) WHERE n <= {funnel.SHORTCUT} OR rn <= {funnel.MAX_VALIDATED}")
def funnel_topk(spark, sf_dir):
    return funnel.capped(_structural(spark, sf_dir)).select("pr_id", "pos")


@query(f"SELECT f.pr_id, o AS ord, f.idx, issue FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY lens_idx, pos) AS idx FROM ({FOUND})) f JOIN (SELECT user_id AS pr_id, unnest([0, 1, 2, 3]) AS o, unnest([user_id % 5 + 1, 2, 2, 9999]) AS idx FROM (SELECT DISTINCT user_id FROM events)) a ON a.pr_id = f.pr_id AND a.idx = f.idx")
def kept_indices(spark, sf_dir):
    answers = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("pr_id")).distinct().withColumn("indices", F.array(F.col("pr_id") % 5 + 1, F.lit(2), F.lit(2), F.lit(9999)))
    rows = funnel.kept_indices(t.findings(spark, sf_dir), answers)
    return rows.select("pr_id", F.col("ord").cast("long").alias("ord"), F.col("idx").cast("long").alias("idx"), "issue")


@query(f"SELECT pr_id, pos, confidence FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY confidence DESC, pos) AS rn FROM ({FOUND}) WHERE confidence >= 3) WHERE rn <= 15")
def per_pr_cap(spark, sf_dir):
    return funnel.per_change_cap(funnel.confident(t.findings(spark, sf_dir))).select("pr_id", "pos", "confidence")


@query()
def dedup_findings_greedy(spark, sf_dir):
    """Order-dependent greedy merge; tests hold it against a plain Python fold."""
    return funnel.dedup_greedy(t.findings(spark, sf_dir).withColumn("entity_name", F.expr(ENTITY_OF)))


def _per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("pr_id", F.col("change_seq") % 5)


@query(f"WITH {SCORED}, x AS (SELECT *, change_seq % 5 AS pr_id FROM ranked), y AS (SELECT *, row_number() OVER (PARTITION BY pr_id, file_path ORDER BY risk_score DESC, change_seq) AS turn, max(risk_score) OVER (PARTITION BY pr_id, file_path) AS best, min(change_seq) OVER (PARTITION BY pr_id, file_path) AS first FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY turn, best DESC, first) AS rank FROM y) SELECT pr_id, entity_id, turn, rank FROM z WHERE rank <= 30")
def round_robin_select(spark, sf_dir):
    rows = funnel.round_robin(_per_file(spark, sf_dir))
    return rows.select("pr_id", "entity_id", F.col("turn").cast("long").alias("turn"), F.col("rank").cast("long").alias("rank"))


@query()
def round_robin_exact(spark, sf_dir):
    """The turn order with its shift when a file runs empty; tests hold it against the fold itself."""
    return funnel.round_robin_exact(_per_file(spark, sf_dir).select("pr_id", "entity_id", "file_path", "risk_score", "change_seq"))


@query(f"WITH {SCORED}, x AS (SELECT *, change_seq % 5 AS pr_id FROM ranked), h AS (SELECT DISTINCT pr_id, file_path FROM x WHERE risk_rank >= 1), l AS (SELECT *, row_number() OVER (PARTITION BY pr_id, file_path ORDER BY risk_score DESC, change_seq) AS rn FROM x WHERE risk_rank = 0 AND (pr_id, file_path) NOT IN (SELECT pr_id, file_path FROM h)) SELECT pr_id, file_path, entity_id FROM l WHERE rn = 1")
def fill_uncovered(spark, sf_dir):
    rows = _per_file(spark, sf_dir)
    return funnel.fill_uncovered(rows.where("risk_rank >= 1"), rows.where("risk_rank = 0"))


_CHUNKS = f"SELECT patch_id % 20 AS pr_id, file || patch_id::VARCHAR || CASE patch_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' ELSE '.xyz' END AS file, length(patch) AS chunk_len FROM ({t.PATCH_SQL})"
_COVER = "SELECT DISTINCT user_id % 20 AS pr_id, 'm' || CAST(event_id % 50 AS VARCHAR(9)) || '.rs' || CAST(event_id % 700 AS VARCHAR(9)) || '.rs' AS path FROM events"


@query(f"WITH ch AS ({_CHUNKS}), cv AS ({_COVER}), rest AS (SELECT * FROM ch WHERE chunk_len > 50 AND NOT EXISTS (SELECT 1 FROM cv WHERE cv.pr_id = ch.pr_id AND (ends_with(ch.file, cv.path) OR ends_with(cv.path, ch.file)))) SELECT pr_id, file, rank FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY CASE WHEN ends_with(file, '.rs') THEN 2 WHEN ends_with(file, '.md') THEN 0 ELSE 1 END DESC, chunk_len DESC, file) AS rank FROM rest) WHERE rank <= 5")
def gap_files(spark, sf_dir):
    suffix = F.when(F.col("patch_id") % 3 == 0, ".md").when(F.col("patch_id") % 3 == 1, ".rs").otherwise(".xyz")
    chunks = t.patches(spark, sf_dir).select((F.col("patch_id") % 20).alias("pr_id"), F.concat("file", F.col("patch_id").cast("string"), suffix).alias("file"), F.length("patch").alias("chunk_len"))
    covered = t.table(spark, sf_dir, "events").selectExpr("user_id % 20 AS pr_id", "'m' || CAST(event_id % 50 AS STRING) || '.rs' || CAST(event_id % 700 AS STRING) || '.rs' AS path")
    return funnel.gap_files(chunks, covered).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- judging and accounts

_IDENT = "list_distinct(list_filter(flatten([" + ", ".join([*(f"regexp_extract_all({{0}}, '{x}')" for x in judge.IDENTIFIER_PATTERNS), "regexp_extract_all({0}, '`([^`]+)`', 1)", "regexp_extract_all({0}, '''([^'']+)''', 1)"]) + f"]), lambda x: length(x) >= 3 AND lower(x) NOT IN {judge.STOP_WORDS}))"


def _ids(x: str) -> str:
    return _IDENT.replace("{0}", x)


@query()
def extract_identifiers(spark, sf_dir):
    """No SQL: its word boundaries know no letters but ASCII ones; tests hold all documents against Python."""
    docs = t.table(spark, sf_dir, "documents")
    ids = judge.identifiers(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.size(ids).cast("long").alias("n"), F.array_join(F.array_sort(ids), ",").alias("ids"))


_LOWSET = lambda x: f"list_transform({_ids(x)}, lambda y: lower(y))"
_JUDGED = f"""g AS ({GOLD}), f AS ({FOUND}),
pm AS (SELECT g.*, f.line, f.issue, row_number() OVER (PARTITION BY gold_id ORDER BY f.pos) AS rn FROM g JOIN f ON f.pr_id = g.pr_id WHERE ends_with(g.path, f.file) OR ends_with(f.file, g.path)),
judged AS (SELECT g.gold_id, g.severity, CASE WHEN pm.gold_id IS NULL THEN 'miss' WHEN (line <> 0 AND greatest(1, (CASE WHEN pm.from_line = 0 THEN pm.to_line ELSE pm.from_line END) - 10) <= line AND line <= pm.to_line + 10) OR len(list_intersect({_LOWSET('pm.note')}, {_LOWSET('pm.issue')})) > 0 THEN 'match' ELSE 'partial' END AS verdict FROM g LEFT JOIN pm ON pm.gold_id = g.gold_id AND pm.rn = 1)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.judge_by_path(t.golden(spark, sf_dir), t.findings(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT * FROM judged")
def judge_path_line(spark, sf_dir):
    return _judged(spark, sf_dir)


@query(f"WITH g AS ({GOLD}), f AS ({FOUND}), gw AS (SELECT gold_id, pr_id, unnest({_LOWSET('note')}) AS w FROM g), fw AS (SELECT DISTINCT pr_id, unnest({_LOWSET('issue')}) AS w FROM f) SELECT gold_id, CASE WHEN gold_id IN (SELECT gold_id FROM gw JOIN fw USING (pr_id, w)) THEN 'match' ELSE 'miss' END AS verdict FROM g")
def judge_overlap(spark, sf_dir):
    return judge.judge_by_identifiers(t.golden(spark, sf_dir), t.findings(spark, sf_dir))


_NAMES = "SELECT user_id AS pr_id, list_distinct(list(event_type) FILTER (WHERE value > 60)) AS hc_names, list_distinct(list(event_type || '_x') FILTER (WHERE value > 30)) AS all_names, list_distinct(list('src/' || event_type || '.py') FILTER (WHERE value > 90)) AS hc_files, count(*) AS entity_count FROM events WHERE event_id % 37 <> 0 GROUP BY user_id"


@query(f"""WITH g AS ({GOLD}), n AS ({_NAMES}), x AS (SELECT g.gold_id, {_LOWSET('note')} AS ids, hc_names, all_names, hc_files, entity_count FROM g LEFT JOIN n USING (pr_id)),
y AS (SELECT *, EXISTS (SELECT 1 FROM unnest(ids) AS a(i), unnest(list_concat(coalesce(hc_names, []), coalesce(all_names, []))) AS b(m) WHERE contains(m, i) OR contains(i, m)) AS hit, EXISTS (SELECT 1 FROM unnest(ids) AS a(i), unnest(coalesce(hc_files, [])) AS b(m) WHERE contains(m, i)) AS inside FROM x)
SELECT gold_id, CASE WHEN hit THEN 'match' WHEN inside THEN 'partial' WHEN coalesce(entity_count, 0) = 0 THEN 'miss' ELSE 'partial' END AS verdict FROM y""")
def judge_names(spark, sf_dir):
    """Names come from the rows of all findings."""
    e = t.table(spark, sf_dir, "events").where("event_id % 37 <> 0")
    names = lambda cond, x: F.collect_set(F.when(F.expr(cond), x))
    kind = F.col("event_type")
    per_pr = e.groupBy(F.col("user_id").alias("pr_id")).agg(names("value > 60", kind).alias("hc_names"), names("value > 30", F.concat(kind, F.lit("_x"))).alias("all_names"), names("value > 90", F.concat(F.lit("src/"), kind, F.lit(".py"))).alias("hc_files"), F.count(F.lit(1)).alias("entity_count"))
    return judge.judge_by_names(t.golden(spark, sf_dir), per_pr)


@query(f"WITH {_JUDGED} SELECT gold_id, severity, CASE WHEN gold_id % 11 = 0 THEN 'match' ELSE verdict END AS verdict FROM judged")
def apply_overrides(spark, sf_dir):
    by_hand = t.golden(spark, sf_dir).where("gold_id % 11 = 0").select("gold_id", F.lit("match").alias("verdict"))
    return judge.apply_overrides(_judged(spark, sf_dir), by_hand)


def _metrics_sql(keys: str, found: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""WITH {_JUDGED}, c AS (SELECT {head}count(*) AS n, count(*) FILTER (WHERE verdict = 'match') AS matches, count(*) FILTER (WHERE verdict = 'partial') AS partials FROM judged {group}), k AS ({found}),
r AS (SELECT c.*, findings, matches / n AS recall, (matches + partials) / n AS lenient, CASE WHEN findings > 0 THEN matches / findings ELSE 0.0 END AS prec FROM c {'LEFT JOIN k USING (' + keys + ')' if keys else ', k'})
SELECT {head}n, matches, partials, round(recall, 6) AS recall, round(lenient, 6) AS lenient_recall, round(prec, 6) AS "precision", CASE WHEN prec + recall > 0 THEN round(2 * prec * recall / (prec + recall), 6) ELSE 0.0 END AS f1 FROM r"""


@query(_metrics_sql("", f"SELECT count(*) AS findings FROM (SELECT DISTINCT pr_id, file FROM ({FOUND}))"))
def judge_metrics(spark, sf_dir):
    n = t.findings(spark, sf_dir).select("pr_id", "file").distinct().agg(F.count(F.lit(1)).alias("findings"))
    return judge.metrics(_judged(spark, sf_dir), n)


@query(_metrics_sql("severity", f"SELECT CASE pos % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS findings FROM ({FOUND}) GROUP BY 1"))
def judge_breakdown(spark, sf_dir):
    level = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (F.col("pos") % 4 + 1).cast("int"))
    n = t.findings(spark, sf_dir).groupBy(level.alias("severity")).agg(F.count(F.lit(1)).alias("findings"))
    return judge.metrics(_judged(spark, sf_dir), n, "severity")


REV, KEYS = t.sql(t.REVIEWS, "orders"), t.sql(t.KEYS, "customer")


@query(f"SELECT review_id, user_id, created_at::VARCHAR AS created_at, status FROM ({REV}) WHERE user_id = 7 ORDER BY created_at DESC, review_id DESC LIMIT 20")
def recent_reviews(spark, sf_dir):
    return judge.recent(t.reviews(spark, sf_dir), 7).select("review_id", "user_id", F.col("created_at").cast("string").alias("created_at"), "status")


@query(f"SELECT user_id, sum(n_findings)::BIGINT AS n_findings FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, review_id DESC) AS rn FROM ({REV})) WHERE rn <= 10 GROUP BY user_id")
def recent_findings_total(spark, sf_dir):
    return judge.newest_per_user(t.reviews(spark, sf_dir), 10).groupBy("user_id").agg(F.sum("n_findings").alias("n_findings"))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, review_id DESC) AS rn FROM ({REV})), u AS (SELECT user_id, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o, max(created_at) AS a FROM r WHERE rn <= 100 GROUP BY user_id) SELECT k.user_id, sum(request_count)::BIGINT AS requests, coalesce(max(i), 0) AS input_tokens, coalesce(max(o), 0) AS output_tokens, coalesce(round(max(i) / 1e6::DOUBLE * 0.2::DOUBLE + max(o) / 1e6::DOUBLE * 15, 6), 0.0) AS cost, max(a)::VARCHAR AS last_activity FROM ({KEYS}) k LEFT JOIN u USING (user_id) GROUP BY k.user_id")
def usage_summary(spark, sf_dir):
    return judge.usage(t.reviews(spark, sf_dir), t.api_keys(spark, sf_dir))


@query(f"SELECT user_id, max(created_at)::VARCHAR AS last_activity FROM ({REV}) GROUP BY user_id")
def last_activity(spark, sf_dir):
    return t.reviews(spark, sf_dir).groupBy("user_id").agg(F.max("created_at").cast("string").alias("last_activity"))


@query(f"SELECT key_id, request_count FROM ({KEYS}) WHERE NOT revoked")
def active_keys(spark, sf_dir):
    return t.api_keys(spark, sf_dir).where("not revoked").select("key_id", "request_count")


@query("SELECT user_id AS job_id, max_by(event_type, struct_pack(a := ts, b := event_id)) AS status, max(ts)::VARCHAR AS at FROM events GROUP BY user_id")
def job_latest_status(spark, sf_dir):
    return jobs.latest_status(t.table(spark, sf_dir, "events").selectExpr("user_id AS job_id", "event_type AS status", "ts AS at", "event_id AS seq")).withColumn("at", F.col("at").cast("string"))


# ---------------------------------------------------------------- texts of reviewers


@query(f"SELECT pos, file, line, 0::BIGINT AS end_line, issue AS description, 3::BIGINT AS confidence FROM ({FOUND})")
def parse_findings_json(spark, sf_dir):
    text = F.concat(F.lit("Found: ["), F.to_json(F.struct(F.col("file").alias("path"), F.col("line").alias("from_line"), F.col("issue").alias("message"))), F.lit(", 7] done"))
    rows = t.findings(spark, sf_dir).select("pos", F.explode(parsing.findings(text)).alias("x"))
    return rows.select("pos", "x.*")


@query(f"SELECT pos, file, line, line + 3 AS end_line, '[' || severity || '] ' || issue AS description FROM ({FOUND})")
def parse_report_blocks(spark, sf_dir):
    line = F.col("line").cast("string")
    text = F.concat(F.lit("Report\nFile: "), "file", F.lit("\nLine: "), line, F.lit(" to "), (F.col("line") + 3).cast("string"), F.lit("\nType: "), "severity", F.lit("\n\nComment:\n"), "issue", F.lit("\n\nMore."))
    rows = t.findings(spark, sf_dir).select("pos", F.explode(parsing.report_blocks(text)).alias("x"))
    return rows.select("pos", "x.*")


@query(f"WITH {SCORED} SELECT risk_level AS verdict, count(*) AS n FROM scored GROUP BY risk_level")
def review_verdict_counts(spark, sf_dir):
    """Answers of an offline reviewer that repeats the level it was shown."""
    rows = scored(spark, sf_dir).select("entity_id", F.concat(F.lit('{"verdict": "'), "risk_level", F.lit('"}')).alias("answer"))
    return reviewer.verdict_counts(rows.select("entity_id", parsing.model_verdict(F.col("answer"))["verdict"].alias("verdict")))


@query(f"SELECT user_id AS pr_id, lens AS lens_idx, count(*) AS n FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, {len(reviewer.LENSES)})) AS lens) GROUP BY 1, 2")
def lens_calls(spark, sf_dir):
    prs = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("pr_id")).distinct()
    return reviewer.lens_calls(prs).groupBy("pr_id", F.col("lens_idx").cast("long").alias("lens_idx")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT pr_id, count(pos) AS n_candidates FROM (SELECT DISTINCT user_id AS pr_id FROM events) LEFT JOIN (SELECT * FROM ({FOUND}) WHERE pr_id % 3 <> 0) USING (pr_id) GROUP BY pr_id")
def export_candidates(spark, sf_dir):
    """Every pull request with its findings as one array, empty where a tool has none."""
    urls = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("url")).distinct()
    found = t.findings(spark, sf_dir).where("pr_id % 3 <> 0").withColumnRenamed("pr_id", "url")
    return reviewer.candidates(urls, found).select(F.col("url").alias("pr_id"), F.size("candidates").cast("long").alias("n_candidates"))


from deltascope.plans import details, matches, reviews  # noqa: E402, F401  register further queries
