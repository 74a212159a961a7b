"""Queries of whole reviews: from the two sides of changed files to ranked entities, and the scoped graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltascope.operators import extract, review, symbols
from deltascope.plans import catalog as q
from deltascope.plans.catalog import CHANGES, SCORED, query
from deltascope.sources import tables as t

#: One entity a document: what an extractor would have found, by arithmetic.
ENTITY = {
    "entity_id": "'e' || CAST(doc_id AS VARCHAR(12))",
    "entity_name": "CASE doc_id % 3 WHEN 0 THEN 'Run' WHEN 1 THEN 'run' ELSE 'Émile' END || CAST(doc_id AS VARCHAR(12))",
    "entity_type": "CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'chunk' END",
    "file_path": "'src/m' || CAST(doc_id % 9 AS VARCHAR(9)) || '/f' || CAST(doc_id % 70 AS VARCHAR(9)) || '.rs'",
    "change_type": "CASE doc_id % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END",
    "start_line": "doc_id % 50",
    "end_line": "doc_id % 50 + 3",
    "structural_change": "CASE WHEN doc_id % 6 IN (0, 1) THEN NULL ELSE doc_id % 5 <> 2 END",
}
_HEAD = "CASE doc_id % 5 WHEN 0 THEN 'pub fn x() {' || chr(10) WHEN 1 THEN 'export x' || chr(10) WHEN 2 THEN 'let pub' || chr(10) ELSE '' END"
_OLD = f"CASE WHEN doc_id % 6 = 0 THEN NULL ELSE {_HEAD} || before END"
_NEW = f"CASE WHEN doc_id % 6 = 1 THEN NULL ELSE {_HEAD} || after END"


def _changed(spark, sf_dir):
    return q._texts(spark, sf_dir).selectExpr("doc_id", f"{_OLD} AS before_content", f"{_NEW} AS after_content", *t.columns(ENTITY)).drop("doc_id")


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_RAW_SCORED = SCORED.replace(f"c AS ({CHANGES})", f"""l AS ({t.LINES_SQL}),
wtx AS (SELECT doc_id, string_agg(before, chr(10) ORDER BY i) AS before, string_agg(after, chr(10) ORDER BY i) AS after FROM l GROUP BY doc_id),
ent AS (SELECT doc_id, {_OLD} AS before_content, {_NEW} AS after_content, {', '.join(t.columns(ENTITY))} FROM wtx),
la AS (SELECT DISTINCT entity_id, {_TRIM.format('unnest(string_split(before_content, chr(10)))')} AS x FROM ent), lb AS (SELECT DISTINCT entity_id, {_TRIM.format('unnest(string_split(after_content, chr(10)))')} AS x FROM ent),
ld AS (SELECT * FROM (SELECT * FROM la EXCEPT SELECT * FROM lb) UNION ALL (SELECT * FROM lb EXCEPT SELECT * FROM la)),
lk AS (SELECT entity_id, bool_or({q._comment('x')}) AS t, bool_or(NOT {q._comment('x')} AND {q._signature('x')}) AS s, bool_or(NOT {q._comment('x')} AND NOT {q._signature('x')}) AS f FROM ld WHERE x <> '' GROUP BY entity_id),
cls AS (SELECT ent.entity_id, CASE WHEN coalesce(before_content, '') = '' OR coalesce(after_content, '') = '' THEN 'functional' WHEN structural_change IS NOT DISTINCT FROM false THEN 'text'
  WHEN lk.entity_id IS NULL THEN CASE WHEN {_TRIM.format('before_content')} <> {_TRIM.format('after_content')} THEN 'functional' ELSE 'text' END
  ELSE concat_ws('+', CASE WHEN t THEN 'text' END, CASE WHEN s THEN 'syntax' END, CASE WHEN f THEN 'functional' END) END AS classification FROM ent LEFT JOIN lk USING (entity_id)),
c AS (SELECT ent.*, classification, row_number() OVER (ORDER BY file_path, start_line, entity_id) AS change_seq FROM ent JOIN cls USING (entity_id))""")
REVIEWED = _RAW_SCORED.replace(q.PUBLIC, f"(regexp_matches(coalesce(string_split(after_content, chr(10))[1], ''), '^(pub |pub\\(crate\\)|export |module\\.exports)') OR {q.PUBLIC})")


@query(f"""WITH {REVIEWED}, {q._COMPONENTS}, sized AS (SELECT component, count(*) AS size, min(review_rank) AS first FROM ranked JOIN comp USING (entity_id) GROUP BY component), g AS (SELECT component, row_number() OVER (ORDER BY size DESC, first) - 1 AS group_id FROM sized)
SELECT entity_id, classification, round(risk_score, 6) AS risk_score, risk_level, blast_radius, dependent_count, dependency_count, is_public_api, group_id::BIGINT AS group_id, review_rank::BIGINT AS review_rank FROM ranked JOIN comp USING (entity_id) JOIN g USING (component)""")
def review_change(spark, sf_dir):
    """Every document is a changed entity with its old and new text, in the graph of all parts."""
    total = t.table(spark, sf_dir, "part").count()
    rows = review.review_entities(_changed(spark, sf_dir), t.edges(spark, sf_dir, hubs=True), total)
    return rows.select("entity_id", "classification", F.round("risk_score", 6).alias("risk_score"), "risk_level", "blast_radius", "dependent_count", "dependency_count", "is_public_api", F.col("group_id").cast("long").alias("group_id"), F.col("review_rank").cast("long").alias("review_rank"))


@query()
def review_files(spark, sf_dir):
    """The whole way from files: entities by the outline, classes, scores.  An extractor is code: tests hold it on fixtures."""
    files = q._texts(spark, sf_dir).select(F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), F.col("before").alias("before_content"), F.col("after").alias("after_content"))
    return review.review_change(files).select("entity_id", "change_type", "classification", "structural_change", "risk_level", "review_rank")


# ---------------------------------------------------------------- the scoped graph

#: Documents as entities: some in one file, named by their first word.
_FILE = "'src/p' || CAST(doc_id % 5 AS VARCHAR(9)) || CASE doc_id % 3 WHEN 0 THEN '' ELSE '/q' || CAST(doc_id % 4 AS VARCHAR(9)) END || '/f' || CAST(doc_id % 120 AS VARCHAR(9)) || '.py'"
_WORDS = "[A-Za-z_][A-Za-z0-9_]*"
_IMPORTS = f"SELECT DISTINCT x.file_path, y.file_path AS target_path FROM (SELECT doc_id, {_FILE} AS file_path FROM documents) x JOIN (SELECT doc_id, {_FILE} AS file_path FROM documents) y ON y.doc_id = x.doc_id + 13 OR y.doc_id = x.doc_id + 40 WHERE x.file_path <> y.file_path"


def _entities(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{_FILE} AS file_path")
    return docs.select("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("entity_id"), F.regexp_extract("text", _WORDS, 0).alias("entity_name"), "file_path", F.col("text").alias("content"))


@query(f"""WITH d AS (SELECT doc_id, 'd' || lpad(doc_id::VARCHAR, 9, '0') AS id, {_FILE} AS file, regexp_extract_all(text, '{_WORDS}') AS w FROM documents),
fold AS (SELECT *, regexp_replace(file, '/?[^/]*$', '') AS folder FROM d), im AS ({_IMPORTS}),
def AS (SELECT w[1] AS word, file, folder, min(id) AS id FROM fold WHERE len(w) > 0 GROUP BY 1, 2, 3),
ref AS (SELECT DISTINCT id AS src, file, folder, unnest(w) AS word FROM fold), fw AS (SELECT DISTINCT file, folder, word FROM ref WHERE word IN (SELECT word FROM def)),
own AS (SELECT fw.file, fw.word, id, 0 AS tier FROM fw JOIN def ON def.file = fw.file AND def.word = fw.word),
imp AS (SELECT fw.file, fw.word, min(id) AS id, 1 AS tier FROM fw JOIN im ON im.file_path = fw.file JOIN def ON def.file = im.target_path AND def.word = fw.word GROUP BY 1, 2),
pairs AS (SELECT fw.file, fw.word, def.id, def.file AS there, (SELECT max(n) FROM unnest(range(0, len(string_split(fw.folder, '/')) + 1)) AS z(n) WHERE n <= len(string_split(def.folder, '/')) AND string_split(fw.folder, '/')[:n] = string_split(def.folder, '/')[:n]) AS common FROM fw JOIN def USING (word)),
near AS (SELECT file, word, id, 2 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY file, word ORDER BY common DESC, len(string_split(there, '/')), there, id) AS rn FROM pairs) WHERE rn = 1),
best AS (SELECT file, word, min_by(id, tier) AS dst, min(tier) AS tier FROM (SELECT * FROM own UNION ALL SELECT * FROM imp UNION ALL SELECT * FROM near) GROUP BY file, word)
SELECT src, dst, CASE min(tier) WHEN 0 THEN '{symbols.OWN}' WHEN 1 THEN '{symbols.IMPORTED}' ELSE '{symbols.NEAREST}' END AS found FROM ref JOIN best USING (file, word) WHERE src <> dst GROUP BY src, dst""")
def scoped_edges(spark, sf_dir):
    """Documents that speak of other documents, by own file, imported file, nearest folder."""
    rows = _entities(spark, sf_dir)
    a, b = rows.select("doc_id", "file_path"), rows.select(F.col("doc_id").alias("other"), F.col("file_path").alias("target_path"))
    near = a.withColumn("other", F.explode(F.array(F.col("doc_id") + 13, F.col("doc_id") + 40))).join(b, "other")
    return symbols.scoped_edges(rows, near.where("file_path <> target_path").select("file_path", "target_path"))
