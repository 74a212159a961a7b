"""Readers, and adapters from the star-schema tables to change-review inputs.

The adapters are deterministic arithmetic; the expressions are plain SQL that
both Spark and the checking engine understand.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written inside the calls of ``contained`` that are running, the innermost last.
_INSIDE: list[list[str]] = []


def delete(spark: SparkSession, path: str, at_end: bool = False) -> None:
    """Delete a path, now or when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(at) if at_end else system.delete(at, True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the session's checkpoint folder; without that setting only a local master gets one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the session's checkpoint folder, which all machines share.

    It is computed once (a checkpoint computes its rows twice), and its size is
    known to the plans that read it.  It goes when the driver ends, or with the operator
    that wrote it on its way (``contained``).
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    if _INSIDE:
        _INSIDE[-1].append(path)
    else:
        delete(spark, path, at_end=True)
    return spark.read.schema(df.schema).parquet(path)


def contained(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is a table; the tables that it wrote on its way are deleted."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        own: list[str] = []
        _INSIDE.append(own)
        try:
            out = operator(*args, **kwargs)
        finally:
            _INSIDE.pop()
        kept = cut(out)
        for path in own:
            delete(out.sparkSession, path)
        return kept

    return run


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the total order ``order``, by a range sort and the counts of its parts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = cut(placed.withColumns({"__part": F.shiftright("__id", 33), "__nth": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id"))
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row for each of the n parts
    before = parts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__nth") + 1).drop("__part", "__nth", "__before")


#: Classes in the order of their bits: text, syntax, functional.
CLASSES = ("text", "syntax", "functional", "text+syntax", "text+functional", "syntax+functional", "text+syntax+functional")
_PICK = lambda n, names: "CASE {} END".format(" ".join(f"WHEN {n} = {i} THEN '{x}'" for i, x in enumerate(names)))

NAME = "CASE WHEN p_partkey % 3 = 0 THEN upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '_') ELSE replace(p_name, ' ', '_') END"
PATH = "replace(lower(p_type), ' ', '_') || '/' || lower(replace(p_brand, '#', '')) || '/f' || CAST(p_partkey % 40 AS VARCHAR(9)) || " + _PICK("p_partkey % 8", (".rs", ".ts", ".py", ".go", ".java", ".md", ".tsx", ".json"))
CHANGES = {
    "change_seq": "p_partkey",
    "entity_id": "'e' || CAST(p_partkey AS VARCHAR(12))",
    "entity_name": NAME,
    "entity_type": _PICK("p_size % 6", ("function", "method", "struct", "class", "field", "chunk")),
    "file_path": PATH,
    "change_type": _PICK("p_partkey % 5", ("deleted", "modified", "renamed", "added", "moved")),
    "classification": _PICK("p_partkey % 7", CLASSES),
    "structural_change": "CASE WHEN p_size % 4 = 1 THEN NULL WHEN p_size % 4 = 0 THEN false ELSE true END",
    "after_len": "CAST(floor(p_retailprice) AS BIGINT)",
}
CHANGED = "p_partkey % 4 <> 3"
NOISE_NAMES = ("yarn.lock", "Cargo.lock", "go.sum", "a.min.js", "b.map", "dist/x.js", "build/y.js", "src/dist/z.js", "c.snap", "d.chunk.js", ".DS_Store")
PATHS = {"path_id": "p_partkey", "path": f"CASE WHEN p_partkey % 5 = 0 THEN {_PICK('p_partkey % 11', NOISE_NAMES)} ELSE {PATH} END"}
FINDINGS = {
    "pr_id": "user_id",
    "lens_idx": "CAST(event_id % 9 AS INT)",
    "pos": "event_id",
    "file": "'f' || CAST(user_id % 7 AS VARCHAR(9)) || '.py'",
    "line": "CAST(floor(value) AS BIGINT)",
    "confidence": "CAST(1 + event_id % 5 AS INT)",
    "severity": "event_type",
    "issue": "event_type || ' in f' || CAST(event_id % 9 AS VARCHAR(9)) || '.py value ' || CAST(event_id % 50 AS VARCHAR(9))",
}
GOLDEN = {
    "gold_id": "event_id",
    "pr_id": "user_id",
    "path": "'src/f' || CAST(event_id % 9 AS VARCHAR(9)) || '.py'",
    "from_line": "greatest(CAST(floor(value) AS BIGINT) - 3, 0)",
    "to_line": "CAST(floor(value) AS BIGINT) + 3",
    "note": FINDINGS["issue"],
    "severity": _PICK("event_id % 4", ("critical", "high", "medium", "low")),
}
REVIEWS = {
    "review_id": "o_orderkey",
    "user_id": "o_custkey",
    "created_at": "CAST(o_orderdate AS DATE)",
    "status": _PICK("CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END", ("pending", "complete", "failed")),
    "input_tokens": "CAST(floor(o_totalprice) AS BIGINT)",
    "output_tokens": "o_orderkey % 5000",
    "n_findings": "o_orderkey % 11",
}
KEYS = {"key_id": "c_custkey", "user_id": "c_custkey", "request_count": "c_custkey % 100", "revoked": "c_custkey % 10 = 0"}


def columns(spec: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in spec.items()]


def sql(spec: dict[str, str], source: str, where: str = "true") -> str:
    """The adapter as a SELECT."""
    return f"SELECT {', '.join(columns(spec))} FROM {source} WHERE {where}"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(CHANGED).selectExpr(*columns(CHANGES))


def all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*columns(CHANGES))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*columns(PATHS))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 37 <> 0").selectExpr(*columns(FINDINGS))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 37 = 0").selectExpr(*columns(GOLDEN))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*columns(REVIEWS))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*columns(KEYS))


def edges(spark: SparkSession, sf_dir: str, hubs: bool = False) -> DataFrame:
    """(src, dst) entity ids: src depends on dst.  ``hubs`` draws targets together."""
    items = table(spark, sf_dir, "lineitem")
    a = items.where("l_quantity >= 48 and l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("a"))
    b = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("b"))
    target = F.col("b") - F.col("b") % 20 if hubs else F.col("b")
    # the few lines of ``a`` are looked up, so that all the others needn't be sorted
    pairs = b.join(a.hint("shuffle_hash"), ["l_orderkey", "n"]).select("a", target.alias("b")).where("a <> b").distinct()
    return pairs.select(F.concat(F.lit("e"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("e"), F.col("b").cast("string")).alias("dst"))


def edges_sql(hubs: bool = False) -> str:
    b = "(b.l_partkey - b.l_partkey % 20)" if hubs else "b.l_partkey"
    return f"SELECT DISTINCT 'e' || CAST(a.l_partkey AS VARCHAR) AS src, 'e' || CAST({b} AS VARCHAR) AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 48 AND a.l_returnflag = 'R' AND a.l_partkey <> {b}"


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i (from 1), before and after of each line."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).selectExpr("doc_id", "k + 1 as i", "line")
    return lines.selectExpr("doc_id", "i", f"{BEFORE} AS before", f"{AFTER} AS after")


BEFORE = "CASE WHEN (i + doc_id) % 11 = 0 THEN '// ' || line WHEN (i + doc_id) % 11 = 1 THEN 'fn ' || line ELSE line END"
AFTER = f"CASE WHEN (i * 7 + doc_id) % 13 = 0 AND doc_id % 7 IN (0, 3, 4, 6) THEN '# ' || line || ' x' WHEN (i * 5 + doc_id) % 13 = 1 AND doc_id % 7 IN (1, 3, 5, 6) THEN 'def ' || line WHEN (i + doc_id) % 13 = 2 AND doc_id % 7 IN (2, 4, 5, 6) THEN line || ' y' ELSE {BEFORE} END"
LINES_SQL = f"SELECT doc_id, i, {BEFORE} AS before, {AFTER} AS after FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"

_KIND = "CASE (i * 3 + doc_id) % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END"


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, file and patch text (one hunk) of each document."""
    docs = table(spark, sf_dir, "documents")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, k: F.concat(F.when(((k + 1) * 3 + F.col("doc_id")) % 4 == 0, "+").when(((k + 1) * 3 + F.col("doc_id")) % 4 == 1, "-").otherwise(" "), x)), "\n")
    n = F.size(F.split("text", "\n")).cast("string")
    at = (F.col("doc_id") + 1).cast("string")
    return docs.select(F.col("doc_id").alias("patch_id"), F.concat(F.lit("src/m"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".rs").otherwise("_test.py")).alias("file"), F.concat(F.lit("@@ -"), at, F.lit(","), n, F.lit(" +"), at, F.lit(","), n, F.lit(" @@\n"), body).alias("patch"))


PATCH_SQL = f"""SELECT doc_id AS patch_id, 'src/m' || (doc_id % 50)::VARCHAR || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' ELSE '_test.py' END AS file,
 '@@ -' || (doc_id + 1)::VARCHAR || ',' || n::VARCHAR || ' +' || (doc_id + 1)::VARCHAR || ',' || n::VARCHAR || ' @@' || chr(10) || body AS patch
 FROM (SELECT doc_id, count(*) AS n, string_agg({_KIND} || line, chr(10) ORDER BY i) AS body
 FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) GROUP BY doc_id)"""


def raw_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pr_id and the raw diff of ten files each."""
    p = patches(spark, sf_dir)
    part = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\nindex 1..2 100644\n--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n"), "patch")
    grouped = p.groupBy((F.floor(F.col("patch_id") / 10)).cast("long").alias("pr_id")).agg(F.array_sort(F.collect_list(F.struct("patch_id", part.alias("part")))).alias("parts"))
    return grouped.select("pr_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n").alias("diff"))


DIFF_SQL = f"""SELECT patch_id // 10 AS pr_id, string_agg('diff --git a/' || file || ' b/' || file || chr(10) || 'index 1..2 100644' || chr(10) || '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || patch, chr(10) ORDER BY patch_id) AS diff FROM ({PATCH_SQL}) GROUP BY patch_id // 10"""
