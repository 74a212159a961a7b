"""Readers of comments, golden sets, commit logs and pull-request lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltascope.functions import predicates as p
from deltascope.operators import matching

COMMENTS = "path string, line long, body string, title string"
GOLDEN = "pr_title string, comments array<struct<comment:string,severity:string>>"
DEFAULT_BODY = "Review comment"


def comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments of a JSON file; a missing body gets a default one."""
    return spark.read.schema(COMMENTS).json(path, multiLine=True).withColumn("body", F.coalesce("body", F.lit(DEFAULT_BODY)))


def golden_comments(spark: SparkSession, path: str) -> DataFrame:
    """One row per golden comment, with its place in the set."""
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True)
    return rows.select("pr_title", F.posexplode("comments").alias("ord", "c")).select("pr_title", "ord", F.col("c.comment").alias("golden_comment"), F.col("c.severity").alias("golden_severity"))


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def commits(log: DataFrame) -> DataFrame:
    """sha and message of log lines; a line without a subject is dropped."""
    parts = F.split("value", " ", 2)
    return log.where(F.size(parts) == 2).select(parts[0].alias("sha"), parts[1].alias("message"))


def pull_requests(lines: DataFrame) -> DataFrame:
    """repo, number, title of tab-separated lines; others are dropped."""
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) == 3).select(parts[0].alias("repo"), parts[1].try_cast("long").alias("number"), parts[2].alias("title"))


def match_titles(pulls: DataFrame, golden: DataFrame) -> DataFrame:
    """Each pull request with the first golden set of its title: equal, or alike in 40 characters.

    One of the titles cut to 40 characters is then the start of the other: titles meet on whole starts.
    """
    distinct = lambda df, name: df.select(F.col("title").alias(name)).where(F.col("title") != "").distinct()
    mine, theirs = distinct(pulls, "title"), distinct(golden, "g_title")
    short = lambda df, name, out: df.select(F.left(name, F.lit(40)).alias(out)).distinct()
    near = matching.starts_meet(short(mine, "title", "t40"), short(theirs, "g_title", "g40"), [], "t40", "g40")
    # a short title is the start of a long one within 40 characters, or a long one begins with its first 40
    met = mine.withColumn("t40", F.left("title", F.lit(40))).join(near, "t40").join(theirs.withColumn("g40", F.left("g_title", F.lit(40))), "g40")
    fits = (F.col("title") == F.col("g_title")) | F.col("title").startswith(F.col("g40")) | F.col("g_title").startswith(F.col("t40"))
    first = golden.groupBy(F.col("title").alias("g_title")).agg(F.min("gold_id").alias("gold_id"))
    best = met.where(fits).join(first, "g_title").groupBy("title").agg(F.min("gold_id").alias("gold_id"))
    return pulls.select("repo", "number", "title").distinct().join(best, "title").select("repo", "number", "title", "gold_id")


def round_robin_sample(items: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` items by turns over repositories (a sampling operator)."""
    turn = F.row_number().over(Window.partitionBy("repo").orderBy("ord"))
    first = F.min("ord").over(Window.partitionBy("repo"))
    return items.withColumns({"turn": turn, "first": first}).orderBy("turn", "first").limit(limit).drop("turn", "first")


def source_files(paths: DataFrame) -> DataFrame:
    """The files that the dependency graph is built from."""
    return paths.where(p.is_source_file(F.col("path")))


def with_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Files of a pull request, with their patch where the raw diff has one."""
    return files.join(patches.select("pr_id", F.col("file").alias("filename"), "patch"), ["pr_id", "filename"], "left")


def file_pairs(files: DataFrame, contents: DataFrame) -> DataFrame:
    """before and after of each file: none before an addition or after a removal, null where not delivered."""
    side = lambda ref, name: contents.where(F.col("ref") == ref).select("pr_id", F.col("path").alias("filename"), F.col("content").alias(name))
    rows = files.join(side("base", "before"), ["pr_id", "filename"], "left").join(side("head", "after"), ["pr_id", "filename"], "left")
    return rows.withColumn("before", F.when(F.col("status") != "added", F.col("before"))).withColumn("after", F.when(F.col("status") != "removed", F.col("after")))
