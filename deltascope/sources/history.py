"""Changed files of a scope, from a history table.

history: seq, sha (null for what is not committed), file_path, status,
before_content, after_content; one row for each file that a commit touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.functions import parsing


def parse_scope(text: str) -> tuple[str, str | None, str | None]:
    """("working", None, None), ("range", a, b) or ("commit", sha, None)."""
    if text == "working":
        return "working", None, None
    if ".." in text:
        a, b = text.split("..", 1)
        return "range", a, b
    return "commit", text, None


def changed_files(history: DataFrame, scope: str) -> DataFrame:
    """file_path, status, before_content, after_content of a scope.

    A range a..b has every file once, from its text before the first commit after a
    to that after the last one up to b; files that end as they began are left out.
    """
    kind, first, last = parse_scope(scope)
    rows = history.where(F.col("sha").isNull()) if kind == "working" else history.where(F.col("sha") == first)
    if kind != "range":
        return rows.select("file_path", parsing.file_status(F.col("status")).alias("status"), "before_content", "after_content")
    at = lambda sha: F.max(F.when(F.col("sha") == sha, F.col("seq")))
    ends = history.agg(at(first).alias("lo"), at(last).alias("hi"))  # one row
    inside = history.join(F.broadcast(ends), (F.col("seq") > F.col("lo")) & (F.col("seq") <= F.col("hi")))
    net = inside.groupBy("file_path").agg(F.min_by("before_content", "seq").alias("before_content"), F.max_by("after_content", "seq").alias("after_content"))
    status = F.when(F.col("before_content").isNull(), "added").when(F.col("after_content").isNull(), "deleted").otherwise("modified")
    return net.where(~F.col("before_content").eqNullSafe(F.col("after_content"))).select("file_path", status.alias("status"), "before_content", "after_content")
