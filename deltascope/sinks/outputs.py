"""Sinks: result files, event logs, and reviews sent to a host."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows with a header; quotes are doubled, line breaks stay inside quotes."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False, emptyValue="")


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object a line; missing values are left out."""
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def append(log: DataFrame, path: str) -> None:
    """Adds events to a log; nothing is ever updated in place, so writers don't race."""
    log.write.mode("append").parquet(path)


def job_event(spark: SparkSession, job_id: int, status: str, at, seq: int) -> DataFrame:
    return spark.createDataFrame([(job_id, status, at, seq)], "job_id long, status string, at timestamp, seq long")


def usage_counts(log: DataFrame) -> DataFrame:
    """Requests and last use of each key, from the log of its uses."""
    return log.groupBy("key_id").agg(F.count(F.lit(1)).alias("request_count"), F.max("used_at").alias("last_used_at"))


def latest_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The current row of each key in a log of row versions."""
    rest = [x for x in log.columns if x != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(key, *(F.col("x")[x].alias(x) for x in rest))


def review_payloads(comments: DataFrame) -> DataFrame:
    """repo, number and the JSON body of a review: its event is always a comment."""
    items = F.array_sort(F.collect_list(F.struct("path", "line", F.lit("RIGHT").alias("side"), "body")))
    grouped = comments.groupBy("repo", "number").agg(items.alias("comments"))
    return grouped.select("repo", "number", F.to_json(F.struct(F.lit("COMMENT").alias("event"), "comments")).alias("payload"))


def post_reviews(payloads: DataFrame, post: Callable[[str, int, str], str]) -> DataFrame:
    """repo, number, answer, error of each call; a failed one doesn't stop the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for repo, number, payload in zip(frame["repo"], frame["number"], frame["payload"], strict=True):
                try:
                    out.append((repo, number, post(repo, int(number), payload), None))
                except Exception as e:  # noqa: BLE001  the remote side may fail in any way
                    out.append((repo, number, None, str(e)))
            yield pd.DataFrame(out, columns=["repo", "number", "answer", "error"])

    return payloads.mapInPandas(run, "repo string, number long, answer string, error string")
