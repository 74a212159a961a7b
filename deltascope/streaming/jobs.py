"""Review jobs as an event log: the latest status of each job, in batch and as a stream.

Streams are an extension: batch systems of this kind keep a job map in memory.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses in the order in which a job passes them.
STATUSES = ("pending", "analyzing", "reviewing", "complete", "failed")


def latest_status(events: DataFrame) -> DataFrame:
    """job_id, status, at of the last event (by time, then sequence) of each job.

    An aggregate only, so it also runs as a stream in update or complete mode.
    """
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("at", "seq")).alias("status"), F.max("at").alias("at"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by status in tumbling windows; later ones than the watermark are dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", size), "status").agg(F.count(F.lit(1)).alias("n"))


def triggers(events: DataFrame) -> DataFrame:
    """Webhook events that start a review: an opened or updated pull request, and not by a bot."""
    return events.where(F.col("event").isin("pull_request") & F.col("action").isin("opened", "synchronize", "reopened") & ~F.coalesce(F.col("sender").endswith("[bot]"), F.lit(False)))


# ---------------------------------------------------------------- the state of a job

#: Which status may follow which: a job goes step by step, and may fail from any step on the way.
NEXT = {None: ("pending",), "pending": ("analyzing", "failed"), "analyzing": ("reviewing", "failed"), "reviewing": ("complete", "failed"), "complete": (), "failed": ()}
ENDED = ("complete", "failed")
STATES = "job_id long, status string, at timestamp, illegal long, timed_out boolean"


def states(events: DataFrame, timeout: str) -> DataFrame:
    """job_id, status, at, illegal, timed_out after all events (job_id, status, at, seq), in order of time and seq.

    A repeated status changes nothing; one that the state doesn't allow is counted and leaves the state.
    A job that hasn't ended is timed out when the latest event of all jobs is over ``timeout`` after its own last one.

    The fold sees a job's events as one array of small codes.
    """
    code = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")).cast("int")
    folded = events.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", code.alias("code")))), lambda x: x["code"]).alias("codes"), F.max("at").alias("at"))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("illegal"))
    last = len(STATUSES)

    def step(acc: Column, x: Column) -> Column:
        state = acc["state"]
        legal = ((x == state + 1) & (state < 4) & (x < last)) | ((x == last) & state.between(1, 3))
        return F.struct(F.when(legal, x).otherwise(state).alias("state"), (acc["illegal"] + F.when(legal | (x == state), 0).otherwise(1)).alias("illegal"))

    rows = folded.withColumn("x", F.aggregate("codes", start, step))
    names = F.array(*map(F.lit, STATUSES))
    status = F.when(F.col("x.state") > 0, F.get(names, F.col("x.state") - 1))
    newest = events.agg(F.max("at").alias("newest"))  # one row
    late = F.col("at") + F.expr(f"INTERVAL {timeout}") < F.col("newest")
    return rows.join(F.broadcast(newest)).select("job_id", status.alias("status"), "at", F.col("x.illegal").alias("illegal"), (~F.coalesce(status.isin(*ENDED), F.lit(False)) & late).alias("timed_out"))


def state_stream(events: DataFrame, timeout_ms: int, late: str = "10 minutes") -> DataFrame:
    """``states`` as a stream (an extension): a row whenever a job's events arrive, or when it is given up.

    Events older than the watermark are dropped.  A timer of event time, ``timeout_ms`` after a
    job's last event, gives up a job that hasn't ended; a later event that its state allows takes it up again.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Jobs(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("job", "status string, at long, illegal long, timed_out boolean")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            known = self.state.get() if self.state.exists() else (None, -1, 0, False)
            status, at, illegal = known[0], known[1], known[2]
            arrived = pd.concat(list(rows)).sort_values(["at", "seq"])
            for new, when in zip(arrived["status"], arrived["at"], strict=True):
                at = max(at, int(when.timestamp() * 1000))
                if new in NEXT.get(status, ()):
                    status = new
                elif new != status:
                    illegal += 1
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if status not in ENDED:
                self.handle.registerTimer(at + timeout_ms)
            self.state.update((status, at, illegal, False))
            yield self._row(key, status, at, illegal, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            status, at, illegal, _ = self.state.get()
            self.state.update((status, at, illegal, True))
            yield self._row(key, status, at, illegal, True)

        def _row(self, key, status, at, illegal, timed_out) -> pd.DataFrame:
            return pd.DataFrame({"job_id": [int(key[0])], "status": pd.Series([status], dtype="object"), "at": [pd.Timestamp(at, unit="ms")], "illegal": [int(illegal)], "timed_out": [timed_out]})

        def close(self) -> None:
            pass

    return events.withWatermark("at", late).groupBy("job_id").transformWithStateInPandas(statefulProcessor=Jobs(), outputStructType=STATES, outputMode="Update", timeMode="EventTime")
