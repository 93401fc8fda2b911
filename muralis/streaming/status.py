"""Status of running jobs from their log: as a stream and, for the same rows, as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG_SCHEMA = "timestamp timestamp, level string, message string, stage string, facade_id string, line long, elapsed double"

# Stages that set a status of their own.
FAILED, REVIEW, FINISHED = "FAILED_GEOMETRY", "NEEDS_MANUAL_REVIEW", "DONE"


def next_status(status: str | None, stage: str | None) -> str | None:
    """A failure is final until another stage runs; a wanted review outlasts completion; a blank stage changes nothing."""
    if not stage or not stage.strip():
        return status
    if stage == FAILED:
        return "Failed"
    if stage == REVIEW:
        return "NeedsReview"
    if stage == FINISHED:
        return status if status == "NeedsReview" else "Done"
    return "InProgress"


def status_of(log: DataFrame) -> DataFrame:
    """facade, status, n, last_elapsed after all rows of ``log`` (facade, ts, line, stage, elapsed), in order of time and line.

    A row sets the status by itself, except that completion keeps a review that came just before. So the status needs only
    the last row that is not a completion, and whether completions follow it: two aggregates, no ordered list of rows.
    """
    order = F.struct("ts", "line")
    told = F.col("stage").isNotNull() & (F.trim("stage") != "")
    done = F.col("stage") == FINISHED
    last = log.groupBy("facade").agg(
        F.max_by("stage", F.when(told & ~done, order)).alias("stage"),
        F.max(F.when(told & ~done, order)).alias("at"),
        F.max(F.when(told & done, order)).alias("done_at"),
        F.count("*").alias("n"),
        F.max_by("elapsed", F.when(F.col("elapsed").isNotNull(), order)).alias("last_elapsed"),
    )
    own = F.when(F.col("stage") == FAILED, "Failed").when(F.col("stage") == REVIEW, "NeedsReview").when(F.col("stage").isNotNull(), "InProgress")
    finished = F.col("done_at").isNotNull() & (F.col("at").isNull() | (F.col("done_at") > F.col("at")))
    return last.select("facade", F.when(finished & (F.coalesce(own, F.lit("")) != "NeedsReview"), "Done").otherwise(own).alias("status"), "n", "last_elapsed")


def status_stream(log: DataFrame) -> DataFrame:
    """The same from a stream, kept per facade: a row for each facade that a micro-batch touches."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, elapsed = state.get if state.exists else (None, 0, None)
        every = pd.concat(list(rows)).sort_values(["ts", "line"], kind="stable")
        for stage, value in zip(every.stage, every.elapsed, strict=True):
            status, n = next_status(status, stage if isinstance(stage, str) else None), n + 1
            elapsed = elapsed if pd.isna(value) else float(value)
        state.update((status, n, elapsed))
        yield pd.DataFrame({"facade": [key[0]], "status": [status], "n": [n], "last_elapsed": [elapsed]})

    kind = dict(log.dtypes)["facade"]
    return log.groupBy("facade").applyInPandasWithState(step, f"facade {kind}, status string, n long, last_elapsed double", "status string, n long, last_elapsed double", "update", GroupStateTimeout.NoTimeout)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Rolled JSON-lines files as a stream; lines that are not JSON keep their text in ``broken``."""
    raw = spark.readStream.text(folder)
    parsed = raw.select(F.col("value"), F.from_json(F.regexp_replace("value", "^\ufeff", ""), LOG_SCHEMA).alias("r"))
    return parsed.select("r.*", F.when(F.col("r").isNull() | F.coalesce(F.col("r.timestamp").isNull() & F.col("r.message").isNull(), F.lit(True)), F.col("value")).alias("broken"))


def unique_warnings(log: DataFrame, within: str = "1 day") -> DataFrame:
    """One row per facade, line and message; in a stream (with ``ts``) those that come at most ``within`` apart, so that its state ends."""
    keys = ["facade", "line", "message"]
    return log.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys) if log.isStreaming else log.dropDuplicates(keys)


def assigned_once(jobs: DataFrame, order: list[str]) -> DataFrame:
    """The first assignment of each archive by ``order``; in a stream the first that comes, for ever: its checkpoint keeps the ids, so that
    no archive is assigned again after a restart. Jobs without an archive are left out."""
    jobs = jobs.filter("archive_id is not null")
    if jobs.isStreaming:
        return jobs.dropDuplicates(["archive_id"])
    rest = [c for c in jobs.columns if c != "archive_id"]
    return jobs.groupBy("archive_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("m")).select("archive_id", "m.*")


def sessions(beats: DataFrame, gap: str = "15 seconds") -> DataFrame:
    """worker, start, end, n: spans without a silence of ``gap``."""
    return beats.groupBy("worker", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("worker", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def latest_by_key(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(key, "m.*")


def unambiguous(messages: DataFrame, running: DataFrame, key: str) -> DataFrame:
    """Messages that exactly one running job matches."""
    one = running.groupBy(key).agg(F.count("*").alias("jobs"), F.first("job").alias("job")).filter("jobs = 1").drop("jobs")
    return messages.join(one, key)


def ring_buffer(log: DataFrame, key: str, order: list[str], n: int = 2000) -> DataFrame:
    """The last ``n`` rows of every key."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return log.withColumn("age", rank).filter(F.col("age") <= n)
