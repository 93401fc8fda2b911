"""What is known of running faces, from a log that never ends: state of a bounded size, and files for all else."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from muralis.operators.store import last_of_key
from muralis.streaming.status import next_status, status_of

#: The fields of which the last known value counts, and their types.
FIELDS = {"image_count": "long", "coverage": "double", "drift": "double", "needs_fallback": "boolean", "requested": "long", "registered": "long", "mean_error": "double", "preview": "string"}
_NATIVE = {"long": int, "double": float, "boolean": bool, "string": str}

# Fixed value: the stage whose preview counts.
PREVIEW = "PREVIEW_UPDATED"

ENDED = ("Done", "Failed")


def faces_of(log: DataFrame) -> DataFrame:
    """facade, status, n and the last known value of each of FIELDS, after all rows of ``log`` (facade, ts, line, stage, FIELDS)."""
    order = F.struct("ts", "line")
    known = {f: F.col(f).isNotNull() & ((F.col("stage") == PREVIEW) if f == "preview" else F.lit(True)) for f in FIELDS}
    fields = log.groupBy("facade").agg(*(F.max_by(f, F.when(known[f], order)).alias(f) for f in FIELDS))
    status = status_of(log.withColumn("elapsed", F.lit(None).cast("double"))).select(F.col("facade").alias("of"), "status", "n")
    return status.join(fields, F.col("of").eqNullSafe(F.col("facade"))).select("facade", "status", "n", *FIELDS)


def face_stream(log: DataFrame, *, late: str = "10 minutes", keep_ms: int = 3_600_000, idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """The same from a stream, and ``ended``: a row for each facade that a micro-batch touches, and a last one when its state is dropped.

    State goes ``keep_ms`` of event time after a facade that is done or has failed spoke last, and after ``idle_ms`` of any other, so
    it follows what runs and not what ever ran; a facade that speaks again afterwards starts anew. Rows must come in order from one
    micro-batch to the next (within one they are sorted); those later than ``late`` are left out.
    """

    def row(facade, state: tuple, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"facade": [facade], **{name: pd.Series([v], dtype=object) for name, v in zip(("status", "n", *FIELDS), state, strict=True)}, "ended": [ended]})

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield row(key[0], tuple(state.get), True)
            state.remove()
            return
        status, n, *values = state.get if state.exists else (None, 0, *(None for _ in FIELDS))
        every = pd.concat(list(rows)).sort_values(["ts", "line"], kind="stable")
        for stage in every.stage:
            status = next_status(status, stage if isinstance(stage, str) else None)
        for k, (field, kind) in enumerate(FIELDS.items()):
            told = every[field][every.stage == PREVIEW] if field == "preview" else every[field]
            told = told.dropna()
            values[k] = _NATIVE[kind](told.iloc[-1]) if len(told) else values[k]
        now = (status, n + len(every), *values)
        state.update(now)
        last = max(int(every.ts.max().timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(last + (keep_ms if status in ENDED else idle_ms))
        yield row(key[0], now, False)

    held = "status string, n long, " + ", ".join(f"{f} {kind}" for f, kind in FIELDS.items())
    kind = dict(log.dtypes)["facade"]
    return log.select("facade", "ts", "line", "stage", *FIELDS).withWatermark("ts", late).groupBy("facade").applyInPandasWithState(step, f"facade {kind}, {held}, ended boolean", held, "update", GroupStateTimeout.EventTimeTimeout)


def rescan(running: Callable[[], DataFrame], path: str, key: str, seen_at: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on a stream of what files say (``key``, ``seen_at``, others): keep the last row of every key under ``path``, save
    for the keys that ``running`` (asked anew for each micro-batch) holds; these speak for themselves. A micro-batch that is repeated
    after a failure overwrites what it wrote, and none reads what earlier ones wrote."""

    def write(batch: DataFrame, number: int) -> None:
        still = batch.filter(F.col(key).isNotNull()).join(running().select(key).distinct(), key, "left_anti")
        last_of_key(still.select(*batch.columns), [key], seen_at).write.mode("overwrite").parquet(f"{path}/scan={number}")

    return write


def scanned(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last row of every key that ``rescan`` wrote."""
    return last_of_key(spark.read.parquet(path), [key], "scan").drop("scan")
