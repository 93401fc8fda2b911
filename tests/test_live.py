"""Streams whose state ends, rescans, and children replaced by partition."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from muralis.operators import children as ch
from muralis.streaming import faces, status

SCHEMA = "facade string, ts timestamp, line long, stage string, " + ", ".join(f"{f} {k}" for f, k in faces.FIELDS.items())


def _run(df, folder, keep):
    q = df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(folder)).start()
    q.processAllAvailable()
    q.stop()


def _log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_seconds("ts")).select("facade", "ts", "line", "stage", *faces.FIELDS)


def test_face_stream_equals_batch_and_ends(spark, tmp_path):
    rng = random.Random(3)
    some = lambda v: v if rng.random() < 0.4 else None
    stages = ["FAILED_GEOMETRY", "NEEDS_MANUAL_REVIEW", "DONE", "MATCH_GEOMETRY", "PREVIEW_UPDATED", None, " "]
    rows = [(f"F{rng.randrange(5)}", 1.7e9 + k, k, rng.choice(stages), some(k), some(k / 7), some(k / 3), some(k % 2 == 0), some(k + 1), some(k - 1), some(k / 9), some(f"p{k}")) for k in range(160)]
    nothing = (None,) * len(faces.FIELDS)
    # Two faces end; a long time later only another speaks, and once more, so that the watermark has passed.
    rows += [("Z1", 1.7e9 + 160, 160, "DONE", 5, *nothing[1:]), ("Z2", 1.7e9 + 160, 161, "FAILED_GEOMETRY", *nothing), ("Z3", 1.7e9 + 160, 162, "MATCH_GEOMETRY", *nothing)]
    log = _log(spark, rows)
    for k in range(4):
        log.filter(F.col("line").between(50 * k, 50 * k + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, ended = {}, {}

    def keep(batch, _):
        for r in batch.collect():
            (ended if r.ended else seen)[r.facade] = tuple(r)[1:-1]

    def again():
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        _run(faces.face_stream(stream, late="1 minute", keep_ms=600_000), tmp_path / "c", keep)

    again()
    assert seen == {r.facade: tuple(r)[1:] for r in faces.faces_of(log).collect()} and not ended
    for k in range(2):
        _log(spark, [("Y", 1.7e9 + 5000 + k * 100, 1000 + k, "MATCH_GEOMETRY", *nothing)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        again()
    done = {f for f, v in seen.items() if v[0] in faces.ENDED}
    assert {"Z1", "Z2"} <= done and set(ended) == done and ended["Z1"] == seen["Z1"] and "Z3" not in ended
    # A face that was dropped starts anew.
    _log(spark, [("Z1", 1.7e9 + 5200, 2000, " ", *nothing)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again()
    assert seen["Z1"][:3] == (None, 1, None)


def test_faces_of_an_empty_log(spark):
    assert faces.faces_of(_log(spark, [])).count() == 0
    r = faces.faces_of(_log(spark, [(None, 1.0, 1, "DONE", *(None,) * 7, "p")])).first()
    assert (r.facade, r.status, r.n, r.preview) == (None, "Done", 1, None)


def test_warnings_and_assignments_of_streams(spark, tmp_path):
    rows = [("F", 100.0, 1, "m"), ("F", 101.0, 1, "m"), ("F", 102.0, 2, "m")]
    log = spark.createDataFrame(rows, "facade string, ts double, line long, message string").withColumn("ts", F.timestamp_seconds("ts"))
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    got = []
    _run(status.unique_warnings(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), "1 minute"), tmp_path / "c1", lambda b, _: got.extend((r.line, r.message) for r in b.collect()))
    assert sorted(got) == [(1, "m"), (2, "m")] and status.unique_warnings(log).count() == 2
    jobs, given = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "archive_id long, job long"), []
    for k in range(2):  # the stream stops, starts again and sees the same archive once more
        jobs.coalesce(1).write.mode("append").parquet(str(tmp_path / "jobs"))
        _run(status.assigned_once(spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs")), ["job"]), tmp_path / "c2", lambda b, _: given.extend(r.archive_id for r in b.collect()))
    assert given == [1]
    assert [(r.archive_id, r.job) for r in status.assigned_once(jobs, ["job"]).collect()] == [(1, 10)]


def test_rescan_leaves_running_faces_alone(spark, tmp_path):
    kind, running = "facade string, seen long, status string", [["A"]]
    write = faces.rescan(lambda: spark.createDataFrame([(f,) for f in running[0]], "facade string"), str(tmp_path / "out"), "facade", "seen")
    for k, rows in enumerate([[("A", 1, "old"), ("B", 1, "x"), ("B", 2, "y"), (None, 1, "n")], [("A", 3, "file"), ("B", 3, "stale")]]):
        (spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))
        running[0] = ["A"] if k == 0 else ["B"]
        _run(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), tmp_path / "c", write)
    found = lambda: {tuple(r) for r in faces.scanned(spark, str(tmp_path / "out"), "facade").select("facade", "seen", "status").collect()}
    assert found() == {("A", 3, "file"), ("B", 2, "y")}
    running[0] = ["B"]
    write(spark.createDataFrame([("A", 3, "file"), ("B", 3, "stale")], kind), 1)  # repeated after a failure
    assert found() == {("A", 3, "file"), ("B", 2, "y")}


def test_children_of_other_parents_keep_their_files(spark, tmp_path):
    kind, path = "facade string, no int, v int", str(tmp_path / "t")
    rows = spark.createDataFrame([("F1", 1, 1), ("F1", 2, 2), ("F2", 1, 3), ("F3", 1, None), (None, 1, 9)], kind)
    ch.replace_children(rows, rows.select("facade"), path, "facade")
    files = lambda f: {(p.name, p.stat().st_mtime_ns) for p in Path(path, f"facade={f}").glob("*.parquet")}
    read = lambda: {tuple(r) for r in ch.stored_children(spark, path, rows.schema).collect()}
    assert read() == {("F1", 1, 1), ("F1", 2, 2), ("F2", 1, 3), ("F3", 1, None)}
    before = files("F2")
    anew = spark.createDataFrame([("F1", 7, 7), ("F1", 7, 7), ("F9", 1, 1)], kind)
    ch.replace_children(anew, spark.createDataFrame([("F1",), ("F1",), ("F3",)], "facade string"), path, "facade")
    assert files("F2") == before and read() == {("F1", 7, 7), ("F2", 1, 3)}
    assert ch.stored_children(spark, path, rows.schema).count() == 3
    # A write that fails changes nothing.
    bad = anew.withColumn("v", F.when(F.col("facade") == "F1", F.raise_error(F.lit("no")).cast("int")).otherwise(1))
    with pytest.raises(Exception):  # noqa: B017
        ch.replace_children(bad, anew.select("facade"), path, "facade")
    assert read() == {("F1", 7, 7), ("F2", 1, 3)} and files("F2") == before
    ch.replace_children(rows.limit(0), rows.select("facade").limit(0), path, "facade")
    assert read() == {("F1", 7, 7), ("F2", 1, 3)}
