"""Building faces: wall segments from footprints, and the photos that show them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.config import DEFAULT, Config
from muralis.functions import geo


def footprint_edges(vertices: DataFrame) -> DataFrame:
    """Edges of closed rings (building, ring, ord, x, y; counter-clockwise): ends, length, and the bearing of the outward normal."""
    w = Window.partitionBy("building", "ring").orderBy("ord")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {k: F.coalesce(F.lead(k).over(w), F.first(k).over(first)) for k in ("x", "y")}
    edges = vertices.select("building", "ring", "ord", F.col("x").alias("x0"), F.col("y").alias("y0"), nxt["x"].alias("x1"), nxt["y"].alias("y1"))
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2.0) + F.pow(F.col("y1") - F.col("y0"), 2.0))
    return edges.withColumn("length", length).filter("length > 0").withColumn("normal", geo.bearing_of(F.col("y1") - F.col("y0"), F.col("x0") - F.col("x1")))


def merged_segments(edges: DataFrame, *, min_length: float = 3.0, cfg: Config = DEFAULT) -> DataFrame:
    """Walls: runs of edges whose normals stay within a few degrees of the run's first one. Runs never close over the ring's
    start. facade_id numbers the walls of a building that are long enough, in ring order."""
    columns = ["building", "ring", "ord", "x0", "y0", "x1", "y1", "normal"]

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ring by ring, in order; the last run of a batch may go on in the next."""
        run: list | None = None
        for batch in batches:
            closed: list[list] = []
            for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and run[0] == e[0] and run[1] == e[1]:
                    d = (e[7] - run[7]) % 360
                    if min(d, 360 - d) < cfg.merge_normal_deg:
                        run[5:7] = e[5:7]
                        continue
                if run:
                    closed.append(run)
                run = list(e)
            schema = batch.schema
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in closed], f.type) for k, f in enumerate(schema)], schema.names)
        if run:
            yield pa.RecordBatch.from_arrays([pa.array([run[k]], f.type) for k, f in enumerate(schema)], schema.names)

    kind = dict(edges.dtypes)
    dealt = edges.select(*columns).repartition("building", "ring").sortWithinPartitions("building", "ring", F.asc_nulls_last("ord"))
    runs = dealt.mapInArrow(merge, ", ".join(f"{k} {kind[k]}" for k in columns))
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2.0) + F.pow(F.col("y1") - F.col("y0"), 2.0))
    walls = runs.withColumn("length", length).filter(F.col("length") >= min_length)
    return walls.withColumn("facade_id", F.format_string("F%03d", F.row_number().over(Window.partitionBy("building").orderBy("ring", "ord"))))


def assign_facades(photos: DataFrame, segments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """image_id, facade_id, rank, score, role: the one or two best walls of each photo (x, y, yaw), of ``segments`` of one building.

    A wall counts if it is near enough and faced squarely enough; nearness, angle and distance weigh 4 : 4 : 2.
    """
    near = photos.join(F.broadcast(segments))  # the walls of one building
    distance = geo.segment_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    view = geo.angle_delta(F.col("yaw") + 180.0, F.col("normal"))
    scored = near.select("image_id", "facade_id", distance.alias("distance"), view.alias("view")).filter((F.col("distance") <= cfg.max_standoff_m) & (F.col("view") <= cfg.max_view_deg))
    closeness = 1.0 - F.col("distance") / cfg.max_standoff_m
    scored = scored.withColumn("score", 0.4 * closeness + 0.4 * (1.0 - F.col("view") / cfg.max_view_deg) + 0.2 * closeness)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "facade_id"))
    best = scored.withColumn("rank", rank).filter("rank <= 2 and score >= 0")
    role = F.when(F.col("rank") == 1, "PRIMARY").when(F.col("view") <= cfg.corner_view_deg, "CORNER_OVERLAP").otherwise("UNASSIGNED")
    return best.withColumn("role", role)
