"""Small lookups, orders and registers around the pipeline and its store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.operators.store import last_of_key

# Drones by camera model.
DRONES = {"M3E": "DJI Mavic 3 Enterprise", "M3T": "DJI Mavic 3 Thermal", "M4E": "DJI Matrice 4E", "M4T": "DJI Matrice 4T", "L2D-20c": "DJI Mavic 3 계열"}


def newest(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows; the least key of equals first. Only they leave their tasks."""
    return rows.orderBy(F.desc(at), key).limit(n)


def of_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted ids; ids that are not there are simply absent."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def best_attempt(attempts: DataFrame, group: str) -> DataFrame:
    """The attempt of least residual, the first of equals; attempts without a residual come last."""
    least = F.min(F.struct(F.col("residual").isNull(), "residual", "attempt")).alias("m")
    return attempts.groupBy(group).agg(least).select(group, F.col("m.attempt").alias("attempt"), F.col("m.residual").alias("residual"))


def in_desk_order(place: Column, name: str) -> list[Column]:
    """Placed rows by their place, those without one last, by name in the order of their characters."""
    return [place.isNull(), place, F.col(name)]


def equipment(make: Column, model: Column) -> Column:
    """The drone of a known camera with the camera's own text behind it, else that text alone."""
    raw = F.nullif(F.concat_ws(" ", F.nullif(make, F.lit("")), F.nullif(model, F.lit(""))), F.lit(""))
    drone = reduce(lambda c, kv: c.when(model == kv[0], F.lit(kv[1])), DRONES.items(), F)
    return F.when(drone.isNotNull(), F.concat(drone, F.lit(" (EXIF "), raw, F.lit(")"))).otherwise(raw)


def shared_intrinsics(photos: DataFrame, known: DataFrame, group: str) -> DataFrame:
    """The ``known`` intrinsics (camera, width, height, focal) of each group's first photo (ord, camera, width, height), where all of its
    photos have the listed size."""
    first = photos.groupBy(group).agg(F.min_by("camera", "ord").alias("camera"), F.min("width").alias("w0"), F.max("width").alias("w1"), F.min("height").alias("h0"), F.max("height").alias("h1"))
    fits = (F.col("w0") == F.col("width")) & (F.col("w1") == F.col("width")) & (F.col("h0") == F.col("height")) & (F.col("h1") == F.col("height"))
    return first.join(known, "camera").filter(fits).select(group, "camera", "focal")


def restricted_points(observations: DataFrame, kept: DataFrame, image: str, point: str) -> DataFrame:
    """Observations of the kept images, of points that still have two."""
    left = observations.join(kept.select(image).distinct(), image, "left_semi")
    seen = left.groupBy(point).agg(F.countDistinct(image).alias("n")).filter("n >= 2").select(point)
    return left.join(seen, point, "left_semi")


def with_rejections(cracks: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Cracks with who rejected them, when and why; the last of several entries counts, and the file's reviewer stands in for a missing one."""
    last = rejected.groupBy(key).agg(F.max_by(F.struct(F.coalesce("reviewed_by", "file_reviewer").alias("by"), "at", "note"), "ord").alias("r"))
    return cracks.join(last, key, "left").select(*cracks.columns, F.col("r.by").alias("rejected_by"), F.col("r.at").alias("rejected_at"), F.col("r.note").alias("note"))


def file_records_upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], now: Column, ord: str | None = None) -> DataFrame:
    """Result files written anew replace those of the same key and are no longer deleted; of several of a key the last one (by ``ord``) counts."""
    incoming = last_of_key(incoming, keys, ord)
    incoming = incoming.select(*(c for c in incoming.columns if c in stored.columns))
    fresh = incoming.withColumn("deleted_at", F.lit(None).cast(dict(stored.dtypes)["deleted_at"])).withColumn("updated_at", now)
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(fresh)


def retention_rearmed(register: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Runs (archive_id, facade_id, folder) enter the register, or start anew there: face and folder are compared without case."""
    named = lambda d, p: d.select("*", F.lower("facade_id").alias(f"{p}f"), F.lower("folder").alias(f"{p}d"))
    own, new = named(register, "k"), named(runs, "k")
    keys = ["archive_id", "kf", "kd"]
    kept = own.join(new.select(*keys).distinct(), keys, "left_anti")
    known = own.select(*keys, F.col("facade_id").alias("f0"), F.col("folder").alias("d0"))
    armed = new.join(known, keys, "left").select("archive_id", F.coalesce("f0", "facade_id").alias("facade_id"), F.coalesce("d0", "folder").alias("folder"), now.alias("registered_at"), F.lit(None).cast(dict(register.dtypes)["deleted_at"]).alias("deleted_at"), F.lit(None).cast("long").alias("bytes_freed"))
    # Runs that differ in case only are one entry, under the name that is known or else the least.
    one = armed.withColumn("kf", F.lower("facade_id")).withColumn("kd", F.lower("folder")).groupBy("archive_id", "kf", "kd").agg(*(F.min(c).alias(c) for c in armed.columns if c != "archive_id")).select(*armed.columns)
    return kept.select(*armed.columns).unionByName(one)


def retention_deleted(register: DataFrame, freed: DataFrame, keys: list[str], now: Column, *, without_case: tuple[str, ...] = ("facade_id", "folder")) -> DataFrame:
    """Entries whose files are gone, with when and how much; faces and folders are compared without case, and of several reports on an entry
    the greatest counts."""
    folded = lambda d, p: [(F.lower(k) if k in without_case else F.col(k)).alias(f"{p}{k}") for k in keys]
    hit = freed.select(*folded(freed, "k_"), F.col("bytes").alias("freed")).groupBy(*(f"k_{k}" for k in keys)).agg(F.max("freed").alias("freed"), F.lit(True).alias("gone"))
    joined = register.select("*", *folded(register, "k_")).join(hit, [f"k_{k}" for k in keys], "left")
    return joined.select(*(c for c in register.columns if c not in ("deleted_at", "bytes_freed")), F.when(F.col("gone"), now).otherwise(F.col("deleted_at")).alias("deleted_at"), F.coalesce("freed", "bytes_freed").alias("bytes_freed"))


# What a finished dense run must hold, and what may go, as patterns of paths within its folder.
DENSE_FOLDERS = r"^((?:stereo/normal_maps|stereo/consistency_graphs|images)/)"
DENSE_NEEDED = (r"^stereo/depth_maps/[^/]*\.geometric\.bin$", r"^sparse/", r"^fused\.ply$")
DENSE_NAMES = ("depth_maps", "sparse", "fused.ply")
DENSE_REMOVED = (r"^stereo/(normal_maps|consistency_graphs)/", r"^images/", r"^stereo/depth_maps/[^/]*\.photometric\.bin$", r"^fused\.ply\.vis$")


def cleanup_plan(files: DataFrame, folder: str) -> DataFrame:
    """Per folder of ``files`` (folder, path, bytes) how many things may be deleted, whole subfolders counting as one, the bytes that this frees,
    and why nothing may go of a run that lacks a needed file."""
    whole = [F.bool_or(F.col("path").rlike(p)) for p in DENSE_NEEDED]
    goes = reduce(lambda a, b: a | b, (F.col("path").rlike(p) for p in DENSE_REMOVED))
    thing = F.coalesce(F.nullif(F.regexp_extract("path", DENSE_FOLDERS, 1), F.lit("")), F.col("path"))
    # One row a thing first: a folder of very many files is summed up within the tasks.
    things = files.groupBy(folder, thing.alias("thing")).agg(F.bool_or(goes).alias("goes"), F.sum(F.when(goes, F.col("bytes"))).alias("b"), *(w.alias(f"has{k}") for k, w in enumerate(whole)))
    found = things.groupBy(folder).agg(F.count_if("goes").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), *(F.bool_or(f"has{k}").alias(f"has{k}") for k in range(len(whole))))
    missing = F.array_join(F.filter(F.array(*(F.when(~F.col(f"has{k}"), F.lit(name)) for k, name in enumerate(DENSE_NAMES))), lambda x: x.isNotNull()), ", ")
    found = found.withColumn("missing", missing).withColumn("complete", F.col("missing") == "")
    return found.select(folder, "complete", F.when(F.col("complete"), F.col("n")).otherwise(0).alias("deleted"), F.when(F.col("complete"), F.col("b")).otherwise(0).alias("bytes_freed"), F.nullif("missing", F.lit("")).alias("missing"))


def offset_summary(checks: DataFrame, group: str, offset: str) -> DataFrame:
    """Of each group's position checks: how many there are, how many were measured, and their median and ninth decile."""
    q = F.percentile(offset, F.array(F.lit(0.5), F.lit(0.9)))
    return checks.groupBy(group).agg(F.count("*").alias("total"), F.count(offset).alias("measured"), q.alias("q")).select(group, "total", "measured", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"))


def on_wall_counts(observations: DataFrame, points: DataFrame, image: str, point: str, distance: float) -> DataFrame:
    """Per image its observations of points nearer to the wall's plane than ``distance``; images without any have 0."""
    seen = observations.join(points.select(point, "off"), point, "left")
    return seen.groupBy(image).agg(F.count_if(F.coalesce(F.abs("off") < distance, F.lit(False))).alias("on_wall"))


def for_worker(jobs: DataFrame, worker: Column) -> DataFrame:
    """Of a broadcast topic the jobs that name this worker, or none."""
    return jobs.filter(F.col("target").isNull() | (F.col("target") == "") | (F.col("target") == worker))


def running_over_files(running: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """What runs now stands for itself, all else for what its files say."""
    return running.unionByName(files.join(running.select(key), key, "left_anti").select(*running.columns))
