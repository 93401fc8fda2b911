"""Cracks: overlapping detections into one, measuring, grading, identities between runs, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.config import DEFAULT, Config
from muralis.graph import connected_components
from muralis.functions import polygons
from muralis.functions.rings import union_by
from muralis.operators.overlaps import Side, polygon_pairs
from muralis.operators.spatial import box_pairs
from muralis.storage import materialise

#: Cell of the box grid: about the size of a large box, so that most boxes touch few cells and few boxes that are apart share one.
CELL = 32.0

#: Decides overlaps of polygons that are too near a limit to tell, from the other columns of both rows.
Settle = Callable[[np.ndarray, Side, Side], np.ndarray]

# Grades and the note of an ungraded crack.
SEVERE, MINOR = "정밀점검대상", "경미"
NOTE_UNKNOWN, NOTE_COARSE = "판정불가(해상도부족): 해상도 정보 없음", "판정불가(해상도부족): %.2f mm/px > 기준 %.2f mm/px"


def with_bounds(shapes: DataFrame) -> DataFrame:
    """Rows of a column polygon, repaired, with their bounding box x0, y0, w, h; what is no polygon goes."""
    whole = shapes.withColumn("polygon", polygons.poly_clean(F.col("polygon"))).filter("polygon is not null")
    b = whole.withColumn("bounds", polygons.bbox(F.col("polygon")))
    lo = b.withColumn("x0", F.col("bounds")[0]).withColumn("y0", F.col("bounds")[1])
    return lo.withColumn("w", F.col("bounds")[2] - F.col("x0")).withColumn("h", F.col("bounds")[3] - F.col("y0")).drop("bounds")


def scored_pairs(rows: DataFrame, within: list[str] | None = None, settle: Settle | None = None, least: float = 0.0, **wanted) -> DataFrame:
    """Pairs of rows that overlap, with their intersection over union as ``iou``: of their polygons where they have any (``with_bounds``; see
    ``polygon_pairs``), else of their boxes (``box_pairs``). Polygons that overlap by less than ``least`` may be left out."""
    if "polygon" not in rows.columns:
        # Spark may divide before it sees that two boxes are apart; the product of two gaps can make ``both`` 0 then.
        return box_pairs(rows, cell=CELL, within=within).withColumn("iou", F.try_divide("inter", "both"))
    return polygon_pairs(rows, cell=CELL, within=within, settle=settle, least=least, **wanted)


def _sided(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select(*columns, "x0", "y0", "w", "h", *(["polygon"] if "polygon" in rows.columns else []))


def overlapping(boxes: DataFrame, iou: float, within: list[str] | None = None, settle: Settle | None = None) -> DataFrame:
    """a, b, iou for boxes, or polygons, that overlap by at least ``iou``."""
    return scored_pairs(boxes, within, settle, iou, emits=["id"]).filter(F.col("iou") >= iou).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "iou")


def merged(boxes: DataFrame, iou: float = DEFAULT.merge_iou) -> DataFrame:
    """Connected groups of overlapping boxes: crack_id (the smallest id), bounding box, greatest confidence, number."""
    groups = connected_components(overlapping(boxes, iou).select("a", "b"))
    of = boxes.join(groups, "id", "left").withColumn("crack_id", F.coalesce("component", "id"))
    return of.groupBy("crack_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max(F.col("x0") + F.col("w")).alias("x1"), F.max(F.col("y0") + F.col("h")).alias("y1"), F.max("conf").alias("conf"), F.count("*").alias("n"))


def merged_polygons(shapes: DataFrame, iou: float = DEFAULT.merge_iou, settle: Settle | None = None) -> DataFrame:
    """Connected groups of overlapping polygons (id, polygon, conf, tile): crack_id (the smallest id), polygon and area of their union's
    largest part, greatest confidence, tiles (sorted, each once), number."""
    placed = materialise(with_bounds(shapes), "placed")
    groups = connected_components(overlapping(placed.drop("conf", "tile"), iou, settle=settle).select("a", "b"))
    of = placed.join(groups, "id", "left").withColumn("crack_id", F.coalesce("component", "id"))
    rest = of.groupBy("crack_id").agg(F.max("conf").alias("conf"), F.array_sort(F.collect_set("tile")).alias("tiles"), F.count("*").alias("n"))
    # A crack of very many boxes lies in many small squares, so that no task has most of its unions.
    return union_by(of, "crack_id", cell=2 * CELL, steps=4).select("crack_id", "polygon", "area", "n_parts").join(rest, "crack_id")


def centre_gap(ax: Column, aw: Column, ay: Column, ah: Column, bx: Column, bw: Column, by: Column, bh: Column) -> Column:
    """Distance between the centres of two boxes. SQL takes b's corner and half its size off one after the other, and a distance of exactly the
    limit stands or falls by that."""
    wide, high = ax + aw / 2 - bx - bw / 2, ay + ah / 2 - by - bh / 2
    return F.sqrt(wide * wide + high * high)


def duplicates_across_images(boxes: DataFrame, cfg: Config = DEFAULT, settle: Settle | None = None, settle_centre: Callable[[np.ndarray, Side, Side, float], np.ndarray] | None = None) -> DataFrame:
    """a, b of different images that overlap enough, or at all with near centres. ``settle_centre`` may replace the distance of polygons' centres
    where it is too near the limit to tell."""
    c = F.col
    out = c("a_id").alias("a"), c("b_id").alias("b"), "iou"
    if "polygon" in boxes.columns:
        x, y = polygons.area_centroid(c("polygon"))

        def near(iou: np.ndarray, a: Side, b: Side) -> np.ndarray:
            gap = np.hypot(a("centre.x") - b("centre.x"), a("centre.y") - b("centre.y"))
            gap = settle_centre(gap, a, b, cfg.cross_image_centre_px) if settle_centre else gap
            return (iou >= cfg.cross_image_iou) | (gap <= cfg.cross_image_centre_px)

        placed = boxes.withColumn("centre", F.struct(x.alias("x"), y.alias("y")))
        return scored_pairs(placed, settle=settle, keep=near, emits=["id", "image_id"]).filter("a_image_id <> b_image_id").select(*out)
    centre = centre_gap(*(c(f"{k}_{x}") for k in "ab" for x in ("x0", "w", "y0", "h")))
    pairs = scored_pairs(boxes).filter("a_image_id <> b_image_id")
    return pairs.filter((c("iou") >= cfg.cross_image_iou) | (centre <= cfg.cross_image_centre_px)).select(*out)


def inflated_groups(boxes: DataFrame, margin: float) -> DataFrame:
    """Bounding boxes of groups of boxes that overlap once inflated by ``margin``; touching is no overlap."""
    wide = boxes.select("id", (F.col("x0") - margin).alias("x0"), (F.col("y0") - margin).alias("y0"), (F.col("w") + 2 * margin).alias("w"), (F.col("h") + 2 * margin).alias("h"))
    groups = connected_components(box_pairs(wide, cell=CELL).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    of = boxes.join(groups, "id", "left").withColumn("group_id", F.coalesce("component", "id"))
    return of.groupBy("group_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max(F.col("x0") + F.col("w")).alias("x1"), F.max(F.col("y0") + F.col("h")).alias("y1"), F.count("*").alias("n"))


def near_misses(candidates: DataFrame, confident: DataFrame, iou: float = DEFAULT.merge_iou, settle: Settle | None = None) -> DataFrame:
    """Candidates that no confident box overlaps by ``iou`` or more."""
    both = candidates.withColumn("side", F.lit(0)).unionByName(confident.withColumn("side", F.lit(1)))
    hits = scored_pairs(both, settle=settle, least=iou, emits=["id", "side"]).filter((F.col("a_side") != F.col("b_side")) & (F.col("iou") >= iou))
    hit_ids = hits.select(F.when(F.col("a_side") == 0, F.col("a_id")).otherwise(F.col("b_id")).alias("id")).distinct()
    return candidates.join(hit_ids, "id", "left_anti")


def graded(width_mm: Column, mm_per_px: Column, cfg: Config = DEFAULT) -> tuple[Column, Column]:
    """(severity, note): no grade without a width or where the resolution is unknown or too coarse."""
    coarse = mm_per_px > cfg.max_mm_per_px
    severity = F.when(width_mm.isNull() | mm_per_px.isNull() | coarse, F.lit(None)).when(width_mm >= cfg.severe_width_mm, SEVERE).otherwise(MINOR)
    note = F.when(width_mm.isNull(), F.lit(None)).when(mm_per_px.isNull(), NOTE_UNKNOWN).when(coarse, F.format_string(NOTE_COARSE, mm_per_px, F.lit(cfg.max_mm_per_px)))
    return severity.cast("string"), note.cast("string")


def crack_summary(cracks: DataFrame, group: str) -> DataFrame:
    """Per group: number, means and greatest values over what is known, and counts by grade and confidence."""
    return cracks.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg("conf").alias("mean_conf"),
        F.max("length").alias("max_length"),
        F.avg("length").alias("mean_length"),
        F.max("width_mm").alias("max_width_mm"),
        F.avg("width_mm").alias("mean_width_mm"),
        F.count_if(F.col("severity") == SEVERE).alias("n_severe"),
        F.count_if(F.col("severity") == MINOR).alias("n_minor"),
        F.count_if(F.col("severity").isNull()).alias("n_ungraded"),
        F.count_if(F.col("conf") >= 0.7).alias("n_high"),
    )


def greedy_matches(pairs: DataFrame, group: str, least: float) -> DataFrame:
    """One-to-one matches of (group, left_ord, right_ord, score): each left row in order takes its best free right row of at least
    ``least``, the first of equals.

    A group's pairs stream past in that order, sorted by Spark: a task holds the right rows that are taken, never the pairs.
    """
    kinds = dict(pairs.dtypes)

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, settled, taken = object(), object(), set()
        for batch in batches:
            kept = []
            for k, (g, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if g != of:
                    of, settled, taken = g, object(), set()
                if left != settled and right not in taken:
                    settled = left
                    taken.add(right)
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    good = pairs.select(group, "left_ord", "right_ord", F.col("score").cast("double").alias("score")).filter(F.col("score") >= least)
    dealt = good.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), group).sortWithinPartitions(group, "left_ord", F.desc("score"), "right_ord")
    return dealt.mapInArrow(match, f"`{group}` {kinds[group]}, left_ord {kinds['left_ord']}, right_ord {kinds['right_ord']}, score double")


def stable_ids(new: DataFrame, old: DataFrame, iou: float = DEFAULT.match_iou) -> DataFrame:
    """crack_id for every new box (facade, ord, x0, y0, w, h): that of the old box (facade, ord, crack_no, ...) it continues, else the next free
    number of the facade."""
    left = _sided(new, "facade", F.col("ord").alias("id"), F.lit(0).alias("side"))
    right = _sided(old, "facade", (-1 - F.col("ord")).alias("id"), F.lit(1).alias("side"))
    pairs = scored_pairs(left.unionByName(right), ["facade"], least=iou).filter("a_side = 1 and b_side = 0")
    pairs = pairs.select(F.col("a_facade").alias("facade"), F.col("b_id").alias("left_ord"), (-1 - F.col("a_id")).alias("right_ord"), F.col("iou").alias("score"))
    matches = greedy_matches(pairs, "facade", iou).select("facade", F.col("left_ord").alias("ord"), F.col("right_ord").alias("old_ord"))
    known = matches.join(old.select("facade", F.col("ord").alias("old_ord"), "crack_no"), ["facade", "old_ord"]).select("facade", "ord", "crack_no")
    last = old.groupBy("facade").agg(F.max("crack_no").alias("last"))
    marked = new.join(known, ["facade", "ord"], "left").join(last, "facade", "left")
    fresh = F.sum(F.col("crack_no").isNull().cast("long")).over(Window.partitionBy("facade").orderBy("ord"))
    number = F.coalesce("crack_no", F.coalesce("last", F.lit(0)) + fresh)
    return marked.select("facade", "ord", number.alias("crack_no"), F.col("crack_no").isNotNull().alias("continued"), F.format_string("%s_C%06d", F.col("facade").cast("string"), number).alias("crack_id"))


def id_continuity(new: DataFrame, old: DataFrame, group: str, key: str) -> DataFrame:
    """Per group how many ids are in both runs, only in the new one, only in the old one."""
    joined = new.select(group, key, F.lit(True).alias("in_new")).join(old.select(group, key, F.lit(True).alias("in_old")), [group, key], "full")
    return joined.groupBy(group).agg(F.count_if(F.col("in_new") & F.col("in_old")).alias("matched"), F.count_if(F.col("in_old").isNull()).alias("new"), F.count_if(F.col("in_new").isNull()).alias("retired"))


def evaluated(truth: DataFrame, found: DataFrame, background: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """outcome rows of detections against truth (image, ord, x0, y0, w, h, width, tag): TP and FN by truth, CONFOUNDER_FP and FP by the rest
    of the detections."""
    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        """left_ord in a, right_ord in b."""
        both = _sided(a, "image", F.col("ord").alias("id"), F.lit(0).alias("side")).unionByName(_sided(b, "image", (-1 - F.col("ord")).alias("id"), F.lit(1).alias("side")))
        hits = scored_pairs(both, ["image"], least=cfg.truth_iou).filter("a_side = 1 and b_side = 0")
        return hits.select(F.col("a_image").alias("image"), F.col("b_id").alias("left_ord"), (-1 - F.col("a_id")).alias("right_ord"), F.col("iou").alias("score"))

    matches = greedy_matches(pairs(truth, found), "image", cfg.truth_iou)
    hit = matches.select("image", F.col("left_ord").alias("ord"), F.col("right_ord").alias("found_ord"))
    widths = found.select("image", F.col("ord").alias("found_ord"), F.col("width").alias("found_width"))
    of_truth = truth.join(hit, ["image", "ord"], "left").join(widths, ["image", "found_ord"], "left")
    of_truth = of_truth.select("image", "ord", F.when(F.col("found_ord").isNull(), "FN").otherwise("TP").alias("outcome"), "tag", F.abs(F.col("width") - F.col("found_width")).alias("width_error"))
    rest = found.join(hit.select("image", F.col("found_ord").alias("ord")), ["image", "ord"], "left_anti")
    confounded = pairs(rest, background).filter(F.col("score") >= cfg.truth_iou).select("image", F.col("left_ord").alias("ord")).distinct().withColumn("c", F.lit(True))
    of_rest = rest.join(confounded, ["image", "ord"], "left").select("image", "ord", F.when(F.col("c"), "CONFOUNDER_FP").otherwise("FP").alias("outcome"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("double").alias("width_error"))
    return of_truth.unionByName(of_rest)


def confusion(outcomes: DataFrame) -> DataFrame:
    """Counts, recall, precision and mean width error by tag; null where there is nothing to divide by."""
    out = outcomes.groupBy(F.coalesce("tag", F.lit("unlabeled")).alias("tag")).agg(
        F.count_if(F.col("outcome") == "TP").alias("tp"), F.count_if(F.col("outcome") == "FN").alias("fn"), F.count_if(F.col("outcome").isin("FP", "CONFOUNDER_FP")).alias("fp"), F.avg("width_error").alias("width_mae")
    )
    return out.withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))


def owner_counts(polygons: DataFrame, owners: DataFrame, least: int = 20) -> DataFrame:
    """id, owner, n: pixels of each polygon (id, pixels; or id, y, x) by owner in a sparse raster (y, x, owner), from ``least`` pixels on."""
    cells = polygons.select("id", F.explode("pixels").alias("p")).select("id", "p.y", "p.x") if "pixels" in polygons.columns else polygons
    return cells.join(owners, ["y", "x"]).groupBy("id", "owner").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def reviewed(cracks: DataFrame, rejected: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """The cracks without the rejected ones, and the manual ones that are not among them."""
    kept = cracks.join(rejected.select(key).distinct(), key, "left_anti")
    return kept.unionByName(added.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)
