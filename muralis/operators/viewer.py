"""Tables behind the desk: job classes, precedence of variants, uploads, manual entries, joins of reports with cracks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Classes of a job on the dashboard, the first that holds.
CLASSES = ("running", "detecting", "retake", "detail", "failed", "manual_review", "done", "queued")


def job_class(flags: dict[str, Column]) -> Column:
    """The first class whose flag is set; queued without any."""
    known = [k for k in CLASSES if k in flags]
    return reduce(lambda c, k: c.when(flags[k], k), known[1:], F.when(flags[known[0]], known[0])).otherwise("queued")


def dashboard(jobs: DataFrame, column: str) -> DataFrame:
    """A row per class, empty ones too; classes without a card are dropped."""
    cards = jobs.sparkSession.createDataFrame([(k,) for k in CLASSES], f"{column} string")
    return cards.join(jobs.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def first_variant(files: DataFrame, key: list[str], variant: str, order: list[str]) -> DataFrame:
    """Per key the file of the first variant there is."""
    rank = reduce(lambda c, kv: c.when(F.col(variant) == kv[1], kv[0]), list(enumerate(order))[1:], F.when(F.col(variant) == order[0], 0))
    rest = [c for c in files.columns if c not in key]
    return files.withColumn("_rank", rank).filter("_rank is not null").groupBy(*key).agg(F.min(F.struct("_rank", *rest)).alias("m")).select(*key, *(f"m.{c}" for c in rest))


def upload_list(results: DataFrame, card_photos: DataFrame, crack_photos: DataFrame) -> DataFrame:
    """Names to upload, once each whatever their case: kept results, photos of cards, photos of reported cracks."""
    every = results.filter("keep").select("name").union(card_photos.select("name")).union(crack_photos.select("name")).filter("name is not null")
    return every.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).select("name")


def manual_numbers(manual: DataFrame, last: Column, group: str, order: str, own: str) -> DataFrame:
    """Numbers of manual cracks after the last detected one; the counter moves on even past rows that bring an id."""
    n = last + F.row_number().over(Window.partitionBy(group).orderBy(order))
    return manual.withColumn("crack_no", F.coalesce(F.col(own), n))


def report_rows(report: DataFrame, cracks: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Cracks with whether a report has them, their state, and the first page of their cards."""
    first = cards.groupBy(key).agg(F.min("page").alias("page"))
    listed = report.select(key, F.col("state").alias("state"), F.lit(True).alias("listed"))
    joined = cracks.join(listed, key, "left").join(first, key, "left")
    return joined.select(*cracks.columns, F.coalesce("listed", F.lit(False)).alias("in_report"), F.coalesce("state", F.lit("unreviewed")).alias("state"), "page")


def numbered_if_known(numbers: DataFrame, cracks: DataFrame, key: str) -> DataFrame:
    """Report numbers of cracks that exist."""
    return numbers.join(cracks.select(key), key, "left_semi")


def floors_updated(rows: DataFrame, setting: DataFrame, canvas: list[str]) -> DataFrame:
    """floor_min and floor_max of boxes (top, bottom) by the setting of a canvas of the very same size: the floors from 1 to the
    total that the box's edges are on; null if neither is on one."""
    s = setting.select(*(F.col(c).alias(f"s_{c}") for c in canvas), "roof", "pitch", "total", "facade")
    joined = rows.join(F.broadcast(s), "facade", "left")  # a row a face
    fits = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in canvas])

    def floor(y: str) -> Column:
        n = (F.col("total") - F.floor((F.col(y) - F.col("roof")) / F.col("pitch"))).cast("long")
        return F.when(fits & (F.col(y) >= F.col("roof")) & n.between(1, F.col("total")), n)

    a, b = floor("top"), floor("bottom")
    return joined.select(*rows.columns, F.coalesce(F.least(a, b), F.lit(None).cast("long")).alias("floor_min"), F.greatest(a, b).alias("floor_max"))


def circular_mean(df: DataFrame, group: str, angle: str) -> DataFrame:
    """Direction of the sum of unit vectors, in [0, 360)."""
    a = F.radians(angle)
    return df.groupBy(group).agg(F.pmod(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))), F.lit(360.0)).alias("mean"))


def capture_direction(df: DataFrame, group: str, order: str, position: str) -> DataFrame:
    """Sign of the covariance of place in the sequence and position: 1 along the wall, -1 against it."""
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("double"))
    return ranked.groupBy(group).agg(F.signum(F.covar_pop("_i", position)).cast("int").alias("direction"))


def splat_mean(df: DataFrame, x: str, y: str, value: str, cell: float) -> DataFrame:
    """Mean value of the points in each cell."""
    return df.groupBy(F.floor(F.col(y) / cell).alias("cy"), F.floor(F.col(x) / cell).alias("cx")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def observed_mm(observations: DataFrame) -> DataFrame:
    """Per crack the means of what is known, and the coarsest resolution."""
    return observations.groupBy("crack").agg(F.avg("width_mm").alias("width_mm"), F.avg("length").alias("length"), F.max("mm_per_px").alias("mm_per_px"), F.count("*").alias("n"))


def plain_walls(points: DataFrame, group: str, depth: str, *, relief: float = 0.3, share: float = 0.05, least: int = 1000) -> DataFrame:
    """Whether so few points stand out from the median depth that the wall is plain; too few points tell nothing."""
    median = points.groupBy(group).agg(F.percentile(depth, F.lit(0.5)).alias("median"))
    out = points.join(median, group).groupBy(group).agg(F.count("*").alias("n"), F.avg((F.abs(F.col(depth) - F.col("median")) > relief).cast("double")).alias("off"))
    return out.select(group, "n", "off", ((F.col("n") >= least) & (F.col("off") < share)).alias("plain"))


def band_plane(points: DataFrame, group: str) -> DataFrame:
    """Means and covariances of points (x, y, z) per group: what a plane fit needs, in one pass of partial sums."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return points.groupBy(group).agg(*(F.avg(k).alias(f"m{k}") for k in "xyz"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs), F.count("*").alias("n"))


def queue_slots(jobs: DataFrame, pool: str, order: list[str], slots: int) -> DataFrame:
    """First come, first served: the first jobs of a pool run, the rest have a place in the queue."""
    rank = F.row_number().over(Window.partitionBy(pool).orderBy(*order))
    ranked = jobs.withColumn("_r", rank)
    return ranked.select(*jobs.columns, (F.col("_r") <= slots).alias("runs"), F.when(F.col("_r") > slots, F.col("_r") - slots).alias("place"))
