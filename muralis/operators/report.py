"""Report figures: histograms, tiers, numbering, roll-ups, floors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.config import DEFAULT, Config


def reportable(cracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows of enough confidence; an unknown one counts as certain here."""
    return cracks.filter(F.coalesce("conf", F.lit(1.0)) >= cfg.report_confidence)


def width_histogram(cracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """label, n over fixed edges, closed on the left; an unknown width counts as 0, and empty bins stay."""
    edges = cfg.width_edges
    labels = [f"<{edges[0]}mm", *(f"{a}-{b}mm" for a, b in zip(edges, edges[1:], strict=False)), f">={edges[-1]}mm"]
    w = F.coalesce("width_mm", F.lit(0.0))
    which = reduce(lambda c, e: c.when(w < e[0], e[1]), list(zip(edges, range(len(edges)), strict=True))[1:], F.when(w < edges[0], 0)).otherwise(len(edges))
    counts = cracks.groupBy(which.alias("bin")).agg(F.count("*").alias("n"))
    spark = cracks.sparkSession
    every = spark.createDataFrame(list(enumerate(labels)), "bin int, label string")
    return every.join(counts, "bin", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def equal_bins(df: DataFrame, value: str, bins: int = 4) -> DataFrame:
    """bin, n of equal bins between least and greatest value; one bin if those are nearly equal."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = df.filter(F.col(value).isNotNull()).join(F.broadcast(ends))  # one row
    step = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") - F.col("lo") < 0.01, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / step).cast("int")))
    return joined.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def confidence_tiers(cracks: DataFrame, group: str) -> DataFrame:
    c = F.coalesce("conf", F.lit(0.0))
    return cracks.groupBy(group).agg(F.count_if(c >= 0.7).alias("high"), F.count_if((c >= 0.4) & (c < 0.7)).alias("medium"), F.count_if(c < 0.4).alias("low"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """by, n, and its percentage of all rows to one decimal; 0 of nothing."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(by, "n", (F.floor(F.coalesce(F.try_divide(F.col("n") * 1000.0, F.col("total")), F.lit(0.0)) + 0.5) / 10.0).alias("pct"))  # one row


def numbered(cracks: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return cracks.withColumn("no", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def longest(cracks: DataFrame, order: list[Column], n: int = 30) -> DataFrame:
    """The first ``n`` rows in order: partial top-n in each task, then of all."""
    return cracks.orderBy(*order).limit(n)


def floor_number(row: Column, roof: Column, pitch: Column, total: Column) -> Column:
    """Floors count from the ground; null off the building."""
    n = (total - F.floor((row - roof) / pitch)).cast("long")
    return F.when((pitch > 0) & (row >= roof) & (n >= 1) & (n <= total), n)


def rolled_up(df: DataFrame, levels: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates for every level of a hierarchy and for all; upper levels have null below."""
    return df.rollup(*levels).agg(*aggregates, F.grouping_id().alias("level"))


def display_name(complex_name: Column, building: Column, face: Column) -> Column:
    """The complex, the building (a number gets the word for it), and the face in brackets; null without the first two."""
    number = F.trim(building)
    number = F.when(number.rlike(r"^\d+$"), F.concat(number, F.lit("동"))).otherwise(F.nullif(number, F.lit("")))
    name = F.nullif(F.concat_ws(" ", F.nullif(F.trim(complex_name), F.lit("")), number), F.lit(""))
    return F.concat(name, F.coalesce(F.concat(F.lit(" ("), face, F.lit(")")), F.lit("")))


def issuer(database: Column, configured: Column) -> Column:
    """The database's value unless it is blank."""
    return F.coalesce(F.nullif(F.trim(database), F.lit("")), configured)


def crop_rectangle(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """The box with a margin that grows with it, clamped to the picture."""
    pad = F.greatest(F.lit(260.0), 0.35 * F.greatest(x1 - x0, y1 - y0))
    return F.array(F.greatest(F.lit(0.0), x0 - pad), F.greatest(F.lit(0.0), y0 - pad), F.least(width, x1 + pad), F.least(height, y1 + pad))


def source_photos(sources: DataFrame) -> DataFrame:
    """One row per (crack, photo): the union of the boxes and the sum of the pixels."""
    return sources.groupBy("crack", "photo").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("pixels").alias("pixels"), F.count("*").alias("n"))


def best_photo(sources: DataFrame) -> DataFrame:
    """Per crack the photo taken most squarely, then with most pixels, then the first."""
    rank = F.row_number().over(Window.partitionBy("crack").orderBy(F.desc("orthogonality"), F.desc("pixels"), "photo"))
    return sources.withColumn("rank", rank).filter("rank = 1").drop("rank")


def endpoints_of_capture(photos: DataFrame, group: str, order: str, n: int = 5) -> DataFrame:
    """The first and the last ``n`` photos of each group."""
    up, down = (F.row_number().over(Window.partitionBy(group).orderBy(o)) for o in (F.asc(order), F.desc(order)))
    return photos.withColumn("up", up).withColumn("down", down).filter((F.col("up") <= n) | (F.col("down") <= n))
