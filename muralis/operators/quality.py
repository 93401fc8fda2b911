"""Gates and statistics of pairwise geometry and of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.config import DEFAULT, Config
from muralis.operators.quantiles import densest_ranges, group_quantiles


def geometry_status(failed: Column, matches: Column, inliers: Column, ratio: Column, error: Column, cfg: Config = DEFAULT) -> Column:
    """The first gate that an edge fails, or OK; a status from an earlier stage stands."""
    return (
        F.when(failed.isNotNull(), failed)
        .when(matches < cfg.min_matches, "LOW_MATCH")
        .when((inliers < cfg.min_inliers) | (ratio < cfg.min_inlier_ratio), "LOW_INLIER")
        .when(error.isNull() | (error > cfg.max_median_error_px), "HIGH_REPROJECTION_ERROR")
        .otherwise("OK")
    )


def stitch_quality(edges: DataFrame, group: str) -> DataFrame:
    """Per group: edges by status, mean inlier ratio, and the median error of the edges that passed."""
    return edges.groupBy(group).agg(
        F.count("*").alias("n_edges"),
        F.count_if(F.col("status") == "OK").alias("n_ok"),
        F.count_if(F.col("status") != "OK").alias("n_failed"),
        F.avg("ratio").alias("mean_ratio"),
        F.percentile(F.when(F.col("status") == "OK", F.col("err")), F.lit(0.5)).alias("median_err"),
    )


def fallback_reasons(mean_drift: Column, max_drift: Column, coverage: Column, cfg: Config = DEFAULT) -> Column:
    """Every reason to fall back to another reconstruction; empty if none."""
    tests = ((mean_drift > cfg.fallback_mean_drift_px, "mean_drift"), (max_drift > cfg.fallback_max_drift_px, "max_drift"), (1 - coverage > cfg.fallback_uncovered, "coverage"))
    return F.filter(F.array(*(F.when(t, F.lit(name)) for t, name in tests)), lambda x: x.isNotNull())


def robust_range(df: DataFrame, group: str, value: str, k: float = 3.0) -> DataFrame:
    """Least and greatest value within k interquartile ranges of the quartiles; of all values if none is."""
    q = group_quantiles(df, [group], value, [0.25, 0.75]).drop("n").withColumn("spread", F.col("q")[1] - F.col("q")[0])
    inlier = (F.col("spread") <= 1e-9) | F.col(value).between(F.col("q")[0] - k * F.col("spread"), F.col("q")[1] + k * F.col("spread"))
    out = df.select(group, value).join(q, group, "left").groupBy(group).agg(F.min(F.when(inlier, F.col(value))).alias("lo"), F.max(F.when(inlier, F.col(value))).alias("hi"), F.min(value).alias("raw_lo"), F.max(value).alias("raw_hi"), F.count("*").alias("n"), F.count_if(inlier).alias("n_in"))
    return out.select(group, F.coalesce("lo", "raw_lo").alias("lo"), F.coalesce("hi", "raw_hi").alias("hi"), "n", "n_in")


def largest_gap(df: DataFrame, group: str, key: str, count: str, ratio: float = 2.5) -> DataFrame:
    """Members below the largest relative gap of their group's sorted counts, sought in the lower half only; and those of count 0, gap or
    not (gap_ratio is null then), if they are no more than half. Groups of fewer than four have none."""
    w = Window.partitionBy(group).orderBy(count, key)
    whole = Window.partitionBy(group)
    ranked = df.select(group, key, count).select("*", F.row_number().over(w).alias("gap_i"), F.count("*").over(whole).alias("gap_size"), F.lead(count).over(w).alias("gap_next"), F.count_if(F.col(count) == 0).over(whole).alias("gap_zeros"))
    ranked = ranked.filter("gap_size >= 4")
    gaps = ranked.filter((F.col("gap_i") <= F.floor(F.col("gap_size") / 2)) & F.col("gap_next").isNotNull()).withColumn("r", (F.col("gap_next") + 1.0) / (F.col(count) + 1.0))
    cut = gaps.groupBy(group).agg(F.max(F.struct("r", (-F.col("gap_i")).alias("neg"))).alias("m")).filter(F.col("m.r") >= ratio).select(group, (-F.col("m.neg")).alias("cut"), F.col("m.r").alias("gap_ratio"))
    empty = (F.col(count) == 0) & (F.col("gap_zeros") <= F.floor(F.col("gap_size") / 2))
    below = F.coalesce(F.col("gap_i") <= F.col("cut"), F.lit(False))
    return ranked.join(cut, group, "left").filter(below | empty).select(group, key, count, F.when(below, F.col("gap_ratio")).alias("gap_ratio"))


def densest_slab(df: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """Per group the start of the range of ``width`` with most values, the first of equals, and their number."""
    return densest_ranges(df, [group], value, width)


def capture_facts(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median, 5th and 95th percentile, and their spread against the median."""
    q = F.percentile(value, F.array(*map(F.lit, (0.05, 0.5, 0.95))))
    out = df.groupBy(group).agg(q.alias("q"), F.count(value).alias("n"))
    return out.select(group, F.col("q")[1].alias("median"), F.col("q")[0].alias("p5"), F.col("q")[2].alias("p95"), F.try_divide(F.col("q")[2] - F.col("q")[0], F.col("q")[1]).alias("spread"), "n")


def cell_statistics(df: DataFrame, cells: list[str], value: str) -> DataFrame:
    """Median and interquartile range per cell."""
    q = df.groupBy(*cells).agg(F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.count(value).alias("n"))
    return q.select(*cells, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "n")


def histogram_mode(df: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """Middle of the fullest bin of ``width``, the lowest of equals."""
    bins = df.groupBy(group, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    best = bins.groupBy(group).agg(F.max(F.struct("n", (-F.col("bin")).alias("neg"))).alias("m"))
    return best.select(group, (-F.col("m.neg") * width + width / 2).alias("mode"), F.col("m.n").alias("n"))


def residual_summary(df: DataFrame, group: str, residual: str, limit: float = 3.0) -> DataFrame:
    """Mean, largest, median, share within the limit, and whether the alignment is accepted."""
    out = df.groupBy(group).agg(F.avg(residual).alias("mean"), F.max(residual).alias("max"), F.percentile(residual, F.lit(0.5)).alias("median"), F.avg((F.col(residual) <= limit).cast("double")).alias("within"))
    return out.withColumn("accepted", (F.col("median") <= limit) | (F.col("within") >= 0.5))


def detail_suspected(mean_ratio: Column, registered: Column, requested: Column) -> Column:
    return (mean_ratio < 0.35) | F.when(requested > 0, registered / requested < 0.7).otherwise(F.lit(False))


def reconciled_flags(suggested: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The suggestion, unless an operator has touched the stored flag."""
    s = stored.select(key, F.col("flag").alias("kept"), "auto_suggested")
    return suggested.join(s, key, "left").select(key, F.when(F.coalesce(F.col("auto_suggested"), F.lit(True)), F.col("flag")).otherwise(F.col("kept")).alias("flag"))


def collinear(moments: DataFrame, *, least_spread: float = 3.0, ratio: float = 0.25) -> DataFrame:
    """Whether positions with covariances cxx, cxy, cyy lie along a line: the larger standard deviation is wide enough and the other
    one small against it."""
    half, det = (F.col("cxx") + F.col("cyy")) / 2, F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    root = F.sqrt(F.greatest(F.lit(0.0), half * half - det))
    first, second = F.sqrt(F.greatest(F.lit(0.0), half + root)), F.sqrt(F.greatest(F.lit(0.0), half - root))
    return moments.withColumn("collinear", (first >= least_spread) & (second < ratio * first))


def wall_distance(pairs: DataFrame, group: str, focal: float, least: int = 4) -> DataFrame:
    """Lower quartile of focal length times baseline over image shift (dx, tx) per group; null of fewer than ``least`` pairs."""
    d = F.when(F.abs("tx") > 1e-9, focal * F.abs("dx") / F.abs("tx"))
    return pairs.groupBy(group).agg(F.count(d).alias("n"), F.when(F.count(d) >= least, F.percentile(d, F.lit(0.25))).alias("distance"))
