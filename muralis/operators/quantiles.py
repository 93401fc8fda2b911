"""Ranks, quantiles and densest ranges of groups that no task holds whole.

Equal values are counted first, then dealt by ranges of (group, value), so that a group with very many values lies in many tasks; a
value's rank is its rank within its range plus what the ranges before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.storage import materialise


def running_counts(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` (group, order, n) with ``upto``: the sum of n over the rows of the group that come no later in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, as another sample would deal the ranges otherwise.
    dealt = materialise(rows.repartitionByRange(parts, *group, *order).withColumn("range", F.spark_partition_id()), "ranges")
    own = F.sum("n").over(Window.partitionBy("range", *group).orderBy(*order))
    totals = dealt.groupBy("range", *group).agg(F.sum("n").alias("total"))
    before = totals.select("range", *group, (F.sum("total").over(Window.partitionBy(*group).orderBy("range")) - F.col("total")).alias("ahead"))
    return dealt.withColumn("own", own).join(before, ["range", *group]).withColumn("upto", F.col("own") + F.col("ahead")).drop("range", "own", "ahead")


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n of the known values."""
    return df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count("*").alias("n"))


def group_quantiles(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """group, n, q (array in the order of ``shares``): exact quantiles with linear interpolation; groups without a known value have no
    row."""
    return _quantiles(value_counts(df, group, value), group, shares)


def _quantiles(counted: DataFrame, group: list[str], shares: list[float]) -> DataFrame:
    """``group_quantiles`` of the rows that ``value_counts`` has counted."""
    counts = running_counts(counted, group, ["value"])
    # Written, so that Spark sees how small they are: a few groups' rows would else be sorted by group, all of one in a task.
    totals = materialise(counts.groupBy(*group).agg(F.max("upto").alias("all")), "totals")
    share = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("share")) for k, s in enumerate(shares))))
    wanted = totals.withColumn("s", share).select(*group, "all", "s.k", (F.col("s.share") * (F.col("all") - 1)).alias("at"))
    low, high = F.floor("at"), F.ceil("at")
    first = F.col("upto") - F.col("n")
    # A target meets the rows of its group only where its rank falls: at most two rows remain of each.
    hit = counts.join(wanted, group).filter((F.col("upto") > low) & (first <= high))
    ends = hit.groupBy(*group, "k").agg(F.first("all").alias("all"), F.first("at").alias("at"), F.min("value").alias("a"), F.max("value").alias("b"))
    mixed = F.when(low == high, F.col("a")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("b"))
    quantiles = ends.select(*group, "all", F.struct("k", mixed.alias("v")).alias("q")).groupBy(*group).agg(F.first("all").alias("n"), F.array_sort(F.collect_list("q")).alias("q"))
    return quantiles.select(*group, "n", F.transform("q", lambda x: x["v"]).alias("q"))


def robust_bounds(df: DataFrame, group: list[str], value: str, k: float = 3.0) -> DataFrame:
    """group, n, lo, hi: the least and the greatest value within k interquartile ranges of the quartiles; of all values where these are
    equal or none is within."""
    counted = materialise(value_counts(df, group, value), "counts")
    q = materialise(_quantiles(counted, group, [0.25, 0.75]).select(*group, "q", (F.col("q")[1] - F.col("q")[0]).alias("spread")), "quartiles")
    inside = (F.col("spread") <= 1e-9) | F.col("value").between(F.col("q")[0] - k * F.col("spread"), F.col("q")[1] + k * F.col("spread"))
    kept = lambda f: F.coalesce(f(F.when(inside, F.col("value"))), f("value"))
    return counted.join(q, group).groupBy(*group).agg(F.sum("n").alias("n"), kept(F.min).alias("lo"), kept(F.max).alias("hi"))


def densest_ranges(df: DataFrame, group: list[str], value: str, width: float) -> DataFrame:
    """group, start, n of the range [start, start + width] from a value with the most values, the first of equals."""
    points = running_counts(value_counts(df, group, value), group, ["value"])
    zero = F.lit(0).cast("long")
    probes = points.select(*group, (F.col("value") + width).alias("value"), F.lit(1).alias("kind"), zero.alias("n"), F.col("value").alias("start"), (F.col("upto") - F.col("n")).alias("before"))
    marks = points.select(*group, "value", F.lit(0).alias("kind"), "n", F.lit(None).cast(dict(points.dtypes)["value"]).alias("start"), zero.alias("before"))
    met = running_counts(marks.unionByName(probes), group, ["value", "kind", "start"]).filter("kind = 1")
    best = met.groupBy(*group).agg(F.max(F.struct((F.col("upto") - F.col("before")).alias("n"), (-F.col("start")).alias("neg"))).alias("m"))
    return best.select(*group, (-F.col("m.neg")).alias("start"), F.col("m.n").alias("n"))


def within(value: Column, bounds: str = "") -> Column:
    return value.between(F.col(f"{bounds}lo"), F.col(f"{bounds}hi"))
