"""Spatial joins as equi-joins on grid cells, so that no pair of far-apart rows is ever formed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.storage import materialise


#: How often the radius of a search for nearest rows is halved, at most.
HALVINGS = 12


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def radius_pairs(points: DataFrame, *, key: str, axes: list[str], radius: float, within: list[str] | None = None) -> DataFrame:
    """Pairs of rows with a.key < b.key and a distance of at most ``radius`` along ``axes``, with ``distance``; every column of
    ``points`` comes as a_<name> and b_<name>. Rows with a null axis pair with nobody.

    Each row goes to its own cell and meets the rows of the cells around it: 3^d copies of one side.
    """
    within = within or []
    placed = points.filter(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in axes]))
    cells = [f"cell_{x}" for x in axes]
    left = placed.select(*(F.col(c).alias(f"a_{c}") for c in points.columns), *(_cell(F.col(x), radius).alias(c) for x, c in zip(axes, cells, strict=True)))
    right = placed.select(*(F.col(c).alias(f"b_{c}") for c in points.columns), *(_cell(F.col(x), radius).alias(c) for x, c in zip(axes, cells, strict=True)))
    for c in cells:
        right = right.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    on = [left[c] == right[c] for c in cells] + [left[f"a_{w}"] == right[f"b_{w}"] for w in within]
    square = reduce(lambda a, b: a + b, [F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2.0) for x in axes])
    joined = left.join(right, on).filter(F.col(f"a_{key}") < F.col(f"b_{key}")).drop(*cells)
    return joined.withColumn("distance", F.sqrt(square)).filter(F.col("distance") <= radius)


def _finest(points: DataFrame, axes: list[str], radius: float, most: int) -> int:
    """How often ``radius`` is halved until no cell of that size holds more than ``most`` points; HALVINGS at most."""
    level = F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("level")
    size = F.lit(radius) / F.pow(F.lit(2.0), F.col("level"))
    cells = points.select(*axes, level).groupBy("level", *(F.floor(F.col(x) / size).alias(f"cell_{x}") for x in axes)).agg(F.count("*").alias("n"))
    fullest = {r.level: r.n for r in cells.groupBy("level").agg(F.max("n").alias("n")).collect()}  # a row a level
    return next((k for k in range(HALVINGS + 1) if fullest.get(k, 0) <= most), HALVINGS)


def nearest_neighbours(points: DataFrame, *, key: str, axes: list[str], radius: float, k: int) -> DataFrame:
    """a, b, distance, rank: up to ``k`` nearest others of each row within ``radius``, ties to the smaller key; directed.

    Rows are sought within small distances first: one with ``k`` others within such a distance has its nearest there and is done, and the rest
    look twice as far, up to the radius. Of rows at one place only the k + 1 of the smallest keys can be among another's nearest.
    """
    known = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in axes])
    open_ = materialise(points.filter(known).select(F.col(key).alias("a"), *axes), "points")
    near_key = F.row_number().over(Window.partitionBy(*axes).orderBy("a"))
    others = materialise(open_.withColumn("n", near_key).filter(F.col("n") <= k + 1).drop("n"), "places")
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    square = reduce(lambda a, b: a + b, [F.pow(F.col(x) - F.col(f"b_{x}"), 2.0) for x in axes])
    parts = []
    for level in range(_finest(others, axes, radius, 4 * k), -1, -1):
        reach = radius / 2**level
        cells = [f"cell_{x}" for x in axes]
        left = open_.select("*", *(_cell(F.col(x), reach).alias(c) for x, c in zip(axes, cells, strict=True))).repartition(tasks, *cells)
        right = others.select(F.col("a").alias("b"), *(F.col(x).alias(f"b_{x}") for x in axes), *(_cell(F.col(x), reach).alias(c) for x, c in zip(axes, cells, strict=True)))
        for c in cells:
            right = right.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
        met = left.join(right.repartition(tasks, *cells), cells).filter("a <> b").select("a", "b", F.sqrt(square).alias("distance")).filter(F.col("distance") <= reach)
        found = materialise(met.withColumn("rank", rank).filter(F.col("rank") <= k), "nearest")
        if not level:
            parts.append(found)
            break
        done = found.filter(F.col("rank") == k).select("a")
        parts.append(found.join(done, "a", "left_semi"))
        open_ = materialise(open_.join(done, "a", "left_anti"), "points")
    return reduce(DataFrame.unionByName, [p.select("a", "b", "distance", "rank") for p in parts])


def box_pairs(boxes: DataFrame, *, cell: float, key: str = "id", within: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Pairs a.key < b.key of boxes (x0, y0, w, h) that overlap (``strict``: in more than an edge), with ``inter``, ``both`` (area of the
    union) and every column as a_<name> and b_<name>.

    A box is listed in each cell that it touches; a pair that shares several is kept in the first one only. Cells are dealt to as many
    tasks as the session shuffles to, however small the boxes' table is: its pairs are what takes time.
    """
    within = within or []
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = boxes.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h"))
    span = lambda lo, hi: F.explode(F.sequence(_cell(F.col(lo), cell), _cell(F.col(hi), cell)))
    listed = ends.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    left = listed.select(*(F.col(c).alias(f"a_{c}") for c in ends.columns), "cx", "cy").repartition(parts, "cx", "cy")
    right = listed.select(*(F.col(c).alias(f"b_{c}") for c in ends.columns), F.col("cx").alias("dx"), F.col("cy").alias("dy")).repartition(parts, "dx", "dy").hint("merge")
    on = [left.cx == right.dx, left.cy == right.dy] + [left[f"a_{w}"] == right[f"b_{w}"] for w in within]
    c = F.col
    wide = F.least(c("a_x1"), c("b_x1")) - F.greatest(c("a_x0"), c("b_x0"))
    high = F.least(c("a_y1"), c("b_y1")) - F.greatest(c("a_y0"), c("b_y0"))
    first = (c("cx") == _cell(F.greatest(c("a_x0"), c("b_x0")), cell)) & (c("cy") == _cell(F.greatest(c("a_y0"), c("b_y0")), cell))
    meets = (wide > 0) & (high > 0) if strict else (wide >= 0) & (high >= 0)
    joined = left.join(right, on).filter((c(f"a_{key}") < c(f"b_{key}")) & first & meets)
    inter = wide * high
    return joined.withColumn("inter", inter).withColumn("both", c("a_w") * c("a_h") + c("b_w") * c("b_h") - c("inter")).drop("cx", "cy", "dx", "dy")
