"""Further queries of the catalogue: lenses and projections, renders, template matches, directions, bands, hulls, photo headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muralis.functions import lens
from muralis.functions.geo import rounded
from muralis.operators import planes as pl
from muralis.operators import positions as ps
from muralis.plans.catalog import c, query, r4, r6
from muralis.sources import exif
from muralis.storage import materialise, table

_KEYS = "l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3"


def _keys() -> list[Column]:
    return [c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_partkey").alias("k3")]


_STEPS = ", ".join(f"i{k} AS (SELECT k1, k2, k3, xd, yd, a, b, xd/f AS x, yd/f AS y FROM (SELECT *, 1::DOUBLE+a*(x*x+y*y)+b*(x*x+y*y)*(x*x+y*y) AS f FROM i{k - 1}))" for k in range(1, lens.ROUNDS + 1))


@query(f"WITH i0 AS (SELECT k1, k2, k3, xd, yd, a, b, xd AS x, yd AS y FROM (SELECT {_KEYS}, (l_quantity*20-500)/900::DOUBLE AS xd, (l_partkey%800-400)/900::DOUBLE AS yd, -0.05::DOUBLE AS a, CASE WHEN l_linenumber%2=0 THEN 0.01::DOUBLE ELSE 0::DOUBLE END AS b FROM lineitem)), {_STEPS} SELECT k1, k2, k3, floor(x*1000000000::DOUBLE+0.5::DOUBLE)/1000000000::DOUBLE AS x, floor(y*1000000000::DOUBLE+0.5::DOUBLE)/1000000000::DOUBLE AS y FROM i{lens.ROUNDS}")
def lens_rays(spark, d):
    """The rays of distorted pixels, of two camera models."""
    two = c("l_linenumber") % 2 == 0
    cam = F.when(two, lens.camera(F.lit("RADIAL"), F.array(*map(F.lit, (900.0, 500.0, 400.0, -0.05, 0.01))))).otherwise(lens.camera(F.lit("SIMPLE_RADIAL"), F.array(*map(F.lit, (900.0, 500.0, 400.0, -0.05)))))
    ray = lens.undistorted(c("l_quantity") * 20, c("l_partkey") % 800, c("cam"))
    t = table(spark, d, "lineitem").withColumn("cam", cam).withColumn("ray", ray)
    return t.select(*_keys(), rounded(c("ray.x"), 9).alias("x"), rounded(c("ray.y"), 9).alias("y"))


def _scene() -> dict[str, Column]:
    """A pinhole, a camera turned by the angle of cosine 0.8, a frame at double size, and an upright wall."""
    vector = lambda *v: F.array(*map(F.lit, v))
    return {
        "cam": lens.camera(F.lit("PINHOLE"), vector(900.0, 880.0, 500.0, 400.0)),
        "pose": F.struct(vector(0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0).alias("r"), vector(1.0, 2.0, 0.0).alias("t")),
        "frame": F.struct(F.lit(2.0).alias("s"), vector(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0).alias("r"), vector(0.5, 0.0, 0.0).alias("t")),
        "plane": F.struct(vector(0.0, 0.0, 20.0).alias("o"), vector(1.0, 0.0, 0.0).alias("u"), vector(0.0, 1.0, 0.0).alias("v")),
    }


@query(f"SELECT k1, k2, k3, CASE WHEN z>0 AND abs(2*z-20)<=3 THEN {r4('(2*(0.8::DOUBLE*a+0.6::DOUBLE*b)+0.5::DOUBLE)*50')} END AS x, CASE WHEN z>0 AND abs(2*z-20)<=3 THEN {r4('2*(-0.6::DOUBLE*a+0.8::DOUBLE*b)*50')} END AS y FROM (SELECT {_KEYS}, l_quantity/4 AS z, (l_partkey%1000-500)/900::DOUBLE*(l_quantity/4)-1 AS a, (l_suppkey%800-400)/880::DOUBLE*(l_quantity/4)-2 AS b FROM lineitem)")
def canvas_by_depth(spark, d):
    """Canvas pixels of photo pixels at their depths; off the wall's band there is none."""
    s = _scene()
    at = lens.canvas_by_depth(c("l_partkey") % 1000, c("l_suppkey") % 800, c("l_quantity") / 4, s["cam"], s["pose"], s["frame"], s["plane"], F.lit(50.0))
    t = table(spark, d, "lineitem").withColumn("at", at)
    return t.select(*_keys(), rounded(c("at.x"), 4).alias("x"), rounded(c("at.y"), 4).alias("y"))


@query(f"SELECT k1, k2, k3, CASE WHEN z>0.000001::DOUBLE THEN {r4('900*((0.8::DOUBLE*a-0.6::DOUBLE*b+1)/z)+500')} END AS x, CASE WHEN z>0.000001::DOUBLE THEN {r4('880*((0.6::DOUBLE*a+0.8::DOUBLE*b+2)/z)+400')} END AS y, {r6('z')} AS z FROM (SELECT {_KEYS}, (l_partkey%40-0.5::DOUBLE)/2 AS a, (l_suppkey%30)/2::DOUBLE AS b, (l_quantity-10)/2 AS z FROM lineitem)")
def projected_points(spark, d):
    """Pixels of points in metres; behind the camera there is none."""
    s = _scene()
    at = lens.projected([(c("l_partkey") % 40).cast("double"), (c("l_suppkey") % 30).cast("double"), c("l_quantity") - 10], s["cam"], s["pose"], s["frame"])
    t = table(spark, d, "lineitem").withColumn("at", at)
    return t.select(*_keys(), rounded(c("at.x"), 4).alias("x"), rounded(c("at.y"), 4).alias("y"), rounded(c("at.z")).alias("z"))


@query("WITH p AS (SELECT l_partkey/10::DOUBLE AS u, l_quantity/5 AS v, l_discount*80-4 AS off, l_suppkey::DOUBLE AS value FROM lineitem WHERE abs(l_discount*80-4)<=3), e AS (SELECT trunc(u*10)::INTEGER AS x, trunc(v*10)::INTEGER AS y, off, value FROM p, (SELECT min(u) AS lo, max(u) AS hi FROM p) WHERE u>lo+0.5::DOUBLE AND u<hi-0.5::DOUBLE), s AS (SELECT y+j AS y, x+i AS x, off, value FROM e, range(-2,3) a(i), range(-2,3) b(j) WHERE x BETWEEN 0 AND 1499 AND y BETWEEN 0 AND 99) SELECT y::INTEGER AS y, x::INTEGER AS x, floor(off*10000+0.5::DOUBLE)/10000::DOUBLE AS off, value FROM (SELECT *, row_number() OVER (PARTITION BY y,x ORDER BY off DESC, value DESC) AS r FROM s WHERE x BETWEEN 0 AND 1499 AND y BETWEEN 0 AND 99) WHERE r=1")
def rendered_points(spark, d):
    """The canvas that points near the wall cover, the foremost before the others."""
    t = table(spark, d, "lineitem").select((c("l_partkey") / 10).alias("u"), (c("l_quantity") / 5).alias("v"), (c("l_discount") * 80 - 4).alias("off"), c("l_suppkey").cast("double").alias("value"))
    return ps.rendered(t, 1500, 100, 10.0, "value", margin=0.5).select("y", "x", rounded(c("off"), 4).alias("off"), "value")


@query()
def position_offsets(spark, d):
    """Each supplier's window of the mosaic of mean prices, shifted by up to two cells, sought again in the mosaic."""
    t = table(spark, d, "lineitem")
    mean = t.groupBy((c("l_partkey") % 60).alias("x"), c("l_quantity").cast("long").alias("y")).agg((F.avg("l_extendedprice") / 200).alias("value"))
    mean = materialise(mean, "mosaic")
    s = c("s_suppkey")
    checks = table(spark, d, "supplier").select(s.alias("id"), (14 + s % 30).alias("cx"), (14 + s % 20).alias("cy"), (s % 5 - 2).alias("dx"), (s % 3 - 1).alias("dy"))
    around = checks.withColumn("i", F.explode(F.sequence(F.lit(-6), F.lit(6)))).withColumn("j", F.explode(F.sequence(F.lit(-6), F.lit(6))))
    photo = around.select("id", (c("cx") + c("i")).alias("px"), (c("cy") + c("j")).alias("py"), (c("cx") + c("i") + c("dx")).alias("x"), (c("cy") + c("j") + c("dy")).alias("y"))
    # The mosaic has at most 60 x 50 cells; the windows' cells, which Spark takes for as few as the suppliers, must not be broadcast.
    photo = photo.join(F.broadcast(mean), ["x", "y"])
    found = ps.position_offsets(checks.select("id", "cx", "cy"), photo.select("id", c("px").alias("x"), c("py").alias("y"), "value"), mean, radius=6, reach=4)
    return found.select("id", *(rounded(c(k), 4).alias(k) for k in ("dx", "dy", "ncc")))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Points of seven faces: walls along x, with some depth, and far points behind every 20th order."""
    far = F.when(c("l_orderkey") % 20 == 0, c("l_quantity") * 20).otherwise(0.0)
    return table(spark, d, "lineitem").select(c("l_linenumber").alias("g"), (c("l_partkey") / 20.0).alias("x"), (c("l_discount") * 8 + far).alias("y"), (c("l_quantity") / 2).alias("z"))


@query()
def principal_directions(spark, d):
    out = pl.principal_directions(_points(spark, d), "g")
    return out.select("g", "n", *(rounded(c("axis")[k]).alias(a) for k, a in enumerate("xyz")))


@query()
def wall_band(spark, d):
    p = _points(spark, d)
    normals = p.select("g").distinct().withColumn("normal", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    _, middle = pl.wall_points(p, normals, "g")
    return middle.select("g", "n_in", "reseeded", *(rounded(c("mean")[k]).alias(a) for k, a in enumerate("xyz")))


def _hulls(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return pl.wall_hulls(t.select(c("l_suppkey").alias("image"), (c("l_partkey") % 397).cast("double").alias("x"), (c("l_quantity") * 6).alias("y"), (c("l_discount") * 20 - 1).alias("off")), "image")


@query()
def wall_hulls(spark, d):
    """The convex hull of what each photo shows of the wall."""
    return _hulls(spark, d).select("image", "n", F.size("hull").alias("corners"), F.array_min(F.transform("hull", lambda p: p["x"])).alias("left"), F.array_max(F.transform("hull", lambda p: p["y"])).alias("bottom"))


@query()
def wall_region(spark, d):
    """Rows of the canvas with the number of their cells that any photo's region covers."""
    k = c("s_suppkey")
    h = F.array(F.lit(0.25), F.lit(0.0), (k % 40 * 5).cast("double"), F.lit(0.0), F.lit(0.25), (k % 7 * 10).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    views = table(spark, d, "supplier").select(k.alias("image"), h.alias("h"), F.lit(400.0).alias("w"), F.lit(300.0).alias("h_px"))
    return pl.wall_region(_hulls(spark, d), views, "image", 320, 160).groupBy("y").agg(F.count("*").alias("cells"))


def _hex(value: Column | int, digits: int) -> Column:
    v = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(v.cast("long")), digits, "0")


@query(f"SELECT p_partkey AS k, 'DJI' AS make, {r6('37+p_size/60::DOUBLE+(p_partkey%60)/3600::DOUBLE')} AS lat, p_size/10::DOUBLE AS alt FROM part")
def exif_positions(spark, d):
    """Headers of photos, written from the parts' numbers byte by byte, read again."""
    entry = lambda tag, kind, count, value: [_hex(tag, 4), _hex(kind, 4), _hex(count, 8), value]
    head = [F.lit("4D4D002A"), _hex(8, 8), _hex(2, 4), *entry(0x010F, 2, 4, F.lit("444A4900")), *entry(0x8825, 4, 1, _hex(38, 8)), _hex(0, 8)]
    gps = [_hex(3, 4), *entry(1, 2, 2, F.lit("4E000000")), *entry(2, 5, 3, _hex(80, 8)), *entry(6, 5, 1, _hex(104, 8)), _hex(0, 8)]
    size, second = c("p_size"), c("p_partkey") % 60
    values = [x for a, b in ((37, 1), (size, 1), (second, 1), (size, 10)) for x in (_hex(a, 8), _hex(b, 8))]
    photos = table(spark, d, "part").select(F.concat(F.lit("/f/"), c("p_partkey").cast("string"), F.lit(".JPG")).alias("path"), F.unhex(F.concat(*head, *gps, *values)).alias("content"))
    m = exif.photo_metadata(photos)
    return m.select(c("image_id").cast("long").alias("k"), c("drone_model").alias("make"), rounded(c("gps.latitude")).alias("lat"), c("gps.altitude_m").alias("alt"))
