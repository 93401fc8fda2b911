"""The driver tables in the roles of inspection data, in Spark and, with the same arithmetic, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muralis.functions import linalg
from muralis.functions.geo import rounded
from muralis.operators.graphs import stitch_edges
from muralis.operators.quality import geometry_status
from muralis.storage import table


def _e(k: int) -> Column:
    return F.col("embedding")[k - 1].cast("double")


def photos(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings")
    return t.select(F.col("vec_id").alias("image_id"), F.col("label").alias("flight"), (_e(3) * 1e-3 + 37.5).alias("lat"), (_e(4) * 1e-3 + 127.0).alias("lon"), (_e(5) * 20.0 + 60.0).alias("alt"), (_e(6) * 1000.0).alias("yaw"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings")
    i = F.col("vec_id")
    return t.select(
        i.alias("id"), F.col("label").alias("image_id"), rounded((_e(1) + 1.0) * 1000.0, 1).alias("x0"), rounded((_e(2) + 1.0) * 1000.0, 1).alias("y0"),
        (12.1 + 4.0 * (i % 7)).alias("w"), (12.0 + 4.0 * (i % 5)).alias("h"), rounded(0.25 + 0.75 * ((i * 37) % 100) / 100.0, 4).alias("conf"),
    )


def edges(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    t = table(spark, d, "lineitem")
    m = F.floor(F.col("l_quantity") * 4.0)
    out = t.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), m.alias("matches"), F.floor(m * (F.col("l_tax") * 8.0 + 0.2)).alias("inliers"), (F.col("l_discount") * 40.0 + 0.5).alias("err"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), *more)
    out = out.withColumn("ratio", F.try_divide(F.col("inliers").cast("double"), F.col("matches").cast("double")))
    return out.withColumn("status", geometry_status(F.lit(None).cast("string"), F.col("matches"), F.col("inliers"), F.col("ratio"), F.col("err")))


def stitch(spark: SparkSession, d: str) -> DataFrame:
    """Accepted edges u < v, one per pair, with weight and a position of v as seen from u."""
    e = edges(spark, d).filter("status = 'OK' and a <> b")
    n = e.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("n"))
    last = stitch_edges(e.withColumn("ord", F.struct("k1", "k2", "ratio")))
    return last.join(n, ["u", "v"]).select("u", "v", "weight", ((F.col("v") - F.col("u")) * 100.0 + (F.col("n") % 7) * 90.0).alias("tx"), ((F.col("u") * F.col("v")) % 13 * 60.0).alias("ty"))


def homography_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The accepted pairs of ``edges`` with their ends in order (u, v) and a homography a to b, and the photos' sizes. Each photo has a view of its own
    (place, turn, scale and slant by its number); a pair's homography is between the two views, off by some pixels by its discount and tax (the
    greatest of several rows of a pair and line), and every 40th order's by far. Pairs are dealt by u, so that what is grouped by both
    ends or joined by u stays where it is: a supplier has some 600 lines, however many there are."""

    def view(k: Column) -> Column:
        s, r = 1.0 + (k % 7) * 0.01, ((k % 11) - 5) * 0.004
        return F.array(s, -r, (k * 37 % 500) * 4.0, r, s, (k * 53 % 300) * 4.0, (k % 5 - 2) * 1e-6, (k % 3 - 1) * 1e-6, F.lit(1.0))

    e = edges(spark, d, ((F.col("l_discount") - 0.05) * 40.0).alias("dx"), ((F.col("l_tax") - 0.04) * 40.0).alias("dy"))
    ends = e.dropna(subset=["k1", "k2", "a", "b"]).filter("a <> b").withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b"))
    # A struct, as a ratio may be unknown; of several rows of a pair and line the greatest is the last.
    best = F.max(F.when(F.col("status") == "OK", F.struct("ratio"))).alias("best")
    t = ends.select("u", "v", "k1", "k2", "a", "b", "dx", "dy", "ratio", "status").repartition("u").groupBy("u", "v", "k1", "k2", "a", "b").agg(F.max("dx").alias("dx"), F.max("dy").alias("dy"), best)
    t = t.filter("best is not null").withColumn("ratio", F.col("best.ratio"))
    nudge = F.array(F.lit(1.0), F.lit(0.0), F.col("dx") + F.when(F.col("k1") % 40 == 0, 900.0).otherwise(0.0), F.lit(0.0), F.lit(1.0), F.col("dy"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    h = linalg.product(nudge, linalg.product(linalg.inverse(view(F.col("b"))), view(F.col("a"))))
    pairs = t.select("a", "b", "u", "v", "ratio", F.lit("OK").alias("status"), F.struct("k1", "k2", "ratio").alias("ord"), h.alias("h"))
    ids = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return pairs, ids.select("node", (400.0 + F.col("node") % 5 * 10.0).alias("w"), (300.0 + F.col("node") % 3 * 10.0).alias("h"))


def cracks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    from muralis.operators.cracks import graded

    out = t.select(F.col("l_suppkey").alias("facade"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), (F.col("l_extendedprice") / 100.0).alias("length"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity") / 50.0).alias("width_mm"), (F.col("l_tax") * 3.0).alias("mm_per_px"), (F.col("l_discount") * 5.0 + 0.5).alias("conf"))
    severity, note = graded(F.col("width_mm"), F.col("mm_per_px"))
    return out.withColumn("severity", severity).withColumn("note", note)


def sources(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("crack"), F.col("l_suppkey").alias("photo"), (F.col("l_partkey") * 1.0).alias("x0"), F.col("l_quantity").alias("y0"), (F.col("l_partkey") + 10.0).alias("x1"), (F.col("l_quantity") + 5.0).alias("y1"), (F.col("l_linenumber") * 10).cast("long").alias("pixels"), (1.0 - F.col("l_tax")).alias("orthogonality"))


def log(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    stage = F.when(F.col("event_type") == "error", "NEEDS_MANUAL_REVIEW").when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "signup", "FAILED_GEOMETRY").otherwise("MATCH_GEOMETRY")
    return t.select(F.col("user_id").alias("facade"), F.col("ts"), F.col("event_id").alias("line"), stage.alias("stage"), F.col("value").alias("elapsed"), "props", "event_type")


def archives(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "cleaned").when(F.col("o_orderstatus") == "P", "cleanup_pending").otherwise("active")
    return t.select(F.col("o_orderkey").alias("archive_id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.date_add(F.col("o_orderdate").cast("date"), 90).alias("due_at"), F.col("o_totalprice").alias("bytes"))


#: The same as common table expressions.
SQL = {
    "photos": "photos AS (SELECT vec_id AS image_id, label AS flight, embedding[3]::DOUBLE*1e-3+37.5::DOUBLE AS lat, embedding[4]::DOUBLE*1e-3+127::DOUBLE AS lon, embedding[5]::DOUBLE*20::DOUBLE+60::DOUBLE AS alt, embedding[6]::DOUBLE*1000::DOUBLE AS yaw FROM embeddings)",
    "framed": "framed AS (SELECT p.*, radians(lon-lon0)*6371000::DOUBLE*cos(radians(lat0)) AS x, radians(lat-lat0)*6371000::DOUBLE AS y, alt AS z FROM photos p, (SELECT avg(lat) lat0, avg(lon) lon0 FROM photos))",
    "boxes": "boxes AS (SELECT vec_id AS id, label AS image_id, floor((embedding[1]::DOUBLE+1)*1000*10+0.5::DOUBLE)/10::DOUBLE AS x0, floor((embedding[2]::DOUBLE+1)*1000*10+0.5::DOUBLE)/10::DOUBLE AS y0, 12.1::DOUBLE+4::DOUBLE*(vec_id%7) AS w, 12::DOUBLE+4::DOUBLE*(vec_id%5) AS h, floor((0.25::DOUBLE+0.75::DOUBLE*((vec_id*37)%100)/100::DOUBLE)*10000+0.5::DOUBLE)/10000::DOUBLE AS conf FROM embeddings)",
    "lapping": "lapping AS (SELECT *, inter/(w*h+w2*h2-inter) AS iou FROM (SELECT a.id AS a, b.id AS b, a.image_id AS ia, b.image_id AS ib, a.w, a.h, b.w AS w2, b.h AS h2, sqrt((a.x0+a.w/2-b.x0-b.w/2)**2+(a.y0+a.h/2-b.y0-b.h/2)**2) AS centre, (least(a.x0+a.w,b.x0+b.w)-greatest(a.x0,b.x0))*(least(a.y0+a.h,b.y0+b.h)-greatest(a.y0,b.y0)) AS inter FROM boxes a JOIN boxes b ON a.id<b.id AND least(a.x0+a.w,b.x0+b.w)-greatest(a.x0,b.x0)>0 AND least(a.y0+a.h,b.y0+b.h)-greatest(a.y0,b.y0)>0))",
    "edges": "edges AS (SELECT *, CASE WHEN matches<50 THEN 'LOW_MATCH' WHEN inliers<30 OR ratio<0.35::DOUBLE THEN 'LOW_INLIER' WHEN err IS NULL OR err>3::DOUBLE THEN 'HIGH_REPROJECTION_ERROR' ELSE 'OK' END AS status FROM (SELECT *, inliers::DOUBLE/nullif(matches,0)::DOUBLE AS ratio FROM (SELECT l_suppkey AS a, l_partkey AS b, floor(l_quantity*4)::BIGINT AS matches, floor(floor(l_quantity*4)*(l_tax*8::DOUBLE+0.2::DOUBLE))::BIGINT AS inliers, l_discount*40::DOUBLE+0.5::DOUBLE AS err, l_orderkey AS k1, l_linenumber AS k2 FROM lineitem)))",
    "stitch": "stitch AS (SELECT u, v, 1::DOUBLE/greatest(ratio,1e-6) AS weight, (v-u)*100::DOUBLE+(n%7)*90::DOUBLE AS tx, (u*v)%13*60::DOUBLE AS ty FROM (SELECT least(a,b) AS u, greatest(a,b) AS v, arg_max(ratio, {'k1':k1,'k2':k2,'r':ratio}) AS ratio, count(*) AS n FROM edges WHERE status='OK' AND a<>b GROUP BY 1,2))",
    "arcs": "arcs AS (SELECT u, v, weight FROM stitch UNION ALL SELECT v, u, weight FROM stitch)",
    "cracks": "cracks AS (SELECT *, CASE WHEN width_mm IS NULL OR mm_per_px>0.15::DOUBLE THEN NULL WHEN width_mm>=0.3::DOUBLE THEN '정밀점검대상' ELSE '경미' END AS severity, CASE WHEN width_mm IS NULL THEN NULL WHEN mm_per_px>0.15::DOUBLE THEN printf('판정불가(해상도부족): %.2f mm/px > 기준 0.15 mm/px', mm_per_px) END AS note FROM (SELECT l_suppkey AS facade, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_extendedprice/100::DOUBLE AS length, CASE WHEN l_linenumber%5<>0 THEN l_quantity/50::DOUBLE END AS width_mm, l_tax*3::DOUBLE AS mm_per_px, l_discount*5::DOUBLE+0.5::DOUBLE AS conf FROM lineitem))",
    "sources": "sources AS (SELECT l_orderkey AS crack, l_suppkey AS photo, l_partkey*1::DOUBLE AS x0, l_quantity AS y0, l_partkey+10::DOUBLE AS x1, l_quantity+5::DOUBLE AS y1, l_linenumber::BIGINT*10 AS pixels, 1::DOUBLE-l_tax AS orthogonality FROM lineitem)",
    "log": "log AS (SELECT user_id AS facade, ts, event_id AS line, CASE event_type WHEN 'error' THEN 'NEEDS_MANUAL_REVIEW' WHEN 'purchase' THEN 'DONE' WHEN 'signup' THEN 'FAILED_GEOMETRY' ELSE 'MATCH_GEOMETRY' END AS stage, value AS elapsed, props, event_type FROM events)",
    "archives": "archives AS (SELECT o_orderkey AS archive_id, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'cleaned' WHEN 'P' THEN 'cleanup_pending' ELSE 'active' END AS status, o_orderdate::DATE+90 AS due_at, o_totalprice AS bytes FROM orders)",
}


def paths_sql(cutoff: float) -> str:
    """``paths`` (node, dist) within the cut-off of the reference photo, after ``arcs``. A weight is at least 1, so a path has no more edges
    than the cut-off."""
    rounds = int(cutoff)
    steps = [f"d{k} AS MATERIALIZED (SELECT node, min(dist) AS dist FROM (SELECT node, dist FROM d{k - 1} UNION ALL SELECT v, dist+weight FROM d{k - 1} JOIN arcs ON u=node WHERE dist+weight<={cutoff}::DOUBLE) GROUP BY 1)" for k in range(1, rounds + 1)]
    source = "d0 AS (SELECT u AS node, 0::DOUBLE AS dist FROM arcs GROUP BY 1 ORDER BY count(*) DESC, u DESC LIMIT 1)"
    return ", ".join([source, *steps, f"paths AS (SELECT * FROM d{rounds})"])


def with_roles(names: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in names.split()) + " " + body
