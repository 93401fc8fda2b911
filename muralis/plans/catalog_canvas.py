"""Further queries of the catalogue: canvas geometry, lookups and registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from muralis.functions.geo import rounded
from muralis.operators import canvas as cv
from muralis.operators import graphs as gr
from muralis.operators import lookups as lk
from muralis.plans import roles
from muralis.plans.catalog import c, query, r6
from muralis.plans.roles import with_roles
from muralis.storage import table


@query(f"SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, {r6('f*l_quantity')} AS mm, {r6('f*f*l_extendedprice')} AS mm2, {r6('l_extendedprice/nullif(s,0)')} AS u_m FROM (SELECT *, CASE WHEN l_linenumber%3<>0 AND s<>0 THEN 1000::DOUBLE/s END AS f FROM (SELECT *, (l_suppkey%4)*100::DOUBLE AS s FROM lineitem))")
def crack_millimetres(spark, d):
    t = table(spark, d, "lineitem").withColumn("s", (c("l_suppkey") % 4) * 100.0)
    calibrated = c("l_linenumber") % 3 != 0
    return t.select(c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_partkey").alias("k3"), rounded(cv.millimetres(c("l_quantity"), c("s"), calibrated)).alias("mm"), rounded(cv.millimetres(c("l_extendedprice"), c("s"), calibrated, 2)).alias("mm2"), rounded(cv.metres(c("l_extendedprice"), c("s"))).alias("u_m"))


@query("SELECT DISTINCT k, greatest(e-768,0) AS lo, e AS hi FROM (SELECT k, least(i*704+768, size) AS e FROM (SELECT p_partkey AS k, p_size*97+60 AS size FROM part), range(0, 20) r(i) WHERE i=0 OR (i-1)*704+768<size)")
def tile_windows(spark, d):
    t = table(spark, d, "part").select(c("p_partkey").alias("k"), (c("p_size") * 97 + 60).cast("int").alias("size"))
    return t.select("k", F.explode(cv.windows(c("size"), 768, 64)).alias("w")).select("k", c("w.lo").cast("long").alias("lo"), c("w.hi").cast("long").alias("hi"))


@query("WITH b AS (SELECT p_partkey AS k, (p_partkey%50)::BIGINT AS x0, (p_partkey%30)::BIGINT AS y0, (p_partkey%50+p_size*3)::BIGINT AS x1, (p_partkey%30+p_size*2)::BIGINT AS y1 FROM part) SELECT k, x0, y0, x1, y1 FROM b WHERE (x1-x0)*(y1-y0)<=400 UNION ALL SELECT k, x0+20*i, y0+20*j, least(x0+20*i+20,x1), least(y0+20*j+20,y1) FROM b, range(0,200) r(i), range(0,200) s(j) WHERE (x1-x0)*(y1-y0)>400 AND x0+20*i<x1 AND y0+20*j<y1")
def shadow_cells(spark, d):
    k = c("p_partkey")
    t = table(spark, d, "part").select(k.alias("k"), (k % 50).cast("long").alias("x0"), (k % 30).cast("long").alias("y0"), (k % 50 + c("p_size") * 3).cast("long").alias("x1"), (k % 30 + c("p_size") * 2).cast("long").alias("y1"))
    return cv.subdivided(t, 400)


@query("SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, least(greatest(l_quantity*8-100, 0), 255)::DOUBLE AS x, x0>=0 AND x0+w<=300 AS inside FROM (SELECT *, l_quantity*8-100 AS x0, l_linenumber*20 AS w FROM lineitem)")
def source_clamp(spark, d):
    t = table(spark, d, "lineitem").withColumn("x0", c("l_quantity") * 8 - 100)
    return t.select(c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_partkey").alias("k3"), cv.clamped(c("x0").cast("double"), F.lit(256)).cast("double").alias("x"), ((c("x0") >= 0) & (c("x0") + c("l_linenumber") * 20 <= 300)).alias("inside"))


_CELLS = "SELECT l_suppkey AS g, l_partkey%40 AS x, l_quantity::BIGINT AS y, l_discount>0.04::DOUBLE AS flag FROM lineitem"


def _cells(spark, d):
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("g"), (c("l_partkey") % 40).alias("x"), c("l_quantity").cast("long").alias("y"), (c("l_discount") > 0.04).alias("flag"))


@query(f"SELECT floor(x/8::DOUBLE)::BIGINT AS tile_x, floor(y/8::DOUBLE)::BIGINT AS tile_y, {r6('avg(flag::INTEGER)')} AS observed_ratio FROM ({_CELLS}) GROUP BY 1,2 HAVING avg(flag::INTEGER)>=0.5::DOUBLE")
def observed_tiles(spark, d):
    return cv.observed_tiles(_cells(spark, d).withColumnRenamed("flag", "observed"), 8).withColumn("observed_ratio", rounded(c("observed_ratio")))


@query(f"SELECT g, x, {r6('avg(flag::INTEGER)')} AS flagged FROM ({_CELLS}) GROUP BY 1,2 HAVING avg(flag::INTEGER)>0.15::DOUBLE")
def corner_columns(spark, d):
    return cv.corner_columns(_cells(spark, d), "g", "x", "flag").withColumn("flagged", rounded(c("flagged")))


@query(f"SELECT g, {r6('count(*)/2000::DOUBLE')} AS coverage FROM (SELECT DISTINCT g, x, y FROM ({_CELLS})) GROUP BY 1")
def coverage(spark, d):
    return cv.coverage_ratio(_cells(spark, d), "g", F.lit(2000.0)).withColumn("coverage", rounded(c("coverage")))


@query("SELECT g, greatest(0, trunc((lo+2)*20)::INTEGER) AS x_lo, least(900, trunc((hi-2)*20)::INTEGER) AS x_hi, least(1000, trunc((top+1)*20)::INTEGER) AS y_hi FROM (SELECT l_suppkey AS g, min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_cont(l_partkey*0.5::DOUBLE, 0.05) AS top FROM lineitem WHERE abs(l_discount*10-0.5::DOUBLE)<=0.35::DOUBLE GROUP BY 1)")
def roof_window(spark, d):
    t = table(spark, d, "lineitem").select(c("l_suppkey").alias("g"), c("l_quantity").alias("u"), (c("l_partkey") * 0.5).alias("v"), (c("l_discount") * 10 - 0.5).alias("off"))
    return cv.roof_window(t, "g", 0.35, 20.0, 900, 1000)


@query(f"WITH v AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, l_quantity AS fx, l_quantity*2 AS fy, CASE WHEN l_partkey%3<>0 THEN l_quantity+l_linenumber*0.5::DOUBLE END AS dx, CASE WHEN l_partkey%3<>0 THEN l_quantity*2-l_linenumber END AS dy FROM lineitem), s AS (SELECT k, quantile_cont(dx-fx,0.5) AS sx, quantile_cont(dy-fy,0.5) AS sy, count(dx) AS nv, count(*) AS n FROM v GROUP BY 1) SELECT k, ord::INTEGER AS ord, {r6('CASE WHEN nv*2<n THEN fx ELSE coalesce(dx,fx+sx) END')} AS x, {r6('CASE WHEN nv*2<n THEN fy ELSE coalesce(dy,fy+sy) END')} AS y, CASE WHEN nv=n THEN 'depth' WHEN nv*2<n THEN 'flat' ELSE 'depth+flat' END AS method FROM v JOIN s USING (k)")
def mixed_placement(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    seen = c("l_partkey") % 3 != 0
    t = table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), F.row_number().over(w).alias("ord"), c("l_quantity").alias("fx"), (c("l_quantity") * 2).alias("fy"), F.when(seen, c("l_quantity") + c("l_linenumber") * 0.5).alias("dx"), F.when(seen, c("l_quantity") * 2 - c("l_linenumber")).alias("dy"))
    m = cv.mixed_placement(t, "k")
    return m.select("k", "ord", rounded(c("x")).alias("x"), rounded(c("y")).alias("y"), "method")


@query(f"SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, coalesce(l_quantity>d*1.03::DOUBLE+0.15::DOUBLE, false) AS hidden, {r6('sqrt((l_quantity-1)**2+(l_linenumber-2)**2+(l_tax-3)**2)')} AS key FROM (SELECT *, CASE WHEN l_partkey%4<>0 THEN l_discount*400 END AS d FROM lineitem)")
def occlusion(spark, d):
    t = table(spark, d, "lineitem").withColumn("d", F.when(c("l_partkey") % 4 != 0, c("l_discount") * 400))
    key = cv.camera_distance(c("l_quantity"), c("l_linenumber"), c("l_tax"), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return t.select(c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_partkey").alias("k3"), cv.hidden(c("l_quantity"), c("d")).alias("hidden"), rounded(key).alias("key"))


@query(f"WITH p AS (SELECT p_size%3 AS image, p_partkey AS id, p_partkey%44-2+0.25::DOUBLE AS x, p_partkey%33-1+0.25::DOUBLE AS y FROM part), cells AS (SELECT i AS image, a AS cx, b AS cy, ((a*7+b*11+i)%17)-3.0::DOUBLE AS depth FROM range(0,3) t(i), range(0,40) u(a), range(0,30) v(b)), w AS (SELECT p.image, p.id, p.x, p.y, least(greatest(least(greatest(round_even(p.x,0),0),39)+ox,0),39)::BIGINT AS cx, least(greatest(least(greatest(round_even(p.y,0),0),29)+oy,0),29)::BIGINT AS cy FROM p, range(-2,3) r(ox), range(-2,3) s(oy)) SELECT image, id, CASE WHEN x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 29 AND count(depth)>=13 THEN {r6('quantile_cont(depth,0.5)')} END AS depth FROM w LEFT JOIN (SELECT * FROM cells WHERE depth>0) USING (image, cx, cy) GROUP BY image, id, x, y")
def depth_samples(spark, d):
    k = c("p_partkey")
    points = table(spark, d, "part").select((c("p_size") % 3).cast("long").alias("image"), k.alias("id"), (k % 44 - 2 + 0.25).alias("x"), (k % 33 - 1 + 0.25).alias("y"), F.lit(40).alias("width"), F.lit(30).alias("height"))
    cells = spark.range(3600).select((c("id") % 3).alias("image"), (F.floor(c("id") / 3) % 40).alias("cx"), F.floor(c("id") / 120).alias("cy"))
    cells = cells.withColumn("depth", (c("cx") * 7 + c("cy") * 11 + c("image")) % 17 - 3.0)
    s = cv.depth_samples(points, cells, "image")
    return s.select("image", "id", rounded(c("depth")).alias("depth"))


@query()
def path_transforms(spark, d):
    """Homographies from every photo to the reference photo, along the tree of fewest hops."""
    e = roles.stitch(spark, d)
    h = F.array(F.lit(1.0), F.lit(0.0), c("tx") * 1e-3, F.lit(0.0), F.lit(1.0), c("ty") * 1e-3, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    tree = gr.breadth_first_tree(e, gr.reference_node(e).select("node"))
    return cv.composed_transforms(e.select(c("u").alias("a"), c("v").alias("b"), h.alias("h")), tree).select("node", *(rounded(c("h")[k]).alias(f"h{k}") for k in (0, 2, 4, 5, 8)))


# ---- lookups and registers ----


@query("SELECT o_orderkey AS k, o_orderdate AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_archives(spark, d):
    return lk.newest(table(spark, d, "orders").select(c("o_orderkey").alias("k"), c("o_orderdate").alias("at")), "at", "k", 50)


@query("SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey*2 FROM orders WHERE o_orderpriority='1-URGENT')")
def archives_by_id(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select((c("o_custkey") * 2).alias("k"))
    return lk.of_ids(table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("name")), ids, "k")


@query("SELECT g, attempt, residual FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY residual IS NULL, residual, attempt) AS r FROM (SELECT l_suppkey AS g, l_orderkey AS attempt, CASE WHEN l_linenumber>1 THEN l_discount END AS residual FROM lineitem)) WHERE r=1")
def best_attempt(spark, d):
    t = table(spark, d, "lineitem").select(c("l_suppkey").alias("g"), c("l_orderkey").alias("attempt"), F.when(c("l_linenumber") > 1, c("l_discount")).alias("residual"))
    return lk.best_attempt(t, "g").select("g", "attempt", "residual")


@query("SELECT n_name AS name, row_number() OVER (ORDER BY place IS NULL, place, n_name) AS at FROM (SELECT n_name, CASE WHEN n_nationkey%3<>0 THEN n_regionkey END AS place FROM nation)")
def desk_order(spark, d):
    from pyspark.sql.window import Window

    t = table(spark, d, "nation").select(c("n_name").alias("name"), F.when(c("n_nationkey") % 3 != 0, c("n_regionkey")).alias("place"))
    return t.select("name", F.row_number().over(Window.orderBy(*lk.in_desk_order(c("place"), "name"))).cast("long").alias("at"))  # the desk's handful of buildings


@query("SELECT g, camera, focal FROM (SELECT p_size AS g, arg_min(camera, p_partkey) AS camera, min(w) AS w0, max(w) AS w1 FROM (SELECT *, ['FC1','FC2','FC3'][p_partkey%3+1] AS camera, CASE WHEN p_partkey%97=0 THEN 100 ELSE 200+p_size%2 END AS w FROM part) GROUP BY 1) JOIN (VALUES ('FC1',200,3.5::DOUBLE),('FC2',201,4.5::DOUBLE)) AS k(camera, width, focal) USING (camera) WHERE w0=width AND w1=width")
def shared_intrinsics(spark, d):
    k = c("p_partkey")
    camera = F.element_at(F.array(F.lit("FC1"), F.lit("FC2"), F.lit("FC3")), (k % 3 + 1).cast("int"))
    photos = table(spark, d, "part").select(c("p_size").alias("g"), k.alias("ord"), camera.alias("camera"), F.when(k % 97 == 0, 100).otherwise(200 + c("p_size") % 2).alias("width"), F.lit(10).alias("height"))
    known = spark.createDataFrame([("FC1", 200, 10, 3.5), ("FC2", 201, 10, 4.5)], "camera string, width int, height int, focal double")
    return lk.shared_intrinsics(photos, known, "g")


@query("SELECT n_nationkey AS k, CASE WHEN model='M4T' THEN 'DJI Matrice 4T (EXIF DJI M4T)' WHEN model='L2D-20c' THEN 'DJI Mavic 3 계열 (EXIF DJI L2D-20c)' WHEN model='X' THEN 'DJI X' WHEN make IS NOT NULL THEN make END AS equipment FROM (SELECT n_nationkey, ['M4T','L2D-20c','X',NULL][n_nationkey%4+1] AS model, CASE WHEN n_nationkey%4=3 AND n_nationkey%8=3 THEN NULL ELSE 'DJI' END AS make FROM nation)")
def equipment(spark, d):
    k = c("n_nationkey")
    model = F.element_at(F.array(F.lit("M4T"), F.lit("L2D-20c"), F.lit("X"), F.lit(None)), (k % 4 + 1).cast("int"))
    t = table(spark, d, "nation").select(k.alias("k"), F.when(~((k % 4 == 3) & (k % 8 == 3)), "DJI").alias("make"), model.alias("model"))
    return t.select("k", lk.equipment(c("make"), c("model")).alias("equipment"))


@query("WITH kept AS (SELECT DISTINCT l_suppkey AS image, l_partkey AS point FROM lineitem WHERE l_suppkey%3=0) SELECT image, count(*) AS n FROM kept WHERE point IN (SELECT point FROM kept GROUP BY 1 HAVING count(*)>=2) GROUP BY 1")
def restricted_points(spark, d):
    t = table(spark, d, "lineitem").select(c("l_suppkey").alias("image"), c("l_partkey").alias("point")).distinct()
    kept = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(c("s_suppkey").alias("image"))
    return lk.restricted_points(t, kept, "image", "point").groupBy("image").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS k, r.who AS rejected_by, r.at AS rejected_at, r.note FROM customer LEFT JOIN (SELECT o_custkey, coalesce(CASE WHEN o_orderkey%2=0 THEN o_orderpriority END, 'desk') AS who, o_orderdate AS at, o_orderstatus AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) r ON r.o_custkey=c_custkey AND r.n=1")
def crack_rejections(spark, d):
    rejected = table(spark, d, "orders").select(c("o_custkey").alias("k"), c("o_orderkey").alias("ord"), F.when(c("o_orderkey") % 2 == 0, c("o_orderpriority")).alias("reviewed_by"), F.lit("desk").alias("file_reviewer"), c("o_orderdate").alias("at"), c("o_orderstatus").alias("note"))
    return lk.with_rejections(table(spark, d, "customer").select(c("c_custkey").alias("k")), rejected, "k")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey%6=0 THEN o_totalprice*2 ELSE o_totalprice END AS size, CASE WHEN o_orderkey%3=0 THEN NULL WHEN o_orderstatus='F' THEN DATE '2024-01-01' END AS deleted_at, CASE WHEN o_orderkey%3=0 THEN DATE '2025-01-01' ELSE DATE '2024-02-02' END AS updated_at FROM orders UNION ALL SELECT o_orderkey+100000000, o_totalprice, NULL, DATE '2025-01-01' FROM orders WHERE o_orderkey%5=0")
def result_files_upsert(spark, d):
    o = table(spark, d, "orders")
    stored = o.select(c("o_orderkey").alias("k"), (c("o_totalprice") + F.when(c("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("size"), F.when(c("o_orderstatus") == "F", F.to_date(F.lit("2024-01-01"))).alias("deleted_at"), F.to_date(F.lit("2024-02-02")).alias("updated_at"))
    incoming = o.filter("o_orderkey % 3 = 0").select(c("o_orderkey").alias("k"), c("o_totalprice").alias("size"), F.lit(1).alias("ord"))
    incoming = incoming.unionByName(o.filter("o_orderkey % 6 = 0").select(c("o_orderkey").alias("k"), (c("o_totalprice") * 2).alias("size"), F.lit(2).alias("ord")))
    incoming = incoming.unionByName(o.filter("o_orderkey % 5 = 0").select((c("o_orderkey") + 100000000).alias("k"), c("o_totalprice").alias("size"), F.lit(1).alias("ord")))
    return lk.file_records_upserted(stored, incoming, ["k"], F.to_date(F.lit("2025-01-01")), "ord")


@query("SELECT o_orderkey AS archive_id, 'F'||(o_custkey%4) AS facade_id, '/out/'||o_orderstatus AS folder, CASE WHEN o_orderkey%3=0 THEN 2025 ELSE 2024 END AS registered_at, CASE WHEN o_orderkey%3<>0 AND o_orderstatus='F' THEN 2024 END AS deleted_at, CASE WHEN o_orderkey%3<>0 AND o_orderstatus='F' THEN 7 END::BIGINT AS bytes_freed FROM orders UNION ALL SELECT o_orderkey+100000000, 'f'||(o_custkey%4), '/out/n', 2025, NULL, NULL FROM orders WHERE o_orderkey%7=0")
def retention_register(spark, d):
    o = table(spark, d, "orders")
    gone = c("o_orderstatus") == "F"
    register = o.select(c("o_orderkey").alias("archive_id"), F.concat(F.lit("F"), c("o_custkey") % 4).alias("facade_id"), F.concat(F.lit("/out/"), "o_orderstatus").alias("folder"), F.lit(2024).alias("registered_at"), F.when(gone, 2024).alias("deleted_at"), F.when(gone, 7).cast("long").alias("bytes_freed"))
    runs = o.filter("o_orderkey % 3 = 0").select(c("o_orderkey").alias("archive_id"), F.concat(F.lit("f"), c("o_custkey") % 4).alias("facade_id"), F.upper(F.concat(F.lit("/out/"), "o_orderstatus")).alias("folder"))
    runs = runs.unionByName(o.filter("o_orderkey % 7 = 0").select((c("o_orderkey") + 100000000).alias("archive_id"), F.concat(F.lit("f"), c("o_custkey") % 4).alias("facade_id"), F.lit("/out/n").alias("folder")))
    runs = runs.unionByName(runs.filter("archive_id % 2 = 0").withColumn("folder", F.initcap("folder")))
    return lk.retention_rearmed(register, runs, F.lit(2025))


@query("SELECT o_orderkey AS k, 'F'||(o_custkey%4) AS facade_id, CASE WHEN o_orderkey%4=0 THEN 2026 WHEN o_orderstatus='F' THEN 2024 END AS deleted_at, CASE WHEN o_orderkey%4=0 THEN o_custkey WHEN o_orderstatus='F' THEN 7 END::BIGINT AS bytes_freed FROM orders")
def retention_marked(spark, d):
    o = table(spark, d, "orders")
    gone = c("o_orderstatus") == "F"
    face = lambda letter: F.concat(F.lit(letter), c("o_custkey") % 4).alias("facade_id")
    register = o.select(c("o_orderkey").alias("k"), face("F"), F.when(gone, 2024).alias("deleted_at"), F.when(gone, 7).cast("long").alias("bytes_freed"))
    freed = o.filter("o_orderkey % 4 = 0").select(c("o_orderkey").alias("k"), face("f"), c("o_custkey").cast("long").alias("bytes"))
    freed = freed.unionByName(freed.filter("k % 8 = 0").withColumn("facade_id", F.upper("facade_id")).withColumn("bytes", c("bytes") - 1))
    return lk.retention_deleted(register, freed, ["k", "facade_id"], F.lit(2026))


_DENSE = ("stereo/depth_maps/a.geometric.bin", "sparse/points.bin", "fused.ply", "stereo/normal_maps/a.bin", "stereo/consistency_graphs/x/a.bin", "images/a.jpg", "stereo/depth_maps/a.photometric.bin", "fused.ply.vis", "notes.txt", "stereo/images/b.jpg")


@query(f"SELECT g, ok AS complete, CASE WHEN ok THEN n ELSE 0 END AS deleted, CASE WHEN ok THEN b ELSE 0 END::BIGINT AS bytes_freed FROM (SELECT g, bool_or(path LIKE 'stereo/depth\\_maps/%.geometric.bin' ESCAPE '\\') AND bool_or(starts_with(path,'sparse/')) AND bool_or(path='fused.ply') AS ok, count(DISTINCT CASE WHEN starts_with(path,'stereo/normal_maps/') THEN 'n' WHEN starts_with(path,'stereo/consistency_graphs/') THEN 'c' WHEN starts_with(path,'images/') THEN 'i' ELSE path END) FILTER (goes) AS n, coalesce(sum(size) FILTER (goes),0) AS b FROM (SELECT *, starts_with(path,'stereo/normal_maps/') OR starts_with(path,'stereo/consistency_graphs/') OR starts_with(path,'images/') OR (starts_with(path,'stereo/depth_maps/') AND path LIKE '%.photometric.bin') OR path='fused.ply.vis' AS goes FROM (SELECT l_orderkey AS g, l_suppkey::BIGINT AS size, {list(_DENSE)!r}[l_partkey%10+1] AS path FROM lineitem)) GROUP BY 1)")
def cleanup_plan(spark, d):
    path = F.element_at(F.array(*map(F.lit, _DENSE)), (c("l_partkey") % 10 + 1).cast("int"))
    t = table(spark, d, "lineitem").select(c("l_orderkey").alias("g"), c("l_suppkey").cast("long").alias("bytes"), path.alias("path"))
    return lk.cleanup_plan(t, "g").select("g", "complete", c("deleted").cast("long").alias("deleted"), c("bytes_freed").cast("long").alias("bytes_freed"))


@query(f"SELECT g, count(*) AS total, count(o) AS measured, {r6('quantile_cont(o,0.5)')} AS median, {r6('quantile_cont(o,0.9)')} AS p90 FROM (SELECT l_suppkey AS g, CASE WHEN l_linenumber<5 THEN l_extendedprice END AS o FROM lineitem) GROUP BY 1")
def position_summary(spark, d):
    t = table(spark, d, "lineitem").select(c("l_suppkey").alias("g"), F.when(c("l_linenumber") < 5, c("l_extendedprice")).alias("o"))
    s = lk.offset_summary(t, "g", "o")
    return s.select("g", "total", "measured", rounded(c("median")).alias("median"), rounded(c("p90")).alias("p90"))


@query("SELECT l_suppkey AS image, count(*) FILTER (abs(p_size-25)<10) AS on_wall FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey%5<>0) ON p_partkey=l_partkey GROUP BY 1")
def on_wall_counts(spark, d):
    points = table(spark, d, "part").filter("p_partkey % 5 <> 0").select(c("p_partkey").alias("point"), (c("p_size") - 25.0).alias("off"))
    return lk.on_wall_counts(table(spark, d, "lineitem").select(c("l_suppkey").alias("image"), c("l_partkey").alias("point")), points, "image", "point", 10.0)


@query("SELECT event_id AS k FROM events WHERE event_type='click' OR event_type='purchase' AND user_id%2=0")
def worker_jobs(spark, d):
    t = table(spark, d, "events").select(c("event_id").alias("k"), F.when(c("event_type") == "click", F.when(c("user_id") % 2 == 0, "")).when((c("event_type") == "purchase") & (c("user_id") % 2 == 0), "w1").otherwise("w2").alias("target"))
    return lk.for_worker(t, F.lit("w1")).select("k")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey%4=0 THEN 'running' ELSE c_mktsegment END AS state FROM customer")
def running_states(spark, d):
    t = table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_mktsegment").alias("state"))
    return lk.running_over_files(t.filter("k % 4 = 0").select("k", F.lit("running").alias("state")), t, "k")
