"""Further queries of the catalogue: fragments on the canvas, reasons to fall back, views of the log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.functions import polygons
from muralis.functions.geo import rounded
from muralis.operators import fragments as fr
from muralis.operators import quality as ql
from muralis.operators import report as rp
from muralis.plans import roles
from muralis.plans.catalog import c, query, r4, r6
from muralis.plans.roles import with_roles
from muralis.storage import table


@query(with_roles("edges", f"SELECT a, {r6('avg(err)*4')} AS mean_drift, {r6('max(err)*4')} AS max_drift, {r6('avg(CASE WHEN status=' + chr(39) + 'OK' + chr(39) + ' THEN 1::DOUBLE ELSE 0::DOUBLE END)')} AS coverage, concat_ws(',', CASE WHEN avg(err)*4>10::DOUBLE THEN 'mean_drift' END, CASE WHEN max(err)*4>20::DOUBLE THEN 'max_drift' END, CASE WHEN 1-avg(CASE WHEN status='OK' THEN 1::DOUBLE ELSE 0::DOUBLE END)>0.5::DOUBLE THEN 'coverage' END) AS reasons FROM edges WHERE k1%3=a%3 GROUP BY a, k1%7"))
def fallback_reasons(spark, d):
    """Every reason to fall back, of parts of the edges of each photo: drift from errors, coverage from what passed."""
    e = roles.edges(spark, d).filter(c("k1") % 3 == c("a") % 3).groupBy("a", (c("k1") % 7).alias("part"))
    g = e.agg((F.avg("err") * 4).alias("mean_drift"), (F.max("err") * 4).alias("max_drift"), F.avg(F.when(c("status") == "OK", 1.0).otherwise(0.0)).alias("coverage"))
    reasons = F.array_join(ql.fallback_reasons(c("mean_drift"), c("max_drift"), c("coverage")), ",")
    return g.select("a", *(rounded(c(k)).alias(k) for k in ("mean_drift", "max_drift", "coverage")), reasons.alias("reasons"))


@query(with_roles("boxes", f"SELECT id, {r4('0.5::DOUBLE*(x0+w/2)+0.1::DOUBLE*(y0+h/2)+image_id*10')} AS cx, {r4('-0.1::DOUBLE*(x0+w/2)+0.5::DOUBLE*(y0+h/2)')} AS cy, {r4('w*h*0.26::DOUBLE')} AS area FROM boxes WHERE image_id%3<>0"))
def projected_fragments(spark, d):
    """Fragments on the canvas; a third of the photos has no transform."""
    b = roles.boxes(spark, d).withColumn("polygon", polygons.box_polygon(c("x0"), c("y0"), c("x0") + c("w"), c("y0") + c("h")))
    h = F.array(F.lit(0.5), F.lit(0.1), c("image_id") * 10.0, F.lit(-0.1), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    views = b.select("image_id").distinct().filter("image_id % 3 <> 0").withColumn("h", h)
    p = fr.projected_fragments(b.select("id", "image_id", "polygon"), views, "image_id")
    cx, cy = polygons.area_centroid(c("on_canvas"))
    return p.select("id", rounded(cx, 4).alias("cx"), rounded(cy, 4).alias("cy"), rounded(polygons.area(c("on_canvas")), 4).alias("area"))


@query("SELECT event_id AS k, upper(event_type) AS level FROM events WHERE lower(event_type) IN ('error','purchase')")
def error_view(spark, d):
    t = table(spark, d, "events").select(c("event_id").alias("k"), F.upper("event_type").alias("level"))
    return fr.at_level(t, "error", "Purchase")


@query("SELECT name, row_number() OVER (ORDER BY lower(name), name) AS at FROM (SELECT CASE WHEN p_partkey%2=0 THEN upper(p_name) ELSE p_name END AS name FROM part WHERE p_size=7) GROUP BY name")
def names_ignoring_case(spark, d):
    """The desk's names of one size, a handful, in the order that ignores case."""
    t = table(spark, d, "part").filter("p_size = 7").select(F.when(c("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(c("p_name")).alias("name")).distinct()
    return t.select("name", F.row_number().over(Window.orderBy(*fr.ignoring_case("name"))).cast("long").alias("at"))


@query("SELECT k, nullif(concat_ws(' ', nullif(trim(cx),''), CASE WHEN regexp_full_match(trim(b),'\\d+') THEN trim(b)||'동' ELSE nullif(trim(b),'') END),'')||coalesce(' ('||face||')','') AS name, coalesce(nullif(trim(cx),''),'desk') AS issuer FROM (SELECT s_suppkey AS k, CASE s_suppkey%3 WHEN 0 THEN '  ' WHEN 1 THEN s_name END AS cx, CASE s_suppkey%4 WHEN 1 THEN ' '||(s_suppkey+100)::VARCHAR WHEN 2 THEN 'A동' WHEN 3 THEN '' END AS b, CASE WHEN s_suppkey%5<>0 THEN 'FRONT' END AS face FROM supplier)")
def display_names(spark, d):
    """Names of buildings and who issues their reports, with blank and missing parts."""
    k = c("s_suppkey")
    t = table(spark, d, "supplier").select(k.alias("k"), F.when(k % 3 == 0, "  ").when(k % 3 == 1, c("s_name")).alias("cx"), F.when(k % 4 == 1, F.concat(F.lit(" "), (k + 100).cast("string"))).when(k % 4 == 2, "A동").when(k % 4 == 3, "").alias("b"), F.when(k % 5 != 0, "FRONT").alias("face"))
    return t.select("k", rp.display_name(c("cx"), c("b"), c("face")).alias("name"), rp.issuer(c("cx"), F.lit("desk")).alias("issuer"))
