"""Further queries of the catalogue: the tables behind the desk and small set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from muralis.functions.geo import rounded
from muralis.operators import depth as dp
from muralis.operators import labels as lb
from muralis.operators import quality as ql
from muralis.operators import store as st
from muralis.operators import viewer as vw
from muralis.plans import roles
from muralis.plans.catalog import c, query, r6
from muralis.plans.roles import with_roles
from muralis.storage import table


@query("SELECT k.class, count(j.class) AS n FROM (VALUES ('running'),('detecting'),('retake'),('detail'),('failed'),('manual_review'),('done'),('queued')) AS k(class) LEFT JOIN (SELECT CASE WHEN o_orderkey%11=0 THEN 'running' WHEN o_orderkey%7=0 THEN 'retake' WHEN o_orderstatus='F' THEN 'done' ELSE 'queued' END AS class FROM orders) j ON j.class=k.class GROUP BY 1")
def dashboard_counts(spark, d):
    jobs = table(spark, d, "orders").select(vw.job_class({"running": c("o_orderkey") % 11 == 0, "retake": c("o_orderkey") % 7 == 0, "done": c("o_orderstatus") == "F"}).alias("class"))
    return vw.dashboard(jobs, "class")


@query("SELECT g, variant, size FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE variant WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, size) AS r FROM (SELECT o_custkey AS g, o_orderpriority AS variant, o_totalprice AS size FROM orders) WHERE variant IN ('1-URGENT','2-HIGH','3-MEDIUM')) WHERE r=1")
def variant_picker(spark, d):
    t = table(spark, d, "orders").select(c("o_custkey").alias("g"), c("o_orderpriority").alias("variant"), c("o_totalprice").alias("size"))
    return vw.first_variant(t, ["g"], "variant", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("SELECT min(name) AS name FROM (SELECT p_name AS name FROM part WHERE p_size<20 UNION ALL SELECT upper(p_name) FROM part WHERE p_size>=40 UNION ALL SELECT p_brand FROM part) GROUP BY lower(name)")
def upload_list(spark, d):
    p = table(spark, d, "part")
    return vw.upload_list(p.select(c("p_name").alias("name"), (c("p_size") < 20).alias("keep")), p.filter("p_size >= 40").select(F.upper("p_name").alias("name")), p.select(c("p_brand").alias("name")))


@query("SELECT o_custkey AS g, o_orderkey AS k, coalesce(CASE WHEN o_orderkey%4=0 THEN o_orderkey END, 100+row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS crack_no FROM orders")
def manual_numbers(spark, d):
    t = table(spark, d, "orders").select(c("o_custkey").alias("g"), c("o_orderkey").alias("k"), F.when(c("o_orderkey") % 4 == 0, c("o_orderkey")).alias("own"))
    return vw.manual_numbers(t, F.lit(100), "g", "k", "own").select("g", "k", "crack_no")


@query("SELECT o.o_orderkey AS k, o.o_orderkey%3=0 AS in_report, CASE WHEN o.o_orderkey%3=0 THEN 'final' ELSE 'unreviewed' END AS state, p.page FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS page FROM lineitem GROUP BY 1) p ON p.l_orderkey=o.o_orderkey")
def report_rows(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("k"))
    cards = table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("page"))
    return vw.report_rows(o.filter("k % 3 = 0").select("k", F.lit("final").alias("state")), o, cards, "k")


@query("SELECT l_orderkey AS k, l_linenumber AS no, l_partkey AS p FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey=l_orderkey AND o_orderstatus='F')")
def numbering_insert(spark, d):
    n = table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("no"), c("l_partkey").alias("p"))
    return vw.numbered_if_known(n, table(spark, d, "orders").filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("k")), "k")


@query("SELECT k1, k2, k3, least(a,b) AS floor_min, greatest(a,b) AS floor_max FROM (SELECT *, CASE WHEN fits AND top>=20 AND 15-floor((top-20)/40::DOUBLE) BETWEEN 1 AND 15 THEN (15-floor((top-20)/40::DOUBLE))::BIGINT END AS a, CASE WHEN fits AND bottom>=20 AND 15-floor((bottom-20)/40::DOUBLE) BETWEEN 1 AND 15 THEN (15-floor((bottom-20)/40::DOUBLE))::BIGINT END AS b FROM (SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_quantity*14 AS top, l_quantity*14+90 AS bottom, l_suppkey%2=0 AND l_linenumber<5 AS fits FROM lineitem))")
def floor_update(spark, d):
    t = table(spark, d, "lineitem").select(c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_partkey").alias("k3"), (c("l_suppkey") % 2).alias("facade"), (c("l_quantity") * 14).alias("top"), (c("l_quantity") * 14 + 90).alias("bottom"), F.when(c("l_linenumber") < 5, 100).otherwise(200).alias("width"))
    setting = spark.createDataFrame([(0, 100, 20.0, 40.0, 15)], "facade long, width int, roof double, pitch double, total int")
    return vw.floors_updated(t, setting, ["width"]).select("k1", "k2", "k3", "floor_min", "floor_max")


@query(with_roles("photos", f"SELECT flight, {r6('m-360*floor(m/360)')} AS mean FROM (SELECT flight, degrees(atan2(avg(sin(radians(yaw))), avg(cos(radians(yaw))))) AS m FROM photos GROUP BY 1)"))
def mean_heading(spark, d):
    return vw.circular_mean(roles.photos(spark, d), "flight", "yaw").select("flight", rounded(c("mean")).alias("mean"))


@query(with_roles("photos", "SELECT flight, sign(covar_pop(i, lon))::INTEGER AS direction FROM (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY image_id) AS i FROM photos) GROUP BY 1"))
def capture_direction(spark, d):
    return vw.capture_direction(roles.photos(spark, d), "flight", "image_id", "lon")


@query(with_roles("boxes", f"SELECT floor(y0/100)::BIGINT AS cy, floor(x0/100)::BIGINT AS cx, {r6('avg(conf)')} AS mean, count(*) AS n FROM boxes GROUP BY 1,2"))
def splat_mean(spark, d):
    return vw.splat_mean(roles.boxes(spark, d), "x0", "y0", "conf", 100.0).select("cy", "cx", rounded(c("mean")).alias("mean"), "n")


@query(with_roles("cracks", f"SELECT k1 AS crack, {r6('avg(width_mm)')} AS width_mm, {r6('avg(length)')} AS length, max(mm_per_px) AS mm_per_px, count(*) AS n FROM cracks GROUP BY 1"))
def observed_mm(spark, d):
    out = vw.observed_mm(roles.cracks(spark, d).withColumnRenamed("k1", "crack"))
    return out.select("crack", rounded(c("width_mm")).alias("width_mm"), rounded(c("length")).alias("length"), "mm_per_px", "n")


@query(f"WITH m AS (SELECT l_suppkey AS g, quantile_cont(l_quantity, 0.5) AS q FROM lineitem GROUP BY 1) SELECT g, count(*) AS n, {r6('avg((abs(l_quantity-q)>20)::INT::DOUBLE)')} AS off, count(*)>=100 AND avg((abs(l_quantity-q)>20)::INT::DOUBLE)<0.2::DOUBLE AS plain FROM lineitem JOIN m ON g=l_suppkey GROUP BY g")
def plain_walls(spark, d):
    t = table(spark, d, "lineitem").select(c("l_suppkey").alias("g"), c("l_quantity").alias("z"))
    return vw.plain_walls(t, "g", "z", relief=20.0, share=0.2, least=100).select("g", "n", rounded(c("off")).alias("off"), "plain")


@query(with_roles("boxes", f"SELECT image_id, {r6('avg(x0)')} AS mx, {r6('covar_pop(x0,x0)')} AS cxx, {r6('covar_pop(x0,y0)')} AS cxy, count(*) AS n FROM boxes GROUP BY 1"))
def plane_moments(spark, d):
    t = roles.boxes(spark, d).select("image_id", c("x0").alias("x"), c("y0").alias("y"), c("w").alias("z"))
    return vw.band_plane(t, "image_id").select("image_id", *(rounded(c(k)).alias(k) for k in ("mx", "cxx", "cxy")), "n")


@query("SELECT c_custkey AS k, c_nationkey AS pool, r<=5 AS runs, CASE WHEN r>5 THEN r-5 END AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)")
def queue_slots(spark, d):
    t = table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_nationkey").alias("pool"), (-c("c_acctbal")).alias("o"))
    return vw.queue_slots(t, "pool", ["o", "k"], 5).drop("o")


@query("SELECT o_custkey AS k, count(*) FILTER (s) AS flagged FROM (SELECT o_custkey, (o_totalprice%1<0.35::DOUBLE) OR (o_orderkey%10)/10.0::DOUBLE<0.7::DOUBLE AS s FROM orders) GROUP BY 1")
def detail_flags(spark, d):
    s = ql.detail_suspected(c("o_totalprice") % 1, (c("o_orderkey") % 10).cast("double"), F.lit(10.0))
    return table(spark, d, "orders").withColumn("s", s).groupBy(c("o_custkey").alias("k")).agg(F.count_if("s").alias("flagged"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey%2=1 OR o_orderkey%4=0 THEN o_orderkey%3=0 ELSE false END AS flag FROM orders")
def flag_reconcile(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("k"))
    suggested = o.withColumn("flag", c("k") % 3 == 0)
    stored = o.filter("k % 2 = 0").select("k", F.lit(False).alias("flag"), (c("k") % 4 == 0).alias("auto_suggested"))
    return ql.reconciled_flags(suggested, stored, "k")


@query("SELECT l_suppkey AS facade, count(*) AS n, max(l_partkey) AS last FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size>25) GROUP BY 1")
def suffix_filter(spark, d):
    t = table(spark, d, "lineitem").select(c("l_suppkey").alias("facade"), lb.crack_number(F.format_string("F%03d_C%06d", "l_suppkey", "l_partkey")).alias("no"))
    gone = table(spark, d, "part").filter("p_size > 25").select(c("p_partkey").alias("no"))
    return t.join(gone, "no", "left_anti").groupBy("facade").agg(F.count("*").alias("n"), F.max("no").alias("last"))


@query("SELECT n_name AS k, CASE n_nationkey%5 WHEN 0 THEN n_name WHEN 1 THEN '정면' WHEN 2 THEN '후면' WHEN 3 THEN '좌측면' ELSE '우측면' END AS face FROM nation")
def face_labels(spark, d):
    m = c("n_nationkey") % 5
    direction = F.element_at(F.array(*map(F.lit, ("x", " front", "BACK", "left ", "RIGHT"))), (m + 1).cast("int"))
    return table(spark, d, "nation").select(c("n_name").alias("k"), st.face_label(F.when(m == 0, c("n_name")), direction).alias("face"))


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey%2=0 INTERSECT SELECT o_custkey FROM orders WHERE o_custkey%3=0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='P'")
def id_sets(spark, d):
    o = table(spark, d, "orders")
    a = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(c("c_custkey").alias("k"))
    return a.intersect(o.filter("o_custkey % 3 = 0").select("o_custkey")).subtract(o.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT count(*) AS files, sum(strlen(html))::BIGINT AS bytes, count(DISTINCT sha256(html)) AS distinct_files FROM pages")
def folder_size(spark, d):
    return table(spark, d, "pages").agg(F.count("*").alias("files"), F.sum(F.octet_length("html")).cast("long").alias("bytes"), F.countDistinct(F.sha2("html", 256)).alias("distinct_files"))


@query(f"WITH p AS (SELECT l_partkey%400 AS p, avg(l_quantity) AS x FROM lineitem GROUP BY 1), m AS (SELECT avg(x) AS m, var_pop(x) AS v FROM p), z AS (SELECT p, x-m AS x, v FROM p, m) SELECT lag, {r6('avg(a.x*b.x)/max(a.v)')} AS corr, count(*) AS n FROM z a, range(5, 40) l(lag), z b WHERE b.p=a.p+lag GROUP BY 1")
def floor_autocorrelation(spark, d):
    t = table(spark, d, "lineitem").groupBy((c("l_partkey") % 400).alias("p")).agg(F.avg("l_quantity").alias("x"))
    return dp.autocorrelation(t, "p", "x", (5, 39)).select("lag", rounded(c("corr")).alias("corr"), "n")


@query(with_roles("boxes", "SELECT floor(x0/20)::BIGINT AS px, floor(y0/20)::BIGINT AS py, max(conf) AS conf, count(*) AS layers FROM boxes GROUP BY 1,2"))
def max_composite(spark, d):
    t = roles.boxes(spark, d).select(F.floor(c("x0") / 20).alias("px"), F.floor(c("y0") / 20).alias("py"), "conf")
    return dp.brightest(t, ["px", "py"], "conf")


@query("SELECT camera, label FROM (SELECT n_name AS camera, n_nationkey+1 AS label FROM nation WHERE n_nationkey<10 UNION ALL SELECT n_name, 10+row_number() OVER (ORDER BY n_name) FROM nation WHERE n_nationkey>=10)")
def owner_index(spark, d):
    n = table(spark, d, "nation")
    return dp.owners_merged(n.filter("n_nationkey < 10").select(c("n_name").alias("camera"), (c("n_nationkey") + 1).alias("label")), n.select(c("n_name").alias("camera")))


@query(with_roles("boxes", "SELECT image_id, sqrt(greatest(0, h+r))>=3 AND sqrt(greatest(0, h-r))<0.9::DOUBLE*sqrt(greatest(0, h+r)) AS collinear FROM (SELECT *, sqrt(greatest(0, h*h-(a*b-k*k))) AS r FROM (SELECT image_id, covar_pop(x0,x0) AS a, covar_pop(y0,y0) AS b, covar_pop(x0,y0) AS k, (covar_pop(x0,x0)+covar_pop(y0,y0))/2 AS h FROM boxes GROUP BY 1))"))
def capture_collinear(spark, d):
    m = vw.band_plane(roles.boxes(spark, d).select("image_id", c("x0").alias("x"), c("y0").alias("y"), c("w").alias("z")), "image_id")
    return ql.collinear(m, ratio=0.9).select("image_id", "collinear")


@query(f"SELECT l_suppkey AS g, count(d) AS n, {r6('CASE WHEN count(d)>=4 THEN quantile_cont(d, 0.25) END')} AS distance FROM (SELECT l_suppkey, CASE WHEN abs(l_discount)>1e-9 THEN 24::DOUBLE*abs(l_quantity)/abs(l_discount) END AS d FROM lineitem) GROUP BY 1")
def wall_distance(spark, d):
    t = table(spark, d, "lineitem").select(c("l_suppkey").alias("g"), c("l_quantity").alias("dx"), c("l_discount").alias("tx"))
    return ql.wall_distance(t, "g", 24.0).select("g", "n", rounded(c("distance")).alias("distance"))
