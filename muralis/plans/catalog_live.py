"""Queries of running faces, assignments and replaced children."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from muralis.functions.geo import rounded
from muralis.operators import children as ch
from muralis.plans import roles
from muralis.plans.catalog import c, query, r6
from muralis.plans.roles import with_roles
from muralis.storage import shared_dir, table
from muralis.streaming import faces as fa
from muralis.streaming import status as ss

_LAST = "arg_max({0}, {{'ts':ts,'line':line}}) FILTER ({0} IS NOT NULL{1})"


def _last(field: str, also: str = "") -> str:
    return _LAST.format(field, also)


@query(with_roles("log", "SELECT facade, CASE WHEN done IS NOT NULL AND (other IS NULL OR done>other) AND last IS DISTINCT FROM 'NEEDS_MANUAL_REVIEW' THEN 'Done' WHEN last='FAILED_GEOMETRY' THEN 'Failed' WHEN last='NEEDS_MANUAL_REVIEW' THEN 'NeedsReview' WHEN last IS NOT NULL THEN 'InProgress' END AS status, n, image_count, "
    f"{r6('coverage')} AS coverage, {r6('drift')} AS drift, needs_fallback, requested, registered, {r6('mean_error')} AS mean_error, preview FROM (SELECT facade, max({{'ts':ts,'line':line}}) FILTER (st='DONE') AS done, max({{'ts':ts,'line':line}}) FILTER (st<>'DONE') AS other, arg_max(st, {{'ts':ts,'line':line}}) FILTER (st<>'DONE') AS last, count(*) AS n, "
    + ", ".join(f"{_last(f, also)} AS {f}" for f, also in {**dict.fromkeys(fa.FIELDS, ""), "preview": " AND st='PREVIEW_UPDATED'"}.items())
    + " FROM (SELECT facade, ts, line, CASE WHEN line%6=0 THEN 'PREVIEW_UPDATED' ELSE stage END AS st, CASE WHEN line%3=0 THEN line%100 END AS image_count, CASE WHEN line%4=0 THEN elapsed/100 END AS coverage, CASE WHEN line%5=0 THEN elapsed*2 END AS drift, CASE WHEN line%7=0 THEN line%2=0 END AS needs_fallback, CASE WHEN line%8=0 THEN line END AS requested, CASE WHEN line%16=0 THEN line-1 END AS registered, CASE WHEN line%9=0 THEN elapsed/50 END AS mean_error, CASE WHEN line%4<>0 THEN 'p'||line END AS preview FROM log) GROUP BY facade)"))
def face_fields(spark, d):
    """Status and the last known value of eight fields of every face, from the log."""
    k, e = c("line"), c("elapsed")
    fields = (F.when(k % 3 == 0, k % 100), F.when(k % 4 == 0, e / 100), F.when(k % 5 == 0, e * 2), F.when(k % 7 == 0, k % 2 == 0), F.when(k % 8 == 0, k), F.when(k % 16 == 0, k - 1), F.when(k % 9 == 0, e / 50), F.when(k % 4 != 0, F.concat(F.lit("p"), k)))
    log = roles.log(spark, d).withColumn("stage", F.when(k % 6 == 0, fa.PREVIEW).otherwise(c("stage"))).select("facade", "ts", "line", "stage", *(x.alias(f) for f, x in zip(fa.FIELDS, fields, strict=True)))
    known = fa.faces_of(log)
    return known.select("facade", "status", "n", *(rounded(c(f)).alias(f) if kind == "double" else c(f) for f, kind in fa.FIELDS.items()))


@query("SELECT o_custkey AS archive_id, arg_min(o_orderkey, {'d':o_orderdate,'k':o_orderkey}) AS job, min(o_orderdate) AS assigned_on FROM orders GROUP BY 1")
def assigned_once(spark, d):
    """The first job of every archive; later ones are not assigned."""
    jobs = table(spark, d, "orders").select(c("o_custkey").alias("archive_id"), c("o_orderkey").alias("job"), c("o_orderdate").alias("assigned_on"))
    return ss.assigned_once(jobs, ["assigned_on", "job"])


@query("SELECT l_suppkey%12 AS facade, l_orderkey AS k1, l_linenumber AS k2, l_extendedprice+CASE WHEN l_suppkey%12 IN (0,3,9) THEN 1 ELSE 0 END AS length FROM lineitem WHERE l_suppkey%12 NOT IN (0,3,6,9) OR (l_suppkey%12<>6 AND l_linenumber<=2)")
def children_replaced(spark, d):
    """Cracks stored by face; then four faces come anew, one of them without any."""
    k1, k2 = c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2")
    t = table(spark, d, "lineitem").select((c("l_suppkey") % 12).alias("facade"), k1, k2, c("l_extendedprice").alias("length"))
    faces = t.select("facade").distinct()
    path = f"{shared_dir(spark)}/children-{uuid.uuid4().hex}"
    ch.replace_children(t, faces, path, "facade")
    anew = faces.filter("facade % 3 = 0")
    ch.replace_children(t.filter("facade in (0, 3, 9) and k2 <= 2").withColumn("length", c("length") + 1), anew, path, "facade")
    return ch.stored_children(spark, path, t.schema)
