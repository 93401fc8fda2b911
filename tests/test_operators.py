"""Golden cases, properties and edge cases of the operators that SQL twins don't reach."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from muralis.functions import geo, linalg, polygons
from muralis.graph import connected_components
from muralis.operators import cracks, depth, graphs, report, store
from muralis.sources import readers
from muralis.streaming import status


def test_evaluation_golden(spark):
    box = lambda x0, y0, x1, y1: (float(x0), float(y0), float(x1 - x0), float(y1 - y0))
    schema = "image string, ord long, x0 double, y0 double, w double, h double, width double, tag string"
    truth = spark.createDataFrame([("p", 1, *box(0, 0, 100, 10), 10.0, "bright"), ("p", 2, *box(200, 200, 260, 206), 6.0, "shadow"), ("p", 3, *box(400, 400, 500, 404), 4.0, "shadow")], schema)
    found = spark.createDataFrame([("p", 0, *box(2, 1, 98, 11), 12.0, None), ("p", 1, *box(201, 199, 259, 207), 5.0, None), ("p", 2, *box(1000, 1000, 1050, 1010), 8.0, None), ("p", 3, *box(605, 601, 695, 609), 7.0, None)], schema)
    background = spark.createDataFrame([("p", 0, *box(600, 600, 700, 610), 0.0, None)], schema)
    out = cracks.evaluated(truth, found, background)
    assert sorted(r.outcome for r in out.collect()) == ["CONFOUNDER_FP", "FN", "FP", "TP", "TP"]
    by = {r.tag: r for r in cracks.confusion(out).collect()}
    assert (by["shadow"].tp, by["shadow"].fn, by["shadow"].recall, by["shadow"].width_mae) == (1, 1, 0.5, 1.0)
    assert by["unlabeled"].fp == 2 and by["unlabeled"].recall is None


def test_boxes_apart_whose_gaps_multiply_to_their_areas(spark):
    """The product of the two negative overlaps is the sum of the areas: nothing to divide by, and no pair."""
    schema = "id long, image_id long, x0 double, y0 double, w double, h double, conf double"
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.5), (2, 2, 20.0, 30.0, 10.0, 10.0, 0.6), (3, 1, 1.0, 0.0, 10.0, 10.0, 0.4)], schema)
    assert [(r.a, r.b) for r in cracks.overlapping(boxes, 0.2).collect()] == [(1, 3)]
    assert sorted((r.crack_id, r.n) for r in cracks.merged(boxes).collect()) == [(1, 2), (2, 1)]
    assert cracks.duplicates_across_images(boxes).collect() == []


def test_centres_exactly_at_the_limit(spark):
    """By SQL's order of subtraction these centres, 40 apart, lie a last bit beyond the limit; or, turned round, on it."""
    schema = "id long, image_id long, x0 double, y0 double, w double, h double, conf double"
    a, b = (556.0, 545.7, 36.1, 28.0, 0.5), (588.0, 571.7, 36.1, 24.0, 0.6)
    for first, second in ((a, b), (b, a)):
        centre = math.hypot(*(first[k] + first[k + 2] / 2 - second[k] - second[k + 2] / 2 for k in (0, 1)))
        boxes = spark.createDataFrame([(1, 1, *first), (2, 2, *second)], schema)
        assert len(cracks.duplicates_across_images(boxes).collect()) == (centre <= 40)
    assert centre > 40 or math.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2) > 40


def test_archives_added_where_others_are_already(spark, tmp_path):
    """An archive added a million further on does not replace the stored one that has its number."""
    from muralis.plans import catalog

    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_totalprice double"
    spark.createDataFrame([(k, 1, "O", None, 5.0) for k in (10, 20, 1_000_010)], schema).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, catalog.archive_upsert(spark, str(tmp_path)).collect()))
    assert got == [(10, "active", 5.0), (20, "active", 6.0), (1_000_010, "active", 0.0), (1_000_010, "active", 5.0), (1_000_020, "active", 0.0), (2_000_010, "active", 0.0)]


def test_severity_golden(spark):
    t = spark.createDataFrame([(None, 0.1), (0.5, None), (0.5, 2.6), (0.3, 0.1), (0.29, 0.1)], "w double, r double")
    s, n = cracks.graded(F.col("w"), F.col("r"))
    assert [tuple(x) for x in t.select(s, n).collect()] == [(None, None), (None, "판정불가(해상도부족): 해상도 정보 없음"), (None, "판정불가(해상도부족): 2.60 mm/px > 기준 0.15 mm/px"), ("정밀점검대상", None), ("경미", None)]


def test_floors_and_angles(spark):
    t = spark.createDataFrame([(99.0,), (100.0,), (149.9,), (150.0,), (599.0,), (600.0,)], "r double")
    assert [x[0] for x in t.select(report.floor_number(F.col("r"), F.lit(100.0), F.lit(50.0), F.lit(10))).collect()] == [None, 10, 10, 9, 1, None]
    t = spark.createDataFrame([(350.0, 10.0), (-179.0, 179.0), (None, 5.0)], "a double, b double")
    assert [x[0] for x in t.select(geo.angle_delta(F.col("a"), F.col("b"))).collect()] == [20.0, 2.0, None]


def test_tiles_golden(spark):
    rows = depth.tiles(spark.createDataFrame([(1, 2000, 1000)], "image_id long, width long, height long")).orderBy("x").collect()
    assert [(r.x, r.w) for r in rows] == [(0, 1024), (896, 1024), (1792, 208)] and rows[0].tile_id == "T000000_000000"


def test_utm(spark):
    """Against the older series in powers of the longitude difference."""

    def series(lat, lon):
        a, f = 6378137.0, 1 / 298.257223563
        e2 = f * (2 - f)
        ep2 = e2 / (1 - e2)
        phi = math.radians(lat)
        n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        t, c = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2
        x = math.radians(lon - ((int((lon + 180) / 6)) * 6 - 177)) * math.cos(phi)
        m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))
        east = 0.9996 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * x**5 / 120) + 500_000
        north = 0.9996 * (m + n * math.tan(phi) * (x**2 / 2 + (5 - t + 9 * c + 4 * c**2) * x**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * x**6 / 720))
        return east, north + (10_000_000 if lat < 0 else 0)

    e, n = geo.utm(F.col("lat"), F.col("lon"))
    points = [(37.5, 127.0), (-33.9, 18.4), (60.2, 24.9), (0.1, -75.3)]
    for r in spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", e.alias("e"), n.alias("n")).collect():
        x, y = series(r.lat, r.lon)
        assert abs(r.e - x) < 0.02 and abs(r.n - y) < 0.02


def test_homography_round_trip(spark):
    h = F.array(*map(F.lit, (1.1, 0.02, 5.0, -0.03, 0.9, 7.0, 1e-5, 2e-5, 1.0)))
    t = spark.range(50).select((F.col("id") * 13.0).alias("x"), (F.col("id") * 7.0).alias("y"))
    u, v = linalg.apply(h, F.col("x"), F.col("y"))
    x, y = linalg.apply(linalg.inverse(h), u, v)
    assert t.select(F.max(F.abs(x - F.col("x")) + F.abs(y - F.col("y"))).alias("d")).first().d < 1e-6


def test_polygon_iou_of_boxes():
    random.seed(3)
    for _ in range(200):
        a, b = ((random.uniform(0, 50), random.uniform(0, 50), random.uniform(1, 40), random.uniform(1, 40)) for _ in range(2))
        p, q = (np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]) for x, y, w, h in (a, b))
        inter = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        assert math.isclose(polygons.intersection_area(p, q), inter, abs_tol=1e-7)


def test_skeleton_of_a_bar():
    mask, _, _ = polygons.raster(np.array([(0, 0), (60, 0), (60, 7), (0, 7)], float))
    assert mask.sum() == 420
    skeleton = polygons.thinned(mask)
    assert 48 <= polygons.skeleton_length(skeleton) <= 62
    assert 2 * polygons.edge_distance(mask)[skeleton].max() == pytest.approx(8.0, abs=1.01)


def test_components_match_union_find(spark):
    random.seed(5)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 640)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stable_ids_are_one_to_one(spark):
    rows = [("f", k, 10.0 * k, 0.0, 12.0, 5.0) for k in range(40)]
    old = spark.createDataFrame([(*r, k + 1) for k, r in enumerate(rows[:30])], "facade string, ord long, x0 double, y0 double, w double, h double, crack_no long")
    new = spark.createDataFrame(rows[5:], "facade string, ord long, x0 double, y0 double, w double, h double")
    got = cracks.stable_ids(new, old).collect()
    assert len({r.crack_id for r in got}) == len(got) == 35
    assert {r.ord: r.crack_no for r in got if r.continued} == {k: k + 1 for k in range(5, 30)}
    assert sorted(r.crack_no for r in got if not r.continued) == list(range(31, 41))


def test_shortest_paths_cut_off(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (3, 4, 5.0), (1, 3, 11.0)], "u long, v long, weight double")
    got = {r.node: r.dist for r in graphs.shortest_paths(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0.0, 2: 5.0, 3: 10.0}


def test_report_state_of_nulls(spark):
    stored = spark.createDataFrame([(1, None, "final"), (2, 5, "final")], "k long, generated_at long, state string")
    new = spark.createDataFrame([(1, None, True), (2, 6, True), (3, 7, True)], "k long, generated_at long, fresh boolean")
    assert {r.k: r.state for r in store.report_state(stored, new, "k").collect()} == {1: "final", 2: "draft", 3: "draft"}


def test_status_stream_equals_batch(spark, tmp_path):
    random.seed(7)
    stages = ["FAILED_GEOMETRY", "NEEDS_MANUAL_REVIEW", "DONE", "MATCH_GEOMETRY", None, " "]
    rows = [(f"F{random.randrange(6)}", 1_700_000_000 + k, k, random.choice(stages), float(k) if k % 3 else None) for k in range(200)]
    log = spark.createDataFrame(rows, "facade string, s long, line long, stage string, elapsed double").select("facade", F.timestamp_seconds("s").alias("ts"), "line", "stage", "elapsed")
    for k in range(4):
        log.filter(F.col("line").between(50 * k, 50 * k + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, _):
        seen.update({r.facade: (r.status, r.n, r.last_elapsed) for r in batch.collect()})

    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = status.status_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == {r.facade: (r.status, r.n, r.last_elapsed) for r in status.status_of(log).collect()}


def test_log_stream_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"timestamp":"2024-01-01T00:00:00","level":"INFO","message":"m","stage":"DONE","facade_id":"F1","line":1}\nnot json\n')
    q = status.log_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.message, r.broken) for r in spark.table("lines").collect()} == {("m", None), (None, "not json")}


def test_readers(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1 UTM\n4 wall\n0 0\n0 10\n20 10\n20 0\n")
    ring = readers.footprint(spark, str(tmp_path / "f.txt")).orderBy("ord").collect()
    assert [(r.x, r.y) for r in ring] == [(20.0, 0.0), (20.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    (tmp_path / "bad.txt").write_text("1 WGS84\n")
    with pytest.raises(ValueError):
        readers.footprint(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_bytes(b"\xef\xbb\xbf" + b'{"a": 1}')
    (tmp_path / "j/b.json").write_text('{"a": ')
    assert sorted(((r.document.a if r.document else None) for r in readers.json_documents(spark, str(tmp_path / "j"), "a int").collect()), key=str) == [1, None]
    z = np.array([[0, 2.5], [1.5, 0]], "<f4")
    files = spark.createDataFrame([("d", bytearray(b"2&2&1&" + z.tobytes()))], "path string, content binary")
    assert {(r.v, r.u, r.z) for r in readers.depth_samples(files).collect()} == {(0, 1, 2.5), (1, 0, 1.5)}
    ply = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    assert readers.point_cloud(spark.createDataFrame([("p", bytearray(ply))], "path string, content binary")).count() == 2
    packet = b'xx<x:xmpmeta xmlns:x="a"><r xmlns:d="b" d:GpsLatitude="37.5" d:GpsLongtitude="127.0"/></x:xmpmeta>yy'
    t = spark.createDataFrame([(bytearray(packet),), (bytearray(b"<x:xmpmeta"),)], "content binary").select(readers.location(readers.xmp(F.col("content"))).alias("g"))
    assert [(r.g.lat, r.g.lon) for r in t.collect()] == [(37.5, 127.0), (None, None)]


def _stitch(spark):
    from muralis.plans import roles

    return roles.stitch(spark, "/root/testdata/sf0.001")


def test_paths_and_tree_over_all_edges(spark):
    """Against Dijkstra and a breadth-first search of the whole stitch graph, and on a chain longer than any fixed number of rounds."""
    import heapq
    from collections import defaultdict

    edges = _stitch(spark)
    rows = edges.collect()
    near = defaultdict(list)
    for r in rows:
        near[r.u].append((r.v, r.weight))
        near[r.v].append((r.u, r.weight))
    source = max(near, key=lambda k: (len(near[k]), k))
    start = graphs.reference_node(edges)
    assert start.first().node == source
    best, heap = {}, [(0.0, source)]
    while heap:
        dist, node = heapq.heappop(heap)
        if node in best or dist > 12.0:
            continue
        best[node] = dist
        for other, weight in near[node]:
            heapq.heappush(heap, (dist + weight, other))
    got = {r.node: r.dist for r in graphs.shortest_paths(edges, start.select("node")).collect()}
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-9 for k in best)
    hops, level = {source: 0}, [source]
    while level:
        level = sorted({o for n in level for o, _ in near[n]} - hops.keys())
        hops.update((o, 1 + min(hops[x] for x, _ in near[o] if x in hops)) for o in level)
    tree = graphs.breadth_first_tree(edges, start.select("node"))
    found = {r.node: (r.hops, r.parent) for r in tree.collect()}
    assert {k: h for k, (h, _) in found.items()} == hops
    assert all(p == min(o for o, _ in near[k] if hops.get(o) == h - 1) for k, (h, p) in found.items() if h)
    used = {(min(k, p), max(k, p)) for k, (_, p) in found.items() if p is not None}
    cycle = {(r.u, r.v) for r in graphs.cycle_edges(edges, tree).collect()}
    assert cycle == {(r.u, r.v) for r in rows if r.u in hops and r.v in hops} - used


def test_triangles(spark):
    rows = [(a, b, a * 100 + b) for a in range(12) for b in range(a + 1, 12) if (a * b) % 3 != 1]
    edges = spark.createDataFrame(rows, "u long, v long, tx long").withColumn("weight", F.lit(1.0))
    known = {(a, b) for a, b, _ in rows}
    wanted = sorted((a, b, w, a * 100 + b, b * 100 + w, a * 100 + w) for a, b in known for w in range(12) if (b, w) in known and (a, w) in known)
    assert sorted(tuple(r) for r in graphs.triangles(edges, "tx").select("u", "v", "w", "uv_tx", "vw_tx", "uw_tx").collect()) == wanted


def test_transforms_along_the_tree(spark):
    from muralis.operators import canvas

    rng = random.Random(3)
    h = {k: np.eye(3) + np.array([[rng.uniform(-0.2, 0.2) for _ in range(3)] for _ in range(3)]) for k in range(4)}
    edges = [(0, 1), (2, 1), (2, 3), (1, 4)]  # the second one goes against the tree
    wanted = {0: np.eye(3)}
    wanted[1] = wanted[0] @ np.linalg.inv(h[0])
    wanted[2] = wanted[1] @ h[1]
    wanted[3] = wanted[2] @ np.linalg.inv(h[2])
    wanted[4] = wanted[1] @ np.linalg.inv(h[3])
    table = spark.createDataFrame([(a, b, h[k].ravel().tolist()) for k, (a, b) in enumerate(edges)], "a long, b long, h array<double>")
    tree = spark.createDataFrame([(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 1, 2)], "node long, parent long, hops int")
    got = {r.node: np.array(r.h).reshape(3, 3) for r in canvas.composed_transforms(table, tree).collect()}
    assert got.keys() == wanted.keys() and all(np.allclose(got[k], wanted[k]) for k in got)


def test_segments_are_merged_across_batches(spark):
    """Rings are read row by row, not a group at a time, and a run goes on in the next batch."""
    from muralis.operators import facades

    rows = [(b, r, o, float(o), 0.0, float(o + 1), 0.0, 0.0 if o < 7 else 90.0) for b in (1, 2) for r in range(3) for o in range(10)]
    edges = spark.createDataFrame(rows, "building long, ring long, ord int, x0 double, y0 double, x1 double, y1 double, normal double")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 4)
    try:
        merged = facades.merged_segments(edges, min_length=1.0)
        assert "FlatMapGroups" not in merged._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.building, r.facade_id, r.ring, r.ord, r.x0, r.x1) for r in merged.collect())
    finally:
        spark.conf.set(setting, before)
    assert got == [(b, f"F{2 * r + k + 1:03d}", r, o, float(o), float(o + n)) for b in (1, 2) for r in range(3) for k, (o, n) in enumerate(((0, 7), (7, 3)))]
