"""Lenses, positions, renders, template matches and photo metadata against numpy and golden bytes."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from muralis.functions import lens
from muralis.operators import positions as ps
from muralis.sources import exif

CAMERA = (900.0, 880.0, 500.0, 400.0, -0.05, 0.01)


def test_lens_round_trip_and_projection(spark):
    rng = np.random.default_rng(1)
    rows = [(k, *map(float, rng.uniform((0, 0), (1000, 800)))) for k in range(200)]
    cam = lens.camera(F.lit("RADIAL"), F.array(*map(F.lit, (900.0, 500.0, 400.0, -0.05, 0.01))))
    df = spark.createDataFrame(rows, "id long, x double, y double").withColumn("u", lens.undistorted(F.col("x"), F.col("y"), cam))
    back = df.withColumn("p", lens.distorted(F.col("u.x"), F.col("u.y"), cam)).select(F.max(F.hypot(F.col("p.x") - F.col("x"), F.col("p.y") - F.col("y"))).alias("off")).first()
    assert back.off < 1e-6
    assert spark.range(1).select(lens.camera(F.lit("FISHEYE"), F.array(F.lit(1.0))).isNull().alias("n")).first().n
    # A wall at z = 10 of an upright camera; frame and plane trivial: depth and ray agree, and projection leads back.
    eye = F.array(*(F.lit(float(k % 4 == 0)) for k in range(9)))
    zero = F.array(*(F.lit(0.0) for _ in range(3)))
    pose, frame = F.struct(eye.alias("r"), zero.alias("t")), F.struct(F.lit(2.0).alias("s"), eye.alias("r"), zero.alias("t"))
    vec = lambda *v: F.array(*map(F.lit, v))
    plane = F.struct(vec(0.0, 0.0, 20.0).alias("o"), vec(1.0, 0.0, 0.0).alias("u"), vec(0.0, 1.0, 0.0).alias("v"))
    by_depth = lens.canvas_by_depth(F.col("x"), F.col("y"), F.lit(10.0), cam, pose, frame, plane, F.lit(50.0))
    on_plane = lens.canvas_on_plane(F.col("x"), F.col("y"), cam, pose, frame, plane, F.lit(50.0))
    far = lens.canvas_by_depth(F.col("x"), F.col("y"), F.lit(12.0), cam, pose, frame, plane, F.lit(50.0))
    point = [F.col("d.x") / 50.0, F.col("d.y") / 50.0, F.lit(20.0)]
    got = df.withColumn("d", by_depth).withColumn("r", on_plane).withColumn("far", far).withColumn("q", lens.projected(point, cam, pose, frame)).collect()
    for r in got:
        assert abs(r.d.x - r.r.x) < 1e-9 and abs(r.d.y - r.r.y) < 1e-9 and r.far is None
        assert abs(r.q.x - r.x) < 1e-6 and abs(r.q.y - r.y) < 1e-6 and abs(r.q.z - 10) < 1e-9
    behind = spark.range(1).select(lens.projected([F.lit(0.0), F.lit(0.0), F.lit(-4.0)], cam, pose, frame).alias("q")).first().q
    assert behind.x is None and behind.z == -2


def test_clicks_are_located(spark):
    h = np.array([[700.0, 20.0, 300.0], [-15.0, 650.0, 250.0], [0.01, -0.02, 1.0]]).reshape(-1)
    rng = np.random.default_rng(3)
    context = np.repeat(np.concatenate([CAMERA, h])[None], 50, axis=0)
    truth = rng.uniform((100, 100), (900, 700), (50, 2))
    clicks, _ = ps.by_camera(context, truth)
    rows = [(k, *map(float, clicks[k]), *map(float, truth[k] + rng.uniform(-150, 150, 2)), list(CAMERA), h.tolist()) for k in range(50)]
    rows.append((99, 1e9, 1e9, 500.0, 400.0, list(CAMERA), [0.0] * 9))
    got = {r.id: r for r in ps.located(spark.createDataFrame(rows, "id long, cx double, cy double, x0 double, y0 double, camera array<double>, h array<double>")).collect()}
    assert got[99].x is None and got[99].residual is None
    for k in range(50):
        assert got[k].residual < 1.0 and np.hypot(got[k].x - truth[k, 0], got[k].y - truth[k, 1]) < 2.5


def test_correlations_equal_plain_sums():
    rng = np.random.default_rng(5)
    search, template = rng.normal(size=(21, 18)), rng.normal(size=(7, 5))
    got = ps.correlations(search, template)
    for b in range(15):
        for a in range(14):
            w = search[b : b + 7, a : a + 5]
            assert abs(got[b, a] - np.corrcoef(w.reshape(-1), template.reshape(-1))[0, 1]) < 1e-9
    assert (ps.correlations(np.ones((9, 9)), template) == 0).all()


def test_planted_offsets_are_found(spark):
    rng = np.random.default_rng(6)
    canvas = rng.uniform(0, 255, (90, 120))
    canvas = (canvas + np.roll(canvas, 1, 0) + np.roll(canvas, 1, 1) + np.roll(canvas, -1, 0) + np.roll(canvas, -1, 1)) / 5
    cells = [(x, y, float(canvas[y, x])) for y in range(90) for x in range(120)]
    checks, photo, planted = [], [], {}
    for k, (cx, cy, dx, dy) in enumerate([(40, 40, 2, -3), (70, 50, 0, 0), (60, 30, -4, 1), (3, 3, 0, 0), (50, 50, 0, 0), (80, 40, 0, 0)]):
        checks.append((k, cx, cy))
        planted[k] = (dx, dy)
        for j in range(-8, 9):
            for i in range(-8, 9):
                if k == 5 and i > -4:  # covers too little
                    continue
                value = 7.0 if k == 4 else float(canvas[(cy + j + dy) % 90, (cx + i + dx) % 120])  # flat
                photo += [(k, cx + i + 0.2, cy + j - 0.3, value - 1), (k, float(cx + i), float(cy + j), value + 1)]
    found = ps.position_offsets(spark.createDataFrame(checks, "id int, cx int, cy int"), spark.createDataFrame(photo, "id int, x double, y double, value double"), spark.createDataFrame(cells, "x int, y int, value double"), radius=8, reach=6)
    got = {r.id: r for r in found.collect()}
    for k in (0, 1, 2):
        assert abs(got[k].dx - planted[k][0]) < 0.5 and abs(got[k].dy - planted[k][1]) < 0.5 and got[k].ncc > 0.99
    assert all(got[k].dx is None for k in (3, 4, 5)) and len(got) == 6


def test_rendered_points(spark):
    rng = np.random.default_rng(8)
    rows = [(*map(float, rng.uniform((-1, -1), (8, 6))), float(rng.uniform(-4, 4)), float(k)) for k in range(300)]
    got = {(r.y, r.x): (r.off, r.value) for r in ps.rendered(spark.createDataFrame(rows, "u double, v double, off double, value double"), 70, 50, 10.0, "value", margin=0.5).collect()}
    near = [r for r in rows if abs(r[2]) <= 3]
    lo, hi = min(r[0] for r in near), max(r[0] for r in near)
    expected = {}
    for u, v, off, value in near:
        x, y = int(u * 10), int(v * 10)
        if lo + 0.5 < u < hi - 0.5 and 0 <= x < 70 and 0 <= y < 50:
            for j in range(max(0, y - 2), min(50, y + 3)):
                for i in range(max(0, x - 2), min(70, x + 3)):
                    expected[j, i] = max(expected.get((j, i), (-9.0, 0.0)), (off, value))
    assert got == expected


def tiff(order, entries, camera=(), gps=()):
    """A TIFF header with three directories; entries are (tag, kind, count, bytes)."""
    end = "<" if order == "II" else ">"
    head = order.encode() + struct.pack(f"{end}HI", 42, 8)
    at, blocks = 8, []

    def place(rows, leads):
        nonlocal at
        size = 2 + 12 * (len(rows) + len(leads)) + 4
        data_at = at + size
        body, data = struct.pack(f"{end}H", len(rows) + len(leads)), b""
        for tag, kind, count, raw in rows:
            body += struct.pack(f"{end}HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{end}I", data_at + len(data)))
            data += raw if len(raw) > 4 else b""
        return body, data, size

    _, data, size = place(entries, [1, 2])
    first_end = at + size + len(data)
    at_camera = first_end
    at, kept = at_camera, at
    camera_body, camera_data, camera_size = place(camera, [])
    at_gps = at_camera + camera_size + len(camera_data)
    at = at_gps
    gps_body, gps_data, _ = place(gps, [])
    at = kept
    body, data, size = place(entries, [1, 2])
    body += struct.pack(f"{end}HHII", 0x8769, 4, 1, at_camera) + struct.pack(f"{end}HHII", 0x8825, 4, 1, at_gps) + b"\0" * 4
    blocks = [head, body, data, camera_body + b"\0" * 4, camera_data, gps_body + b"\0" * 4, gps_data]
    return b"".join(blocks)


def photo(order="II"):
    end = "<" if order == "II" else ">"
    fraction = lambda *v: struct.pack(f"{end}{2 * len(v)}I", *(x for a, b in v for x in (a, b)))
    return tiff(
        order,
        [(0x010F, 2, 4, b"DJI\0"), (0x0110, 2, 8, b"L2D-20c\0"), (0x0132, 2, 20, b"2025:09:01 10:20:30\0")],
        [(0x9003, 2, 20, b"2025:09:02 11:21:31\0"), (0x920A, 5, 1, fraction((1229, 100))), (0xA405, 3, 1, struct.pack(f"{end}H", 24))],
        [(1, 2, 2, b"S\0"), (2, 5, 3, fraction((37, 1), (30, 1), (36, 10))), (3, 2, 2, b"E\0"), (4, 5, 3, fraction((127, 1), (0, 1), (180, 10))), (6, 5, 1, fraction((555, 10)))],
    )


def jpeg(exif_bytes, xmp=b""):
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + exif_bytes) + segment(0xC0, struct.pack(">BHHB", 8, 3956, 5280, 3)) + b"\xff\xda" + xmp


@pytest.mark.parametrize("order", ["II", "MM"])
def test_exif_of_golden_bytes(order):
    tags = exif.jpeg_tags(jpeg(photo(order)))
    assert tags == {"Make": "DJI", "Model": "L2D-20c", "DateTime": "2025:09:01 10:20:30", "DateTimeOriginal": "2025:09:02 11:21:31", "FocalLength": "12.29", "FocalLengthIn35mmFilm": "24", "GPSLatitudeRef": "S", "GPSLatitude": "37.0 30.0 3.6", "GPSLongitudeRef": "E", "GPSLongitude": "127.0 0.0 18.0", "GPSAltitude": "55.5", "Width": "5280", "Height": "3956"}
    assert exif.tiff_tags(b"") == exif.tiff_tags(b"II*\0") == exif.jpeg_tags(b"\xff\xd8\xff") == {}
    whole = photo(order)
    for cut in range(0, len(whole), 7):  # damaged files give what is whole
        assert set(exif.tiff_tags(whole[:cut]).items()) <= set(tags.items())


def test_photo_metadata_merges_and_flattens(spark):
    packet = b'<x:xmpmeta xmlns:x="a" xmlns:d="b"><d:r d:GpsLatitude="37.25" d:GpsLongtitude="127.5" d:AbsoluteAltitude="+81.5" d:GimbalYawDegree="-12.5" d:Model="M3E"/></x:xmpmeta>'
    rows = [("file:/a/flight7/DJI_0001.JPG", jpeg(photo(), packet)), ("file:/a/flight7/DJI_0002.JPG", jpeg(photo())), ("x.jpg", None)]
    flat = exif.flattened(exif.photo_metadata(spark.createDataFrame(rows, "path string, content binary")))
    assert flat.columns[:4] == ["image_id", "file_path", "timestamp", "drone_model"] and "gps.latitude" in flat.columns and "camera.focal_length_mm" in flat.columns
    a, b, none = sorted((r.asDict() for r in flat.collect()), key=lambda r: r["file_path"])
    assert (a["gps.latitude"], a["gps.longitude"], a["gps.altitude_m"], a["camera_model"], a["drone_model"], a["gimbal_pose.yaw_deg"]) == (37.25, 127.5, 81.5, "M3E", "DJI", -12.5)
    assert abs(b["gps.latitude"] + 37.501) < 1e-9 and abs(b["gps.longitude"] - 127.005) < 1e-9 and b["gps.altitude_m"] == 55.5
    assert b["timestamp"] == "2025-09-02T11:21:31" and b["image_id"] == "DJI_0002" and b["mission.flight_id"] == "flight7" and (b["width"], b["height"]) == (5280, 3956)
    assert none["gps.latitude"] is None and none["image_id"] == "x" and none["mission.flight_id"] is None


def test_position_offsets_broadcasts_no_windows(spark):
    """The cells of all windows are far more than the suppliers' file tells: none of them may go through the driver."""
    from muralis.plans import catalog_positions

    plan = catalog_positions.position_offsets(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in plan]
    for k, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = next((m for m in range(k + 1, len(plan)) if depth[m] <= depth[k]), len(plan))
            assert not any("Generate" in x and "FLOOR" not in x for x in plan[k:below]), plan
