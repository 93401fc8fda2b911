"""Cameras with radial distortion, and the ways between photo, ray, wall and canvas, as column expressions.

A camera is struct<fx, fy, cx, cy, k1, k2>; a pose struct<r: array of nine, t: array of three> takes the native frame to the camera's; a frame
struct<s, r, t> takes the native frame to metres; a plane struct<o, u, v> has its origin and two unit axes there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounds of the inversion, half the band of canvas points around the wall (m).
ROUNDS, WALL_BAND_M = 12, 3.0

# Places of fx, fy, cx, cy, k1, k2 among the parameters of a camera model.
MODELS = {
    "SIMPLE_PINHOLE": (0, 0, 1, 2, None, None),
    "PINHOLE": (0, 1, 2, 3, None, None),
    "SIMPLE_RADIAL": (0, 0, 1, 2, 3, None),
    "SIMPLE_RADIAL_FISHEYE": (0, 0, 1, 2, 3, None),
    "RADIAL": (0, 0, 1, 2, 3, 4),
}


def camera(model: Column, params: Column) -> Column:
    """The camera of a model and its parameters; null for a model that is not known."""
    out = F
    for name, places in MODELS.items():
        cells = [F.lit(0.0) if k is None else params[k] for k in places]
        out = out.when(model == name, F.struct(*(c.cast("double").alias(n) for c, n in zip(cells, ("fx", "fy", "cx", "cy", "k1", "k2"), strict=True))))
    return out.otherwise(F.lit(None))


def _factor(x: Column, y: Column, cam: Column) -> Column:
    r2 = x * x + y * y
    return 1.0 + cam["k1"] * r2 + cam["k2"] * r2 * r2


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def undistorted(x: Column, y: Column, cam: Column) -> Column:
    """struct<x, y>: the ray (x, y, 1) of a photo's pixel, by a fixed number of rounds of the distortion's inversion."""
    xd, yd = (x - cam["cx"]) / cam["fx"], (y - cam["cy"]) / cam["fy"]

    def step(s: Column, _: Column) -> Column:
        f = _factor(s["x"], s["y"], cam)
        return _xy(xd / f, yd / f)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), _xy(xd, yd), step)


def distorted(x: Column, y: Column, cam: Column) -> Column:
    """struct<x, y>: the pixel of a ray (x, y, 1)."""
    f = _factor(x, y, cam)
    return _xy(cam["fx"] * x * f + cam["cx"], cam["fy"] * y * f + cam["cy"])


def times(r: Column, v: list[Column]) -> list[Column]:
    """A 3x3 matrix times a vector."""
    return [r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3)]


def turned_back(r: Column, v: list[Column]) -> list[Column]:
    """The transposed 3x3 matrix times a vector."""
    return [r[i] * v[0] + r[3 + i] * v[1] + r[6 + i] * v[2] for i in range(3)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def vector(column: Column) -> list[Column]:
    return [column[k] for k in range(3)]


def normal(plane: Column) -> list[Column]:
    u, v = vector(plane["u"]), vector(plane["v"])
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(dot(n, n))
    return [x / size for x in n]


def in_metres(native: list[Column], frame: Column) -> list[Column]:
    return [frame["s"] * x + frame["t"][k] for k, x in enumerate(times(frame["r"], native))]


def _on_canvas(point: list[Column], plane: Column, px_per_m: Column) -> tuple[Column, Column]:
    """The canvas pixel of a point, and its distance from the plane."""
    off = [x - plane["o"][k] for k, x in enumerate(point)]
    return _xy(dot(off, vector(plane["u"])) * px_per_m, dot(off, vector(plane["v"])) * px_per_m), dot(off, normal(plane))


def canvas_by_depth(x: Column, y: Column, depth: Column, cam: Column, pose: Column, frame: Column, plane: Column, px_per_m: Column, band: float = WALL_BAND_M) -> Column:
    """struct<x, y>: the canvas pixel of a photo's pixel at a depth; null without a depth, or farther than the band from the wall."""
    ray = undistorted(x, y, cam)
    at = [ray["x"] * depth, ray["y"] * depth, depth]
    world = turned_back(pose["r"], [a - pose["t"][k] for k, a in enumerate(at)])
    cell, off = _on_canvas(in_metres(world, frame), plane, px_per_m)
    return F.when((depth > 0) & (F.abs(off) <= band), cell)


def canvas_on_plane(x: Column, y: Column, cam: Column, pose: Column, frame: Column, plane: Column, px_per_m: Column) -> Column:
    """struct<x, y>: where a pixel's ray meets the plane, without any depth; null if it runs along the plane."""
    ray = undistorted(x, y, cam)
    centre = in_metres([-c for c in turned_back(pose["r"], vector(pose["t"]))], frame)
    along = times(frame["r"], turned_back(pose["r"], [ray["x"], ray["y"], F.lit(1.0)]))
    n = normal(plane)
    reach = dot([plane["o"][k] - c for k, c in enumerate(centre)], n) / F.nullif(dot(along, n), F.lit(0.0))
    cell, _ = _on_canvas([c + reach * a for c, a in zip(centre, along, strict=True)], plane, px_per_m)
    return F.when(reach.isNotNull(), cell)


def projected(point: list[Column], cam: Column, pose: Column, frame: Column) -> Column:
    """struct<x, y, z>: the pixel of a point in metres and its depth; x and y are null behind the camera."""
    native = [x / frame["s"] for x in turned_back(frame["r"], [p - frame["t"][k] for k, p in enumerate(point)])]
    at = [x + pose["t"][k] for k, x in enumerate(times(pose["r"], native))]
    front = at[2] > 1e-6
    cell = distorted(at[0] / at[2], at[1] / at[2], cam)
    return F.struct(F.when(front, cell["x"]).alias("x"), F.when(front, cell["y"]).alias("y"), at[2].alias("z"))
