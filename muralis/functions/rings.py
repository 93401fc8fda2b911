"""Unions and repairs of polygons: rings are cut at all their crossings, and the pieces with the inside on one side only are
joined to rings again.

A shape is a list of rings, outer ones anticlockwise and holes clockwise. Coordinates are snapped to a millionth.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ring = np.ndarray

#: Digits that coordinates keep, and how far beside a piece its side is looked at.
DIGITS, BESIDE = 6, 2e-6
#: Points held by a task before it hands its partial unions on.
HELD = 200_000


def signed_area(ring: Ring) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def area(rings: Iterable[Ring]) -> float:
    return sum(map(signed_area, rings))


def _pieces(rings: list[Ring]) -> np.ndarray:
    """(a, b) of the rings' edges, cut wherever another edge crosses, touches or runs along them."""
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    keep = (a != b).any(axis=1)
    a, b = a[keep], b[keep]
    low, high = np.minimum(a, b), np.maximum(a, b)
    out = []
    for i in range(len(a)):
        near = np.flatnonzero((low[:, 0] <= high[i, 0] + 1e-6) & (high[:, 0] >= low[i, 0] - 1e-6) & (low[:, 1] <= high[i, 1] + 1e-6) & (high[:, 1] >= low[i, 1] - 1e-6))
        near = near[near != i]
        along = b[i] - a[i]
        length = float(along @ along)
        r, s = along, b[near] - a[near]
        det = r[0] * s[:, 1] - r[1] * s[:, 0]
        w = a[near] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * s[:, 1] - w[:, 1] * s[:, 0]) / det
            u = (w[:, 0] * r[1] - w[:, 1] * r[0]) / det
        hit = (np.abs(det) > 1e-12) & (t > 0) & (t < 1) & (u >= -1e-9) & (u <= 1 + 1e-9)
        # The same point for either edge of a crossing: from the one with the smaller number.
        first = near > i
        other = a[near] + u[:, None] * s
        points = [np.where(first[:, None], a[i] + t[:, None] * r, other)[hit]]
        ends = np.concatenate([a[near], b[near]])
        off = ends - a[i]
        place = off @ along / length
        beside = np.abs(off[:, 0] * along[1] - off[:, 1] * along[0]) / np.sqrt(length)
        points.append(ends[(beside <= 1e-6) & (place > 0) & (place < 1)])
        cuts = np.round(np.concatenate(points), DIGITS)
        cuts = cuts[np.argsort((cuts - a[i]) @ along, kind="stable")]
        chain = np.concatenate([a[i : i + 1], cuts, b[i : i + 1]])
        chain = chain[np.concatenate([[True], (np.diff(chain, axis=0) != 0).any(axis=1)])]
        out.append(np.stack([chain[:-1], chain[1:]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2, 2))


def _winding(points: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """How often the pieces go round each point, anticlockwise."""
    out = np.zeros(len(points), int)
    a, b = pieces[:, 0], pieces[:, 1]
    for at in range(0, len(points), 512):
        x, y = points[at : at + 512, 0, None], points[at : at + 512, 1, None]
        up, down = (a[:, 1] <= y) & (b[:, 1] > y), (a[:, 1] > y) & (b[:, 1] <= y)
        left = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (x - a[:, 0]) * (b[:, 1] - a[:, 1])
        out[at : at + 512] = (up & (left > 0)).sum(axis=1) - (down & (left < 0)).sum(axis=1)
    return out


def arranged(rings: list[Ring], inside: Callable[[np.ndarray], np.ndarray]) -> list[Ring]:
    """The boundary of where ``inside(winding number)`` holds."""
    rings = [np.round(r, DIGITS) for r in rings if len(r) >= 3]
    if not rings:
        return []
    pieces = _pieces(rings)
    turned = (pieces[:, 0, 0] > pieces[:, 1, 0]) | ((pieces[:, 0, 0] == pieces[:, 1, 0]) & (pieces[:, 0, 1] > pieces[:, 1, 1]))
    one_way = np.where(turned[:, None, None], pieces[:, ::-1], pieces)
    unique, which = np.unique(one_way.reshape(-1, 4), axis=0, return_inverse=True)
    net = np.bincount(which.reshape(-1), np.where(turned, -1, 1), len(unique)).astype(int)
    a, b = unique[:, :2], unique[:, 2:]
    along = b - a
    beside = np.stack([-along[:, 1], along[:, 0]], axis=1) / np.linalg.norm(along, axis=1)[:, None]
    left = _winding((a + b) / 2 + BESIDE * beside, pieces)
    is_left, is_right = inside(left), inside(left - net)
    out: dict[tuple[float, float], list[tuple[float, float]]] = defaultdict(list)
    for p, q in [*zip(a[is_left & ~is_right].tolist(), b[is_left & ~is_right].tolist()), *zip(b[is_right & ~is_left].tolist(), a[is_right & ~is_left].tolist())]:
        out[tuple(p)].append(tuple(q))
    found = []
    while out:
        start = next(iter(out))
        chain, here = [start], out[start].pop()
        if not out[start]:
            del out[start]
        while here != start and here in out:
            before, ways = chain[-1], out[here]
            # The leftmost turn keeps shapes that touch in a point apart.
            back = np.arctan2(before[1] - here[1], before[0] - here[0])
            turn = [(back - np.arctan2(w[1] - here[1], w[0] - here[0])) % (2 * np.pi) or 2 * np.pi for w in ways]
            k = int(np.argmin(turn))
            chain.append(here)
            here = ways.pop(k)
            if not ways:
                del out[chain[-1]]
        ring = _straightened(np.array(chain))
        if len(ring) >= 3 and abs(signed_area(ring)) > 1e-9:
            found.append(ring)
    return found


def _straightened(ring: Ring) -> Ring:
    """Without the points on a straight line between their neighbours."""
    before, after = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
    d, e = ring - before, after - ring
    bent = np.abs(d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]) > 1e-6 * np.maximum(1.0, np.linalg.norm(d, axis=1) * np.linalg.norm(e, axis=1)) * 1e-3
    return ring[bent]


def parts(rings: list[Ring]) -> list[list[Ring]]:
    """The rings as polygons: an outer ring with its holes each, the largest first."""
    outer = sorted((r for r in rings if signed_area(r) > 0), key=signed_area)
    found = [[r] for r in outer]
    for hole in rings:
        if signed_area(hole) < 0:
            # A point just inside of the hole's first edge; the smallest outer ring around it is its own.
            p = (hole[0] + hole[1]) / 2
            for shape in found:
                r = shape[0]
                if _winding(p[None], np.stack([r, np.roll(r, -1, axis=0)], axis=1))[0] or any(np.allclose(p, x) for x in r):
                    shape.append(hole)
                    break
    return sorted(found, key=area, reverse=True)


def turns(p: np.ndarray) -> np.ndarray:
    """1 or -1 for each ring of a stack (k, n, 2) that is strictly convex, anticlockwise or clockwise; 0 for others, slight bends included."""
    if p.shape[1] < 3:
        return np.zeros(len(p), int)
    along = np.roll(p, -1, axis=1) - p
    after = np.roll(along, -1, axis=1)
    cross = along[..., 0] * after[..., 1] - along[..., 1] * after[..., 0]
    with np.errstate(invalid="ignore"):
        bent = np.abs(cross) > 1e-6 * np.maximum(1.0, np.hypot(along[..., 0], along[..., 1]) * np.hypot(after[..., 0], after[..., 1]))
        sign = np.where((cross > 0).all(axis=1), 1, np.where((cross < 0).all(axis=1), -1, 0))
        once = np.abs(np.arctan2(cross, (along * after).sum(axis=-1)).sum(axis=1)) < 3 * np.pi  # a star goes round more often
        return np.where(bent.all(axis=1) & once & np.isfinite(p).all(axis=(1, 2)), sign, 0)


def union(shapes: Iterable[list[Ring]]) -> list[Ring]:
    """All that lies in any of the shapes."""
    return arranged([r for s in shapes for r in s], lambda w: w > 0)


def cleaned(points: np.ndarray | None) -> list[Ring] | None:
    """A ring as a shape, its crossings resolved: what it goes round in the direction of its greater area stays. None where that is nothing
    or falls apart."""
    if points is None or len(points) < 3 or not np.isfinite(points).all():
        return None
    if turn := turns(points[None])[0]:
        return [points if turn > 0 else points[::-1]]
    sign = 1 if signed_area(points) >= 0 else -1
    rings = arranged([points], lambda w: w * sign > 0)
    found = parts(rings if sign > 0 else [r[::-1] if signed_area(r) < 0 and len(rings) == 1 else r for r in rings])
    if len(found) != 1:
        return None
    # What was a point of the ring keeps its place; only crossings are snapped.
    own = dict(zip(map(tuple, np.round(points, DIGITS).tolist()), points.tolist(), strict=True))
    return [np.array([own.get(tuple(v), v) for v in r.tolist()]) for r in found[0]]


def points_of(value) -> np.ndarray | None:
    """An array of structs (x, y), as Arrow and pandas hand it over."""
    if value is None:
        return None
    p = np.array([(v["x"], v["y"]) for v in value], float).reshape(-1, 2)
    return p[:-1] if len(p) > 3 and (p[0] == p[-1]).all() else p


def plain(ring: Ring) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def united(shapes: list[list[Ring]]) -> list[Ring]:
    """The union of shapes, two halves of their plane at a time: neighbours first, so that what lies within goes early."""
    if len(shapes) <= 8:
        return union(shapes)
    middle = np.array([np.concatenate(s).mean(axis=0) for s in shapes])
    order = np.argsort(middle[:, int(np.ptp(middle, axis=0).argmax())], kind="stable")
    half = len(order) // 2
    return union([united([shapes[k] for k in part]) for part in (order[:half], order[half:])])


def union_by(polygons: DataFrame, key: str, polygon: str = "polygon", *, cell: float = 256.0, steps: int = 3) -> DataFrame:
    """key, n_parts, polygon (the outer ring of the largest part), area (of that part), total_area of the union of each key's polygons.

    Polygons of a key that begin in the same square of ``cell`` are united first, a share of them per task, then those of squares four times
    as wide, ``steps`` times, then all: a key with very many polygons reaches its last task as few partial unions, without what lies within.
    What is no polygon counts for nothing; a key without any gets null.
    """
    kind = dict(polygons.dtypes)[key]
    fields = f"`{key}` {kind}, sx long, sy long, rings array<array<struct<x:double,y:double>>>"
    message = pa.schema([("sx", pa.int64()), ("sy", pa.int64()), ("rings", RINGS)])

    def begun(rings: list[Ring]) -> tuple[int, int]:
        low = np.min([r.min(axis=0) for r in rings], axis=0)
        return int(low[0] // cell), int(low[1] // cell)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The polygons of a task, repaired and united by key and square."""
        held: dict = defaultdict(list)
        size, of = 0, pa.null()

        def emit() -> pa.RecordBatch:
            keys, shapes = [k for k, _, _ in held], [united([s for s in v if s]) for v in held.values()]
            squares = [(x, y) for _, x, y in held]
            return pa.RecordBatch.from_arrays([pa.array(keys, of), *(pa.array([s[k] for s in squares], pa.int64()) for k in (0, 1)), pa.array([[plain(r) for r in s] for s in shapes], RINGS)], [key, *message.names])

        for batch in batches:
            of = batch.column(0).type
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shape = cleaned(points_of(value)) or []
                held[(k, *(begun(shape) if shape else (0, 0)))].append(shape)
                size += sum(map(len, shape)) + 1
            if size > HELD:
                yield emit()
                held.clear()
                size = 0
        if held:
            yield emit()

    def shapes_of(table: pa.Table) -> list[list[Ring]]:
        return [[points_of(r) for r in rings] for rings in table.column("rings").to_pylist() if rings]

    def join(table: pa.Table) -> pa.Table:
        rings = united(shapes_of(table))
        return pa.table([table.column(key).slice(0, 1), table.column("sx").slice(0, 1), table.column("sy").slice(0, 1), pa.array([[plain(r) for r in rings]], RINGS)], names=[key, *message.names])

    def finish(table: pa.Table) -> pa.Table:
        found = parts(united(shapes_of(table)))
        best = found[0] if found else None
        columns = [table.column(key).slice(0, 1), pa.array([len(found)], pa.int32()), pa.array([plain(best[0]) if best else None], RINGS.value_type), pa.array([area(best) if best else None], pa.float64()), pa.array([sum(map(area, found)) if found else None], pa.float64())]
        return pa.table(columns, names=[key, "n_parts", "polygon", "area", "total_area"])

    # Dealt to as many tasks as the session shuffles to: the unions take long, however small their table is.
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = lambda c: F.floor(F.array_min(F.transform(F.col(polygon), lambda p: p[c])) / cell)
    partial = polygons.select(key, polygon).repartition(tasks, key, low("x"), low("y")).mapInArrow(gather, fields)
    for _ in range(steps):
        partial = partial.repartition(tasks, key, "sx", "sy").groupBy(key, "sx", "sy").applyInArrow(join, fields)
        partial = partial.withColumn("sx", F.floor(F.col("sx") / 4)).withColumn("sy", F.floor(F.col("sy") / 4))
    return partial.groupBy(key).applyInArrow(finish, f"`{key}` {kind}, n_parts int, polygon array<struct<x:double,y:double>>, area double, total_area double")
