"""Overlaps of polygons: those that share a grid cell meet in one task, as arrays, and only the pairs that count become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.functions import polygons, rings
from muralis.storage import materialise

#: Polygons of a cell that meet at once; a fuller cell is dealt to groups, and two groups at a time meet in a task.
TILE = 1024
#: Rows that a task gathers before it lets whole groups meet, and pairs that it looks at in one go.
HELD, PAIRS = 4096, 32_768
#: An overlap of polygons below this share is what rounding makes of touching.
SLIVER = 1e-6

_BOUNDS = ("x0", "y0", "w", "h")

#: The values of a column, or of a field of one (box.x0), of one side of pairs.
Side = Callable[[str], np.ndarray]


def by_boxes(iou: np.ndarray, a: Side, b: Side) -> np.ndarray:
    """The polygons' ``iou``, unless it is so near 0, a limit or the middle between two rounded values that the last bits decide: then that of the
    boxes, by SQL's arithmetic, and nan where they don't overlap."""
    step = iou * 10000 + 0.5
    near = (iou <= SLIVER) | (np.abs(iou - 0.2) < 1e-9) | (np.abs(iou - 0.15) < 1e-9) | (np.abs(step - np.rint(step)) < 1e-6)
    k = np.flatnonzero(near)
    if len(k):
        ax, ay, aw, ah, bx, by, bw, bh = (side(f"box.{v}")[k] for side in (a, b) for v in ("x0", "y0", "w", "h"))
        wide, high = np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx), np.minimum(ay + ah, by + bh) - np.maximum(ay, by)
        with np.errstate(divide="ignore", invalid="ignore"):
            iou = iou.copy()
            iou[k] = np.where((wide > 0) & (high > 0), wide * high / (aw * ah + bw * bh - wide * high), np.nan)
    return iou


def centre_gap_by_boxes(gap: np.ndarray, a: Side, b: Side, limit: float) -> np.ndarray:
    """The distance of the polygons' centres, unless it is so near the limit that the last bits decide: then that of the boxes, subtracted in SQL's
    order."""
    k = np.flatnonzero(np.abs(gap - limit) < 1e-6)
    if len(k):
        ax, ay, aw, ah, bx, by, bw, bh = (side(f"box.{v}")[k] for side in (a, b) for v in ("x0", "y0", "w", "h"))
        wide, high = ax + aw / 2 - bx - bw / 2, ay + ah / 2 - by - bh / 2
        gap = gap.copy()
        gap[k] = np.sqrt(wide * wide + high * high)
    return gap


class _Shapes:
    """The rows of whole groups as arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch, self.values = batch, {}
        of = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
        self.x0, self.y0 = of("x0"), of("y0")
        self.x1, self.y1 = self.x0 + of("w"), self.y0 + of("h")
        self.cx, self.cy = of("cx"), of("cy")
        xy, self.at, self.n = polygons._rings_of(batch.column("polygon"))
        self.xy = xy.T.copy()
        self.turn, self.area = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
        for k in polygons._stacks(self.n):
            stack = xy[self.at[k, None] + np.arange(self.n[k[0]])]
            self.turn[k] = rings.turns(stack)
            if stack.shape[1] >= 3:
                self.area[k] = np.abs(polygons._areas(stack))

    def side(self, k: np.ndarray) -> Side:
        def values(name: str) -> np.ndarray:
            if name not in self.values:
                column, *fields = name.split(".")
                found = self.batch.column(column)
                for field in fields:
                    found = found.field(field)
                self.values[name] = found.to_numpy(zero_copy_only=False)
            return self.values[name][k]

        return values

    def corners(self, k: np.ndarray, n: int) -> np.ndarray:
        """The corners of rows of n each, anticlockwise: (2, n, k)."""
        up = np.arange(n)[:, None]
        return np.take(self.xy, self.at[k] + np.where(self.turn[k] > 0, up, n - 1 - up), axis=1)

    def overlaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Intersection over union of pairs; nan of those that are apart, or that are no polygons."""
        out = np.full(len(i), np.nan)
        for k in polygons._stacks(self.n[i] * (1 << 32) + self.n[j]):
            n, m = int(self.n[i[k[0]]]), int(self.n[j[k[0]]])
            if n < 3 or m < 3:
                continue
            convex = (self.turn[i[k]] != 0) & (self.turn[j[k]] != 0)
            if not convex.all():
                for row in k[~convex]:
                    value = polygons.iou(*(self.xy[:, self.at[s] : self.at[s] + self.n[s]].T if self.area[s] > 1e-9 else None for s in (i[row], j[row])))
                    out[row] = np.nan if value is None else value
                k = k[convex]
            both = polygons.common_areas(self.corners(i[k], n), self.corners(j[k], m))
            out[k] = both / (self.area[i[k]] + self.area[j[k]] - both)
        return out


def _partners(fresh: np.ndarray, side: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of groups (``fresh`` where one begins) the first row it meets and how many: those after it in its group, or, in a group of two
    sides (``mixed``, sorted by ``side``), the first side's rows the whole second side."""
    n = len(fresh)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], n)
    of = np.cumsum(fresh) - 1
    middle = ends - np.add.reduceat(side.astype(np.int64), starts)
    first = np.where(mixed, middle[of], np.arange(n) + 1)
    return first, np.where(mixed & side, 0, ends[of] - first)


def polygon_pairs(
    rows: DataFrame, *, cell: float, key: str = "id", within: list[str] | None = None, least: float = 0.0, emits: list[str] | None = None,
    settle: Callable[[np.ndarray, Side, Side], np.ndarray] | None = None, keep: Callable[[np.ndarray, Side, Side], np.ndarray] | None = None,
) -> DataFrame:
    """Pairs a.key < b.key of polygons (with their bounds x0, y0, w, h) that overlap, by ``least`` and as ``keep`` wants it, with their intersection
    over union as ``iou`` and the columns ``emits`` (all but polygon and bounds) as a_<name> and b_<name>.

    ``settle`` may replace an ``iou`` that is too near a limit to tell, nan for none; without it slivers are no overlap. A polygon is sent to each cell
    that its bounds touch, and to each pair of groups there that its own is one of; a pair counts in the first cell that both touch. A task holds
    a few groups at a time, however full a cell is.
    """
    within = within or []
    c, tasks = F.col, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = rows.filter(reduce(lambda a, b: a & b, [c(k).isNotNull() for k in ("polygon", *within)]))
    placed = materialise(known, "polygons")
    carried = [k for k in rows.columns if k not in ("polygon", *_BOUNDS)]
    emits = carried if emits is None else emits
    span = lambda lo, size: F.explode(F.sequence(F.floor(c(lo) / cell).cast("long"), F.floor((c(lo) + c(size)) / cell).cast("long")))
    cells = [*within, "cx", "cy"]
    listed = placed.withColumn("cx", span("x0", "w")).withColumn("cy", span("y0", "h"))
    full = listed.groupBy(*cells).agg(F.ceil(F.count("*") / TILE).cast("int").alias("groups")).filter("groups > 1")
    groups = F.coalesce("groups", F.lit(1))
    dealt = listed.join(full, cells, "left").withColumn("own", F.pmod(F.xxhash64(key), groups).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1)))
    tile = [*cells, "lo", "hi"]
    dealt = dealt.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).select(*carried, "polygon", *_BOUNDS, "cx", "cy", "lo", "hi", "own")
    dealt = dealt.repartition(tasks, *tile).sortWithinPartitions(*tile, "own")
    kinds = dict(rows.dtypes)

    def compared(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = _Shapes(batch)
        fresh = _begins(batch)
        lo, hi, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi", "own"))
        first, count = _partners(fresh, (lo != hi) & (own == hi), lo != hi)
        ids = batch.column(key)
        done = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
            i = np.repeat(np.arange(at, to), count[at:to])
            j = np.repeat(first[at:to], count[at:to]) + np.arange(done[at], done[to]) - np.repeat(done[at:to], count[at:to])
            at = to
            for x0, x1, place in ((s.x0, s.x1, s.cx), (s.y0, s.y1, s.cy)):
                low = np.maximum(x0[i], x0[j])
                meets = (np.minimum(x1[i], x1[j]) > low) & (np.floor(low / cell) == place[i])
                i, j = i[meets], j[meets]
            iou = s.overlaps(i, j)
            kept = np.flatnonzero(~np.isnan(iou))
            i, j, iou = i[kept], j[kept], iou[kept]
            x, y = ids.take(pa.array(i)), ids.take(pa.array(j))
            before = pc.less(x, y).to_numpy(zero_copy_only=False)
            a, b = np.where(before, i, j), np.where(before, j, i)
            iou = settle(iou, s.side(a), s.side(b)) if settle else iou
            with np.errstate(invalid="ignore"):
                kept = (iou >= least) & (iou > (0 if settle else SLIVER)) & pc.not_equal(x, y).to_numpy(zero_copy_only=False)
            a, b, iou = a[kept], b[kept], iou[kept]
            if keep:
                kept = keep(iou, s.side(a), s.side(b))
                a, b, iou = a[kept], b[kept], iou[kept]
            if len(iou):
                of = pa.array(a), pa.array(b)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(v) for v in of for k in emits), pa.array(iou)], [*(f"{p}_{k}" for p in "ab" for k in emits), "iou"])

    def _begins(batch: pa.RecordBatch) -> np.ndarray:
        """Where another tile begins than that of the row before."""
        fresh = np.zeros(batch.num_rows, bool)
        fresh[:1] = True
        for k in tile:
            col = batch.column(k)
            fresh[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
        return fresh

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < HELD:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(_begins(whole))[-1])
            if last:
                yield from compared(whole.slice(0, last))
            held = [whole.slice(last)]
        if held:
            yield from compared(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    fields = ", ".join(f"`{p}_{k}` {kinds[k]}" for p in "ab" for k in emits)
    return dealt.mapInArrow(meet, f"{fields}, iou double")
