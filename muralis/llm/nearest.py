"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Data and queries are dealt into blocks by a hash of their id; each block becomes one row with its cover tree. The queries
first meet a small share of the data, whose k-th scores are bounds that they carry into every other block. Then every block
of queries meets every block of data in a task of its own. There, pairs of a query node and a data node are visited from
the most promising down; a pair goes when the largest inner product that the two covering radii allow is below the worst
k-th score of the node's queries. Each pair of blocks yields at most k candidates a query, and the best k of all are kept.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of data and of a block of queries, about.
DATA_ROWS = 8192
QUERY_ROWS = 2048
#: A node of at most so many rows is not divided; the covering radius of a level against that above it.
LEAF_ROWS = 48
SHRINK = 0.8
#: Rows of the share of the data that the queries meet first.
FIRST_ROWS = 4096
#: The same for the trees of queries, whose leaves are answered at once.
QUERY_LEAF = 16


class CoverTree:
    """Rows in leaf order, and nodes (centre row, covering radius, first row, end, children, level).

    All rows below a node lie within its radius of its centre (covering). A node of level n is divided by a radius of
    SHRINK ** n of the root's: each row joins the first centre that is within it, and the row that is farthest from all centres
    becomes the next one, so that the centres of children are farther apart than this radius (separation). Where one
    centre covers all, the level is passed over. A node's children of few rows (a sixth of a leaf) are held together as one leaf, so
    that they are scored together.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS):
        rows = rows.astype(np.float64)
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], ids[order]
        placed: list[np.ndarray] = []
        bundle = max(2, leaf_rows // 6)
        self.centre, self.radius, self.first, self.end, self.children, self.level = [], [], [], [], [], []
        count = 0

        def distances(members: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(((rows[members] - rows[centre]) ** 2).sum(axis=1))

        def lonely(members: np.ndarray, radius: float) -> np.ndarray:
            """Members that have no other one within ``radius``."""
            x = rows[members]
            square = (x**2).sum(axis=1)
            out = np.zeros(len(members), bool)
            for k in range(0, len(members), 512):
                d2 = square[k : k + 512, None] + square[None, :] - 2 * (x[k : k + 512] @ x.T)
                out[k : k + 512] = (d2 <= radius * radius).sum(axis=1) <= 1
            return out

        def divided(members: np.ndarray, d: np.ndarray, centre: int, radius: float) -> list[tuple[np.ndarray, np.ndarray, int]]:
            """The children that cover ``members`` at ``radius``."""
            out, near = [], d <= radius
            out.append((members[near], d[near], centre))
            rest, far = members[~near], d[~near]
            apart = lonely(rest, radius)  # each would be a centre for itself only
            out += [(rest[k : k + 1], np.zeros(1), int(rest[k])) for k in np.flatnonzero(apart)]
            rest, far = rest[~apart], far[~apart]
            while len(rest):
                centre = int(rest[np.argmax(far)])
                own = distances(rest, centre)
                near = own <= radius
                out.append((rest[near], own[near], centre))
                rest, far = rest[~near], np.minimum(far, own)[~near]
            return out

        def added(centre: int, radius: float, level: int) -> int:
            for field, value in ((self.centre, centre), (self.radius, radius), (self.first, count), (self.end, 0), (self.children, []), (self.level, level)):
                field.append(value)
            return len(self.centre) - 1

        def build(members: np.ndarray, d: np.ndarray, centre: int, level: int) -> int:
            nonlocal count
            radius = float(d.max())
            node = added(centre, radius, level)
            parts = []
            if len(members) > leaf_rows and radius > 0:
                below = max(level + 1, math.ceil(math.log(radius / root) / math.log(SHRINK) + 1e-9) if radius < root else level + 1)
                parts = divided(members, d, centre, min(SHRINK**below * root, SHRINK * radius))
            if len(parts) > 1:
                for part in parts:
                    if len(part[0]) >= bundle:
                        self.children[node].append(build(*part, below))
                few = np.concatenate([p[0] for p in parts if len(p[0]) < bundle] or [np.zeros(0, np.int64)])
                if len(few):  # one leaf, as far as the parent's centre covers them
                    leaf = added(centre, float(distances(few, centre).max()), below)
                    placed.append(few)
                    count += len(few)
                    self.end[leaf] = count
                    self.children[node].append(leaf)
            else:
                placed.append(members)
                count += len(members)
            self.end[node] = count
            return node

        everyone = np.arange(len(rows))
        start = int(np.argmin(((rows - rows.mean(axis=0)) ** 2).sum(axis=1)))
        away = distances(everyone, start)
        root = float(away.max())
        build(everyone, away, start, 0)
        taken = np.concatenate(placed)
        back = np.empty(len(rows), np.int64)
        back[taken] = everyone
        self.rows, self.ids = rows[taken], ids[taken]
        self.centre = back[self.centre]
        self.radius = np.array(self.radius)
        self.floor: np.ndarray | None = None
        self.length = np.sqrt((self.rows[self.centre] ** 2).sum(axis=1))

    def packed(self) -> bytes:
        return pickle.dumps(self, protocol=5)


class Best:
    """The k best candidates of each query so far: scores and ids, ties to the smaller id; ``floor``: scores that each query's k-th best
    has at least, whatever has been offered."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.scored = k, 0
        self.floor = np.full(queries, -np.inf) if floor is None else floor
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def worst(self, a: int, b: int) -> float:
        return float(np.maximum(self.score[a:b, -1], self.floor[a:b]).min())

    def offer(self, a: int, b: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[i, j]: of query a + i and candidate ids[j]."""
        self.scored += scores.size
        least = np.maximum(self.score[a:b, -1], self.floor[a:b])
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        rows = np.concatenate([row, np.repeat(np.arange(b - a), self.k)])
        values = np.concatenate([scores[row, col], self.score[a:b].ravel()])
        names = np.concatenate([ids[col], self.id[a:b].ravel()])
        order = np.lexsort((names, -values, rows))
        rows, values, names = rows[order], values[order], names[order]
        first = np.searchsorted(rows, np.arange(b - a))
        take = first[:, None] + np.arange(self.k)
        self.score[a:b], self.id[a:b] = values[take], names[take]


def dual_search(queries: CoverTree, data: CoverTree, k: int, floor: np.ndarray | None = None) -> Best:
    """The k largest inner products of every query with rows of ``data`` that have another id, but for those below the query's ``floor``."""
    best = Best(len(queries.rows), k, floor)

    def bounds(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The largest inner products that the radii of the nodes allow."""
        dots = queries.rows[queries.centre[q]] @ data.rows[data.centre[r]].T
        far = queries.radius[q][:, None]
        most = dots + queries.length[q][:, None] * data.radius[r] + far * data.length[r] + far * data.radius[r]
        return most + 1e-9 * np.abs(most) + 1e-6

    root = np.zeros(1, np.int64)
    heap, tick = [(-float(bounds(root, root)[0, 0]), 0, 0, 0)], 1
    while heap:
        most, _, q, r = heapq.heappop(heap)
        a, b = queries.first[q], queries.end[q]
        if -most < best.worst(a, b):
            continue
        if not queries.children[q] and not data.children[r]:
            c, d = data.first[r], data.end[r]
            scores = queries.rows[a:b] @ data.rows[c:d].T
            scores[queries.ids[a:b, None] == data.ids[None, c:d]] = -np.inf
            best.offer(a, b, scores, data.ids[c:d])
            continue
        q_parts, r_parts = (np.array(t.children[node] or [node]) for t, node in ((queries, q), (data, r)))
        most = bounds(q_parts, r_parts)
        for i, x in enumerate(q_parts.tolist()):
            worst = best.worst(queries.first[x], queries.end[x])
            for j in np.flatnonzero(most[i] >= worst).tolist():
                heapq.heappush(heap, (-float(most[i, j]), tick, x, int(r_parts[j])))
                tick += 1
    return best


def top_inner_products(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products for each row whose vec_id is divisible by ``every``, over ``vectors``
    (vec_id, embedding), components as floor(scale * x).

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Shorter vectors
    count as padded with zeros. Equal scores go to the smaller id; rows that share the query's id are not candidates, and of
    several such rows the first vector in order asks. Fewer than k candidates are all returned; an empty table, or one without queries, gives no rows.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    clean = clean.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))
    asked = clean.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = clean.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    data_blocks, query_blocks = (max(1, math.ceil(n / most)) for n, most in ((sizes.n, DATA_ROWS), (sizes.q, QUERY_ROWS)))

    def tree_of(table: pa.Table, leaf_rows: int) -> pa.Table:
        lists = table.column("v").to_pylist()
        width = max(map(len, lists))
        rows = np.zeros((len(lists), width))
        for k, v in enumerate(lists):
            rows[k, : len(v)] = v
        built = CoverTree(rows, table.column("vec_id").to_numpy(), leaf_rows)
        return pa.table([table.column("block").slice(0, 1), pa.array([built.packed()], pa.binary())], names=["block", "tree"])

    def data_tree(table: pa.Table) -> pa.Table:
        return tree_of(table, LEAF_ROWS)

    def query_tree(table: pa.Table) -> pa.Table:
        return tree_of(table, QUERY_LEAF)

    def blocks(df: DataFrame, n: int, build=data_tree) -> DataFrame:
        dealt = df.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"))
        return dealt.groupBy("block").applyInArrow(build, "block int, tree binary")

    def search(batches):
        for batch in batches:
            for q, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                queries, data = pickle.loads(q), pickle.loads(d)  # noqa: S301 - made by this job
                width = max(queries.rows.shape[1], data.rows.shape[1])
                for t in (queries, data):
                    t.rows = np.pad(t.rows, ((0, 0), (0, width - t.rows.shape[1])))
                best = dual_search(queries, data, k, queries.floor)
                found = best.score > -np.inf
                names = np.repeat(queries.ids, k).reshape(found.shape)[found]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(best.id[found]), pa.array(best.score[found].astype(np.int64))], ["query_id", "vec_id", "score"])

    def with_floor(batches):
        for batch in batches:
            for q, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if d is None:  # no row was drawn: no bound yet
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.binary())], ["queries"])
                    continue
                queries, data = pickle.loads(q), pickle.loads(d)  # noqa: S301 - made by this job
                width = max(queries.rows.shape[1], data.rows.shape[1])
                for t in (queries, data):
                    t.rows = np.pad(t.rows, ((0, 0), (0, width - t.rows.shape[1])))
                queries.floor = dual_search(queries, data, k).score[:, -1]
                yield pa.RecordBatch.from_arrays([pa.array([queries.packed()], pa.binary())], ["queries"])

    # Some rows, by a hash: their k-th scores are lower bounds of the k-th scores over all rows.
    some = clean.filter(F.pmod(F.xxhash64("vec_id", "v", F.lit(5)), F.lit(1 << 30)) <= int(min(1.0, FIRST_ROWS / max(1, sizes.n)) * (1 << 30)))
    first = blocks(some, 1).select(F.col("tree").alias("data"), F.lit(0).alias("one"))
    asked_trees = blocks(asked, query_blocks, query_tree).select(F.col("tree").alias("queries"), F.lit(0).alias("one"))
    # The broadcast is one tree of about FIRST_ROWS rows, or none where no row is drawn.
    bounded = asked_trees.join(F.broadcast(first), "one", "left").select("queries", "data").mapInArrow(with_floor, "queries binary") if data_blocks > 1 else asked_trees.select("queries")
    asked_blocks = bounded.select("queries", F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))).alias("block"))
    pairs = asked_blocks.join(blocks(clean, data_blocks).withColumnRenamed("tree", "data"), "block").select("queries", "data")
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
