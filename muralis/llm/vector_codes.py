"""Product codes of vectors: four parts, each by the nearest of 256 entries, with entries refined in rounds.

The entries of a part position stand in a ball tree. A batch of parts goes down the tree together: a ball is visited
unless it is farther than the best entry so far by more than its radius, with radii rounded up and equality visited, and the
distance of the winner is computed again in integers. Assignment and sums are one pass over the packed table a round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.llm.vectors import floored, unpack
from muralis.storage import materialise, materialise_with

#: Rows that go down the trees together.
ROWS = 2048
#: Widening of every bound, far beyond the rounding of a few doubles.
SLACK = 1 + 1e-9
#: A label with more than this share of the rows is joined by broadcast: there are fewer of them than its reciprocal.
HOT_SHARE = 0.001


class BallTree:
    """Balls around the integer rows ``entries``; a leaf holds at most ``leaf`` of them, in ascending order."""

    def __init__(self, entries: np.ndarray, leaf: int = 16):
        self.entries = entries
        self.members: list[np.ndarray] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.visited = 0
        self._grow(np.arange(len(entries)), leaf)
        self.leaves = [k for k, c in enumerate(self.children) if c is None]
        self.largest = int(np.abs(entries).max(initial=0))

    def _grow(self, at: np.ndarray, leaf: int) -> int:
        node, rows = len(self.members), self.entries[at]
        centre = rows.sum(axis=0) // len(rows)
        # The farthest entry's distance is exact before its root is taken, and the root is rounded up.
        far = ((rows - centre) ** 2).sum(axis=1)
        self.members.append(at)
        self.centre.append(centre)
        self.radius.append(math.sqrt(int(far.max())) * SLACK)
        self.children.append(None)
        if len(at) > leaf:
            one = rows[int(far.argmax())]
            other = rows[int(((rows - one) ** 2).sum(axis=1).argmax())]
            order = np.argsort((rows - one) @ (other - one), kind="stable")
            half = len(at) // 2
            near, rest = np.sort(at[order[:half]]), np.sort(at[order[half:]])
            self.children[node] = (self._grow(near, leaf), self._grow(rest, leaf))
        return node

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each integer row; the lower index of equals."""
        bound = rows.shape[1] * (int(np.abs(rows).max(initial=0)) + self.largest) ** 2
        if bound >= 1 << 62:
            raise ValueError("components are too large for exact distances")
        kind = np.float64 if 4 * bound < 1 << 53 else np.int64  # sums of products are exact in either
        q = rows.astype(kind)
        own = (q * q).sum(axis=1)
        best = np.full(len(q), np.iinfo(np.int64).max if kind is np.int64 else np.inf, kind)
        index = np.full(len(q), len(self.entries))

        def squared(at: np.ndarray, points: np.ndarray) -> np.ndarray:
            p = points.astype(kind)
            return own[at, None] - 2 * (q[at] @ p.T) + (p * p).sum(axis=1)

        def try_leaf(node: int, at: np.ndarray) -> None:
            members = self.members[node]
            d = squared(at, self.entries[members])
            k = d.argmin(axis=1)
            d, found = d[np.arange(len(at)), k], members[k]
            better = (d < best[at]) | ((d == best[at]) & (found < index[at]))
            best[at[better]], index[at[better]] = d[better], found[better]
            self.visited += len(at) * len(members)

        everyone = np.arange(len(q))
        first = squared(everyone, np.stack([self.centre[k] for k in self.leaves])).argmin(axis=1)
        for k, node in enumerate(self.leaves):
            if len(at := np.flatnonzero(first == k)):
                try_leaf(node, at)
        first = np.array(self.leaves)[first]
        stack = [(0, everyone)]
        while stack:
            node, at = stack.pop()
            if self.children[node] is None:
                at = at[first[at] != node]
            # Equality is visited: an entry as near with a lower index may lie on the rim.
            reach = (np.sqrt(best[at].astype(np.float64)) + self.radius[node]) * SLACK
            at = at[squared(at, self.centre[node][None, :])[:, 0] <= reach * reach * SLACK]
            if not len(at):
                continue
            if self.children[node] is None:
                try_leaf(node, at)
            else:
                stack += [(child, at) for child in self.children[node]]
        exact = ((rows - self.entries[index]) ** 2).sum(axis=1)
        if not np.array_equal(exact, best.astype(np.int64)):
            raise ArithmeticError("a distance differs from its value in integers")
        return index, exact


def encode_vectors(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every usable row of ``vectors`` (vec_id, embedding, label).

    Components count as floor(scale * x). Vectors that are null or hold null or non-finite components give no rows; shorter vectors
    count as padded with zeros to the longest, and all to a multiple of ``parts``. The first entries come from the rows with
    the smallest ids (null ids last, rows that share an id in the order of their packed vectors); fewer rows give fewer entries, and
    equal entries yield to the lowest. Repeated rows give a row each; null labels sum together. Components whose distances exceed a
    long raise ValueError. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept, facts = materialise_with(floored(vectors, scale, "vec_id", "label"), "vectors", n=F.count("*"), dims=F.max("size"))
    part = -(-int(facts["dims"]) // parts)
    dims = part * parts
    # Bounded: ``entries`` rows.
    first = [r.x for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    books = [np.ascontiguousarray(unpack(first, dims)[:, k * part : (k + 1) * part]) for k in range(parts)]

    def sums(trees):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = len(trees.value[0].entries)
            count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, part), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = unpack(batch.column(0).slice(at, ROWS).to_pylist(), dims)
                    for k, tree in enumerate(trees.value):
                        mine = x[:, k * part : (k + 1) * part]
                        index, _ = tree.nearest(mine)
                        count[k] += np.bincount(index, minlength=size)
                        np.add.at(total[k], index, mine)
            k, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[k, entry]), pa.array(list(total[k, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        return run

    for _ in range(rounds if first else 0):
        trees = spark.sparkContext.broadcast([BallTree(b) for b in books])  # entries x dims numbers
        each = kept.select("x").mapInArrow(sums(trees), "part int, entry int, n long, total array<long>")
        found = each.select("part", "entry", "n", F.posexplode("total").alias("place", "total")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in found.collect():  # at most entries x dims rows
            books[r.part][r.entry, r.place] = r.total // r.n
        trees.unpersist()

    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    trees = spark.sparkContext.broadcast([BallTree(b) for b in books] if first else [])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                x = unpack(rows.column(2).to_pylist(), dims)
                code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for k, tree in enumerate(trees.value):
                    index, d = tree.nearest(x[:, k * part : (k + 1) * part])
                    code[:, k] = index
                    error += d
                digits = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([digits[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(x))], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    coded = materialise(kept.select("vec_id", "label", "x").mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    per_label = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    # Labels that hold many rows are fewer than 1 / HOT_SHARE and are joined without a shuffle; the rest have few rows each.
    hot = F.broadcast(per_label.filter(F.col("n") > HOT_SHARE * facts["n"]).select(F.col("label").alias("of"), "label_error"))
    cold = per_label.filter(F.col("n") <= HOT_SHARE * facts["n"]).select(F.col("label").alias("of"), "label_error")
    same = F.col("label").eqNullSafe(F.col("of"))
    out = coded.join(hot, same).unionByName(coded.join(hot, same, "left_anti").join(cold, same))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
