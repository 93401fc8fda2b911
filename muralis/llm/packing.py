"""Best-two-fit packing of token pieces into sequences.

Sequences are planned on the histogram of piece lengths, which has one entry per length whatever the corpus holds; the
pieces then find their places by their rank among the pieces of their length, without being gathered.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.llm.tokens import BYTE_BPE, BYTE_RANKS, byte_encoder
from muralis.storage import materialise


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of the pieces of a sequence, number of such sequences) that use up ``counts[length]`` pieces.

    A sequence takes the longest piece that fits, again and again. Then its smallest piece is taken out if two unplaced
    pieces fill the gap so widened more tightly. As a plan depends only on which lengths are left, it is repeated as
    often as the counts allow before the next is made: the work is bounded by the number of lengths.
    """
    left = counts.astype(np.int64).copy()
    plans: list[tuple[list[int], int]] = []
    lengths = np.arange(capacity + 1)

    def largest_up_to() -> np.ndarray:
        """At x, the largest length of at most x that is left; 0 if there is none."""
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    while left[1:].any():
        took: dict[int, int] = defaultdict(int)
        pieces, gap = [], capacity
        below = largest_up_to()
        while gap and (size := int(below[gap])):
            n = min(gap // size, int(left[size]))
            pieces += [size] * n
            took[size] += n
            left[size] -= n
            gap -= n * size
            below = largest_up_to()
        smallest = pieces[-1]
        if gap and len(pieces) > 1:
            left[smallest] += 1
            room, below = gap + smallest, largest_up_to()
            first = np.flatnonzero(left[: room + 1] > 0)
            first = first[first > 0]
            second = below[np.minimum(first, room - first)]
            again = (second == first) & (left[first] < 2)
            second = np.where(again, below[np.maximum(second - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            k = int(np.argmax(both)) if len(both) else 0
            if len(both) and both[k] > smallest:
                took[smallest] -= 1
                pieces[-1:] = [int(first[k]), int(second[k])]
                for x in pieces[-2:]:
                    took[x] += 1
                    left[x] -= 1
            else:
                left[smallest] -= 1
        # Repeats leave every length that was available in the first round available; else the plan is made anew.
        more = min(int(left[x]) // n for x, n in took.items() if n)
        if took.get(smallest) == 0:
            more = min(more, int(left[smallest]) - 1) if left[smallest] > 1 else 0
        more = max(0, more)
        for x, n in took.items():
            left[x] -= n * more
        plans.append((pieces, more + 1))
    return plans


class Places:
    """Where the pieces of each length go: slots sorted by (length, first rank), each with a sequence and an offset."""

    def __init__(self, plans: list[tuple[list[int], int]]):
        used: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for pieces, times in plans:
            offset = 0
            for size in pieces:
                rows.append((size, used[size], sequence, offset))
                used[size] += times
                offset += size
            sequence += times
        rows.sort()
        self.size, self.rank, self.sequence, self.offset = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        self.sequences = sequence

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = lambda s, r: (s << np.int64(48)) | r
        at = np.searchsorted(key(self.size, self.rank), key(size, rank), "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def token_pieces(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, path: str = BYTE_BPE, ranks: str | None = BYTE_RANKS) -> DataFrame:
    """The pieces of every document, with their rank among the pieces of their length within the task (``part``)."""

    def cut(batches):
        encoder = byte_encoder(path, ranks)
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = encoder.encode(text) + end
                n = len(packed) // 4
                at, size = 0, (n - 1) % capacity + 1
                piece = 0
                while at < n:
                    for c, v in zip(cols, (doc, piece, at, size, zlib.crc32(packed[4 * at : 4 * (at + size)]), seen[size]), strict=True):
                        c.append(v)
                    seen[size] += 1
                    at, size, piece = at + size, capacity, piece + 1
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(cols[0]), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "local_rank", "part"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, local_rank long, part int")


def pack_documents(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, path: str = BYTE_BPE, ranks: str | None = BYTE_RANKS) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``capacity`` tokens: a row per piece.

    A document's ids are closed by ``end_id``. Only documents of more than ``capacity`` ids are cut; all their pieces but
    the first are full. Null or empty text: one piece of the end id alone. Repeated rows and null ids are packed row by
    row; an empty table gives no rows. Pieces of one length are interchangeable, so ties need no order.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, capacity=capacity, end_id=end_id, path=path, ranks=ranks), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most one row per task and length, however many pieces share the length.
    firsts = materialise(per_part.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")), "piece-ranks")
    counts = np.zeros(capacity + 1, np.int64)
    for row in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row.length] = row.n
    places = spark.sparkContext.broadcast(Places(plan_sequences(counts, capacity)))  # bounded by the number of lengths

    def place(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sequence, offset = places.value.find(t.column("length").to_numpy(), t.column("rank").to_numpy())
            kept = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield from kept.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).to_batches()

    ranked = pieces.join(firsts.select("length", "part", "first"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("local_rank")).alias("rank"))
    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
