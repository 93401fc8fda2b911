"""Vectors as rows of integers, packed into few bytes so that they shuffle, group and store cheaply."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of this size and more are refused: a double holds them no longer exactly.
LIMIT = 1 << 52


def usable(embedding: str = "embedding") -> Column:
    """True where the vector is not null and holds no null and no non-finite component."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(embedding).isNotNull() & ~odd


def pack(rows: np.ndarray) -> list[bytes]:
    """One byte string per row of integers: its width, then the components in as few bytes as the row needs, without zeros at the
    end. Rows are equal, zeros at the end apart, exactly where their strings are."""
    if not len(rows):
        return []
    size = np.abs(rows).max(axis=1, initial=0)
    width = np.select([size < 128, size < 1 << 15, size < 1 << 31], [1, 2, 4], 8)
    filled = rows.shape[1] - np.argmax((rows != 0)[:, ::-1], axis=1) if rows.shape[1] else np.zeros(len(rows), int)
    filled[size == 0] = 0
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        raw, step = rows[at].astype(f"<i{w}").tobytes(), int(w) * rows.shape[1]
        head = bytes([w])
        for k, (i, n) in enumerate(zip(at.tolist(), filled[at].tolist(), strict=True)):
            out[i] = head + raw[k * step : k * step + n * int(w)]
    return out


def unpack(packed: list[bytes], dims: int) -> np.ndarray:
    """The rows again, filled up with zeros to ``dims`` components."""
    rows = np.zeros((len(packed), dims), np.int64)
    by_shape: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(packed):
        by_shape.setdefault((b[0], len(b)), []).append(i)
    for (w, size), at in by_shape.items():
        n = (size - 1) // w
        if n:
            joined = np.frombuffer(b"".join([packed[i][1:] for i in at]), f"<i{w}")
            rows[at, :n] = joined.reshape(len(at), n)
    return rows


def floored(vectors: DataFrame, scale: float, *carried: str) -> DataFrame:
    """x (packed floor(scale * component)) and size (number of components), after the columns ``carried``, of the usable rows of
    ``vectors`` (embedding)."""
    kinds = dict(vectors.dtypes)

    def floor(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(carried))
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            sizes = np.diff(ends, prepend=0)
            with np.errstate(over="ignore"):
                whole = np.floor(scale * values)
            if (np.abs(whole) >= LIMIT).any():
                raise ValueError("a component is too large to be kept as an exact integer")
            rows = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
            rows[np.arange(rows.shape[1])[None, :] < sizes[:, None]] = whole.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carried))), pa.array(pack(rows), pa.binary()), pa.array(sizes, pa.int32())], [*carried, "x", "size"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "x binary", "size int"])
    return vectors.filter(usable()).select(*carried, "embedding").mapInArrow(floor, schema)
