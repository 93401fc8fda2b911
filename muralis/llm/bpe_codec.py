"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A long text is cut into leaves that are encoded in parallel tasks. Neighbouring encodings are then joined pairwise, as a
tree: a window around each join is encoded anew and grows until its tokens agree with both sides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.llm.tokens import _BOUNDARY, BYTE_BPE, BYTE_RANKS, ByteEncoder, byte_encoder

#: Characters of a leaf; texts of more than two leaves are encoded as trees.
LEAF_CHARS = 16_384
#: Tokens that a window must share with each side beyond the join, in a row.
AGREE = 8


class Encoded:
    """Ids of a piece of text, with the byte at which each token starts (and the end)."""

    def __init__(self, raw: bytes, ids: np.ndarray, lengths: np.ndarray):
        self.raw, self.ids = raw, ids
        self.at = np.concatenate(([0], np.cumsum(lengths[ids])))


def _char_start(raw: bytes, at: int) -> bool:
    return at >= len(raw) or raw[at] & 0xC0 != 0x80


def _agreement(side: np.ndarray, side_at: np.ndarray, own: np.ndarray, own_at: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Pairs (index in side, index in own) at which ``need`` tokens in a row start at the same bytes and are equal."""
    _, i, j = np.intersect1d(side_at[: len(side)], own_at[: len(own)], assume_unique=True, return_indices=True)
    same = side[i] == own[j]
    return [(int(i[k]), int(j[k])) for k in range(len(i) - need + 1) if same[k : k + need].all() and i[k + need - 1] - i[k] == need - 1 == j[k + need - 1] - j[k]]


def join(left: Encoded, right: Encoded, encoder: ByteEncoder, lengths: np.ndarray) -> Encoded:
    """The encoding of left.raw + right.raw, as encoding the joined text at once gives it."""
    raw, mid = left.raw + right.raw, len(left.raw)
    width = 32
    while True:
        a, b = max(0, len(left.ids) - width), min(len(right.ids), width)
        while a > 0 and not _char_start(raw, int(left.at[a])):
            a -= 1
        while b < len(right.ids) and not _char_start(raw, mid + int(right.at[b])):
            b += 1
        lo, hi = int(left.at[a]), mid + int(right.at[b])
        own = np.frombuffer(encoder.encode(raw[lo:hi].decode()), "<u4")
        own_at = lo + np.concatenate(([0], np.cumsum(lengths[own])))
        start = (0, 0) if a == 0 else None
        end = (len(right.ids), len(own)) if b == len(right.ids) else None
        if start is None:
            # The window's first tokens may miss what stood before it; the agreement lies past them.
            found = [p for p in _agreement(left.ids[a:], left.at[a:-1], own, own_at[:-1], AGREE) if p[1] > 0]
            start = (a + found[0][0], found[0][1]) if found else None
        if end is None:
            # Likewise the window's last tokens; the right side's first tokens may miss what stood before the join.
            found = [p for p in _agreement(right.ids[:b], mid + right.at[:b], own, own_at[:-1], AGREE) if p[1] + AGREE < len(own)]
            end = found[-1] if found else None
        if start and end and start[1] <= end[1]:
            return Encoded(raw, np.concatenate([left.ids[: start[0]], own[start[1] : end[1]], right.ids[end[0] :]]), lengths)
        width *= 2


def join_tree(parts: list[Encoded], encoder: ByteEncoder, lengths: np.ndarray) -> Encoded:
    while len(parts) > 1:
        parts = [join(parts[k], parts[k + 1], encoder, lengths) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def leaves_of(text: str, size: int) -> list[str]:
    """Halves of halves, each cut near its middle at a boundary of the tokenizer if one is near, else anywhere."""
    if len(text) <= size:
        return [text]
    mid = len(text) // 2
    near = _BOUNDARY.search(text, mid, min(len(text), mid + 256))
    mid = near.start() if near else mid
    return leaves_of(text[:mid], size) + leaves_of(text[mid:], size)


def _digest(encoder: ByteEncoder, packed: bytes) -> tuple[int, str, str]:
    text = encoder.decode(packed)
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def bpe_round_trip(docs: DataFrame, *, leaf_chars: int = LEAF_CHARS, path: str = BYTE_BPE, ranks: str | None = BYTE_RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs`` (doc_id, text).

    Null or empty text encodes to no ids and decodes to the empty text. Repeated rows and null ids give a row each; an
    empty table gives none. Texts of more than ``2 * leaf_chars`` characters are spread over tasks.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def whole(batches):
        encoder = byte_encoder(path, ranks)
        for batch in batches:
            done = [_digest(encoder, encoder.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut(batches):
        for batch in batches:
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                parts = leaves_of(text, leaf_chars)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array([doc] * len(parts), batch.schema.field(1).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["row", "doc_id", "leaf", "text"])

    def encode_leaf(batches):
        encoder = byte_encoder(path, ranks)
        for batch in batches:
            ids = pa.array([encoder.encode(t) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], ["row", "doc_id", "leaf", "text", "ids"])

    def concatenate(table: pa.Table) -> pa.Table:
        encoder = byte_encoder(path, ranks)
        lengths = np.array([len(b) for b in encoder.token_bytes])
        table = table.sort_by("leaf")
        parts = [Encoded(t.encode(), np.frombuffer(p, "<u4"), lengths) for t, p in zip(table.column("text").to_pylist(), table.column("ids").to_pylist(), strict=True)]
        n, ids, text = _digest(encoder, join_tree(parts, encoder, lengths).ids.astype("<u4").tobytes())
        return pa.table([table.column("doc_id").slice(0, 1), pa.array([n], pa.int64()), pa.array([ids]), pa.array([text])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    is_long = F.coalesce(F.length("text"), F.lit(0)) > 2 * leaf_chars
    leaves = docs.filter(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, f"row long, doc_id {kind}, leaf int, text string")
    leaves = leaves.repartition("row", "leaf").mapInArrow(encode_leaf, f"row long, doc_id {kind}, leaf int, text string, ids binary")
    long = leaves.groupBy("row").applyInArrow(concatenate, out)
    return docs.filter(~is_long).mapInArrow(whole, out).unionByName(long)
