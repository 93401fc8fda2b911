"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and as many ids as fit its 60 payload bits at the selector's width. An id of more
than 60 bits follows an escape word as a raw word. Documents start at a word, and every block stores the word at which
each of its documents starts and where its raw words are, so a block decodes by whole-array operations.

The files are Parquet tables of blocks, written and read by Spark, so they live in any store that Spark reaches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.llm.tokens import WORD_BPE, word_encoder
from muralis.storage import materialise

# Fixed values: (ids, bits of each) that selectors 1 to 14 pack into 60 bits; selector 15 announces a raw word.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15

#: Documents and ids after which a block is closed (a block holds whole documents).
BLOCK_DOCS = 512
BLOCK_IDS = 262_144

_FORMAT = "part int, block int, doc_ids array<long>, n_tokens array<int>, word_starts array<int>, raw_words array<int>, words binary"
_COUNT = np.array([0, *(n for n, _ in PACKINGS), 0], np.int64)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), np.uint8)
    for k in range(1, 64):
        above = ids >= np.uint64(1) << np.uint64(k)
        if not above.any():
            break
        out[above] = k + 1
    return out


def pack_words(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the concatenated documents in ``ids`` (uint64), whose ends are ``ends``; the word at which each document
    starts; and the places of raw words. Each word takes the most ids that fit it within the document."""
    n = len(ids)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int32), np.zeros(0, np.int32)
    left = np.minimum(np.repeat(ends, ends - starts) - np.arange(n), 255).astype(np.uint8)
    widest = {1: _bit_lengths(ids)}
    choice = np.where(widest[1] > 60, ESCAPE, 14).astype(np.uint8)
    step = np.ones(n, np.uint8)
    last = 1
    for k in range(len(PACKINGS) - 2, -1, -1):
        count, bits = PACKINGS[k]
        wide = widest[last].copy()
        gap = count - last  # at most ``last``: two spans of the former length cover the new one
        wide[: n - gap] = np.maximum(widest[last][: n - gap], widest[last][gap:])
        widest = {count: wide}
        last = count
        fits = (left >= count) & (wide <= bits)
        choice[fits] = k + 1
        step[fits] = count
    steps, at, heads = step.tolist(), 0, []
    while at < n:  # the only sequential part: hop from word to word
        heads.append(at)
        at += steps[at]
    head = np.array(heads, np.int64)
    chosen = choice[head].astype(np.uint64)
    words = chosen << np.uint64(60)
    for k, (count, bits) in enumerate(PACKINGS, 1):
        rows = np.flatnonzero(chosen == k)
        if len(rows):
            values = ids[head[rows][:, None] + np.arange(count)]
            words[rows] |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    escaped = np.flatnonzero(chosen == ESCAPE)
    words = np.insert(words, escaped + 1, ids[head[escaped]])
    raw = escaped + 1 + np.arange(len(escaped))
    before = np.searchsorted(head, starts)
    return words, (before + np.searchsorted(escaped, before)).astype(np.int32), raw.astype(np.int32)


def unpack_words(words: np.ndarray, raw_words: np.ndarray) -> np.ndarray:
    """The ids (uint64) of a block's words; ``raw_words`` are the places of its raw words."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[chosen]
    if len(raw_words):
        chosen[raw_words] = 0
        counts[raw_words] = 1
    at = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for k, (count, bits) in enumerate(PACKINGS, 1):
        rows = np.flatnonzero(chosen == k)
        if len(rows):
            mask = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
            out[at[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & mask
    if len(raw_words):
        out[at[raw_words]] = words[raw_words]
    return out


def token_blocks(docs: DataFrame, *, end_id: int = 2, path: str = WORD_BPE) -> DataFrame:
    """Blocks of the documents' ids, each document closed by ``end_id``, in ascending doc_id order over ``part``, ``block``."""

    def encode(batches):
        encoder = word_encoder(path)
        part, block, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def closed() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.uint64)
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            words, starts, raw = pack_words(flat, np.cumsum(sizes))
            row = {"part": part, "block": block, "doc_ids": list(names), "n_tokens": sizes.tolist(), "word_starts": starts.tolist(), "raw_words": raw.tolist(), "words": words.astype("<u8").tobytes()}
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(encoder.encode(text) + end)
                names.append(doc)
                held += len(ids[-1]) // 4
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_IDS:
                    yield closed()
                    block, held = block + 1, 0
                    ids.clear()
                    names.clear()
        if ids:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, _FORMAT)


_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("word_starts", pa.list_(pa.int32())), ("raw_words", pa.list_(pa.int32())), ("words", pa.binary())])


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in ``blocks``, decoded from their words."""
    sums = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # A row per file part, each counted in the step before: the window sees no documents.
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    own = blocks.groupBy("part", "block").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    own = own.select("part", "block", (F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).alias("block_start"))
    starts = own.join(bases, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("at"))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_words(np.frombuffer(row["words"], "<u8"), np.array(row["raw_words"], np.int64)).astype("<u4")
                raw, sizes = memoryview(ids.tobytes()), np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["at"] + begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    wide = blocks.select("part", "block", "doc_ids", "n_tokens", "raw_words", "words").join(starts, ["part", "block"])
    return wide.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, *, end_id: int = 2, path: str = WORD_BPE) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in file format, read the files back, and digest each document.

    Null or empty text: the end id alone. Null ids come first; rows that share a doc_id follow each other by text and
    keep a row each. An empty table gives none.
    """
    return read_documents(materialise(token_blocks(docs, end_id=end_id, path=path), "token-blocks"))
