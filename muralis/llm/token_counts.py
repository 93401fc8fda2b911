"""Token counts by a map-side two-tier lookup.

A broadcast table holds the token counts of the most frequent pre-tokens; what it lacks is looked up in, or encoded
into, a cache of the worker process. No pre-token is ever shuffled: the job is one pass over the documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.llm.tokens import BYTE_BPE, BYTE_RANKS, CACHE_CHARS, _Chunks, _Uneven, byte_encoder


#: Characters of a text that may feed the table.
SAMPLE_CHARS = 20_000


class FrequentLengths:
    """Compact table, pre-token -> number of tokens: the sorted pre-tokens as one text, and two flat arrays.

    It pickles to a few hundred kilobytes; a worker unrolls it into its first-tier hash table once.
    """

    def __init__(self, lengths: dict[str, int]):
        keys = sorted(lengths)
        self.blob = "".join(keys)
        self.cuts = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
        self.counts = np.array([lengths[k] for k in keys], np.uint16)

    def __len__(self) -> int:
        return len(self.counts)

    def unrolled(self) -> dict[str, int]:
        cuts = self.cuts.tolist()
        return {self.blob[a:b]: n for a, b, n in zip(cuts, cuts[1:], self.counts.tolist(), strict=False)}


def frequent_lengths(docs: DataFrame, *, sample_rows: int = 1024, size: int = 32_768, path: str = BYTE_BPE, ranks: str | None = BYTE_RANKS) -> FrequentLengths:
    """The table's pre-tokens come from at most ``sample_rows`` texts of at most SAMPLE_CHARS characters. They decide only which lookups are answered
    without encoding; every count is the same whatever the table holds."""

    seen: Counter[str] = Counter()
    # Taken from the first partitions that have enough rows; a limit inside the plan would gather rows of every task.
    for row in docs.select("text").filter(F.length("text") <= SAMPLE_CHARS).limit(sample_rows).collect():
        seen.update(row.text.split(" ")[1:])
    chunks = [k for k, _ in seen.most_common(2 * size) if k and not k[0].isspace() and not k[-1].isspace() and len(k) <= CACHE_CHARS][:size]
    encoder = byte_encoder(path, ranks)
    return FrequentLengths({k: len(encoder.ids_of(" " + k)) for k in chunks})


def token_counts(docs: DataFrame, *, limit: int = 512, path: str = BYTE_BPE, ranks: str | None = BYTE_RANKS, table: FrequentLengths | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text; further columns are ignored).

    Null or empty text: 0 bytes, 0 tokens. Repeated rows and null ids give a row each; an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(table or frequent_lengths(docs, path=path, ranks=ranks))

    def count(batches):
        encoder = byte_encoder(path, ranks)
        misses = encoder.__dict__.setdefault("lengths", _Chunks(lambda t: len(encoder.ids_of(t))))

        class Lengths(dict):
            __missing__ = staticmethod(misses.__getitem__)

        lengths = Lengths(shared.value.unrolled())
        get = lengths.__getitem__
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes, n_tokens = [], []
            for text in texts:
                n_bytes.append(len(text.encode()) if text else 0)
                head, *rest = (text or "").split(" ")
                try:
                    if rest and (not head or head[-1].isspace()):
                        raise _Uneven
                    n_tokens.append((len(encoder.ids_of(head)) if head else 0) + sum(map(get, rest)))
                except _Uneven:
                    n_tokens.append(len(encoder.encode(text)) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
