"""Document fingerprints by consistent weighted sampling.

A document is the multiset of its terms: words, and the pieces of long ones. Each of the fingerprint's coordinates draws one
(term, level) sample with gamma variables that depend on the term alone, so two documents agree in a coordinate with a
probability equal to their generalised Jaccard similarity: the sum of the terms' smaller counts over that of their larger ones.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coordinates of a fingerprint, each kept as 16 bits.
COORDINATES = 128
#: (term, count) pairs that a worker remembers; half a kilobyte each.
CACHE_ROWS = 120_000
#: A word is one term; of a longer one, each of its overlapping pieces of so many characters is.
GRAM = 12
#: Terms sampled at once: few enough for the processor's cache.
TERMS = 256
#: Quantiles of a table of the gamma distribution, and steps of ln(a) within a key.
_QUANTILES = 1 << 16
_STEPS = 1 << 14


def words_of(text: str | None) -> Counter[str]:
    """The text's terms and their counts."""
    out = Counter((text or "").lower().split())
    for word in [w for w in out if len(w) > GRAM]:
        n = out.pop(word)
        for k in range(len(word) - GRAM + 1):
            out[word[k : k + GRAM]] += n
    return out


@lru_cache(maxsize=1)
def _gamma_quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), and their logarithms."""
    p = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    low, high = np.zeros(_QUANTILES), np.full(_QUANTILES, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = -np.expm1(-middle) - middle * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low.astype(np.float32), np.log(low).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """A row of 32-bit keys per weighted term; the smallest key of a coordinate over all rows is the document's sample.

    With r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) by term and coordinate: t = floor(ln(weight) / r + b) and
    ln(a) = ln(c) - r (t - b) - r. The upper 20 bits of a key order by ln(a), the lower 12 help to identify (term, t).
    """
    gamma, log_gamma = _gamma_quantiles()
    x = (hashes[:, None] ^ (np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    parts = x.view(np.uint16).reshape(len(hashes), coordinates, 4)  # r, c, b and the element draw on 16 bits each
    r = gamma[parts[..., 0]]
    b = (parts[..., 2].astype(np.float32) + np.float32(0.5)) * np.float32(2**-16)
    element = parts[..., 3].astype(np.uint32)
    level = 1 - b  # t - b + 1, where t is 0: always for a term that occurs once
    more = np.flatnonzero(weights > 1)
    if len(more):
        t = np.floor(np.log(weights[more].astype(np.float32))[:, None] / r[more] + b[more])
        level[more] += t
        element[more] += t.astype(np.uint32) * np.uint32(2654435761)
    log_a = log_gamma[parts[..., 1]] - r * level
    order = np.clip((log_a + np.float32(48)) * np.float32(_STEPS), 0, 64 * _STEPS - 1).astype(np.uint32)
    return order << np.uint32(12) | (element ^ element >> np.uint32(12)) & np.uint32(0xFFF)


def _folded(keys: np.ndarray) -> np.ndarray:
    """16 bits of each key."""
    x = (keys ^ keys >> np.uint32(16)) * np.uint32(0x7FEB352D)
    return ((x ^ x >> np.uint32(15)) * np.uint32(0x846CA68B) >> np.uint32(16)).astype(np.uint16)


class Sampler:
    """Fingerprints of word counts, with a bounded memory of the rows of words met before."""

    def __init__(self, coordinates: int = COORDINATES, rows: int = CACHE_ROWS):
        self.coordinates, self.keys = coordinates, np.empty((rows, coordinates), np.uint32)
        self.index: dict[tuple[str, int], int] = {}

    def _learn(self, items: set[tuple[str, int]]) -> None:
        fresh = list(items - self.index.keys())
        if len(self.index) + len(fresh) > len(self.keys):
            self.index.clear()
            fresh = list(items)
        for k in range(0, len(fresh), TERMS):
            part = fresh[k : k + TERMS]
            at = len(self.index)
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w, _ in part], np.uint64)
            self.keys[at : at + len(part)] = samples(hashes, np.array([n for _, n in part]), self.coordinates)
            self.index.update(zip(part, range(at, at + len(part)), strict=True))

    def fingerprints(self, counts: list[Counter[str]]) -> np.ndarray:
        """16-bit coordinates, a row per document; 0 throughout for one without words."""
        out = np.full((len(counts), self.coordinates), np.uint32(2**32 - 1))
        step = len(self.keys) // 2
        pending: list[tuple[int, list[tuple[str, int]]]] = []
        held: set[tuple[str, int]] = set()

        def flush() -> None:
            self._learn(held)
            for row, items in pending:
                for k in range(0, len(items), 1024):
                    found = np.take(self.keys, list(map(self.index.__getitem__, items[k : k + 1024])), axis=0)
                    np.minimum(out[row], found.min(axis=0), out=out[row])
            pending.clear()
            held.clear()

        for row, c in enumerate(counts):
            items = list(c.items())
            for k in range(0, len(items), step):
                part = items[k : k + step]
                if len(held) + len(part) > len(self.keys):
                    flush()
                pending.append((row, part))
                held.update(part)
        flush()
        elements = _folded(out)
        elements[[not c for c in counts]] = 0
        return elements


def likeness(a: np.ndarray, b: np.ndarray, empty_a: bool, empty_b: bool) -> float:
    return float(empty_a == empty_b) if empty_a or empty_b else float((a == b).mean())


def in_descending_runs(docs: DataFrame, runs: int) -> DataFrame:
    """``docs`` cut into ``runs`` ranges of doc_id; ``run`` is sorted by descending doc_id (then text) and followed by a copy of the row
    that comes after its last one: the first of the next range, or of all. What is gathered is one id per range."""
    spark = docs.sparkSession
    points = [k / runs for k in range(1, runs)]
    bounds = np.array(docs.agg(F.percentile_approx("doc_id", points, 10 * runs).alias("b")).first().b or [], np.int64) if points else np.array([], np.int64)

    def place(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        return np.where(null, 0, np.searchsorted(bounds, ids, "right") + 1)

    @F.pandas_udf("int")
    def run_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(place(doc_id.fillna(0).to_numpy(np.int64), doc_id.isna().to_numpy()))

    # max() is null only where all ids are, that is in run 0, whose rows then all tie.
    tops = {r.run: r.top for r in docs.select(run_of("doc_id").alias("run"), "doc_id").groupBy("run").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    receiver = {tops[run]: order[k - 1] for k, run in enumerate(order)}  # of the first: the last

    @F.pandas_udf("array<int>")
    def targets(doc_id: pd.Series) -> pd.Series:
        null = doc_id.isna().to_numpy()
        ids = doc_id.fillna(0).to_numpy(np.int64)
        own = place(ids, null).tolist()
        return pd.Series([[a, receiver[key]] if (key := None if n else i) in receiver else [a] for a, i, n in zip(own, ids.tolist(), null.tolist(), strict=True)])

    placed = docs.select("doc_id", "text", F.posexplode(targets("doc_id")).alias("copy", "run"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = F.array(*map(F.lit, _one_key_a_partition(spark, n)))
    dealt = placed.withColumn("lane", F.get(lanes, F.col("run") % n)).repartition(n, "lane").sortWithinPartitions("run", "copy", F.desc_nulls_last("doc_id"), "text")
    return dealt.select("doc_id", "text", "copy", "run")


def _one_key_a_partition(spark: SparkSession, n: int) -> list[int]:
    """n integers that Spark's hash partitioning into n parts deals to different parts, so that ranges spread evenly."""
    tried = spark.range(max(64, 16 * n * n.bit_length())).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("part")).agg(F.min("key").alias("key"))
    keys = [r.key for r in tried.collect()]
    return keys + list(range(n - len(keys)))


def edited(text: str, following: str) -> str:
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def fingerprint_documents(docs: DataFrame, *, coordinates: int = COORDINATES) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id long, text), of its edited text, and their likeness, see README.

    Null text counts as empty. Texts without words are alike among themselves (1) and unlike all others (0). Rows that
    share a doc_id follow each other by text; null ids come last. The only row of a table follows itself. An empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    runs = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def fingerprint(batches):
        sampler = Sampler(coordinates)
        last = None  # (doc_id, text) still without the row after it, and its run

        def digests(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
            counts = [c for _, text, following in pairs for c in (words_of(text), words_of(edited(text, following)))] + [words_of(pairs[-1][2])]
            prints = sampler.fingerprints(counts)
            rows = []
            for k, (doc, text, following) in enumerate(pairs):
                own, other = 2 * k, 2 * k + 1
                after = own + 2  # the row after, where the next pair begins with it
                if k + 1 < len(pairs) and pairs[k + 1][1] != following:
                    after = None
                next_print, next_count = (prints[after], counts[after]) if after is not None else (sampler.fingerprints([c := words_of(following)])[0], c)
                rows.append((doc, len(text), hashlib.sha256(edited(text, following).encode()).hexdigest(), prints[own].astype(">u2").tobytes().hex(), prints[other].astype(">u2").tobytes().hex(), likeness(prints[own], prints[other], not counts[own], not counts[other]), likeness(prints[own], next_print, not counts[own], not next_count)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            pairs: list[tuple[int, str, str]] = []
            size = 0
            for doc, text, copy, run in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if last is not None and last[2] == run:
                    pairs.append((last[0], last[1], text))
                    size += len(text)
                last = None if copy else (doc, text, run)
                if size > 400_000:
                    yield digests(pairs)
                    pairs, size = [], 0
            if pairs:
                yield digests(pairs)

    return in_descending_runs(docs, runs).mapInArrow(fingerprint, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
