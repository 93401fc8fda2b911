"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is the multiset of its runs of five words, a weighted set. Darts fall on each unit of weight of each element, at a
rate that reaches every coordinate of the signature whatever the text's size; a dart's coordinate and rank come from its
hash, and each coordinate keeps its earliest dart. Two texts share a coordinate's dart with a probability equal to the
generalised Jaccard similarity of their weighted sets.

Texts that share a band of coordinates are compared, exactly, with two centres per bucket instead of with each other; the
centres are drawn anew in every band. Where a bucket's texts are then not all of one component, texts of different components
meet in blocks, and those that seem alike by their sketches (a byte of every coordinate, and the least hashes of their
elements) are compared exactly too. A bucket of very many texts of different components is divided first by the texts' sizes:
texts whose sizes differ too much to be alike need not meet, all others do. The few late links are then added to the components, not to the links.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.graph import connected_components
from muralis.llm.batches import pieces, tidy
from muralis.storage import materialise, materialise_with, passing

#: Words of a shingle, and the similarity from which texts are near-duplicates.
SHINGLE = 5
SIMILARITY = 0.8
#: Bands and coordinates of a band. At similarity 0.8 a pair shares no band once in 30,000 times.
BANDS = 26
ROWS = 5
#: Coordinates in which two sketches must agree. At similarity 0.8 a pair has 104 of 130 on average, and fewer than 80 once in
#: a million times.
AGREEING = 80
#: Least hashes of a text's elements that its sketch keeps: all of a short text's. Of longer ones, they tell the similarity with
#: a standard error of less than 0.009, and five of those errors are allowed for.
LEAST = 2048
#: Texts of a bucket that meet others together, those of a group of them that a worker holds at once, and units that it compares at once.
BLOCK = 64
TILE = 1024
UNITS = 16_384
#: A bucket with more pairs of different components than so many texts have is divided by the texts' sizes.
HOT = 2048
#: Word hashes a worker remembers.
CACHE_WORDS = 100_000

# Thai to Khmer, kana, Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _poisson() -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts on a unit of area."""
    terms = np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1, 16))))
    return np.cumsum(terms)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the text's runs of SHINGLE words (all its words, if fewer), and how often each occurs. Characters of scripts
    that don't space their words count as words."""
    words = _UNSPACED.sub(r" \g<0> ", (text or "").lower()).split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.array(list(map(_words.__getitem__, words)), np.uint64)
    size = min(SHINGLE, len(h))
    runs = np.full(len(h) - size + 1, _U(size))
    for k in range(size):
        runs = _mixed(runs * _GOLDEN + h[k : len(h) - size + 1 + k])
    return np.unique(runs, return_counts=True)


def dart_signature(elements: np.ndarray, weights: np.ndarray, coordinates: int) -> np.ndarray:
    """The earliest dart of every coordinate, as hashes."""
    first = np.cumsum(weights) - weights
    copy = (np.arange(int(weights.sum())) - np.repeat(first, weights)).astype(np.uint64)
    units = _mixed(np.repeat(elements, weights) + copy * _GOLDEN)
    out, filled = np.zeros(coordinates, np.uint64), np.zeros(coordinates, bool)
    reach, cell = coordinates * (np.log(coordinates) + 2) / len(units), 0
    while True:
        cells = np.arange(cell, int(np.ceil(reach)), dtype=np.uint64)
        areas = _mixed(units[None, :] ^ _mixed(cells + _U(1))[:, None]).ravel()
        counts = np.searchsorted(_poisson(), (areas >> _U(11)).astype(np.float64) * 2.0**-53, "right")
        darts = np.repeat(areas, counts)
        nth = np.arange(len(darts)) - np.repeat(np.cumsum(counts) - counts, counts)
        darts = _mixed(darts + (nth + 1).astype(np.uint64) * _GOLDEN)
        # Earlier cells come first, so ranks of later cells never win a filled coordinate.
        rank = np.repeat(np.repeat(cells.astype(np.float64), len(units)), counts) + (_mixed(darts) >> _U(11)).astype(np.float64) * 2.0**-53
        order = np.argsort(-rank, kind="stable")
        place = (darts[order] % _U(coordinates)).astype(np.int64)
        keep = ~filled[place]
        out[place[keep]] = darts[order][keep]  # of several, the last one written has the least rank
        filled[place] = True
        if filled.all():
            return out
        cell, reach = int(np.ceil(reach)), 2 * np.ceil(reach)


def least_hashes(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The LEAST smallest of the hashes of a weighted set's units, ascending."""
    first = np.cumsum(weights) - weights
    copy = (np.arange(int(weights.sum())) - np.repeat(first, weights)).astype(np.uint64)
    return np.unique(_mixed(np.repeat(elements, weights) + copy * _GOLDEN))[:LEAST]


def seem_alike(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether the least hashes a[i[k]] and b[j[k]] admit a similarity of ``threshold``, and whether they leave no doubt of it, for each k.
    Of texts whose units are all kept, they tell the similarity itself."""
    rows = [*a, *b]
    sizes = np.array([len(r) for r in rows])
    _, code = np.unique(np.concatenate(rows), return_inverse=True)
    order, of = np.argsort(code, kind="stable"), np.repeat(np.arange(len(rows)), sizes)
    code, of = code[order], of[order]
    meets = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(code[-1]) + 1, UNITS):  # so many different units at once
        part = slice(*np.searchsorted(code, (low, low + UNITS)))
        marks = np.zeros((len(rows), UNITS), np.float32)
        marks[of[part], code[part] - low] = 1
        meets += marks[: len(a)] @ marks[len(a) :].T
    both = meets[i, j]
    full = sizes >= LEAST
    total, allowed = (sizes[i] + sizes[len(a) + j]).astype(np.float64), np.zeros(len(i))
    for k in np.flatnonzero(full[i] | full[len(a) + j]).tolist():  # cut at the hash up to which both are whole
        x, y = a[i[k]], b[j[k]]
        cut = min(r[-1] for r in (x, y) if len(r) >= LEAST)
        total[k] = np.searchsorted(x, cut, "right") + np.searchsorted(y, cut, "right")
        allowed[k] = 5 * (threshold * (1 - threshold) / LEAST) ** 0.5
    return both >= (threshold - allowed) * (total - both), both >= (threshold + allowed) * (total - both)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of links between components a[k] and b[k], the first ones that join them as all do."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := root(x)) != (y := root(y)):
            parent[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def bands_of(signature: np.ndarray) -> np.ndarray:
    grid = signature.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1).astype(np.uint64) * _GOLDEN
    for k in range(ROWS):
        h = _mixed(h * _GOLDEN + grid[:, k])
    return h.view(np.int64)


def likeness(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> float:
    """Generalised Jaccard similarity of two weighted sets: sorted elements and their weights."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    total = int(n.sum()) + int(m.sum()) - both
    return both / total if total else 0.0


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("name"), F.coalesce("text", F.lit("")).alias("text"))


def verified_links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (a, b) those whose weighted sets are alike, each compared once; written."""

    @tidy
    def compare(batches):
        for batch in batches:
            cols = [batch.column(k) for k in range(2, 6)]
            alike = [likeness(np.array(a, np.int64), np.array(n), np.array(b, np.int64), np.array(m)) >= threshold for a, n, b, m in zip(*(c.to_numpy(zero_copy_only=False) for c in cols), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    wide = pairs.distinct().join(sets.toDF("a", "a_set", "a_n"), "a").join(sets.toDF("b", "b_set", "b_n"), "b").select("a", "b", "a_set", "a_n", "b_set", "b_n")
    return materialise(wide.mapInArrow(compare, "a long, b long"), "links")


def mixed_members(members: DataFrame) -> tuple[DataFrame, dict]:
    """``members`` (bucket, key, component) of buckets with several components, with n, mains, main and hot; and how many such
    buckets, and hot ones, there are.

    ``main``: of the bucket's largest component, which has ``mains`` members. ``hot``: the bucket has more pairs of different components than HOT texts.
    """
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top"))
    hot = ((F.col("n") - F.col("top.c")) * F.col("n") > HOT * HOT).alias("hot")
    # Written, so that the join's sides are plain shuffles, which Spark splits at a bucket of very many texts.
    stats, state = materialise_with(counts.filter("top.c < n").select("bucket", "n", F.col("top.c").alias("mains"), F.col("top.component").alias("largest"), hot), "mixed", buckets=F.count("*"), hot=F.count_if("hot"))
    mixed = members.join(stats, "bucket").select("bucket", "key", "component", "n", "mains", (F.col("component") == F.col("largest")).alias("main"), "hot")
    return mixed, state


def divided(members: DataFrame) -> DataFrame:
    """``members`` (bucket, key, component) by pairs of their buckets instead: at most BANDS * (BANDS - 1) / 2 rows a text. Members that share one
    bucket only don't meet, so ``near_duplicate_classes`` takes ``sized`` instead."""
    own = members.groupBy("key", "component").agg(F.array_sort(F.collect_set("bucket")).alias("own"))
    pairs = F.expr("explode(flatten(transform(own, (x, i) -> transform(slice(own, i + 2, size(own)), y -> xxhash64(x, y)))))")
    return own.select(pairs.alias("bucket"), "key", "component")


def sized(members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """``members`` (bucket, key, component) by classes of their sizes (key, size) within their buckets: two rows a member. Sizes of alike texts differ
    by a factor of at most 1 / ``threshold``, the width of a class, so that alike texts are in one class or in neighbouring ones."""
    width = max(-math.log(threshold), 1e-6) * (1 + 1e-9) if threshold > 0 else math.inf
    of = F.floor(F.log(F.col("size").cast("double")) / width).cast("long")
    listed = members.join(sizes, "key").withColumn("class", F.explode(F.array(of, of + 1)))
    return listed.select(F.xxhash64("bucket", "class").alias("bucket"), "key", "component")


def tiles(members: DataFrame) -> DataFrame:
    """``members`` (bucket, key, component, n, mains, main) by the tiles in which they meet: bucket, tile, side, inner, key, component.

    A bucket's members of the main component and its others are dealt to groups of about TILE. A group of the others (side 1) meets every group
    of the main component (side 0), itself with the first of these (``inner``), and the other groups of the others in tiles of their own. So each
    pair that is not of the main component alone meets in one tile, and a member has a row for each group that its own one meets.
    """
    c = F.col
    mains, others = (c("mains"), c("n") - c("mains")) if "mains" in members.columns else (c("n"), c("n"))
    groups = members.withColumn("gm", F.ceil(mains / TILE).cast("int")).withColumn("go", F.ceil(others / TILE).cast("int"))
    groups = groups.withColumn("g", F.pmod(F.xxhash64("key"), F.when(c("main"), c("gm")).otherwise(c("go"))).cast("int"))
    of_main = "transform(sequence(0, go - 1), h -> struct(g * go + h as tile, 0 as side, g = 0 as inner))"
    of_others = "transform(sequence(0, gm - 1), m -> struct(m * go + g as tile, 1 as side, m = 0 as inner))"
    among_others = "transform(filter(sequence(0, go - 1), h -> h <> g), h -> struct(gm * go + least(g, h) * go + greatest(g, h) as tile, if(g < h, 0, 1) as side, false as inner))"
    return groups.select("bucket", F.expr(f"explode(if(main, {of_main}, concat({of_others}, {among_others})))").alias("t"), "key", "component").select("bucket", "t.*", "key", "component")


def likely_pairs(members: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of ``members`` (bucket, key, component, n, mains, main) of different components that may be alike.

    Members meet in ``tiles``, and there in blocks of BLOCK; a task reads its tiles one after the other, so large groups are not joined with
    themselves. Pairs that ``sketches`` (key, sketch, least) show to be unlike are left out, and of those that they leave no doubt of, two
    blocks give as many as join their components.
    """

    def meet(sketch: list[np.ndarray], least: list[list], component: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        open_ = component[x][:, None] != component[y][None, :]
        i, j = np.nonzero(np.triu(open_, 1) if same else open_)
        good = np.concatenate([(sketch[x[i[at : at + BLOCK]]] == sketch[y[j[at : at + BLOCK]]]).sum(1) >= AGREEING for at in range(0, len(i), BLOCK)]) if len(i) else np.zeros(0, bool)
        i, j = i[good], j[good]
        if len(i):
            good, sure = seem_alike([least[k] for k in x], [least[k] for k in y], i, j, threshold)
            good, sure = np.flatnonzero(good & ~sure), np.flatnonzero(sure)
            take = np.concatenate([good, sure[spanning(component[x][i[sure]], component[y][j[sure]])]])
            i, j = i[take], j[take]
        return x[i], y[j]

    def of_tile(rows: pa.RecordBatch) -> pa.RecordBatch:
        component, side, key = (rows.column(k).to_numpy() for k in ("component", "side", "key"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        least = [np.frombuffer(v, np.uint64) for v in rows.column("least").to_pylist()]
        first, second = ([np.flatnonzero(side == s)[at : at + BLOCK] for at in range(0, int((side == s).sum()), BLOCK)] for s in (0, 1))
        found = [meet(sketch, least, component, x, y, False) for x in first for y in second]
        if rows.column("inner")[0].as_py():
            found += [meet(sketch, least, component, x, y, i == 0) for k, x in enumerate(second) for i, y in enumerate(second[k:])]
        a, b = (key[np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)])] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    @tidy
    def pick(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if rest and (rest[0].column(0)[0], rest[0].column(1)[0]) != (batch.column(0)[at], batch.column(1)[at]):
                    yield of_tile(pa.concat_batches(rest))
                    rest = []
                rest.append(batch.slice(at, end - at))
        if rest:
            yield of_tile(pa.concat_batches(rest))

    dealt = tiles(members).join(sketches, "key").select("bucket", "tile", "side", "inner", "key", "component", "sketch", "least")
    found = dealt.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "key").mapInArrow(pick, "a long, b long")
    setting, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", members.sparkSession.conf
    before = conf.get(setting)
    conf.set(setting, min(TILE, int(before)) if int(before) > 0 else TILE)  # these rows are large
    try:
        return materialise(found, "pairs")
    finally:
        conf.set(setting, before)


def near_duplicate_classes(docs: DataFrame, *, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_copies, first, text_md5 for every row of ``docs`` (doc_id, text): the smallest doc_id of its class, the rows that have the
    very same text, and whether the row's doc_id and text are the class's first in order (of one class, all such rows are equal in both).

    A class holds texts that links of at least ``threshold`` similarity connect, and their exact copies. Null counts as
    empty, and texts without words are alike to exact copies only. Rows that share a doc_id follow their own texts. A row
    without a doc_id keeps null as its class, joins nobody and is its own first. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    named = _hashed(docs.select("doc_id", "text").filter("doc_id is not null"))

    @tidy
    def sign(batches):
        for batch in pieces(batches):
            bands, sketches = [], []
            for text in batch.column(2).to_pylist():
                elements, weights = shingles(text)
                signature = dart_signature(elements, weights, BANDS * ROWS) if len(elements) else None
                bands.append([] if signature is None else bands_of(signature).tolist())
                sketches.append(None if signature is None else _mixed(signature).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "name", "bands", "sketch"])

    # Only the classes are needed once they are written.
    with passing(docs.sparkSession):
        signed = named.mapInArrow(sign, f"doc_id {kind}, name binary, bands array<long>, sketch binary")
        # One row per distinct text, with a key of its own; copies meet in the partial step already.
        texts = signed.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        texts = materialise(texts.withColumn("key", F.monotonically_increasing_id()), "texts")
        banded = texts.select("key", F.explode("bands").alias("bucket"))
        draw = F.struct(F.xxhash64("bucket", "key"), "key")  # by bucket, so that the buckets that a pair shares offer it different centres
        shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(draw)["key"].alias("centre"), F.max(draw)["key"].alias("other")).filter("n > 1")
        buckets = materialise(banded.join(shared, "bucket").select("bucket", "key", "n", "centre", "other"), "buckets")

        @tidy
        def sets_of(batches):
            for batch in pieces(batches):
                found = [shingles(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.view(np.int64) for e, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int32())), pa.array([least_hashes(e, n).tobytes() for e, n in found], pa.binary())], ["key", "elements", "weights", "least"])

        # Written, so that Spark can split the join at a text of very many copies.
        wanted = materialise(texts.select("key", "name").join(buckets.select("key").distinct(), "key", "left_semi"), "wanted")
        found = named.select("name", "text").join(wanted.hint("merge"), "name").groupBy("key").agg(F.min("text").alias("text"))
        sets = materialise(found.mapInArrow(sets_of, "key long, elements array<long>, weights array<int>, least binary"), "sets")
        weighted = sets.drop("least")
        faced = buckets.select("key", F.explode(F.array("centre", "other")).alias("centre")).filter("key <> centre")
        links = verified_links(faced.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")), weighted, threshold)
        linked = materialise(connected_components(links).withColumnRenamed("id", "key"), "linked")

        members = buckets.filter("n > 2").join(linked, "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
        mixed, state = mixed_members(materialise(members, "members"))
        if state["buckets"]:
            cold = mixed.filter("not hot").drop("hot")
            if state["hot"]:
                sizes = weighted.select("key", F.aggregate("weights", F.lit(0).cast("long"), lambda s, n: s + n).alias("size"))
                cold = cold.unionByName(mixed_members(materialise(sized(mixed.filter("hot").select("bucket", "key", "component"), sizes, threshold), "members"))[0].drop("hot"))
            sketches = texts.select("key", "sketch").join(sets.select("key", "least"), "key")
            late = verified_links(likely_pairs(cold, sketches, threshold), weighted, threshold)
            if not late.isEmpty():
                of = linked.select("key", "component")
                ends = late.join(of.toDF("a", "a_component"), "a", "left").join(of.toDF("b", "b_component"), "b", "left")
                joined = connected_components(ends.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")))
                # Each end of a late link has its component's new number; all others keep theirs.
                every = linked.unionByName(joined.select(F.col("id").alias("key"), F.col("id").alias("component"))).groupBy("key").agg(F.min("component").alias("component"))
                linked = materialise(every.join(joined.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left").select("key", F.coalesce("whole", "component").alias("component")), "linked")

        first = F.min(F.struct("doc_id", "name")).alias("first")
        known = texts.select("name", "doc_id", "n_copies", "key").join(linked, "key", "left")
        firsts = known.filter("component is not null").groupBy("component").agg(first)
        labelled = known.join(firsts, "component", "left").select("name", "n_copies", F.coalesce("first", F.struct("doc_id", "name")).alias("head"))
        # Written, so that Spark can split the join at a text of very many copies.
        labelled = materialise(labelled, "classes", lasts=True)
    rows = named.select("doc_id", "name").join(labelled, "name").select("doc_id", F.col("head.doc_id").alias("class_id"), F.col("n_copies").cast("long").alias("n_copies"), (F.struct("doc_id", "name") == F.col("head")).alias("first"), F.lower(F.hex("name")).alias("text_md5"))
    alone = docs.filter("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("first"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    return rows.unionByName(alone)

