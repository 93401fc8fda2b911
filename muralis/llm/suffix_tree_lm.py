"""Scores of texts by a probabilistic suffix tree over words.

A state of the tree is a context of zero, one or two words. It is retained if its own next-word distribution, left-one-out on
the training texts, codes what followed it by some nats shorter than its parent's, and it is smoothed towards the
parent by the weight that does so best. A word is scored by the longest retained suffix of the words before it.

Texts are cut once into chunks of about a million words, which are written with their words numbered. From then on a chunk asks and is
answered: first the vocabulary (one word, one bucket) for numbers and counts, then the tree (one last word, one
bucket) for the probabilities of its distinct runs of three words. Buckets hold all that is known of their key and follow the corpus
in number. Contexts that end in a very frequent word lie in several buckets, by a class of the word before it: what follows that word is counted
before, in buckets by a class of the word that follows, and its counts come with the runs. Savings are added in whole grains, so that no
score depends on how many buckets there are. Answers come in the order of the questions, so neither carries texts or rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.llm.batches import pieces
from muralis.storage import materialise, materialise_bucketed

#: Words of a chunk, about; bytes of a text that are split into words at once.
CHUNK, STRETCH = 1 << 20, 1 << 22
#: Training words of a bucket of the tree, on average.
BUCKET = 1_000_000
#: A last word with this share of a bucket's training words, or more, is divided into classes.
HOT_SHARE = 0.25
#: Weights of the parent among which left-one-out coding chooses, and the nats a state must save.
WEIGHTS, GAIN = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0), 4.0
#: Parts of a nat in which savings are added: sums of whole numbers, the same in any order.
GRAINS = 1 << 16
#: Columns of what a word saves, by weight.
SAVED = [f"saved{k}" for k in range(len(WEIGHTS))]
#: Number of the mark before the first word.
BEGIN = 0
#: Bits of a word's number within its chunk.
BITS = 21

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, by stretches; the last one ends with the end token (no bytes)."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while len(data) - at > STRETCH and (space := _SPACE.search(data, at + STRETCH)):
        yield data[at : space.start()].split()
        at = space.end()
    yield [*data[at:].split(), b""]


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit number."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def expanded(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: integers in the fewest whole bytes, plane by plane, so that they compress."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu":
            top = int(a.max(initial=0))
            width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
            a = a.astype(f"<u{width}")
        out.append((a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()))
    return compressed(pickle.dumps(out))


def spread(packed: bytes) -> list[np.ndarray]:
    out = []
    for kind, planes in pickle.loads(expanded(packed)):  # noqa: S301 - made by this job
        width = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)
        out.append(a.astype(np.int64) if a.dtype.kind in "iu" else a)
    return out


class Chunk:
    """Documents, or stretches of them: words numbered in order of appearance, two words of history before each piece."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b" "]  # the mark of the beginning: no word has a space
        self.runs: list[np.ndarray] = []
        self.texts: list[tuple] = []
        self.size = 0

    def add(self, row: int, doc: object, held: bool, before: list[bytes], words: list[bytes], whole: bool) -> None:
        run = np.fromiter(map(self.number.__getitem__, before + words), np.int32, len(before) + len(words))
        self.runs.append(run)
        self.texts.append((row, doc, held, whole, len(run)))
        self.size += len(run)

    def full(self) -> bool:
        return self.size >= CHUNK or len(self.number) >= 1 << (BITS - 1)

    def packed(self) -> bytes:
        return compressed(pickle.dumps((b"\n".join(self.number), self.texts, squeezed(np.concatenate(self.runs)))))


class Positions:
    """A chunk again, as arrays over its scored words w with the two words before, v and u; ``known`` is what it holds of its words."""

    def __init__(self, packed: bytes):
        self.known, self.texts, run = pickle.loads(expanded(packed))  # noqa: S301 - made by this job
        (tokens,) = spread(run)
        lengths = np.array([t[4] for t in self.texts])
        scored = np.ones(len(tokens), bool)
        starts = np.cumsum(lengths) - lengths
        scored[starts] = scored[starts + 1] = False
        at = np.flatnonzero(scored)
        self.u, self.v, self.w = tokens[at - 2], tokens[at - 1], tokens[at]
        self.sizes = lengths - 2
        self.learned = np.repeat([not t[2] for t in self.texts], self.sizes)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        ends = np.cumsum(self.sizes)
        sums = np.zeros(len(ends), values.dtype)
        some = self.sizes > 0
        if some.any():
            sums[some] = np.add.reduceat(values, (ends - self.sizes)[some])
        return sums


def word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    """The bucket of each word of a chunk, the mark of the beginning apart (-1)."""
    out = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    out[BEGIN] = -1
    return out


def ask_words(buckets: int):
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = Positions(body)
                words = p.known.split(b"\n")
                of, counts = word_buckets(words, buckets), np.bincount(p.w[p.learned], minlength=len(words))
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cuts))
                packed = [compressed(pickle.dumps((b"\n".join([words[i] for i in order[cuts[b] : cuts[b + 1]]]), squeezed(counts[order[cuts[b] : cuts[b + 1]]])))) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bucket", "payload"])

    return ask


def answer_words(buckets: int):
    """Number and training count of every word of a bucket, to each chunk that asks; and, without a chunk, the bucket's totals."""

    def answer(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("chunk").to_numpy(), kind="stable")
        bucket, chunks, payloads = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist(), table.column("payload").to_pylist()
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        asked, total = [], np.zeros(0, np.int64)
        for i in order:
            joined, counts = pickle.loads(expanded(payloads[i]))  # noqa: S301 - made by this job
            (n,) = spread(counts)
            index = np.fromiter(map(number.__getitem__, joined.split(b"\n")), np.int64, len(n))
            total = np.concatenate([total, np.zeros(len(number) - len(total), np.int64)])
            total[index] += n  # a chunk asks for a word once
            asked.append((chunks[i], index))
        replies = [squeezed(1 + index * buckets + bucket, total[index]) for _, index in asked]
        size = len(asked)
        return pa.table(
            [pa.array([c for c, _ in asked] + [None], pa.int64()), pa.array([bucket] * (size + 1), pa.int32()), pa.array([*replies, None], pa.binary()), pa.array([None] * size + [int(total.sum())], pa.int64()), pa.array([None] * size + [int((total > 0).sum())], pa.int64())],
            names=["chunk", "bucket", "payload", "tokens", "kinds"],
        )

    return answer


def number_words(word_parts: int):
    """A chunk with the numbers and counts of its words in the words' place."""

    def number(bodies: pa.Table, replies: pa.Table) -> pa.Table:
        joined, texts, run = pickle.loads(expanded(bodies.column("payload")[0].as_py()))  # noqa: S301 - made by this job
        of = word_buckets(joined.split(b"\n"), word_parts)
        numbers, counts = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(word_parts + 1))
        for b, reply in by_bucket(replies).items():
            at = order[cuts[b] : cuts[b + 1]]
            numbers[at], counts[at] = spread(reply)
        return pa.table([bodies.column("chunk"), pa.array([compressed(pickle.dumps((squeezed(numbers, counts), texts, run)))], pa.binary())], names=["chunk", "payload"])

    return number


def by_bucket(replies: pa.Table) -> dict[int, bytes]:
    return dict(zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True))


def divided(count: np.ndarray, hot: float) -> np.ndarray:
    """Whether a last word with ``count`` training occurrences lies in several buckets."""
    return (count >= 2) & (count >= hot)


def classes(u: np.ndarray, count: np.ndarray, hot: float) -> np.ndarray:
    """The class of the word u beside a last word with ``count`` training occurrences: 0 unless that reaches ``hot``."""
    return (mixed(u + 77) % (1 + np.floor(count / hot)).astype(np.uint64)).astype(np.int64)


def bucket_of(v: np.ndarray, kind: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a class of the last word v."""
    return (mixed(v * 1_000_003 + kind) % np.uint64(buckets)).astype(np.int64)


class Asked:
    """A chunk's distinct questions about its words, each with a v, dealt to buckets and sorted in them."""

    def __init__(self, p: Positions):
        self.p, self.mask = p, np.uint64((1 << BITS) - 1)
        self.id, self.count = spread(p.known)

    def dealt(self, asks: np.ndarray, words: list[np.ndarray], other: str, buckets: int, hot: float) -> None:
        """Distinct rows of ``words`` at the positions ``asks``; their v by a class of the word ``other``."""
        keys = np.zeros(len(asks), np.uint64)
        for x in words:
            keys = keys << np.uint64(BITS) | x[asks].astype(np.uint64)
        self.asks = asks
        self.keys, self.run = np.unique(keys, return_inverse=True)
        self.n = np.bincount(self.run, self.p.learned[asks], len(self.keys)).astype(np.int64)
        for k, name in enumerate("vwu"[: len(words)]):
            setattr(self, name, (self.keys >> np.uint64((len(words) - 1 - k) * BITS) & self.mask).astype(np.int64))
        v = self.id[self.v]
        self.bucket = bucket_of(v, classes(self.id[getattr(self, other)], self.count[self.v], hot), buckets)
        self.order = np.lexsort((self.id[self.w], v, self.bucket))

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        buckets, starts = np.unique(self.bucket[self.order], return_index=True)
        for b, at in zip(buckets.tolist(), np.split(self.order, starts[1:]), strict=False):
            yield b, at

    def packed(self, at: np.ndarray, *more: np.ndarray) -> bytes:
        """v once a run, the other words by their places among the slice's different words, and numbers by their rises."""
        v, starts, lengths = np.unique(self.v[at], return_index=True, return_counts=True)
        rise = np.argsort(starts)  # runs come by the number of v
        v, lengths = v[rise], lengths[rise]
        others = [x[at] for x in self.others]
        names, places = np.unique(np.concatenate([self.id[x] for x in others]), return_inverse=True)
        counts = np.zeros(len(names), np.int64)
        counts[places] = self.count[np.concatenate(others)]
        return squeezed(np.diff(self.id[v], prepend=0), self.count[v], lengths, np.diff(names, prepend=0), counts, *np.split(places, len(others)), self.n[at], *more)


def questions(table: pa.Table) -> tuple[list[int], list[list[np.ndarray]]]:
    """The chunks that ask and, of each: v, its count, the others' numbers and counts, and what else was packed."""
    chunks, payloads = table.column("chunk").to_pylist(), table.column("payload").to_pylist()
    out = []
    order = np.argsort(np.array(chunks), kind="stable").tolist()
    for i in order:
        v, v_count, lengths, names, counts, *rest = spread(payloads[i])
        out.append([np.repeat(np.cumsum(v), lengths), np.repeat(v_count, lengths), np.cumsum(names), counts, *rest])
    return [chunks[i] for i in order], out


class Pairs(Asked):
    """The distinct v, w of a chunk whose v is divided."""

    def __init__(self, p: Positions, buckets: int, hot: float):
        super().__init__(p)
        self.dealt(np.flatnonzero((p.v != BEGIN) & divided(self.count, hot)[p.v]), [p.v, p.w], "w", buckets, hot)
        self.others = [self.w]


class Questions(Asked):
    """The distinct runs u, v, w of a chunk whose v is a possible context."""

    def __init__(self, p: Positions, buckets: int, hot: float):
        super().__init__(p)
        # A context that was met once in training says nothing, left out once.
        self.dealt(np.flatnonzero((p.v != BEGIN) & (self.count[p.v] >= 2)), [p.v, p.w, p.u], "u", buckets, hot)
        self.others = [self.w, self.u]


def of_chunk(chunk: int, found: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([chunk] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["chunk", "bucket", "payload"])


def ask_pairs(buckets: int, hot: float):
    def ask(bodies: pa.Table) -> pa.Table:
        q = Pairs(Positions(bodies.column("payload")[0].as_py()), buckets, hot)
        return of_chunk(bodies.column("chunk")[0].as_py(), [(b, q.packed(at)) for b, at in q.slices()])

    return ask


def answer_pairs(total: int, kinds: int):
    """How often w follows v in training, to each chunk that asks; and, without a chunk, what each v saves by these w."""

    def answer(table: pa.Table) -> pa.Table:
        chunks, asked = questions(table)
        sizes = [len(a[0]) for a in asked]
        v, v_count, w, w_count, n = map(np.concatenate, zip(*((v, v_count, names[at], counts[at], n) for v, v_count, names, counts, at, n in asked), strict=True))
        ids, one = np.unique(v, return_inverse=True)
        _, w_at = np.unique(w, return_inverse=True)
        _, first, pair = np.unique(one << 32 | w_at, return_index=True, return_inverse=True)
        count = np.bincount(pair, n, len(first)).astype(np.int64)
        of_v = np.zeros(len(ids), np.int64)
        of_v[one] = v_count
        saved = savings(count, one[first], (w_count[first] + 1) / (total + kinds + 1), of_v).astype(np.int64)
        replies = [squeezed(c) for c in np.split(count[pair], np.cumsum(sizes)[:-1])]
        none, size = [None] * len(ids), len(chunks)
        return pa.table(
            [
                pa.array(chunks + none, pa.int64()), pa.array([table.column("bucket")[0].as_py()] * (size + len(ids)), pa.int32()), pa.array(replies + none, pa.binary()),
                *(pa.array([None] * size + x.tolist(), pa.int64()) for x in (ids, of_v, *saved)),
            ],
            names=["chunk", "bucket", "payload", "v", "v_count", *SAVED],
        )

    return answer


def deal_words(buckets: int, hot: float):
    """The weight of each divided word, and whether it is retained, to all buckets of its classes."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, *saved = (c.to_numpy() for c in batch.columns)
            weights, keeps = chosen(np.array(saved))
            for v, count, weight, keep in zip(ids.tolist(), counts.tolist(), weights.tolist(), keeps.tolist(), strict=True):
                kinds = np.arange(1 + int(np.floor(count / hot)))
                to = np.unique(bucket_of(np.full(len(kinds), v), kinds, buckets))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(pa.array([x] * len(to), t) for x, t in ((v, pa.int64()), (weight, pa.float64()), (keep, pa.bool_())))], ["bucket", "v", "weight", "keep"])

    return deal


def ask_runs(buckets: int, hot: float):
    def ask(bodies: pa.Table, replies: pa.Table) -> pa.Table:
        p = Positions(bodies.column("payload")[0].as_py())
        pairs, answers = Pairs(p, buckets, hot), by_bucket(replies)
        follows = np.zeros(len(pairs.keys), np.int64)
        for b, at in pairs.slices():
            (follows[at],) = spread(answers[b])
        keys = pairs.keys
        del pairs, answers
        q, found = Questions(p, buckets, hot), []
        known = divided(q.count, hot)
        for b, at in q.slices():
            v, w = q.v[at], q.w[at]
            some = np.flatnonzero(changes(v, w) & known[v])
            key = v[some].astype(np.uint64) << np.uint64(BITS) | w[some].astype(np.uint64)
            found.append((b, q.packed(at, follows[np.searchsorted(keys, key)])))
        return of_chunk(bodies.column("chunk")[0].as_py(), found)

    return ask


def changes(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether a row's v or w differs from the one before."""
    out = np.ones(len(v), bool)
    out[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    return out


def savings(count: np.ndarray, context: np.ndarray, parent: np.ndarray, total: np.ndarray) -> np.ndarray:
    """By weight, the grains that each context saves against its parent by these entries (a context and a word); ``total``: occurrences of each
    context. Left-one-out: each occurrence is coded by the counts of all others."""
    seen = np.flatnonzero(count > 0)
    c, s, p = count[seen], context[seen], parent[seen]
    return np.array([np.bincount(s, np.rint(GRAINS * c * np.log((c - 1 + x * p) / ((total[s] - 1 + x) * p))), len(total)) for x in WEIGHTS])


def chosen(saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parent's weight in each context, and whether the context is retained."""
    return np.array(WEIGHTS)[saved.argmax(axis=0)], saved.max(axis=0) >= GAIN * GRAINS


def smoothed(count: np.ndarray, context: np.ndarray, parent: np.ndarray, total: np.ndarray, weight: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each entry by its context, or its parent's where that is not retained; and which is."""
    own = (count + weight[context] * parent) / (total[context] + weight[context])
    return np.where(keep[context], own, parent), keep[context]


def retained(count: np.ndarray, context: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``smoothed`` for contexts all of whose entries are here."""
    total = np.bincount(context, count, int(context.max(initial=-1)) + 1)
    return smoothed(count, context, parent, total, *chosen(savings(count, context, parent, total)))


def answer_runs(total: int, kinds: int, hot: float):
    def answer(table: pa.Table, words: pa.Table) -> pa.Table:
        names = ["chunk", "bucket", "payload"]
        if not table.num_rows:
            return table.select(names)
        chunks, asked = questions(table)
        sizes, columns = [len(a[0]) for a in asked], []
        for v, v_count, numbers, counts, w, u, n, follows in asked:
            v_w = np.zeros(len(v), np.int64)
            v_w[changes(v, w) & divided(v_count, hot)] = follows
            columns.append((v, v_count, numbers[w], counts[w], numbers[u], n, v_w))
        v, v_count, w, w_count, u, n, v_w = map(np.concatenate, zip(*columns, strict=True))
        del asked, columns
        # The context of one word: v. Entries: pairs of a context and w. Those of a divided v are not all here: what all of them save was added before.
        ids, start, one = np.unique(v, return_index=True, return_inverse=True)
        _, w_at = np.unique(w, return_inverse=True)
        _, u_at = np.unique(u, return_inverse=True)
        pairs, first, pair = np.unique(one << 32 | w_at, return_index=True, return_inverse=True)
        base = (w_count[first] + 1) / (total + kinds + 1)
        of_v, apart = v_count[start], divided(v_count[start], hot)
        count = np.where(apart[one[first]], v_w[first], np.bincount(pair, n, len(pairs)))
        weight, keep = chosen(savings(count, one[first], base, of_v))
        at = np.searchsorted(ids, words.column("v").to_numpy())
        at, here = np.minimum(at, len(ids) - 1), ids[np.minimum(at, len(ids) - 1)] == words.column("v").to_numpy()
        weight[at[here]] = words.column("weight").to_numpy()[here]
        keep[at[here]] = words.column("keep").to_numpy(zero_copy_only=False)[here] if words.num_rows else False
        by_one, kept_one = smoothed(count, one[first], base, of_v, weight, keep)
        # The context of two words: u and v. Entries: runs of a pair and u.
        _, two = np.unique(one << 32 | u_at, return_inverse=True)
        runs, first, run = np.unique(pair << 32 | u_at, return_index=True, return_inverse=True)
        by_two, kept_two = retained(np.bincount(run, n, len(runs)), two[first], by_one[pair[first]])
        flag = (kept_one[pair[first]] | kept_two)[run]
        score = np.log10(by_two)[run].astype(np.float32)
        ends = np.cumsum(sizes)[:-1]
        replies = [squeezed(np.packbits(f), s[f]) for f, s in zip(np.split(flag, ends), np.split(score, ends), strict=True)]
        return pa.table([pa.array(chunks, pa.int64()), pa.array([table.column("bucket")[0].as_py()] * len(chunks), pa.int32()), pa.array(replies, pa.binary())], names=names)

    return answer


def score_chunks(buckets: int, hot: float, total: int, kinds: int, doc_type: pa.DataType):
    def score(bodies: pa.Table, replies: pa.Table) -> pa.Table:
        runs = by_bucket(replies)
        q = Questions(Positions(bodies.column("payload")[0].as_py()), buckets, hot)
        known = q.count[q.p.w]
        base = np.log10((known + 1) / (total + kinds + 1))
        best = np.full(len(q.v), np.nan)
        for b, at in q.slices():
            bits, values = spread(runs[b])
            flag = np.unpackbits(bits.astype(np.uint8))[: len(at)].astype(bool)
            best[at[flag]] = values
        scores = base.copy()
        if len(q.asks):
            by_tree = best[q.run]
            has = ~np.isnan(by_tree)
            scores[q.asks[has]] = by_tree[has]
        p = q.p
        texts = list(zip(*p.texts, strict=True))
        return pa.table(
            [
                pa.array(texts[0], pa.int64()), pa.array(texts[1], doc_type), pa.array(texts[2], pa.bool_()), pa.array(texts[3], pa.bool_()), pa.array(p.sizes, pa.int64()),
                pa.array(p.per_text((known > 0).astype(np.int64))), pa.array(p.per_text(base)), pa.array(p.per_text(scores)),
            ],
            names=["row", "doc_id", "held_out", "whole", "n_tokens", "n_known", "base_score", "score"],
        )

    return score


def lm_scores(docs: DataFrame, *, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_fold`` are scored but not learned from; a null id is learned from. Null
    and empty texts have the end token alone. Repeated rows are learned from as often as they come and get a row each. Very long texts
    are read in stretches. A word that training lacks counts as one unknown kind. The score is rounded to 24 bits a word.
    Without a training text every score is 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        chunk, serial, row = Chunk(), 0, first

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first + serial], pa.int64()), pa.array([chunk.packed()], pa.binary())], ["chunk", "payload"])

        for batch in pieces(batches):
            for doc, text, is_held in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                before = [b" ", b" "]
                for k, words in enumerate(words_of(text)):
                    at = 0
                    while at < len(words):
                        part = words[at : at + CHUNK]
                        chunk.add(row, doc, is_held, before, part, whole=k == 0 and at == 0 and len(part) == len(words) and words[-1] == b"")
                        before, at = (before + part)[-2:], at + CHUNK
                        if chunk.full():
                            yield written()
                            chunk, serial = Chunk(), serial + 1
                row += 1
        if chunk.texts:
            yield written()

    # A chunk meets its answers several times; bucketed by its number it does not move for that.
    word_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts, drop_texts = materialise_bucketed(rows.mapInArrow(cut, "chunk long, payload binary"), "lm_chunks", "chunk", word_parts)
    message = "chunk long, bucket int, payload binary"
    asked = texts.mapInArrow(ask_words(word_parts), message)
    words = materialise(asked.groupBy("bucket").applyInArrow(answer_words(word_parts), message + ", tokens long, kinds long"), "lm-words")
    facts = words.filter("chunk is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    buckets = max(word_parts, -(-facts.n // BUCKET))
    hot = max(1.0, HOT_SHARE * facts.n / buckets)

    def by_chunk(df: DataFrame):
        return df.filter("chunk is not null").select("chunk", "bucket", "payload").groupBy("chunk")

    bodies, drop = materialise_bucketed(texts.groupBy("chunk").cogroup(by_chunk(words)).applyInArrow(number_words(word_parts), "chunk long, payload binary"), "lm_chunks", "chunk", word_parts)
    drop_texts()
    sums = ", ".join(f"{c} long" for c in ("v", "v_count", *SAVED))
    pairs = materialise(bodies.groupBy("chunk").applyInArrow(ask_pairs(buckets, hot), message).groupBy("bucket").applyInArrow(answer_pairs(facts.n, facts.v), f"{message}, {sums}"), "lm-pairs")
    states = pairs.filter("chunk is null").groupBy("v").agg(F.max("v_count").alias("v_count"), *(F.sum(c).alias(c) for c in SAVED))
    states = states.mapInArrow(deal_words(buckets, hot), "bucket int, v long, weight double, keep boolean")
    runs = bodies.groupBy("chunk").cogroup(by_chunk(pairs)).applyInArrow(ask_runs(buckets, hot), message)
    # Read once, by the scoring below: not written.
    tree = runs.groupBy("bucket").cogroup(states.groupBy("bucket")).applyInArrow(answer_runs(facts.n, facts.v, hot), message)
    doc_type = pa_type(docs)
    fields = f"row long, doc_id {kind}, held_out boolean, whole boolean, n_tokens long, n_known long, base_score double, score double"
    scored = materialise(bodies.groupBy("chunk").cogroup(by_chunk(tree)).applyInArrow(score_chunks(buckets, hot, facts.n, facts.v, doc_type), fields), "lm-scores")
    drop()
    # Only texts that were read in stretches are put together; the others' rows are whole.
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    long_texts = scored.filter("not whole").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    out = scored.filter("whole").select(columns).union(long_texts.select(columns))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts.n).cast("long").alias("train_tokens"), "base_score", "score")


def pa_type(docs: DataFrame) -> pa.DataType:
    """The Arrow type of doc_id."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
