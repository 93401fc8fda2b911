"""Suffix-array deduplication of repeated 200-byte strings.

1. Every start of a 200-byte window is tied to an anchor: the 80-byte string of least hash within the window. Equal
   windows have equal anchors at equal distances, so a window can repeat only where its anchor does.
2. Anchors are counted by hash (combined before the shuffle). Where an anchor repeats, the stretch of text that covers the
   windows tied to it is its *context*. Equal contexts are counted by hash, and one of each goes to the task of its anchor,
   unless all contexts of the anchor are equal: then there is nothing to sort, for all of their windows repeat.
3. Each anchor's distinct contexts form a text whose suffix array is built by linear grouping construction. Windows are
   equal where neighbours among the window starts in that order share 200 bytes.
4. Anchors with many occurrences are salted by content: equal contexts stay together, and each part reports one row for
   each distinct window; windows reported by two parts repeat as well. No group is gathered whole.
5. The repeated starts return to the contexts' occurrences and then to the documents.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.llm.batches import pieces, tidy
from muralis.llm.suffix_sort import suffix_arrays
from muralis.storage import materialise

#: Bytes of a repeated string.
WINDOW = 200
#: Bytes of an anchor; a window holds WINDOW - ANCHOR + 1 of them.
ANCHOR = 80
#: Occurrences of an anchor beyond which it is salted, and about how many of them a part then takes.
SALT_ABOVE = 2048
SALT_ROWS = 256
#: Bytes hashed at once (few enough for the processor's cache), text held by a task for sorting, and text sorted at once.
BUFFER = 256_000
HELD = 8_000_000
SORTED = 1_500_000

_U = np.uint64
_INDEX_BITS = 26


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(maxsize=2)
def _symbols(seed: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | _U(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def rolling(buffer: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """A hash of each ``width`` bytes of ``buffer``."""
    n = len(buffer)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(19, (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_symbols(seed)[buffer] * down[:n], out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * up[: n - width + 1])


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    held = 1
    while held * 2 <= width:
        x = np.minimum(x[:-held], x[held:])
        held *= 2
    return x if held == width else np.minimum(x[: len(x) - (width - held)], x[width - held :])


def anchored_runs(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of windows tied to one anchor occurrence: the text's index, the anchor's hash, the first start, and the
    number of starts."""
    sizes = np.array([len(r) for r in raws], np.int64)
    buffer = np.frombuffer(b"".join(raws), np.uint8)
    h = rolling(buffer, ANCHOR)
    if len(h) < WINDOW - ANCHOR + 1:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    mask = _U((1 << _INDEX_BITS) - 1)
    # The leftmost of equal hashes wins: the position breaks ties.
    least = _window_minimum((h & ~mask) | np.arange(len(h), dtype=np.uint64), WINDOW - ANCHOR + 1)
    anchor = (least & mask).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(raws)), sizes)[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= ends[text])
    if not len(start):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    anchor = anchor[start]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.concatenate((first, [len(start)])))
    of = text[start[first]]
    return of, h[anchor[first]], start[first] - (ends - sizes)[of], count


def _buffers(raws: list[bytes]):
    """Lists of (index, offset, bytes) of about BUFFER bytes; longer texts in pieces that overlap by WINDOW - 1 bytes."""
    held, size = [], 0
    for k, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - WINDOW + 1), BUFFER):
            piece = raw if len(raw) <= BUFFER else raw[at : at + BUFFER + WINDOW - 1]
            held.append((k, at, piece))
            size += len(piece)
            if size >= BUFFER:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs_of(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    out = []
    for part in _buffers(raws):
        of, h, first, count = anchored_runs([p for _, _, p in part])
        index, offset = np.array([k for k, _, _ in part]), np.array([at for _, at, _ in part])
        out.append((index[of], h, first + offset[of], count))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def repeated_starts(contexts: list[bytes], counts: list[int], lanes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By suffix array, the windows of distinct ``contexts`` (sorted by lane): for each, in suffix order, the context, the start, and
    the number of its class of equal windows within the lane. Starts are all but the last WINDOW - 1 positions of a context."""
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    text = np.ones(int(ends[-1]), np.int64)  # 1 closes a context
    body = np.ones(len(text), bool)
    body[ends - 1] = False
    text[body] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 2
    lane = np.array(lanes)
    first = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1])))
    order = suffix_arrays(text, (ends - sizes)[first])
    of = np.repeat(np.arange(len(contexts)), sizes)
    order = order[order + WINDOW < ends[of[order]]]
    raw = (text - 2).astype(np.uint8)  # closing positions are never within a window
    same = lane[of[order[1:]]] == lane[of[order[:-1]]]
    for offset in (0, WINDOW - 1, WINDOW // 2, *range(0, WINDOW, 8)):
        rows = np.flatnonzero(same)
        if not len(rows):
            break
        a, b = order[rows] + offset, order[rows + 1] + offset
        equal = raw[a] == raw[b]
        if offset % 8 == 0:
            for k in range(1, min(8, WINDOW - offset)):
                equal &= raw[a + k] == raw[b + k]
        same[rows] = equal
    return of[order], order - (ends - sizes)[of[order]], np.cumsum(np.concatenate(([0], ~same)))


def _lane_rows(rows: list[tuple[int, int, bytes, int, bool]]) -> list[tuple]:
    """rows: (lane, anchor, context, count, salted). -> (key, anchor, context hash, first, last, alone) with key null for
    starts known to repeat; salted lanes also report a row for each of their distinct windows, keyed by its hash."""
    merged: dict[tuple[int, bytes], list] = {}
    for lane, anchor, context, count, salted in rows:
        merged.setdefault((lane, context), [anchor, 0, salted])[1] += count
    keys = sorted(merged)
    found = [merged[k] for k in keys]
    contexts, lanes = [c for _, c in keys], [lane for lane, _ in keys]
    counts, salted = np.array([f[1] for f in found]), np.array([f[2] for f in found])
    of, start, cls = repeated_starts(contexts, counts.tolist(), lanes)
    repeats = (np.bincount(cls)[cls] > 1) | (counts[of] > 1)
    names = [_context_name(c) for c in contexts]
    out = []
    hot = np.flatnonzero(salted[of] & np.concatenate(([True], cls[1:] != cls[:-1])))
    if len(hot):
        class_repeats = np.zeros(cls[-1] + 1, bool)
        class_repeats[cls[repeats]] = True
        for k in hot.tolist():
            c, s = int(of[k]), int(start[k])
            key = hashlib.blake2b(contexts[c][s : s + WINDOW], digest_size=16).digest()
            out.append((key, found[c][0], names[c], s, s, not class_repeats[cls[k]]))
    of, start = of[repeats], start[repeats]
    order = np.lexsort((start, of))
    of, start = of[order], start[order]
    if len(of):
        first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1))))
        last = np.concatenate((first[1:], [len(of)])) - 1
        out += [(None, found[c][0], names[c], a, b, False) for c, a, b in zip(of[first].tolist(), start[first].tolist(), start[last].tolist(), strict=True)]
    return out


def _context_name(context: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(context, digest_size=8).digest(), "little", signed=True)


_MARKS = pa.schema([("key", pa.binary()), ("anchor", pa.int64()), ("context", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("alone", pa.bool_())])


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """key, th, spans for ``docs`` (key, th, text) and its distinct ``texts`` (key, th, text, copies): ``spans`` lists the [first, last]
    starts of repeated windows. Equal texts have one key and th, so copies give one row, and however many they are, the
    places of one text."""

    @tidy
    def anchors(batches):
        for batch in pieces(batches):
            raws = [(t or "").encode() for t in batch.column(2).to_pylist()]
            of, h, first, count = runs_of(raws)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(h.view(np.int64)), pa.array((first << 8 | count).astype(np.int64))], ["key", "th", "anchor", "run"])

    found = docs.mapInArrow(anchors, "key long, th int, anchor long, run long")
    # Written, so that the join's sides are plain shuffles, which Spark splits at an anchor of very many rows.
    counts = materialise(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    parts = F.when(F.col("n") > SALT_ABOVE, F.ceil(F.col("n") / SALT_ROWS)).otherwise(1).cast("int")
    repeated = found.join(counts, "anchor").select("key", "th", F.struct("anchor", "run", parts.alias("parts")).alias("hit"))
    # A set: copies of a text have the same hits, and those of an anchor meet in the partial step already.
    hits = repeated.groupBy("key", "th").agg(F.collect_set("hit").alias("hits"))
    wide = texts.join(hits, ["key", "th"]).select("key", "th", "text", "hits", "copies")

    def unfolded(hits: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For each hit of a batch its row, and the hits' fields."""
        fields = hits.flatten()
        rows = np.repeat(np.arange(len(hits)), hits.value_lengths().to_numpy())
        return rows, {fields.type.field(k).name: fields.field(k).to_numpy(zero_copy_only=False) for k in range(fields.type.num_fields)}

    def context_of(texts: pa.StringArray, rows: np.ndarray, runs: np.ndarray) -> list[bytes]:
        raws = [t.encode() for t in texts.to_pylist()]
        firsts, ends = (runs >> 8).tolist(), ((runs >> 8) + (runs & 255) + WINDOW - 1).tolist()
        return [raws[k][a:b] for k, a, b in zip(rows.tolist(), firsts, ends, strict=True)]

    def names_of(batch: pa.RecordBatch) -> np.ndarray:
        """The names of a batch's contexts; only a piece's contexts are held at a time."""
        return np.concatenate([np.array([_context_name(x) for x in context_of(piece.column(2), rows, hits["run"])], np.int64) for piece in pieces([batch]) for rows, hits in [unfolded(piece.column(3))]])

    def occurrences(combined: bool):
        """Rows by anchor and context; if ``combined``, one for each anchor and context of a batch, with their number."""

        @tidy
        def read(batches):
            for batch in batches:
                rows, hits = unfolded(batch.column(3))
                names = names_of(batch)
                n = batch.column(4).to_numpy()[rows]
                if combined and len(names):
                    key = np.rec.fromarrays([hits["anchor"], names])
                    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
                    sums = np.zeros(len(first), np.int64)
                    np.add.at(sums, kind, n)
                    rows, names, n, hits = rows[first], names[first], sums, {k: v[first] for k, v in hits.items()}
                take = pa.array(rows)
                arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(hits["anchor"], pa.int64()), pa.array(names), pa.array(hits["run"], pa.int64())]
                extra = [pa.array(hits["parts"], pa.int32()), pa.array(names % hits["parts"], pa.int32()), pa.array(n)] if combined else []
                yield pa.RecordBatch.from_arrays([*arrays, *extra], ["key", "th", "anchor", "context", "run", *(["parts", "salt", "n"] if combined else [])])

        return read

    @tidy
    def contexts(batches):
        for batch in pieces(batches):
            rows, hits = unfolded(batch.column(1))
            found = context_of(batch.column(0), rows, hits["run"])
            yield pa.RecordBatch.from_arrays([pa.array(hits["anchor"], pa.int64()), pa.array(hits["salt"], pa.int32()), pa.array(hits["parts"] > 1), pa.array(hits["n"], pa.int64()), pa.array(found, pa.binary())], ["anchor", "salt", "salted", "n", "context"])

    @tidy
    def sort_lanes(batches):
        lanes: list[list[tuple]] = []
        size, last = 0, None
        for batch in batches:
            for anchor, salt, salted, n, context in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (anchor, salt) != last:
                    if size > HELD:
                        yield from _sorted_lanes(lanes)
                        lanes, size = [], 0
                    last = (anchor, salt)
                    lanes.append([])
                lanes[-1].append((anchor, context, n, salted))
                size += len(context)
        yield from _sorted_lanes(lanes)

    # Combined in the task before the shuffle; a salted anchor's contexts go to several tasks, equal ones to the same.
    fields = "key long, th int, anchor long, context long, run long"
    dealt = wide.mapInArrow(occurrences(True), f"{fields}, parts int, salt int, n long").repartition("anchor", "salt")
    one = dealt.groupBy("anchor", "salt", "context").agg(F.sum("n").alias("n"), F.max("parts").alias("parts"), F.min(F.struct("key", "th", "run")).alias("r"))
    one = one.withColumn("kinds", F.count("*").over(Window.partitionBy("anchor", "salt")))
    single = (F.col("kinds") == 1) & (F.col("parts") == 1)
    whole = one.filter(single & (F.col("n") > 1)).select("anchor", "context", F.lit(0).alias("first"), (F.col("r.run").bitwiseAND(255) - 1).cast("int").alias("last"))
    kept = one.filter(~single).groupBy("r.key", "r.th").agg(F.collect_list(F.struct("anchor", "salt", "n", "parts", "r.run")).alias("hits"))
    cut = texts.join(kept, ["key", "th"]).select("text", "hits", "copies")  # copies: as in wide, so that Spark reuses the shuffle
    lanes = cut.mapInArrow(contexts, "anchor long, salt int, salted boolean, n long, context binary").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    marks = lanes.mapInArrow(sort_lanes, "key binary, anchor long, context long, first int, last int, alone boolean")
    # Rows without a key stand alone; of a key, at most one row per part of a salted anchor comes together.
    group = F.coalesce("key", F.unhex(F.concat_ws("", F.lit("00"), *(F.lpad(F.hex(c), 16, "0") for c in ("anchor", "context", "first")))))
    marks = marks.groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.collect_list(F.struct("anchor", "context", "first", "last", "alone", F.col("key").isNull().alias("known"))).alias("rows"))
    marks = marks.select("n", F.explode("rows").alias("r")).filter("r.known or (r.alone and n > 1)").select("r.anchor", "r.context", "r.first", "r.last")
    places = wide.mapInArrow(occurrences(False), fields).select("key", "th", "anchor", "context", F.shiftright("run", 8).alias("at")).join(marks.unionByName(whole), ["anchor", "context"])
    span = F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"))
    return places.groupBy("key", "th").agg(F.collect_list(span).alias("spans"))


def _sorted_lanes(lanes: list[list[tuple]]):
    """Lanes of similar size advance together, so that few long ones don't hold up many short ones."""
    lanes.sort(key=lambda rows: sum(len(r[1]) for r in rows))
    part, size = [], 0
    for k, rows in enumerate(lanes):
        part += [(k, *r) for r in rows]
        size += sum(len(r[1]) for r in rows)
        if size > SORTED or k + 1 == len(lanes):
            yield from _as_batches(_lane_rows(part))
            part, size = [], 0


def _as_batches(rows: list[tuple]):
    for k in range(0, len(rows), 10_000):
        part = rows[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], f.type) for j, f in enumerate(_MARKS)], schema=_MARKS)


def removed_runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) of bytes covered by windows that start within the spans."""
    out: list[list[int]] = []
    for first, last in sorted({(s["first"], s["last"]) for s in spans or ()}):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + WINDOW)
        else:
            out.append([first, last + WINDOW])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _keyed(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs`` (text, and the columns ``carried``) with key and th: 96 bits that name the text. Null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carried)), F.xxhash64(text).alias("key"), F.hash(text).alias("th"), text.alias("text"))


def texts_with_spans(docs: DataFrame) -> DataFrame:
    """text, spans, key, th: a row for each distinct text of ``docs`` (text), with the spans of its repeated windows (null: none)."""
    keyed = _keyed(docs).select("key", "th", "text")
    texts = keyed.groupBy("key", "th").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    return texts.join(repeated_spans(keyed, texts), ["key", "th"], "left").select("text", "spans", "key", "th", "copies")


def _to_rows(docs: DataFrame, found: DataFrame, *carried: str) -> DataFrame:
    """The columns ``carried`` of every row of ``docs``, and what was ``found`` (key, th, ...) of its text."""
    rows = _keyed(docs, *carried).drop("text").join(found, ["key", "th"])
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(carried)), *(c for c in found.columns if c not in ("key", "th")))


def repeated_byte_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    A byte goes if a 200-byte string that covers it starts anywhere else too, in this document or another; all
    occurrences go. Null or empty text: nothing to remove. Repeated rows count as documents of their own, so texts of
    200 bytes or more that occur twice go whole; each is worked on once, however many rows repeat it. Ids, null or shared by
    different texts, are only carried. An empty table gives no rows.
    """

    @tidy
    def digest(batches):
        for batch in pieces(batches):
            rows = []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, runs = text.encode(), removed_runs(spans)
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["key", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = texts_with_spans(docs).mapInArrow(digest, "key long, th int, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return _to_rows(docs, found, "doc_id")


def remove_repeats(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the text without its repeated bytes, and the columns ``carried``, a row for every row of ``docs``.

    Characters that a cut splits are dropped. Null text counts as empty.
    """

    @tidy
    def cut(batches):
        for batch in pieces(batches):
            texts = [kept_bytes(t.encode(), removed_runs(s)).decode("utf-8", "ignore") for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(texts, pa.string())], ["key", "th", "text"])

    found = texts_with_spans(docs).mapInArrow(cut, "key long, th int, text string")
    return _to_rows(docs, found, "doc_id", *carried).select("doc_id", "text", *carried)
