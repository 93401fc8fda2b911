"""Quality and toxicity of documents by co-training.

Two views of a document, its text content and its page metadata (language, source and size as the table gives them), each
get a logistic model. In each round both models score all unlabelled documents, and those that one of them is surest of go
to the other one to learn from. Held-out labelled rows calibrate both views and weigh them into one score. Only the labelled
rows are a bounded sample; every document is scored in its task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muralis.llm.batches import pieces, tidy
from muralis.storage import materialise

#: Labelled rows that the models are fitted on, about.
LABELLED_ROWS = 8_000
ROUNDS = 5
#: Pseudo-labels per class, view and round, and the confidence that they need.
PER_ROUND = 60
CONFIDENCE = 0.97
#: Learned words and word beginnings (of so many letters): the likelihood ratio statistic from which the labelled rows of a
#: language, or of all, tie one to the label (15: once in 10,000 words by chance), how much likelier it is under the label
#: (log odds), and the rows with the label that it takes (one row says nothing: all its rare words are only there).
LEXICON_EVIDENCE = 15.0
LEXICON_ODDS = 2.5
LEXICON_ROWS = 2

BEGINNINGS = (4, 5, 6, 7, 8)
#: Scores from, and below, which a document is kept.
LEAST_QUALITY = 0.5
MOST_TOXICITY = 0.5

_WORD = re.compile(r"\w+")
_SYMBOLS = np.frombuffer(b"#$%&*|!?.,<>{}=@_~", np.uint8)
_META_BUCKETS = 64
#: Hashed words, and hashed runs of three bytes, of the text view: so many of each.
_GRAM_BUCKETS = 128
_BLOCK = 1 << 20
#: Rows whose features are a matrix at once.
_SCORED = 1024
#: Words whose codes a task remembers.
_WORDS_KEPT = 1 << 17
#: Ridge penalties of a feature, and of a hashed one: these are many and weak (cross-validated on labelled rows of sf0.01).
RIDGE = 1.0
GRAM_RIDGE = 30.0
#: Parts of a pick, so that no task ranks more than PER_ROUND rows of each.
_PARTS = 512


def beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


class WordCodes(dict):
    """The bucket of a word, plus _GRAM_BUCKETS if it is in the lexicon; a bounded memory of a pure function."""

    def __init__(self, lexicon: frozenset[str]) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.heads = {w.rstrip("*")[: BEGINNINGS[0]] for w in lexicon}  # most words are told apart by them

    def __missing__(self, word: str) -> int:
        hit = word[: BEGINNINGS[0]] in self.heads and (word in self.lexicon or not self.lexicon.isdisjoint(beginnings(word)))
        code = zlib.crc32(word.encode()) % _GRAM_BUCKETS + _GRAM_BUCKETS * hit
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = code
        return code


def _roots(counts: np.ndarray) -> np.ndarray:
    """Roots of the shares, a byte each."""
    return np.rint(255 * np.sqrt(counts / max(1.0, counts.sum()))).astype(np.uint8)


def text_features(text: str, codes: WordCodes) -> tuple[np.ndarray, float, bytes]:
    """Shape of the text, how many of its words are in the lexicon, and its hashed words and runs of three bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    words = _WORD.findall(text.lower())
    seen = Counter(words)
    m = max(1, len(words))
    repeated = sum(map(eq, words, words[1:])) / m
    lines = int(counts[10]) + 1
    upper = int(counts[65:91].sum())
    head = [upper / max(1, upper + int(counts[97:123].sum())), counts[48:58].sum() / n, counts[128:].sum() / n, counts[10] / n, counts[32] / n, n / m / 10]
    tail = [np.log1p(lines), np.log1p(n / lines), repeated, len(seen) / m, max(seen.values(), default=0) / m, np.log1p(m)]
    shape = np.concatenate([head, np.log1p(100 * counts[_SYMBOLS] / n), tail])
    found = np.bincount(np.fromiter(map(codes.__getitem__, seen), np.int64, len(seen)), np.fromiter(seen.values(), float, len(seen)), 2 * _GRAM_BUCKETS).reshape(2, -1)
    runs = np.zeros(_GRAM_BUCKETS)
    for at in range(0, len(raw) - 2, _BLOCK):
        piece = raw[at : at + _BLOCK + 2].astype(np.uint32)
        runs += np.bincount((piece[:-2] << 16 | piece[1:-1] << 8 | piece[2:]) * np.uint32(2654435761) >> 25, minlength=_GRAM_BUCKETS)
    return shape, float(np.log1p(found[1].sum())), np.concatenate([_roots(found.sum(axis=0)), _roots(runs)]).tobytes()


@lru_cache(1 << 12)
def _meta_bucket(name: str, value: str | None) -> int:
    """Bucket of a column's value; -1 if it is unknown."""
    return -1 if value is None else zlib.crc32(f"{name}={value}".encode()) % _META_BUCKETS


def meta_features(lang: str | None, source: str | None, size: int | None) -> list[float]:
    """The document's size and buckets of its language and source, as its columns give them."""
    return [float(size is None), math.log1p(max(0, size or 0)), _meta_bucket("lang", lang), _meta_bucket("source", source)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Logistic:
    """Ridge-penalised logistic regression on standardised features, by Newton steps."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = RIDGE, steps: int = 25) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._with_one(x)
        penalty = np.append(np.broadcast_to(ridge, x.shape[1]), 1e-6)
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -12, 12), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        return self._with_one(x) @ self.weights


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    combined: Logistic

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return _sigmoid(self.combined.score(np.column_stack([self.text.score(text), self.meta.score(meta)])))


class CoTraining:
    """What both views of one target have learned from so far."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = RIDGE) -> None:
        """``ridge``: penalties of the text view's features."""
        self.ridges = ridge, RIDGE
        held = np.arange(len(y)) % 4 == 3
        self.views = [[text[~held], y[~held]], [meta[~held], y[~held]]]
        self.able = len(set(y[~held])) == 2
        check = held if len(set(y[held])) == 2 else ~held
        self.checks = text[check], meta[check], y[check]

    def models(self) -> list[Logistic]:
        return [Logistic().fit(x, target, ridge) for (x, target), ridge in zip(self.views, self.ridges, strict=True)]

    def learn(self, view: int, x: np.ndarray, y: np.ndarray) -> None:
        """Add pseudo-labels that the other view gives to ``view``."""
        if len(y):
            self.views[view] = [np.vstack([self.views[view][0], x]), np.concatenate([self.views[view][1], y])]

    def finish(self) -> CoTrained:
        """Both views, calibrated and weighed together on the held-out rows."""
        text, meta = self.models()
        x, z, y = self.checks
        return CoTrained(text, meta, Logistic().fit(np.column_stack([text.score(x), meta.score(z)]), y, 0.1))


def _share(df: DataFrame, rows: int, seed: int, *by: str) -> DataFrame:
    """About ``rows`` of ``df``, by a hash of doc_id (or the columns ``by``): the same rows in every run."""
    total = df.count()
    return df if total <= rows else df.filter(F.pmod(F.xxhash64(*(by or ("doc_id",)), F.lit(seed)), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


def _labelled(docs: DataFrame, marks: DataFrame, rows: int) -> DataFrame:
    """The different texts that carry a marked id, with its labels: about twice ``rows`` at most, however many rows share an id."""
    known = docs.select("doc_id", "text", "lang", "source", "n_chars").filter("text is not null").join(F.broadcast(marks), "doc_id")  # bounded by ``rows``
    return _share(materialise(known.distinct(), "labelled"), 2 * rows, 2, "doc_id", "text")


def _with_size(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns``, text, lang, source and n_chars (null where the table has none)."""
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(*columns, "text", "lang", "source", size.alias("n_chars"))


#: Columns of a document's features.
FEATURES = "shape array<float>, hits float, grams binary, meta array<float>"
_FEATURE_NAMES = ["shape", "hits", "grams", "meta"]
_FEATURE_TYPES = (pa.list_(pa.float32()), pa.float32(), pa.binary(), pa.list_(pa.float32()))


def _lists(rows: np.ndarray) -> pa.Array:
    rows = np.asarray(rows, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _features(batch: pa.RecordBatch, codes: WordCodes) -> list[pa.Array]:
    """The columns FEATURES of a batch with text, lang, source and n_chars."""
    if not batch.num_rows:
        return [pa.array([], t) for t in _FEATURE_TYPES]
    texts, *rest = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))
    shape, hits, grams = zip(*(text_features(t or "", codes) for t in texts), strict=True)
    return [_lists(np.array(shape)), pa.array(np.array(hits, np.float32)), pa.array(grams, pa.binary()), _lists(np.array(list(map(meta_features, *rest))))]


def _featured(docs: DataFrame, names: list[str], lexicon: frozenset[str]) -> DataFrame:
    """The columns ``names`` of ``docs``, whether its text is blank, and the features of its text, lang, source and n_chars."""

    @tidy
    def featured(batches):
        codes = WordCodes(lexicon)
        for batch in pieces(batches):
            blank = pa.array([not (t or "").strip() for t in batch.column("text").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), blank, *_features(batch, codes)], [*names, "blank", *_FEATURE_NAMES])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(featured, "".join(f"{c} {kinds[c]}, " for c in names) + "blank boolean, " + FEATURES)


def surest(pool: DataFrame, models: dict[str, list[Logistic]], taken: dict[str, set[int]], most: int = PER_ROUND) -> DataFrame:
    """target, view, label, sure, key and the features of the rows of ``pool`` (key, FEATURES) that each model is surest of.

    ``models`` has a text and a metadata model by target. At most ``most`` rows per target, view and label, with a confidence
    of CONFIDENCE or more, the surest first, ties to the smaller key, equal keys once, and none of the keys ``taken``.
    Each task hands on its own surest rows only, so that what is ranked does not grow with the rows of a task.
    """
    slots = [(target, view, label) for target in models for view in (0, 1) for label in (0, 1)]

    @tidy
    def best(batches):
        kept = {slot: {} for slot in slots}
        for batch in pieces(batches, _SCORED):
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            views = QualityModel.views(*(batch.column(c) for c in _FEATURE_NAMES))
            for target, pair in models.items():
                free = np.unique(keys, return_index=True)[1]  # equal keys once
                free = free[~np.isin(keys[free], list(taken[target]))]
                for view, model in enumerate(pair):
                    odds = model.score(views["meta" if view else target][free])
                    for label in (0, 1):
                        sure = _sigmoid(odds if label else -odds)
                        order = np.lexsort((keys[free], -sure))[:most]
                        order = order[sure[order] >= CONFIDENCE]
                        pick = kept[target, view, label]
                        for p, row in zip(sure[order], batch.take(pa.array(free[order])).to_pylist(), strict=True):
                            pick.setdefault(row["key"], (float(p), row))
                        kept[target, view, label] = dict(sorted(pick.items(), key=lambda kv: (-kv[1][0], kv[0]))[:most])
        out = [{"target": t, "view": v, "label": y, "sure": s, **row} for (t, v, y), pick in kept.items() for s, row in pick.values()]
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("target", pa.string()), ("view", pa.int32()), ("label", pa.int32()), ("sure", pa.float64()), ("key", pa.int64()), *zip(_FEATURE_NAMES, _FEATURE_TYPES, strict=True)])
    slot = ["target", "view", "label"]
    found = pool.mapInArrow(best, "target string, view int, label int, sure double, key long, " + FEATURES).dropDuplicates([*slot, "key"])
    order = [F.desc("sure"), F.asc("key")]
    part = Window.partitionBy(*slot, F.pmod("key", F.lit(_PARTS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*slot).orderBy(*order))).filter(F.col("rank") <= most)


def learned_words(rows: DataFrame) -> frozenset[str]:
    """Words and beginnings of words that the rows (text, lang, y) of a language, or all rows, tie to label 1.

    Every one with the evidence is taken, however rare. Rows of one text count once, and what a shorter beginning covers is
    left out. The rows are bounded, and so are their words.
    """

    @tidy
    def distinct_words(batches):
        for batch in pieces(batches):
            words = [set(_WORD.findall((t or "").lower())) for t in batch.column(0).to_pylist()]
            seen = [sorted(ws.union(*map(beginnings, ws))) for ws in words]
            at = pa.array(np.repeat(np.arange(len(seen)), [len(s) for s in seen]))
            yield pa.RecordBatch.from_arrays([pa.array([w for s in seen for w in s], pa.string()), batch.column(1).take(at), batch.column(2).take(at)], ["word", "lang", "y"])

    def pooled(df: DataFrame, *keys: str) -> DataFrame:
        """Label sums of the rows (lang, y, keys) by language and, with "*" as their language, over all languages."""
        every = df.withColumn("lang", F.explode(F.array("lang", F.lit("*"))))
        return every.groupBy("lang", *keys).agg(F.sum("y").alias("a"), F.count("*").alias("n"))

    rows = rows.select("text", F.concat(F.lit("="), F.coalesce("lang", F.lit(""))).alias("lang"), F.col("y").cast("int").alias("y")).dropDuplicates()
    totals = pooled(rows).toDF("lang", "ones", "total").filter("ones > 0 and ones < total")
    counts = pooled(rows.mapInArrow(distinct_words, "word string, lang string, y int"), "word")
    c = F.col
    cells = counts.join(F.broadcast(totals), "lang").filter(c("a") >= LEXICON_ROWS)  # totals: a row per language
    parts = [(c("a"), c("n") * c("ones")), (c("n") - c("a"), c("n") * (c("total") - c("ones"))), (c("ones") - c("a"), (c("total") - c("n")) * c("ones")), (c("total") - c("ones") - c("n") + c("a"), (c("total") - c("n")) * (c("total") - c("ones")))]
    evidence = 2 * sum((F.when(x > 0, x * F.log(x * c("total") / e)).otherwise(0.0) for x, e in parts), F.lit(0.0))
    odds = F.log((c("a") + 0.5) / (c("ones") + 1.0)) - F.log((c("n") - c("a") + 0.5) / (c("total") - c("ones") + 1.0))
    found = {r.word for r in cells.filter((evidence >= LEXICON_EVIDENCE) & (odds >= LEXICON_ODDS)).select("word").distinct().collect()}
    return frozenset(w for w in found if found.isdisjoint(x for x in beginnings(w.rstrip("*")) if x != w))


@dataclass
class QualityModel:
    quality: CoTrained | None
    toxicity: CoTrained | None
    words: frozenset[str]

    @staticmethod
    def views(shape: pa.Array, hits: pa.Array, grams: pa.Array, meta: pa.Array) -> dict[str, np.ndarray]:
        """The text views for quality and for toxicity, and the metadata view, of at least one row of FEATURES."""
        s, m = (x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(float) for x in (shape, meta))
        h = hits.to_numpy(zero_copy_only=False).astype(float)
        g = np.frombuffer(b"".join(grams.to_pylist()), np.uint8).reshape(len(grams), -1) / 255
        buckets = (m[:, 2:, None] == np.arange(_META_BUCKETS)).any(axis=1)
        return {"quality": np.column_stack([s, g]), "toxicity": np.column_stack([h, h > 0, s[:, -1]]), "meta": np.column_stack([m[:, :2], buckets])}


def _fitted(docs: DataFrame, labels: DataFrame, labelled_rows: int, rounds: int) -> tuple[QualityModel, DataFrame]:
    """The model, and the features of all ``docs`` (doc_id, text, lang, source, n_chars, others), written once.

    The rows written hold the other columns of ``docs``, key (null: no text), blank, marked (true: fitted on) and FEATURES.
    Each round reads the features of the rows that are not marked.
    """
    marks = _share(labels.select("doc_id", "quality", "toxic").filter("doc_id is not null and quality is not null and toxic is not null").distinct(), labelled_rows, 1)
    known = _labelled(docs, marks, labelled_rows)
    words = learned_words(known.select("text", "lang", F.col("toxic").alias("y")))
    rows = sorted(_featured(known, ["doc_id", "quality", "toxic"], words).collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.grams, r.shape, r.meta, r.quality, r.toxic))
    key = F.when(F.col("text").isNotNull(), F.xxhash64("text", "lang", "source", "n_chars"))
    marked = marks.select("doc_id", F.lit(True).alias("marked")).distinct()
    every = docs.withColumn("key", key).join(F.broadcast(marked), "doc_id", "left")
    names = [c for c in every.columns if c not in ("text", "lang", "source", "n_chars")]
    written = materialise(_featured(every, names, words), "features")
    if not rows:
        return QualityModel(None, None, words), written

    def viewed(rows: list) -> dict[str, np.ndarray]:
        return QualityModel.views(*(pa.array([r[c] for r in rows], t) for c, t in zip(_FEATURE_NAMES, _FEATURE_TYPES, strict=True)))

    views = viewed(rows)
    grams = np.arange(views["quality"].shape[1]) >= views["quality"].shape[1] - 2 * _GRAM_BUCKETS
    ridges = {"quality": np.where(grams, GRAM_RIDGE, RIDGE), "toxicity": RIDGE}
    learners = {target: CoTraining(views[target], views["meta"], np.array([float(r[c]) for r in rows]), ridges[target]) for target, c in (("quality", "quality"), ("toxicity", "toxic"))}
    learners = {target: x for target, x in learners.items() if x.able}
    taken: dict[str, set[int]] = {target: set() for target in learners}
    pool = written.filter("key is not null and marked is null").select("key", "shape", "hits", "grams", "meta")
    for _ in range(rounds if learners else 0):
        found = surest(pool, {target: x.models() for target, x in learners.items()}, taken).collect()  # PER_ROUND by target, view and label
        if not found:
            break
        found.sort(key=lambda r: (r.target, r.view, r.label, r.rank))
        for target, learner in learners.items():
            for view in (0, 1):  # each view's labels go to the other
                gifts = [r for r in found if (r.target, r.view) == (target, view)]
                if gifts:
                    learner.learn(1 - view, viewed(gifts)["meta" if view == 0 else target], np.array([float(r.label) for r in gifts]))
                    taken[target].update(r.key for r in gifts)
    finished = {target: x.finish() for target, x in learners.items()}
    return QualityModel(finished.get("quality"), finished.get("toxicity"), words), written


def fit_quality(docs: DataFrame, labels: DataFrame, *, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> QualityModel:
    """Fit on about ``labelled_rows`` rows of ``labels`` (doc_id, quality, toxic; the bound on labels) and on all other ``docs``."""
    return _fitted(_with_size(docs, "doc_id"), labels, labelled_rows, rounds)[0]


def _judged(model: QualityModel, features: pa.RecordBatch) -> list[pa.Array]:
    """Quality, toxicity (null: not known) and whether to keep each row of FEATURES and blank."""
    blank = features.column("blank").to_numpy(zero_copy_only=False).astype(bool)
    keep, out = ~blank, []
    views = QualityModel.views(*(features.column(c) for c in _FEATURE_NAMES)) if len(blank) else None
    for target, learned in (("quality", model.quality), ("toxicity", model.toxicity)):
        if learned is None or views is None:
            out.append(pa.nulls(len(blank), pa.float64()))
            continue
        p = np.where(blank, 0.0, learned.probability(views[target], views["meta"]))
        keep &= p >= LEAST_QUALITY if target == "quality" else p < MOST_TOXICITY
        out.append(pa.array(np.round(p, 6)))
    return [*out, pa.array(keep)]


def _scored(featured: DataFrame, model: QualityModel, names: list[str]) -> DataFrame:
    """The columns c0, c1 ... of ``featured`` by their ``names``, and the scores."""
    shared = featured.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    carried = [f"c{k}" for k in range(len(names))]

    @tidy
    def score(batches):
        for batch in pieces(batches, _SCORED):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *_judged(shared.value, batch)], [*carried, "quality", "toxicity", "keep"])

    kinds = dict(featured.dtypes)
    scores = featured.mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", quality double, toxicity double, keep boolean")
    return scores.toDF(*names, "quality", "toxicity", "keep")


def _carrying(docs: DataFrame, *carried: str) -> tuple[DataFrame, list[str]]:
    """What the features need of ``docs``, with doc_id and ``carried`` once more as c0, c1 ..., and their names."""
    names = list(dict.fromkeys(["doc_id", *carried]))
    inputs = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    copies = docs.select(*inputs, *(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))
    return _with_size(copies, "doc_id", *(f"c{k}" for k in range(len(names)))), names


def score_quality(docs: DataFrame, model: QualityModel, *carried: str) -> DataFrame:
    """doc_id, quality, toxicity, keep, and the columns ``carried``, for every row of ``docs`` (doc_id, text, lang, source, n_chars).

    Null or blank text scores 0 and 0 and is rejected. Null lang, source or n_chars, or no column n_chars, say nothing. A
    target whose labels held one class only scores null and rejects nothing. Equal rows get equal scores; an empty table
    gives none.
    """
    inputs, names = _carrying(docs, *carried)
    return _scored(_featured(inputs, [f"c{k}" for k in range(len(names))], model.words), model, names)


def classify_quality(docs: DataFrame, labels: DataFrame, *carried: str, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``score_quality`` of ``docs`` by the model that ``fit_quality`` makes of them; every text is read for features once."""
    inputs, names = _carrying(docs, *carried)
    model, written = _fitted(inputs, labels, labelled_rows, rounds)
    return _scored(written, model, names)
