"""Vector codes, whitening and language-model scores against brute force, with the awkward rows included."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from muralis.llm import html_extract, nearest, quality, vector_codes, vectors, whitening
from muralis.llm import suffix_tree_lm as lm

VECTORS = "vec_id long, embedding array<float>, label int, x int, size string, n int, code string"


def random_vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dims)) * (1 + np.arange(dims) % 5) / 8
    return rows.astype(np.float32)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(int(i) * 3 % 701, v.tolist(), int(i) % 3 if i % 5 else None) for i, v in enumerate(random_vectors(700, 16))]
    same = rows[7][1]
    rows += [(1000 + k, same, 9) for k in range(400)] + [(1500, [0.0] * 16, 1), (1501, [-0.0] * 16, 1), (None, rows[3][1], 2), (5, rows[5][1], 0), (1502, rows[1][1][:9], 0)]
    rows += [(1600, None, 1), (1601, [None] + rows[0][1][1:], 1), (1602, [float("nan")] * 16, 1), (1603, [float("inf")] + rows[0][1][1:], 1)]
    return spark.createDataFrame([(*r, 1, "a", 2, "b") for r in rows], VECTORS).repartition(5)


def kept(table, scale, dims=16):
    out = []
    for r in table.collect():
        v = r.embedding
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(scale * c) for c in v]
        out.append((r.vec_id, r.label, tuple(x + [0] * (dims - len(x)))))
    return out


def test_packed_vectors():
    rows = np.array([[0, 0, 0], [1, 0, 0], [-128, 5, 0], [127, 0, 0], [40000, -1, 3], [1 << 40, 0, 1]])
    packed = vectors.pack(rows)
    assert np.array_equal(vectors.unpack(packed, 3), rows)
    assert vectors.pack(np.array([[1, 0, 0, 0]]))[0] == packed[1]
    assert vectors.unpack(vectors.pack(np.zeros((2, 0), np.int64)), 0).shape == (2, 0)


def test_ball_tree_equals_all_distances():
    rng = np.random.default_rng(3)
    for dims, spread, shift in ((2, 40, 0), (16, 300, 0), (5, 3, 0), (4, 1 << 24, 1 << 26)):
        entries = rng.integers(-spread, spread, (256, dims)) + shift
        entries[200:] = entries[:56]  # ties
        rows = rng.integers(-spread, spread, (3000, dims)) + shift
        tree = vector_codes.BallTree(entries)
        index, d = tree.nearest(rows)
        every = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(index, every.argmin(axis=1)) and np.array_equal(d, every.min(axis=1))
        if dims == 2:
            assert tree.visited < 0.3 * every.size  # balls are left out


def test_vector_codes(spark, table, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 0.3)  # labels on either side
    rows = kept(table, 1024)
    packed = {x: vectors.pack(np.array([x]))[0] for _, _, x in rows}
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, packed[r[2]]))
    x = np.array([r[2] for r in rows])
    books = [x[:64, k * 4 : k * 4 + 4].copy() for k in range(4)]

    def nearest():
        d = [((x[:, None, k * 4 : k * 4 + 4] - books[k][None]) ** 2).sum(axis=2) for k in range(4)]
        return [e.argmin(axis=1) for e in d], sum(e.min(axis=1) for e in d)

    for _ in range(4):
        code, _ = nearest()
        for k in range(4):
            for e in set(code[k].tolist()):
                mine = x[code[k] == e, k * 4 : k * 4 + 4]
                books[k][e] = mine.sum(axis=0) // len(mine)
    code, error = nearest()
    labels = defaultdict(int)
    for r, e in zip(rows, error):
        labels[r[1]] += int(e)
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    expected = [(r[0], "".join(f"{int(c[i]):02x}" for c in code), int(error[i]), labels[r[1]], digest) for i, r in enumerate(rows)]
    got = vector_codes.encode_vectors(table, entries=64)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert vector_codes.encode_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    few = vector_codes.encode_vectors(spark.createDataFrame([(1, [0.5, 0.25, 0.0], None), (2, [0.5, 0.25, 0.0], None)], "vec_id int, embedding array<double>, label string")).collect()
    assert [(r.vec_id, r.code, r.error) for r in sorted(few)] == [(1, "00000000", 0), (2, "00000000", 0)]


def test_symmetric_qr():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        if n == 17:
            a[5:9] = a[:, 5:9] = 0.0
        values, q = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * max(1, values[0]))
        assert np.allclose(q.T @ q, np.eye(n), atol=1e-13) and np.allclose(a @ q, q * values, atol=1e-11)
    assert np.array_equal(whitening.symmetric_qr(np.zeros((3, 3)))[0], np.zeros(3))


def test_moments_merge():
    rows = np.random.default_rng(4).integers(-500, 500, (1000, 6))
    whole = whitening.Moments(6)
    for part in (rows[:1], rows[1:400], rows[400:400], rows[400:]):
        m = whitening.Moments(6)
        m.add(part)
        whole.merge(m)
    assert whole.n == 1000 and whole.total == rows.sum(axis=0).tolist()
    assert np.allclose(whole.covariance(), np.cov(rows.T, bias=True), rtol=1e-12)


def test_whitening(spark, table):
    rows = kept(table, 256)
    fit = np.array(sorted({r[2] for r in rows}))
    n, total = len(fit), fit.sum(axis=0)
    values, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, q = values[::-1], q[:, ::-1]
    got = whitening.whiten_embeddings(table)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 4 * len(rows)
    expected = Counter()
    for vec_id, _, x in rows:
        expected[vec_id, n, int(((n * np.array(x) - total) ** 2).sum())] += 4
    assert Counter((r.vec_id, r.n, r.deviation) for r in got) == expected
    by_id = {(r.vec_id, r.component): r.whitened for r in got}
    names = Counter(r[0] for r in rows)
    for c in range(1, 5):
        ids = [(r[0], r[2]) for r in rows if names[r[0]] == 1]
        ours = np.array([by_id[i, c] for i, _ in ids])
        theirs = (np.array([x for _, x in ids]) - total / n) @ q[:, c - 1] / math.sqrt(values[c - 1])
        assert np.allclose(ours, theirs, atol=1e-8) or np.allclose(ours, -theirs, atol=1e-8)
    assert {(r.component, round(r.explained, 9)) for r in got} == {(c + 1, round(values[c] / values.sum(), 9)) for c in range(4)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert whitening.whiten_embeddings(spark.createDataFrame([], VECTORS)).collect() == []
    flat = whitening.whiten_embeddings(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id int, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.component, r.deviation, None if r.whitened is None else abs(round(r.whitened, 9)), r.explained) for r in flat) == [(i, c, 512 * 512, 1.0 if c == 1 else None, 2.0 - c) for i in (1, 2) for c in (1, 2)]
    one = whitening.whiten_embeddings(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id int, embedding array<double>")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 2


def brute_scores(rows, buckets, hot_share):
    """The tree with plain dictionaries; numbers of words as the operator deals them, for the classes of frequent words only."""
    texts = []
    for doc, text in rows:
        held = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2
        words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
        texts.append((doc, held, [*words, b""]))
    count = Counter(w for _, held, words in texts if not held for w in words)
    n, v = sum(count.values()), len(count)
    base = lambda w: (count[w] + 1) / (n + v + 1)
    one, two = defaultdict(Counter), defaultdict(Counter)
    for _, held, words in texts:
        if not held:
            for i in range(1, len(words)):
                u = words[i - 2] if i > 1 else None
                one[words[i - 1]][words[i]] += 1
                two[u, words[i - 1]][words[i]] += 1

    def state(counts, parent):
        total, best = sum(counts.values()), (-math.inf, None)
        for x in lm.WEIGHTS:
            saved = sum(c * math.log((c - 1 + x * parent(w)) / ((total - 1 + x) * parent(w))) for w, c in counts.items())
            best = max(best, (saved, x), key=lambda b: b[0])
        if total < 2 or best[0] < lm.GAIN:
            return None
        return lambda w: (counts[w] + best[1] * parent(w)) / (total + best[1])

    ones = {c: state(f, base) for c, f in one.items()}
    twos = {c: state(f, ones[c[1]] or base) for c, f in two.items()}
    out = []
    for doc, held, words in texts:
        score = 0.0
        for i, w in enumerate(words):
            p = base
            if i:
                p = twos.get((words[i - 2] if i > 1 else None, words[i - 1])) or ones.get(words[i - 1]) or base
            score += math.log10(p(w))
        out.append((doc, held, len(words), sum(count[w] > 0 for w in words), n, sum(math.log10(base(w)) for w in words), score))
    return out, sum(x is not None for x in ones.values()), sum(x is not None for x in twos.values())


@pytest.mark.parametrize("chunk", [1 << 19, 50])
def test_lm_scores_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "STRETCH", 1 << 22 if chunk > 50 else 300)
    monkeypatch.setattr(lm, "HOT_SHARE", 1e9)  # no classes: the brute force knows none
    random.seed(5)
    names = [f"W{k}é" for k in range(40)] + ["The", "of", "a\x0b"]
    passage = " ".join(random.choices(names, k=60))
    rows = [(k, " ".join(random.choices(names, weights=[1] * 40 + [20, 20, 9], k=random.randint(0, 120))) + ("\n" + passage if k % 3 == 0 else "")) for k in range(90)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, passage), (203, "İ Ä\x85x\xa0y z\x1cq"), (5, rows[5][1]), (204, "long " * 3000)]
    expected, ones, twos = brute_scores(rows, 4, 1)
    assert ones > 5 and twos > 20
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, bucket string, chunk int, score double").repartition(3)
    got = lm.lm_scores(docs)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, expected = sorted(map(tuple, got.collect()), key=key), sorted(expected, key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5] for g in got], [e[5] for e in expected], rtol=1e-12)
    assert np.allclose([g[6] for g in got], [e[6] for e in expected], rtol=1e-6)


@pytest.mark.parametrize("bucket", [10, 1500])
def test_lm_scores_do_not_depend_on_buckets(spark, monkeypatch, bucket):
    """Frequent words are divided into classes or not, in few buckets or many: the same states and scores."""
    random.seed(6)
    names = [f"w{k}" for k in range(30)] + ["the", "of"]
    rows = [(k, " ".join(random.choices(names, weights=[1] * 30 + [40, 20], k=random.randint(20, 120)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "CHUNK", 700)
    expected, ones, twos = brute_scores(rows, 4, 1)
    assert ones and twos
    monkeypatch.setattr(lm, "HOT_SHARE", 1e9)
    whole = sorted(map(tuple, lm.lm_scores(docs).collect()))
    monkeypatch.setattr(lm, "BUCKET", bucket)
    monkeypatch.setattr(lm, "HOT_SHARE", 0.05)
    parted = sorted(map(tuple, lm.lm_scores(docs).collect()))
    assert parted == whole
    assert np.allclose([r[6] for r in parted], [e[6] for e in sorted(expected)], rtol=1e-6)


def test_lm_scores_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lm.lm_scores(docs).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 0 for r in rows)


def test_lm_distribution_sums_to_one(monkeypatch):
    """Entries of a context, one of them unseen in training, and the parent's probabilities of all words."""
    parent = np.array([0.4, 0.3, 0.2, 0.1])
    prob, kept = lm.retained(np.array([30, 0, 2, 0]), np.zeros(4, int), parent)
    assert kept.all() and abs(prob.sum() - 1) < 1e-12 and prob[0] > 0.8
    prob, kept = lm.retained(np.array([4, 3, 2, 1]), np.zeros(4, int), parent)
    assert not kept.any() and np.array_equal(prob, parent)


def test_lm_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_scores(empty).collect() == []
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = lm.lm_scores(spark.createDataFrame([(k, "a b") for k in ids], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.base_score, r.score) for r in rows] == [(0, 0, 0.0, 0.0)] * len(ids)


@pytest.mark.parametrize("lonely", [21, 22])
def test_top_k_where_most_rows_share_an_id(spark, monkeypatch, lonely):
    """Several blocks, of which all rows but two queries have one id: every query finds candidates, drawn sample or not."""
    monkeypatch.setattr(nearest, "DATA_ROWS", 200)
    monkeypatch.setattr(nearest, "FIRST_ROWS", 1)
    rows = [(lonely, [float(k % 13), float(k % 7)]) for k in range(900)] + [(20, [1.0, 2.0]), (40, [2.0, -1.0])]
    found = nearest.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q, v in ((20, (64, 128)), (40, (128, -64))):
        scores = sorted((sum(a * 64 * b for a, b in zip(x, v)) for i, x in rows if i != q), reverse=True)[:20]
        assert [r.score for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [int(s) for s in scores]


@pytest.mark.parametrize("pages", [1, 2, 3, 12])
@pytest.mark.parametrize("name", ["wp-block-comments", "reactions-thread", "post-comments"])
def test_html_article_before_longer_comments(spark, pages, name):
    """Comments that are longer than the story, outside of the article element and in it, on hosts of any number of pages."""
    rows, expected = [], {}
    for k in range(pages):
        story, talk = " ".join(f"w{i}x{k}" for i in range(80)), " ".join(f"c{i}y{k}" for i in range(120))
        rows.append((k, f"http://a.example/{k}", f'<body><nav><a>Home {k}</a></nav><article><p>{story}</p></article><div class="{name}"><p>{talk}</p></div></body>'))
        rows.append((100 + k, f"http://b.example/{k}", f'<body><nav><a>Home {k}</a></nav><article><p>{story}</p><div class="{name}"><p>{talk}</p></div></article></body>'))
        expected |= {k: story, 100 + k: story}
    found = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == expected


def test_labelled_rows_are_bounded(spark):
    """Two labels, thousands of texts that share one of the ids, and rows that repeat."""
    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('text ', id % 2500) AS text", "'en' AS lang", "'s' AS source", "5L AS n_chars")
    docs = docs.unionByName(spark.range(3).selectExpr("2L AS doc_id", "'two' AS text", "'en' AS lang", "'s' AS source", "3L AS n_chars"))
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality._labelled(docs, marks, 5000).count() == 2501
    assert 0 < quality._labelled(docs, marks, 100).count() < 300
