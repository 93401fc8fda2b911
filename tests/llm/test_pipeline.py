"""The pipeline's stages, each held against brute force on its own input."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from muralis import storage
from muralis.llm.near_dup import near_duplicate_classes
from muralis.llm.quality import fit_quality, score_quality
from tests.llm.test_llm import removed, shingle_counts

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = list(corpus_pipeline.COLUMNS)

    kept = stages["quality classifier"](spark, docs, DATA).cache()
    keep = {r.doc_id for r in score_quality(docs, fit_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).filter("keep").collect()}
    assert {r.doc_id for r in kept.collect()} == keep and kept.columns == columns

    one = stages["near-duplicates"](spark, kept, DATA).cache()
    assert one.columns == columns
    left = {r.doc_id: shingle_counts(r.text) for r in one.collect()}
    alike = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values())
    assert not any(alike(left[a], left[b]) for a in left for b in left if a < b)
    gone = {r.doc_id: shingle_counts(r.text) for r in kept.collect() if r.doc_id not in left}
    every = {**left, **gone}
    assert all(any(alike(x, every[b]) for b in every if b < a) for a, x in gone.items())

    cut = stages["repeated passages"](spark, one, DATA).cache()
    assert cut.columns == columns
    before = one.collect()
    expected = {r.doc_id: np.frombuffer(raw, np.uint8)[~covered].tobytes().decode("utf-8", "ignore") for r, (raw, covered) in zip(before, removed([r.text for r in before]))}
    assert {r.doc_id: r.text for r in cut.collect()} == expected

    packed = stages["best-fit packing"](spark, cut, DATA)
    assert {r.doc_id for r in packed.collect()} == set(expected)


def test_awkward_documents(spark):
    rows = [(None, "some text " * 40, None, None, None), (1, None, None, None, None), (1, "", "en", "s", 0), (2, "some text " * 40, "en", "s", 400), (2, "some text " * 40, "en", "s", 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, DATA).count() > 0
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_steps_make_room(spark, tmp_path, monkeypatch):
    """Of what the first two stages write, only what their results read is left; blocks may be nested."""
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, DATA)
    assert left() == ["kept"] and kept.count() > 0
    found = near_duplicate_classes(kept)
    assert left() == ["classes", "kept"] and found.count() == kept.count()
    with storage.passing(spark):
        with storage.passing(spark):
            storage.materialise(docs.limit(1), "inner")
            result = storage.materialise(docs.limit(1), "outer", lasts=True)
        assert left() == ["classes", "kept", "outer"] and result.count() == 1
    assert left() == ["classes", "kept"]
