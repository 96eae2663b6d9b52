"""Results that a review found cut or untested."""

import random

import pytest

pytest.importorskip("dredgeline.llm")
pytest.importorskip("public_tokenizers")

from test_llm import SCHEMA, brute_components, corpus, same  # noqa: E402


def test_stage_drops_near_copies_of_five_words(spark):
    """A text of 300 words with isolated edits: six leave a copy at 5 words and 0.8, and five at 3 words and 0.9."""
    import corpus_pipeline

    r = random.Random(5)
    rows = corpus()
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    for k in range(9):
        w = list(base)
        for e in range(k):
            w[20 + 30 * e] = f"edit{k}"
        rows.append((1000 + k, " ".join(w), "en", "s1", 1))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    found = brute_components(rows, 5, 80)
    same(kept.select("doc_id"), [(c,) for c in {c for _, k, c in found if k}] + [(d,) for d, k, _ in found if not k])
    ids = {x.doc_id for x in kept.select("doc_id").collect()}
    assert 1000 in ids and not ids & {1001, 1002, 1003, 1004, 1005, 1006}


def test_scores_do_not_depend_on_the_broadcast_bound(spark, monkeypatch):
    """The filter has its 10 bits an entry on both sides of the bound, and unseen pairs miss there."""
    from dredgeline.llm import bloom_lm

    monkeypatch.setattr(bloom_lm, "GROUP", 4000)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    by = {mb: sorted(map(tuple, bloom_lm.score_texts(docs, filter_mb=mb).collect()), key=repr) for mb in (64, 0)}
    assert len(by[0]) == len(by[64]) == len(corpus())
    for x, y in zip(by[0], by[64]):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:])


def test_probes_end_at_the_highest_level():
    """A full segment answers with its highest level instead of probing on."""
    from types import SimpleNamespace

    import numpy as np

    from dredgeline.llm import bloom_lm

    full = [SimpleNamespace(kind=bloom_lm.PAIR, bucket=b, top=3, segment=b"\xff" * 8) for b in range(64)]
    keys = np.arange(100, dtype=np.uint64) << np.uint64(56)
    assert set(bloom_lm.Filter(4, 64).fill(iter(full)).levels(keys, bloom_lm.PAIR)) == {3}
