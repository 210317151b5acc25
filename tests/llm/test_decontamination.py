import random

import numpy as np
import pytest

from parcelflow.llm import decontamination as D
from tests.llm.test_operators import brute_align


def zipf(rng, n, words=50_000):
    p = 1 / np.arange(1, words + 1)
    return rng.choice(words, size=n, p=p / p.sum()).astype(np.uint64)


def test_a_large_test_set_of_common_words_gives_few_hits():
    """20,000 items of 50 words drawn as in prose: about two hits for each word of a document, and next to nothing to align."""
    rng = np.random.default_rng(1)
    words = list(D.mix(zipf(rng, 20_000 * 50)).reshape(20_000, 50))
    items = D.Items(np.arange(20_000), words, D.N, D.MIN_SCORE)
    h = D.mix(zipf(rng, 200_000))
    hit, _ = items.hits(h, np.arange(0, 200_001, 1000))
    assert len(hit) < 2.5 * len(h)
    doc, _, first, last = items.stretches(h, np.arange(0, 200_001, 1000))
    assert (last - first).sum() < 0.1 * len(h)


@pytest.mark.parametrize("chunk", [1_000_000, 10])
@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
def test_every_edited_copy_that_scores_is_found(spark, monkeypatch, chunk, share):
    """Replaced, left out and put in words; found pairs and scores are those of alignment with every item, by either path."""
    monkeypatch.setattr(D, "CHUNK_WORDS", chunk)
    rng = random.Random(int(share * 10))
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 5000}"
    items = [(i, [word() for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 8, 20, 40]))]) for i in range(40)]
    texts = [[word() for _ in range(120)] for _ in range(15)]
    for _, w in items:
        out = []
        for x in w:
            if rng.random() >= share:
                out.append(x)
            else:
                out += rng.choice([[], ["edit"], [x, "put"], [x, "put", "more"]])
        texts.append([*[word() for _ in range(6)], *out, *[word() for _ in range(6)]])
    want = {}
    for k, t in enumerate(texts):
        for i, w in items:
            s = brute_align(w, t) / (2 * len(w))
            if s >= (0.5 if len(w) >= 5 else 1):
                want[k, i] = s
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(spark, docs, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 40
    assert sorted(r.doc_id for r in D.clean(spark, docs, bench).collect()) == sorted(set(range(len(texts))) - {k for k, _ in want})


def test_bounds_leave_every_scoring_alignment_enough_pairs():
    """The least of pairs that an alignment of score 0.5 keeps, by trying all ways to spend its losses."""
    for size in range(5, 60):
        _, choose, need, _ = (x[0] for x in D.bounds(np.array([size]), D.N, 0.5))
        least = min(size - 1 - 2 * u - t - i // 2 for u in range(size) for t in range(size) for i in range(size + 1) if 3 * u + 2 * t + i <= size)
        assert choose - (size - 1 - least) >= need >= 1
