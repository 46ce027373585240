from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from weir.llm.shingles import fingerprint
from weir.llm.similar import least_difference, parities, similar_texts


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def planted(rng):
    """Texts of few changed words, beside texts that share a passage with all others."""
    shared = [f"s{i}" for i in range(60)]
    out = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))] + shared[: 60 * (g % 2)]
        out += [" ".join(base)] + [" ".join(changed(rng, base, rng.randrange(1, 7))) for _ in range(4)]
    return out + [" ".join(changed(rng, shared, rng.randrange(0, 4))) for _ in range(120)] + ["", "one two", "One  two"]


def test_all_similar_pairs_are_found(spark):
    texts = planted(random.Random(3))
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string")
    shingled, fps = [sets(t) for t in texts], [fingerprint(t.encode()) for t in texts]
    want = set()
    for i, x in enumerate(shingled):
        for j in range(i):
            y = shingled[j]
            if x and y and 5 * len(x & y) >= 4 * len(x | y) and (fps[i] ^ fps[j]).bit_count() > 4:
                want.add(frozenset((signed(fps[i]), signed(fps[j]))))
    assert len(want) > 50
    for tile in (4096, 16):  # 16: keys are split, chunk against chunk
        assert {frozenset(r) for r in similar_texts(df, 0.8, tile=tile).collect()} == want


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 31, 32, 33, 500, 5000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for part in (0.0, 0.02, 0.2, 1.0):
            k = int(part * len(x))
            y = np.unique(np.concatenate([x[k:], rng.integers(0, 2**63, rng.integers(0, k + 1), dtype=np.uint64)]))
            differ = len(np.setxor1d(x, y))
            bound = least_difference(parities(x), parities(y))
            assert bound == least_difference(parities(y), parities(x)) <= differ
            assert bound >= 0.4 * differ or n < 500  # the bound is of use, the more the nearer the sets are


def test_the_stage_drops_a_copy_of_few_changed_words(spark, sf_dir):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(220)]
    copy = list(base)
    for i in (20, 70, 120, 170):
        copy[i] = "changed"
    x, y = " ".join(base), " ".join(copy)
    assert len(sets(x) & sets(y)) / len(sets(x) | sets(y)) >= 0.8
    assert (fingerprint(x.encode()) ^ fingerprint(y.encode())).bit_count() > 4
    docs = spark.createDataFrame([(1, x), (2, y), (3, " ".join(base[:110]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, sf_dir).collect()) == [1, 3]
