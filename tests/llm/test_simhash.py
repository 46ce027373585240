from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.llm import simhash
from weir.llm.graph import components
from weir.llm.queries import op2_simhash_near_dedup


def slow_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps: dict) -> dict:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j > i and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB cÄ  \t\n\x0b\x1c\x85ſK"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_sparks_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c d", seed=42)


def test_whole_table(spark, sf_dir):
    rows = op2_simhash_near_dedup(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes(fps)


def _planted(rng, groups, size):
    out = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            for b in rng.sample(range(64), rng.randrange(6)):
                base ^= 1 << b
            out.append(base)
    return list(dict.fromkeys(out))


def test_links_connect_all_that_is_near(spark):
    rng = random.Random(5)
    fps = _planted(rng, 40, 8) + [0, 1, (1 << 64) - 1]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = classes(dict(zip(signed, fps, strict=True)))
    for tile in (4096, 4):  # 4: keys are split, chunk against chunk
        roots = {r["node"]: r["root"] for r in components(simhash.near_links(df, tile)).collect()}
        groups = {}
        for s in signed:
            groups.setdefault(roots.get(s, s), set()).add(s)
        expected = {}
        for s, c in want.items():
            expected.setdefault(c, set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_group_gives_a_forest(spark):
    """A thousand near copies give less than a link each for each key, not half a million pairs."""
    rng = random.Random(2)
    fps = list({0xABCDEF0123456789 ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(3000)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    n = links.count()
    assert n < 64 * len(fps)
    assert len({r["root"] for r in components(links).collect()}) == 1


def test_components_of_all_shapes(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    ring = [(5000 + i, 5000 + (i + 1) % 30) for i in range(30)]
    df = spark.createDataFrame([*path, *star, *ring, (7, 7), (1001, 1000)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(df).collect()}
    for nodes in (range(61), range(1000, 1200), range(5000, 5030)):
        assert len({roots[n] for n in nodes}) == 1
    assert len(set(roots.values())) == 3
    assert components(df.limit(0)).collect() == []


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert {r["fp"] for r in empty} == {0} and {r["component_id"] for r in empty} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] == 1} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] is None and r["fp"] != 0] == [None]
    assert simhash.near_duplicates(no_docs).collect() == []


def test_keep_one(odd_docs, no_docs):
    rows = simhash.keep_one(odd_docs).collect()
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:12]) for r in rows)
    assert kept == sorted([("1", "the quick br"), ("2", "another text"), ("3", ""), ("None", "a text witho"), ("6", "word word wo"), ("7", "ü" * 12), ("8", "1234 5678 !!")])
    assert simhash.keep_one(no_docs).collect() == []


def test_keep_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text here now ok")] * 5 + [(2, "same text here now ok")], "doc_id long, text string")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, "same text here now ok")]


def test_one_key_counts_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)))
        hits = 0
        for bit in range(64):
            at, n = next(s for s in simhash.SEGMENTS if s[0] <= bit < s[0] + s[1])
            meets = not int(x) & ((1 << n) - 1 << at) & ~(1 << bit)
            if meets:
                hits += bool(simhash._verified(np.array([x]), np.array([bit]))[0])
        assert hits == (1 if int(x).bit_count() <= 4 else 0)
