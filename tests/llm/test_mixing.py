from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from weir.llm import mixing
from weir.llm.queries import op10_entropy_balanced_mix


def slow_targets(sizes):
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, fixed = 1.5 * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        w = sum(weight[i] for i in free)
        want = {i: left * weight[i] / w for i in free}
        over = {i for i in free if want[i] > 2 * sizes[i]}
        if not over:
            return [fixed.get(i, want.get(i)) for i in range(len(sizes))]
        fixed |= {i: 2.0 * sizes[i] for i in over}


def test_targets():
    for sizes in ([10, 10, 10], [1, 100, 5, 7, 900], [0, 0], [], [5], [3, 0, 8], list(range(1, 40))):
        assert mixing.targets(sizes) == pytest.approx(slow_targets(sizes))


def test_whole_table(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_entropy_balanced_mix(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    count = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in docs.items()}
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == count[r["doc_id"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        total[source] += r["size"]
        taken[source] += r["taken"]
        assert target.setdefault(source, r["target"]) == r["target"]
    order = sorted(total)
    assert [target[s] for s in order] == pytest.approx(slow_targets([total[s] for s in order]))
    assert all(r["source_size"] == total[docs[r["doc_id"]]["source"]] for r in rows)
    for s in order:
        least = min(count[i] for i, r in docs.items() if r["source"] == s and count[i])
        assert abs(taken[s] - target[s]) <= max(least, 0.02 * target[s])


def test_rates_meet_the_targets_and_are_tilts(spark, sf_dir):
    found = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    for _, own in found.groupby("source"):
        assert (own.rate * own["size"]).sum() == pytest.approx(own.target.iloc[0], rel=1e-6)
        if own.target.iloc[0] < 2 * own.source_size.iloc[0]:
            odds = np.log(own.rate / (2 - own.rate))  # linear in the size: an exponential tilt
            slope = odds[own["size"] > 0] / own["size"][own["size"] > 0]
            assert np.allclose(slope, slope.iloc[0], rtol=1e-5)
        assert own.copies.between(0, 2).all()


def test_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "copies").collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(5)))


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["source"] for r in rows} == {"a", "b", "c", None}
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert mixing.mix(no_docs).collect() == []
    repeated = mixing.repeat(odd_docs, mixing.mix(odd_docs))
    assert repeated.columns == odd_docs.columns
    assert repeated.count() == sum(r["copies"] for r in rows)
    assert mixing.repeat(no_docs, mixing.mix(no_docs)).collect() == []


def test_the_null_source_is_last(spark):
    docs = spark.createDataFrame([(1, "a b c d", None), (2, "a b c d", "z"), (3, "a b c d", "\U0001F600"), (4, "a b c d", "Z"), (5, "a b c d", "")], "doc_id long, text string, source string")
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    want = slow_targets([4] * 5)
    assert [target[s] for s in ("", "Z", "z", "\U0001F600", None)] == pytest.approx(want)


def test_one_repeated_document(spark):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 90 + [(i, "x " * i, "b") for i in range(2, 30)] + [(i + 100, "y " * i, "c") for i in range(2, 30)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    taken = sum(r["copies"] * r["size"] for r in rows if r["source"] == "a")
    assert len(rows) == docs.count() and abs(taken - next(r["target"] for r in rows if r["source"] == "a")) <= 2


def slow_copies(sizes, target, most=2):
    """Words taken of one source: bisection for the tilt, then rounding from long to short. ``sizes``: {size: documents}."""
    total, rows = sum(s * n for s, n in sizes.items()), sum(sizes.values())
    mean = total / rows
    rate = lambda lam, s: most / (1 + math.exp(-max(-700, min(700, lam * s / mean))))
    if target >= most * total * (1 - 1e-12):
        return {s: (most if s else 1) * n for s, n in sizes.items()}
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(s * n * rate(mid, s) for s, n in sizes.items()) > target:
            hi = mid
        else:
            lo = mid
    out, owed = {}, 0.0
    for s, n in sorted(sizes.items(), reverse=True):
        owed += s * n * rate(lo, s)
        out[s] = min(max(round(owed / s), 0), most * n) if s else n
        owed -= out[s] * s
    return out


def test_copies_against_a_slow_version(spark, sf_dir):
    found = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    for _, own in found.groupby("source"):
        want = slow_copies(own["size"].value_counts().to_dict(), own.target.iloc[0])
        got = own.groupby("size").copies.sum().to_dict()
        assert sum(abs(got[s] - want[s]) for s in want) <= 2  # a rounding at the border may go either way


def test_copies_go_to_the_rows_that_they_were_counted_for(spark):
    rows = [(1, "a", "s"), (1, "a b c d e", "s"), (1, "a b c d e", "t"), (None, "x y", "s"), (None, "x y", "s"), (None, "z y", "s"), (2, "q", None), (2, "q", None)] + [(i, "w " * i, "s") for i in range(3, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    words = lambda rs: sorted((str(s), n) for s, n in rs.items())
    want, got = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    for r in mixing.repeat(docs, mixed).collect():
        got[r["doc_id"], r["source"], len(r["text"].split())] += 1
    assert words(got) == words({k: v for k, v in want.items() if v})
    fixed = spark.createDataFrame([(1, "s", 1, 2), (1, "s", 5, 1)], "doc_id long, source string, size long, copies long")
    two = docs.where("doc_id = 1 AND source = 's'")
    assert sorted(len(r["text"].split()) for r in mixing.repeat(two, fixed).collect()) == [1, 1, 5]


def test_a_document_that_is_a_third_of_the_table(spark, monkeypatch):
    from weir.llm import common

    real = common.numbered
    monkeypatch.setattr(mixing, "numbered", lambda df, count, out, chunk=7: real(df, count, out, 7))
    docs = spark.createDataFrame([(1, "one two three", "a")] * 100 + [(None, f"n{i} x", "a") for i in range(60)] + [(i, "x " * (i % 40), "b") for i in range(2, 160)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert len(rows) == docs.count()
    repeated = mixing.repeat(docs, mixed)
    assert repeated.count() == sum(r["copies"] for r in rows)
    assert repeated.where("doc_id = 1").count() == sum(r["copies"] for r in rows if r["doc_id"] == 1)
    again = sorted(map(str, mixing.repeat(docs.repartition(7), mixing.mix(docs.repartition(5))).collect()))
    assert again == sorted(map(str, repeated.collect()))
