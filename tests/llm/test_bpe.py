from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weir.llm import bloom, bpe
from weir.llm.queries import op3_bpe_round_trip, vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def codec():
    return bpe.load(vocabulary())


def test_whole_table(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_bpe_round_trip(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aA 's1!\n\t 　")), max_size=80))
def test_codec_equals_the_library(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_special_tokens_and_unknown_files(codec, library):
    text = "a<|endoftext|> b <|endoftext|><|endoftext"
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    import public_tokenizers

    other = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.splits
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert other.encode("Hello there").tolist() == t.encode("Hello there", add_special_tokens=False).ids


def shared_corpus():
    """Passages that stand in many texts, at places that chunks don't begin at."""
    rng = random.Random(11)
    words = ["the", "of", "don't", "naïve", "1234", "x" * 9, "...", "Ärger", "\n\n", "  two", "<|endoftext|>", "日本語", "we'll"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", "a", "ing", "é"]) for _ in range(n))
    passages = [make(600) for _ in range(3)]
    out = [(i, make(rng.randrange(200)) + rng.choice(passages) + make(rng.randrange(200))) for i in range(40)]
    out += [(100, out[0][1]), (100, out[0][1]), (101, out[0][1]), (102, "ab" * 20_000), (103, "é" * 5000 + " x y"), (104, "a b " * 9000), (105, "")]
    return out


def test_joins_are_repaired_exactly(spark, library):
    corpus = shared_corpus()
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(df, vocabulary()).collect())
    assert got == sorted((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in corpus)


def known_chunks(codec, raw, some=lambda k: True):
    """Chunks of a text as if each had been encoded elsewhere."""
    owner, begin, end = bpe.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert (owner == 0).all() and (begin[1:] >= end[:-1]).all()
    return [(b, e, bpe.pack_chunk(codec, raw[b:e])) for k, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)) if some(k)]


def test_chunks_join_exactly(codec, library):
    for _, text in shared_corpus()[:12]:
        for some in (lambda k: True, lambda k: k % 2, lambda k: k % 3 == 0):
            ids, taken = bpe.join(codec, text.encode(), known_chunks(codec, text.encode(), some))
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and taken > 0


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from(["the", " ", "  ", "\n", "'", "'s", "'ll", "re", " don't", "é", "日本語", "，", "12", "!!", "<|endoftext|>", "<|endo", "\t", "   ", "%%%", "ß", "\U0001F600", "\u0558", "\u3000"]), max_size=200),
    st.lists(st.integers(0, 2000), max_size=6),
    st.integers(0, 255),
)
def test_joins_at_any_place(codec, library, parts, places, which):
    """Pieces cut anywhere, not only by the rolling hash, join to the library's ids."""
    text = "".join(parts)
    raw = text.encode()
    cuts = sorted({0, len(raw), *(p for p in places if p < len(raw) and raw[p] & 0xC0 != 0x80)})
    known = [(a, b, bpe.pack_chunk(codec, raw[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if which >> k & 1]
    assert bpe.join(codec, raw, known)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_splits_are_the_librarys(codec, library):
    settled = bpe._settled()
    for c in (chr(i) for i in range(0x30000) if settled[i] and not 0xD800 <= i < 0xE000):
        for text in (f"a{c}1  b", f".{c}{c}'s"):
            assert bpe.pretokens(codec, text.encode()).tolist() == [len(text[:e].encode()) for _, (_, e) in library.pre_tokenizer.pre_tokenize_str(text)]
    for text in ("a 😀😀 b" + " c" * 20, "x\u0558y"):  # further than that nothing is taken for certain
        ends = bpe.pretokens(codec, text.encode()).tolist()
        assert all(e < 2 for e in ends)


def test_chinese_texts_share_chunks(spark, codec, library, monkeypatch):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("的一是不了人我在有他这为之大来以个中上们") if rng.random() < 0.95 else rng.choice("，。") for _ in range(n))
    passage = make(20_000)
    ids, taken = bpe.join(codec, passage.encode(), known_chunks(codec, passage.encode()))
    assert taken > 0.7 * len(ids) and ids.tolist() == library.encode(passage, add_special_tokens=False).ids
    corpus = [(i, make(50 * i) + passage + make(33 * i)) for i in range(6)]
    kept = tables(monkeypatch)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(spark.createDataFrame(corpus, "doc_id long, text string"), vocabulary()).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in corpus}
    assert kept["shared_chunks"].count() > 20


def test_a_chunk_that_very_many_texts_hold(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "HOT_CHUNK", 5)
    monkeypatch.setattr(bpe, "HOT_TEXT", 3)
    rng = random.Random(8)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(1500))
    corpus = [(i, f"{i} {passage}") for i in range(40)] + [(i, passage) for i in range(20)]
    kept = tables(monkeypatch)
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(spark.createDataFrame(corpus, "doc_id long, text string"), vocabulary()).collect())
    assert got == sorted((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in corpus)
    parts = {(r["h1"], r["h2"], r["part"]): r["n"] for r in kept["uses"].groupBy("h1", "h2", "part").agg(F.count("*").alias("n")).collect()}
    assert len({p for _, _, p in parts}) > 4 and max(parts.values()) < 30


def tables(monkeypatch):
    """The intermediate tables that the operator writes, by name."""
    kept, real = {}, bpe.materialize

    def spy(df, name):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(bpe, "materialize", spy)
    return kept


def test_cuts_follow_content(monkeypatch):
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 20_000).astype(np.uint8)
    a = np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), passage])
    b = np.concatenate([rng.integers(97, 123, 3).astype(np.uint8), passage])
    inside = lambda x, at: {c - at for c in bpe.cuts(x).tolist() if c - at >= bpe.WINDOW}
    assert inside(a, 777) == inside(b, 3) and len(inside(a, 777)) > 5
    whole = bpe.cuts(a).tolist()
    monkeypatch.setattr(bpe, "SLICE", 1000)
    assert bpe.cuts(a).tolist() == whole


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    """What the shared-chunk scan encodes is a copy of each, not one a text."""
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000))
    docs = spark.createDataFrame([(i, f"{i} {passage}") for i in range(30)], "doc_id long, text string")
    kept = tables(monkeypatch)
    bpe.encode(docs, vocabulary()).count()
    shared, encoded = kept["shared_chunks"].count(), kept["shared_work"].where(F.col("kind") == bpe.CHUNK).count()
    assert shared > 10 and shared <= encoded <= shared + 2
    assert kept["uses"].count() >= 29 * shared


def test_odd_rows(odd_docs, no_docs, library):
    coded = bpe.decode(bpe.encode(odd_docs, vocabulary()), vocabulary()).collect()
    want = sorted((str(r["doc_id"]), tuple(library.encode(r["text"] or "", add_special_tokens=False).ids), r["text"] or "") for r in odd_docs.select("doc_id", "text").collect())
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in coded) == want
    again = bpe.encode(odd_docs, vocabulary(), decoded=True).collect()
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in again) == want
    empty = bpe.decode(bpe.encode(no_docs, vocabulary()), vocabulary())
    assert empty.collect() == [] and empty.columns == ["doc_id", "ids", "decoded"]


def test_bloom_has_no_false_negatives(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**63), 2**63 - 1, 5000)
    words = bloom.build(spark.createDataFrame([(int(v),) for v in x], "h long"), "h")
    assert bloom.holds(words, x.view(np.uint64)).all()
    assert bloom.holds(words, rng.integers(0, 2**63 - 1, 20_000).view(np.uint64)).mean() < 0.1
    assert not bloom.holds(bloom.build(spark.createDataFrame([], "h long"), "h"), x.view(np.uint64)).any()


def test_a_text_of_very_many_rows(spark, library):
    from collections import Counter

    base = "The quick brown fox jumps " * 60
    rows = [(i % 7, base) for i in range(1300)] + [(i, f"{i} more {base}") for i in range(20)] + [(None, base)] * 3
    coded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), vocabulary())
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in coded.collect())
    assert got == Counter((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in rows)
