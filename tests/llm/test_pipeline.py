"""The corpus pipeline, stage by stage, against plain versions of what each stage decides."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.test_simhash import classes, slow_fingerprint
from weir.llm import language, mixing, quality
from weir.llm.common import materialize
from weir.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = materialize(stage(spark, docs, sf_dir), name)
        out.append((docs, result))
        docs = result
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_registration():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "simhash_near_dedup", "mix_sources", "bpe_encoding"]
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_columns_stay(stages):
    for _, result in stages[:-1]:
        assert result.columns == COLUMNS


def test_quality_stage(spark, sf_dir, stages):
    before, after = stages[0]
    score = {r["doc_id"]: r["predicted"] for r in quality.score(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert rows(after) == Counter({r: n for r, n in rows(before).items() if score[r[0]]})
    assert 0 < after.count() < before.count()


def test_language_stage(stages):
    before, after = stages[1]
    found = {r["doc_id"]: r for r in language.identify(before).collect()}
    assert rows(after) == Counter({r: n for r, n in rows(before).items() if found[r[0]]["lang_pred"] != "und" and found[r[0]]["score"] >= 0.2})


def test_dedup_stage(stages):
    """Links of four bits at most, or of five-word shingle sets that are 0.8 alike, by comparing all texts."""
    before, after = stages[2]
    texts = {r[0]: r[1] for r in before.select("doc_id", "text").collect()}
    sets = {i: set(words_of(t)) for i, t in texts.items()}
    root = classes({i: slow_fingerprint(t) for i, t in texts.items()})

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    kept = {find(i) for i in ids}
    assert rows(after) == Counter({r: n for r, n in rows(before).items() if r[0] in kept})


def words_of(text):
    words = (text or "").encode().lower().split()
    return [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []


def test_mix_stage(stages):
    before, after = stages[3]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert rows(after) == +Counter({r: n * copies[r[0]] for r, n in rows(before).items()})


def test_token_stage(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in before.collect():
        ids = tuple(library.encode(r["text"], add_special_tokens=False).ids)
        want[r["doc_id"], len(ids), ids, hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in after.collect()) == want


def test_run_is_all_stages(spark, sf_dir, stages):
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in stages[-1][1].collect())


def test_stages_take_odd_rows(spark, sf_dir, odd_docs, no_docs):
    """What each stage keeps of rows with nulls, repeated ids and clashing columns."""
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).collect() == []
    quality_, language_, dedup, mix, tokens = (stage for _, stage in corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:9]) for r in df.collect())
    given = ids(odd_docs)
    for stage in (quality_, language_):
        out = stage(spark, odd_docs, sf_dir)
        assert out.schema == odd_docs.schema and not Counter(ids(out)) - Counter(given)
    out = dedup(spark, odd_docs, sf_dir)
    # 1 and 2 are one class, the wordless texts are one whose smallest id is 3, and 2 has another text as well
    assert out.schema == odd_docs.schema
    assert ids(out) == sorted([(False, 1, "the quick"), (False, 2, "another t"), (True, 0, "a text wi"), (False, 3, ""), (False, 6, "word word"), (False, 7, "ü" * 9), (False, 8, "1234 5678")])
    copies = Counter()
    for r in mixing.mix(odd_docs).collect():
        copies[r["doc_id"], r["size"]] += r["copies"]
    out = mix(spark, odd_docs, sf_dir)
    assert out.schema == odd_docs.schema
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in out.collect()) == +copies
    assert tokens(spark, odd_docs, sf_dir).count() == odd_docs.count()


def test_a_small_corpus_whole(spark, tmp_path):
    """The pipeline's rows against plain versions of all decisions, applied to a corpus of a few known texts."""
    rng = __import__("random").Random(3)
    words = "the of and to in that it was for on with as his they be at one have this from".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(60) for _ in range(30)]
    texts += [texts[0], texts[1] + " again", "12 34 !!", ""]
    docs = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    kept = [d for d in docs if d[0] < 30]  # 30 and 31 repeat others, 32 and 33 have no letters; all are good
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got == +Counter(want)
