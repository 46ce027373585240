"""A quality classifier on random-indexing word vectors.

Random indexing. Every word (a run of letters, digits or signs) has an index
vector of four +1 and -1, fixed by its hash; its context vector is the sum of the
index vectors of its neighbours over the whole corpus, and both together are its
word vector. Words that make up at least ``floor`` of all words (1 / floor at
most, whatever the size of the corpus) have a vector each; the rarer ones, about
whose contexts little is known, share ``SHARED`` vectors by their hash. All words
of the corpus are counted for that.

A document is the mean of its word vectors, and of the products of the vectors of
words that stand side by side or one apart: products bind two vectors to that of
their pair, as usual for random indexing of sequences, so pairs are pooled like
words. There is no other feature. A network of two layers, written in numpy, is
fitted to labelled rows, and its logits are divided by a temperature fitted on
rows it has not seen.

Vectors hold whole numbers, so all sums are exact: the result does not depend on
how rows are dealt or long texts are cut. The corpus is read three times for all
documents; counts of words and sums of vectors are shuffled. The network is fitted
on the driver on ``sample`` labelled rows at most (those of the smallest hash of
their id among the rows that have a document).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, crc32_of_id, materialize
from .runs import token_blocks

SHARED, DIMS, NONZERO, UNIT = 4096, 32, 4, 64  # UNIT: length of half a word vector
FLOOR = 2e-5
REACH = (1, 2)  # distances of neighbours
FEATURES = 2 * DIMS * (1 + len(REACH))
PRIOR = 8  # words without any direction that every document is given


def index_vectors(seeds: np.ndarray) -> np.ndarray:
    """A sparse ternary vector for each seed: one +1 or -1 in each quarter."""
    out = np.zeros((len(seeds), DIMS), np.int8)
    with np.errstate(over="ignore"):
        x = (seeds ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    rows = np.arange(len(seeds))
    for q in range(NONZERO):
        nibble = (x >> np.uint64(4 * q)).astype(np.int64) & 15
        out[rows, q * (DIMS // NONZERO) + nibble % (DIMS // NONZERO)] = 1 - 2 * (nibble >> 3)
    return out


class Words:
    """Rows of the vector table: the frequent words' own (by their sorted hashes), behind the shared ones."""

    def __init__(self, own: np.ndarray):
        self.own = own
        self.index = index_vectors(np.concatenate([np.arange(SHARED, dtype=np.uint64), own]))

    def rows(self, h: np.ndarray) -> np.ndarray:
        shared = (h >> np.uint64(64 - (SHARED.bit_length() - 1))).astype(np.int64)
        if not len(self.own):
            return shared
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[at] == h, SHARED + at, shared)


def _count(batches: Batches) -> Batches:
    """Rows (word, n), added up within the task in steps of bounded size."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        word, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(word, kind="stable")
        word, n = word[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return word[first], np.add.reduceat(n, first)

    def rows() -> pa.RecordBatch:
        word, n = merge()
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    for _, blocks in token_blocks(batches):
        for _, h, seen in blocks:
            if len(h) > seen:
                held.append(np.unique(h[seen:], return_counts=True))
                size += len(held[-1][0])
            if size > 400_000:
                held = [merge()]
                size = len(held[0][0])
                if size > 300_000:
                    yield rows()
                    held, size = [], 0
    if held:
        yield rows()


def frequent_words(texts: DataFrame, floor: float = FLOOR) -> np.ndarray:
    """Sorted hashes of the words that make up at least ``floor`` of all words of ``texts``; 1 / floor at most."""
    counted = arrow_map(texts.select("text"), _count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "word_counts")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = counted.where(F.col("n") >= max(1, math.ceil(floor * total))).select("word").toPandas()
    return np.sort(found["word"].to_numpy(np.int64).view(np.uint64))


def _contexts(sent):
    """Sums of the neighbours' index vectors, a row for each row of the table that occurs."""

    def run(batches: Batches) -> Batches:
        words = sent.value
        index = words.index
        total, hit = np.zeros(index.shape, np.int64), np.zeros(len(index), bool)
        for _, blocks in token_blocks(batches):
            for text, h, seen in blocks:
                if not len(h):
                    continue
                b = words.rows(h)
                near = np.zeros((len(b), DIMS), np.int8)
                for d in REACH:
                    first = np.flatnonzero(text[d:] == text[:-d]) if len(b) > d else np.zeros(0, np.int64)
                    first = first[first + d >= seen]
                    near[first] += index[b[first + d]]
                    near[first + d] += index[b[first]]
                order = np.argsort(b, kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], np.diff(b[order]) != 0]))
                own = b[order][cut]
                total[own] += np.add.reduceat(near[order], cut, axis=0, dtype=np.int64)
                hit[own] = True
        own = np.flatnonzero(hit)
        columns = [pa.array(own.astype(np.int32)), *(pa.array(np.ascontiguousarray(total[own, k])) for k in range(DIMS))]
        yield pa.RecordBatch.from_arrays(columns, names=["b", *(f"c{k}" for k in range(DIMS))])

    return run


def word_vectors(texts: DataFrame, words: Words) -> np.ndarray:
    """The table [context vector, index vector] of all rows, in whole numbers, from the whole corpus."""
    names = [f"c{k}" for k in range(DIMS)]
    sent = texts.sparkSession.sparkContext.broadcast(words)  # SHARED + 1 / floor rows of 40 bytes at most
    sums = arrow_map(texts.select("text"), _contexts(sent), "b int, " + ", ".join(f"{c} long" for c in names))
    found = sums.groupBy("b").agg(*(F.sum(c).alias(c) for c in names)).toPandas()  # as many rows
    context = np.zeros(words.index.shape)
    context[found["b"].to_numpy(np.int64)] = found[names].to_numpy(np.float64)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return np.hstack([np.rint(context / np.where(norm > 0, norm, 1) * UNIT), words.index * (UNIT / np.sqrt(NONZERO))]).astype(np.int8)


def _features(batches: Batches, words: Words, table: np.ndarray, column: str):
    """(rows, features) slice by slice."""
    for batch, blocks in token_blocks(batches, column):
        n = batch.num_rows
        single, pairs, count = np.zeros((n, 2 * DIMS)), np.zeros((len(REACH), n, 2 * DIMS)), np.zeros(n)
        for text, h, seen in blocks:
            for k in range(0, len(h), CHUNK):  # with the words that stand before it
                lead = min(k, max(REACH)) if k else seen
                _pool(text[k - (lead if k else 0) : k + CHUNK], table[words.rows(h[k - (lead if k else 0) : k + CHUNK])], lead, single, pairs, count)
        share = 1 / (count + PRIOR)[:, None]  # a few words say little: they stay near the origin
        yield batch, np.hstack([single * share / UNIT, *(p * share / UNIT**2 for p in pairs)])


CHUNK = 50_000  # words pooled at a time


def _pool(text: np.ndarray, v: np.ndarray, seen: int, single: np.ndarray, pairs: np.ndarray, count: np.ndarray) -> None:
    """Add up vectors ``v`` of words, and products of pairs, by text; the first ``seen`` words are only the left of pairs."""

    def by_text(owner: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[first]] += np.add.reduceat(values, first, axis=0, dtype=np.int64)

    by_text(text[seen:], v[seen:], single)
    count += np.bincount(text[seen:], minlength=len(count))
    wide = v.astype(np.int16)
    for d, out in zip(REACH, pairs, strict=True):
        right = np.arange(max(seen, d), len(text))
        right = right[text[right] == text[right - d]]
        by_text(text[right], wide[right] * wide[right - d], out)


@dataclass
class Network:
    """x -> tanh(x a + b) c + d, divided by the temperature, as a logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return (np.tanh(self.standard(x) @ a + b) @ c)[:, 0] + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 80, seed: int = 5) -> Network:
    """Fit the network and its temperature; the last sixth of the rows is for the temperature.

    Without rows every score is 0.5; rows of one label part nothing, so all scores are their smoothed share of good ones.
    """
    rng = np.random.default_rng(seed)
    scale = x.std(0) if len(x) else np.ones(x.shape[1])
    net = Network(
        x.mean(0) if len(x) else np.zeros(x.shape[1]), np.where(scale > 1e-6, scale, 1.0),
        [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros((hidden, 1)), np.zeros(1)],
    )
    if not len(x):
        return net
    if y.min() == y.max():
        net.weights[3][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return net
    cut = len(x) - len(x) // 6
    z, t = net.standard(x[:cut]), y[:cut]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for k in range(0, cut, 128):
            i = order[k : k + 128]
            a, b, c, d = net.weights
            h = np.tanh(z[i] @ a + b)
            p = 1 / (1 + np.exp(-np.clip((h @ c)[:, 0] + d[0], -60, 60)))
            g = ((p - t[i]) / len(i))[:, None]
            back = g @ c.T * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * a, back.sum(0), h.T @ g + 1e-4 * c, g.sum(0)]
            step += 1
            for w, (m, v), grad in zip(net.weights, moments, grads, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    rest = net.logits(x[cut:]) if cut < len(x) else net.logits(x)
    target = y[cut:] if cut < len(x) else y
    sign = np.where(target > 0.5, 1.0, -1.0)
    options = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    loss = [np.logaddexp(0, -sign * rest / o).mean() for o in options]
    net.temperature = float(options[int(np.argmin(loss))])
    return net


@dataclass
class Scorer:
    """What scoring needs: the words, their vectors and the network, each sent to every executor once (a few MB in all)."""

    words: object
    table: object
    network: object

    def batches(self, batches: Batches, column: str):
        """(rows, their scores), slice by slice."""
        for batch, x in _features(batches, self.words.value, self.table.value, column):
            yield batch, self.network.value.score(x)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample: int = 20_000,
    folds: int = 5,
    floor: float = FLOOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Scorer:
    """Word vectors from all of ``docs``, and a network from at most ``sample`` labelled rows of it.

    Rows whose crc32 of the id (as text) leaves 0 by ``folds`` are held out and
    teach no label. Labels that are null, and ids that are null, teach nothing; an
    id labelled twice counts with its smallest label; ids without a document are
    left out before the sample is taken.
    """
    send = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known_words = Words(frequent_words(texts, floor))
    words, table = send(known_words), send(word_vectors(texts, known_words))
    taught = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc32_of_id(F.col(id_col)) % folds != 0))
    taught = taught.groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).cast("double").alias("y"))
    taught = taught.join(texts.select("id").distinct().hint("merge"), "id", "left_semi")  # ids of both grow with the corpus
    chosen = materialize(taught.select("id", "y", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample), "labelled")
    known = texts.join(F.broadcast(chosen), "id").select("text", "h", "y")  # ``sample`` rows of 24 bytes at most

    def features(batches: Batches) -> Batches:
        for batch, x in _features(batches, words.value, table.value, "text"):
            rows = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), rows], names=["h", "y", "x"])

    found = arrow_map(known, features, "h long, y double, x binary").orderBy("h", "x").limit(sample).toPandas()
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return Scorer(words, table, send(fit(x, found["y"].to_numpy(np.float64))))


def score(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``<id_col>, held_out, score, predicted`` for every row; ``options`` are those of ``train``.

    Null texts count as empty; empty texts get a score as well. Repeated rows are
    given back as often as they come, null ids are kept. Without labels every
    score is 0.5. Empty tables give empty results. Other columns are ignored.
    """
    scorer = train(docs, labels, folds=folds, id_col=id_col, text_col=text_col, **options)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Batches) -> Batches:
        for batch, found in scorer.batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "score"])

    return arrow_map(texts, run, f"id {dict(texts.dtypes)['id']}, score double").select(
        F.col("id").alias(id_col),
        (crc32_of_id(F.col("id")) % folds == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, whole, that ``score`` predicts as good. No text is shuffled for it.

    Null and empty texts have a score like any other. Repeated rows and null ids
    are kept or go like any other. Without labels every score is 0.5. Empty tables
    give empty results. All columns are kept, whatever their names.
    """
    scorer = train(docs, labels, text_col=text_col, **options)

    def run(batches: Batches) -> Batches:
        for batch, found in scorer.batches(batches, text_col):
            yield batch.filter(pa.array(found >= threshold))

    return arrow_map(docs, run, docs.schema)
