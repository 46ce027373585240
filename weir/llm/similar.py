"""Texts with alike sets of word shingles, by an exact set join.

Two sets of Jaccard similarity t or more share an element among the first
n - ceil(t n) + 1 of each, in any order that is the same for all sets. These
elements are the index: texts that meet under one, of sizes and places that still
allow t, are candidates. Each text has the parities of its elements in buckets,
two to four bits an element: where those of two texts differ, their sets do, so a
candidate whose parities differ too often is none. Only the others' whole sets,
which are some thirty times as large, are moved and compared. Elements
that many texts have come last in the order, so they are hardly ever in the
index; they are counted in a sixteenth of the texts, which sets the order and
never the result.

Equal texts are one row before the index. Pairs whose fingerprints link them
already are no candidates; where only classes are asked for, neither are pairs that
a chain of such links among the texts of a key connects, so a group of near copies
is hardly compared again. A key
of more than ``tile`` texts is split, chunk against chunk. The index is several
times as large as the hashes of the texts, so its keys are joined in ``PASSES``,
each a part of them; the shuffle files of one are gone before the next.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, materialize, small_slices, text_bytes
from .graph import roots
from .shingles import MAX_BITS, fingerprint, shingles

SHARE = 16  # one text of so many is counted for the order
FREQUENT = 200_000  # elements that come last at most
PASSES = 4


def shingle_set(text: bytes, words: int) -> np.ndarray:
    parts = list(shingles(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def parities(elements: np.ndarray) -> bytes:
    """Whether each of 2^k buckets (at least two an element) holds an odd number of the elements, a bit each."""
    buckets = 1 << max(6, (2 * len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound, from their parities, of the number of elements that only one of two sets has."""
    a, b = (np.frombuffer(z, np.uint8) for z in ((x, y) if len(x) >= len(y) else (y, x)))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]  # of half the buckets
    return int(np.bitwise_count(a ^ b).sum())


def _sets(words: int):
    """(text hash, set) of each row (text, text hash)."""

    def run(batches: Batches) -> Batches:
        for batch in small_slices(batches, "text"):
            raw, off = text_bytes(batch.column(0))
            raw = raw.tobytes()
            sets = [shingle_set(raw[s:e], words).view(np.int64) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["text_hash", "elements"])

    return run


def _index(words: int, fingerprint_words: int, least: Fraction, last: np.ndarray):
    """(text hash, fingerprint, size, parities, first elements and their places by pass) of each row (text, text hash); ``last``: frequent elements, rarest first."""
    sorting = np.argsort(last)
    known = last[sorting]

    def first(elements: np.ndarray) -> np.ndarray:
        n = len(elements)
        rank = np.zeros(n, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, elements), len(known) - 1)
            rank = np.where(known[at] == elements, sorting[at] + 1, 0)
        return elements[np.lexsort((elements, rank))][: n - -(-n * least.numerator // least.denominator) + 1 if n else 0]

    def run(batches: Batches) -> Batches:
        for batch in small_slices(batches, "text"):
            raw, off = text_bytes(batch.column(0))
            raw, fps, sizes, odd = raw.tobytes(), [], [], []
            keys, places = ([[] for _ in range(PASSES)] for _ in range(2))
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                elements = shingle_set(raw[s:e], words)
                fps.append(fingerprint(raw[s:e], fingerprint_words))
                sizes.append(len(elements))
                odd.append(parities(elements))
                own = first(elements)
                for k in range(PASSES):
                    at = np.flatnonzero(own % np.uint64(PASSES) == k)
                    keys[k].append(own[at].view(np.int64))
                    places[k].append(at.astype(np.int32))
            cols = [batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary())]
            cols += [pa.array(k, pa.list_(pa.int64())) for k in keys] + [pa.array(k, pa.list_(pa.int32())) for k in places]
            yield pa.RecordBatch.from_arrays(cols, names=["text_hash", "fp", "size", "parities", *_pass_columns("keys"), *_pass_columns("places")])

    return run


def _pass_columns(name: str) -> list[str]:
    return [f"{name}_{k}" for k in range(PASSES)]


def _connected(fp: np.ndarray, cut: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row the first row that chains of links within its group connect it to."""
    rest = np.repeat(cut + n, n) - np.arange(len(fp)) - 1
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i = np.flatnonzero((np.repeat(n, n) <= 256) & (rest > 0))
    d = 1
    while len(i):
        near = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= MAX_BITS]
        a.append(near)
        b.append(near + d)
        d += 1
        i = i[rest[i] >= d]
    for s, m in zip(cut[n > 256].tolist(), n[n > 256].tolist(), strict=True):
        own = fp[s : s + m]
        step = max(1, 500_000 // m)
        for k in range(0, m, step):
            x, y = np.nonzero(np.bitwise_count(own[k : k + step, None] ^ own[None, :]) <= MAX_BITS)
            x += k
            root = roots(x[x < y], y[x < y], m)
            moved = np.flatnonzero(root != np.arange(m))
            a.append(moved + s)
            b.append(root[moved] + s)
    return roots(np.concatenate(a), np.concatenate(b), len(fp))


def _candidates(least: Fraction, every: bool):
    """Input sorted by gid: (gid, text hash, fp, size and place in one). Keeps the open group, so memory is a batch and a group."""
    up, down = least.numerator, least.numerator + least.denominator

    def pairs(cols: list[np.ndarray]) -> pa.RecordBatch:
        gid, text, fp, size, place = cols
        cut = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
        n = np.diff(np.append(cut, len(gid)))
        rest = np.repeat(cut + n, n) - np.arange(len(gid)) - 1  # rows of the group that follow
        out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        root = None if every else _connected(fp, cut, n)

        def add(i: np.ndarray, j: np.ndarray) -> None:
            a, b = size[i], size[j]
            ok = np.minimum(a - place[i], b - place[j]) >= -(-up * (a + b) // down)
            ok &= (np.bitwise_count(fp[i] ^ fp[j]) > MAX_BITS if root is None else root[i] != root[j]) & (text[i] != text[j])
            ok &= np.minimum(a, b) * least.denominator >= np.maximum(a, b) * up
            out_i.append(i[ok])
            out_j.append(j[ok])

        i = np.flatnonzero((np.repeat(n, n) <= 256) & (rest > 0))
        d = 1
        while len(i):
            add(i, i + d)
            d += 1
            i = i[rest[i] >= d]
        for s, m in zip(cut[n > 256].tolist(), n[n > 256].tolist(), strict=True):
            for k in range(s, s + m - 1):
                j = np.arange(k + 1, s + m)
                add(np.full(len(j), k), j)
        i, j = np.concatenate(out_i), np.concatenate(out_j)
        swap = text[i] > text[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        both = np.unique(np.stack([text[i], text[j], fp[i].view(np.int64), fp[j].view(np.int64)], 1), axis=0) if len(i) else np.zeros((0, 4), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, k]) for k in range(4)], names=["text_a", "text_b", "a", "b"])

    def run(batches: Batches) -> Batches:
        held = None
        for batch in batches:
            new = [batch.column(k).to_numpy() for k in range(4)]
            new[2:] = [new[2].view(np.uint64), new[3] >> 32, new[3] & 0xFFFFFFFF]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) > 100_000:
                end = int(np.searchsorted(held[0], held[0][-1]))
                if end:
                    yield pairs([c[:end] for c in held])
                    held = [c[end:] for c in held]
        if held is not None and len(held[0]):
            yield pairs(held)

    return run


def _possible(least: Fraction):
    """The rows (text_a, text_b, a, b, sizes, parities) whose parities allow the similarity, without the last four columns."""
    up, down = least.numerator, least.numerator + least.denominator

    def run(batches: Batches) -> Batches:
        for batch in batches:
            total = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
            differ = [least_difference(x, y) for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)]
            ok = (total - np.array(differ, np.int64)) * down >= 2 * up * total
            yield batch.select([0, 1, 2, 3]).filter(pa.array(ok))

    return run


def _similar(least: Fraction):
    """Links (a, b) of the rows (a, b, set of a, set of b) that are alike."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * least.denominator >= (len(x) + len(y) - both) * least.numerator)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _pass_pairs(index: DataFrame, number: int, frequent: DataFrame, least: Fraction, tile: int, every: bool) -> DataFrame:
    """Candidate pairs (text_a, text_b, a, b) that meet under the keys of one pass."""
    both = F.posexplode(F.arrays_zip(F.col(f"keys_{number}").alias("key"), F.col(f"places_{number}").alias("place")))
    packed = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("x.place").cast("long"))
    keyed = index.select("text_hash", "fp", "size", both.alias("p", "x")).select("text_hash", "fp", packed.alias("where"), F.col("x.key").alias("key"))
    pair = F.lit(0).cast("long")
    # a key of over ``tile`` texts is among the frequent ones, unless the sample is far off
    split = keyed.join(F.broadcast(frequent), "key", "left_semi").groupBy("key").agg(F.ceil(2 * F.count("*") / tile).cast("long").alias("parts")).where("parts > 2")
    split = materialize(split, "split_shingles")
    if not split.isEmpty():
        keyed = keyed.join(F.broadcast(split), "key", "left").withColumn("own", F.pmod(F.xxhash64("text_hash", F.lit(11)), F.col("parts")))
        none = F.array(F.lit(None).cast("long"))
        others = F.expr("filter(sequence(0L, parts - 1), i -> i <> own)")
        keyed = keyed.select("text_hash", "fp", "where", "key", "own", F.explode(F.when(F.col("parts").isNull(), none).otherwise(others)).alias("other"))
        pair = F.when(F.col("other").isNull(), F.lit(0).cast("long")).otherwise(F.least("own", "other") * 65536 + F.greatest("own", "other"))
    # two keys of one gid would only give candidates more
    dealt = keyed.select(F.xxhash64("key", pair).alias("gid"), "text_hash", "fp", "where").repartition("gid").sortWithinPartitions("gid")
    return materialize(arrow_map(dealt, _candidates(least, every), "text_a long, text_b long, a long, b long").distinct(), f"candidates_{number}")


def similar_texts(texts: DataFrame, similarity: float, *, words: int = 5, fingerprint_words: int = 4, tile: int = 4096, every: bool = True) -> DataFrame:
    """``a, b``: fingerprints of all texts (column ``text``) that are at least this similar and not near by fingerprint.

    With ``every`` false only as many as, with the links of near fingerprints, connect the same texts.
    """
    least = Fraction(str(similarity))
    hashed = texts.where("text is not null").select("text", F.xxhash64("text").alias("text_hash"))
    counted = arrow_map(hashed.where(F.pmod("text_hash", F.lit(SHARE)) == 0), _sets(words), "text_hash long, elements array<long>")
    counted = counted.select(F.explode("elements").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n >= 4")
    last = [r["key"] for r in counted.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()][::-1]
    order = np.array(last, np.int64).view(np.uint64)
    arrays = ", ".join([f"{c} array<long>" for c in _pass_columns("keys")] + [f"{c} array<int>" for c in _pass_columns("places")])
    index = arrow_map(hashed, _index(words, fingerprint_words, least, order), f"text_hash long, fp long, size int, parities binary, {arrays}")
    index = materialize(index.dropDuplicates(["text_hash"]), "shingle_index")
    frequent = index.sparkSession.createDataFrame([(k,) for k in last], "key long")
    found = [_pass_pairs(index, k, frequent, least, tile, every) for k in range(PASSES)]
    pairs = reduce(DataFrame.unionByName, found).distinct()
    odd = lambda n: index.select(F.col("text_hash").alias(f"text_{n}"), F.col("size").alias(f"size_{n}"), F.col("parities").alias(f"parities_{n}"))
    pairs = pairs.join(odd("a"), "text_a").join(odd("b"), "text_b").select("text_a", "text_b", "a", "b", "size_a", "size_b", "parities_a", "parities_b")
    pairs = materialize(arrow_map(pairs, _possible(least), "text_a long, text_b long, a long, b long"), "similar_candidates")

    nodes = materialize(pairs.select(F.explode(F.array("text_a", "text_b")).alias("text_hash")).distinct(), "candidate_texts")
    if nodes.count() <= 500_000:  # of 8 bytes; beyond that an ordinary join
        nodes = F.broadcast(nodes)
    wanted = hashed.join(nodes, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text", "text_hash")
    sets = materialize(arrow_map(wanted, _sets(words), "text_hash long, elements array<long>"), "candidate_sets")
    side = lambda n: sets.select(F.col("text_hash").alias(f"text_{n}"), F.col("elements").alias(f"elements_{n}"))
    whole = pairs.join(side("a"), "text_a").join(side("b"), "text_b").select("a", "b", "elements_a", "elements_b")
    return arrow_map(whole, _similar(least), "a long, b long")
