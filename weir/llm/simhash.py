"""Near-duplicates by SimHash, found through deletion-variant signatures.

Fingerprints that differ in at most four bits, cut into three segments, have a
segment that differs in at most one bit. Each fingerprint is therefore indexed
under 64 keys: a segment with one bit taken out (a wildcard there). Two
fingerprints meet under a key, the full distance is verified, and the classes are
the connected components.

Sizes: texts are read once and never shuffled; equal fingerprints become one row
before the index (so exact copies cost nothing), each fingerprint has 64 rows of
16 bytes in it. A key that many fingerprints share is split: with ``tile`` as the
bound its members are dealt into chunks and every pair of chunks is a group of
its own, of about two ``tile`` members. A group gives back a spanning forest of
its verified links, never all pairs, and each link is looked at under one key
only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, materialize, small_slices, text_bytes, unused
from .graph import components, roots
from .shingles import MAX_BITS, fingerprint
from .similar import similar_texts

SEGMENTS = ((0, 21), (21, 21), (42, 22))  # (first bit, bits)


def _fingerprints(words: int):
    def run(batches: Batches) -> Batches:
        for batch in small_slices(batches, "text"):
            raw, off = text_bytes(batch.column(1))
            raw = raw.tobytes()
            fps = [fingerprint(raw[s:e], words) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    return run


def _verified(x: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which differences x are links to be reported under the key with wildcard ``bit``.

    A pair meets under many keys. It counts under one: in the first segment that
    differs in at most one bit, at that bit, or at the segment's first bit.
    """
    ok = np.bitwise_count(x) <= MAX_BITS
    done = np.zeros(x.shape, bool)
    result = np.zeros(x.shape, bool)
    for at, n in SEGMENTS:
        seg = x & np.uint64((1 << n) - 1 << at)
        few = np.bitwise_count(seg) <= 1
        here = (bit >= at) & (bit < at + n) & few & ~done
        result |= here & ((seg != 0) | (bit == at))
        done |= few
    return ok & result


def _forest(gid: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) that connect what the groups of equal gid link."""
    cut = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
    size = np.diff(np.append(cut, len(gid)))
    keep = np.repeat(size > 1, size)
    gid, fp, size = gid[keep], fp[keep], size[size > 1]
    if not len(gid):
        return fp, fp
    begin = np.cumsum(size) - size
    bit = (gid >> 54) & 63
    own, at = np.unique(fp, return_inverse=True)
    rest = np.repeat(begin + size, size) - np.arange(len(gid)) - 1  # rows of the group that follow
    pa_, pb_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(size <= 64, size)
    for d in range(1, 64):
        i = np.flatnonzero(small & (rest >= d))
        if not len(i):
            break
        i = i[_verified(fp[i] ^ fp[i + d], bit[i])]
        pa_.append(at[i])
        pb_.append(at[i + d])
    for s, n in zip(begin[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        run, idx = fp[s : s + n], at[s : s + n]
        step = max(1, 500_000 // n)
        fa, fb = [], []
        for k in range(0, n, step):
            i, j = np.nonzero(_verified(run[k : k + step, None] ^ run[None, k:], bit[s]))
            ok = j > i
            i, j = i[ok] + k, j[ok] + k
            root = roots(i, j, n)
            moved = np.flatnonzero(root != np.arange(n))
            fa.append(moved)
            fb.append(root[moved])
        root = roots(np.concatenate(fa), np.concatenate(fb), n)
        moved = np.flatnonzero(root != np.arange(n))
        pa_.append(idx[moved])
        pb_.append(idx[root[moved]])
    root = roots(np.concatenate(pa_), np.concatenate(pb_), len(own))
    moved = np.flatnonzero(root != np.arange(len(own)))
    return own[moved], own[root[moved]]


def _link(batches: Batches) -> Batches:
    """Input sorted by gid. Keeps the open group from batch to batch, so memory is a batch and a group."""

    def out(gid: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _forest(gid, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    gid, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        gid = np.concatenate([gid, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if len(gid) > 100_000:
            end = int(np.searchsorted(gid, gid[-1]))
            if end:
                yield out(gid[:end], fp[:end])
                gid, fp = gid[end:], fp[end:]
    if len(gid):
        yield out(gid, fp)


def near_links(fps: DataFrame, tile: int = 4096) -> DataFrame:
    """``a, b``: links that connect all fingerprints ``fp`` (distinct) within four bits of each other."""
    values = [_bits(at, n).bitwiseAND(F.lit(m).cast("long")) for at, n, _, m in _variants()]
    keyed = fps.select("fp", F.posexplode(F.array(*values)).alias("bit", "value")).select("fp", _key("bit", "value"))

    segments = fps.select(F.posexplode(F.array(*[_bits(at, n) for at, n in SEGMENTS])).alias("seg", "value"))
    hot = materialize(segments.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > tile // 2), "hot_segments")
    pair = F.lit(0).cast("long")
    if not hot.isEmpty():
        # some of the keys of these segment values have over ``tile`` fingerprints
        variant = [
            F.struct(F.lit(s).alias("s"), F.lit(j).alias("bit"), F.col("value").bitwiseAND(F.lit(m).cast("long")).alias("value"))
            for j, (_, _, s, m) in enumerate(_variants())
        ]
        wide = hot.select("seg", "n", F.explode(F.array(*variant)).alias("x")).where("x.s = seg")
        parts = F.ceil((F.sum("n") + tile / 2) / tile).cast("long")  # a value under the bound may come on top
        split = wide.select(_key("x.bit", "x.value"), "n").groupBy("key").agg(parts.alias("parts")).where("parts > 1")
        split = materialize(split, "split_keys")
        if split.count() <= 100_000:  # of 16 bytes; beyond that an ordinary join
            split = F.broadcast(split)
        keyed = keyed.join(split, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(11)), F.col("parts")))
        others = F.expr("filter(sequence(0L, parts - 1), i -> i <> own)")
        none = F.array(F.lit(None).cast("long"))
        keyed = keyed.select("fp", "key", "own", F.explode(F.when(F.col("parts").isNull(), none).otherwise(others)).alias("other"))
        pair = F.when(F.col("other").isNull(), F.lit(0).cast("long")).otherwise(
            F.shiftleft(F.least("own", "other"), 16).bitwiseOR(F.greatest("own", "other"))
        )
    dealt = keyed.select(F.shiftleft("key", 32).bitwiseOR(pair).alias("gid"), "fp")
    return arrow_map(dealt.repartition("gid").sortWithinPartitions("gid"), _link, "a long, b long")


def _variants() -> list[tuple[int, int, int, int]]:
    """For each of the 64 bits: its segment's first bit, width and number, and the segment's mask without the bit."""
    return [(at, n, s, ((1 << n) - 1) & ~(1 << k)) for s, (at, n) in enumerate(SEGMENTS) for k in range(n)]


def _key(bit: str, value: str):
    """The wildcard's place above the 22 bits that a segment has at most."""
    return F.shiftleft(F.col(bit).cast("long"), 22).bitwiseOR(F.col(value)).alias("key")


def _bits(at: int, n: int):
    """The segment's value, moved down to bit 0."""
    return F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def near_duplicates(docs: DataFrame, *, words: int = 4, similarity: float | None = None, tile: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, fp, class_fp, component_id`` for every row.

    ``fp`` is the fingerprint as a signed long, ``class_fp`` names the class (a
    fingerprint in it), ``component_id`` is the smallest id in the class. With
    ``similarity``, texts whose sets of five-word shingles have at least that
    Jaccard similarity are linked as well, however far their fingerprints are.

    Null and wordless texts have fingerprint 0 and are linked like any other.
    Repeated rows are given back as often as they come. Null ids are linked but
    name no class (a class of null ids only has a null ``component_id``). Empty
    tables give empty results. Other columns are ignored.
    """
    rows = materialize(
        arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), _fingerprints(words), f"id {dict(docs.dtypes)[id_col]}, fp long"),
        "fingerprints",
    )
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct_fingerprints")
    links = near_links(fps.select("fp"), tile)
    if similarity is not None:
        links = links.unionByName(similar_texts(docs.select(F.col(text_col).cast("string").alias("text")), similarity, fingerprint_words=words, tile=tile, every=False))
    roots = components(links).withColumnsRenamed({"node": "fp", "root": "class_fp"})
    classed = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("class_fp", "fp").alias("class_fp"))
    least = classed.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    classes = materialize(classed.join(least, "class_fp").select("fp", "class_fp", "component_id"), "classes")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "class_fp", "component_id")


def keep_one(docs: DataFrame, *, words: int = 4, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each class: that of the smallest id.

    Rows that repeat the kept id in its class are reduced to one as well (that of
    the smallest digest). A class without any id keeps one of its rows. Null and
    wordless texts are one class like any other. Empty tables give empty results.
    All columns are kept, whatever their names and types.
    """
    found = near_duplicates(docs, words=words, similarity=similarity, id_col=id_col, text_col=text_col)
    found = found.select(F.col(id_col).alias("id"), "fp", "class_fp", "component_id")
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("class_fp").agg(
        F.min("fp").alias("kept_fp"), F.first("component_id", ignorenulls=True).alias("kept_id")
    )
    kept = materialize(kept.select("kept_id", "kept_fp"), "kept")
    once = kept.groupBy("kept_id").agg(F.count("*").alias("classes"))
    counts = found.groupBy(F.col("id").alias("kept_id")).agg(F.count("*").alias("n"))
    plain = materialize(once.join(counts, "kept_id").where("n = 1").select("kept_id"), "kept_plain")
    cols = docs.columns
    (kept_id,) = unused(cols, "kept_id")
    # ids grow with the rows: no broadcast
    simple = docs.join(plain.select(F.col("kept_id").alias(kept_id)).hint("merge"), F.col(id_col) == F.col(kept_id), "left_semi")
    # ids that several rows carry (or none): told apart by their fingerprint, then reduced to one row
    odd = materialize(kept.join(plain, "kept_id", "left_anti"), "kept_odd")
    if odd.isEmpty():
        return simple
    ids = odd.select(F.col("kept_id").alias(kept_id)).distinct()
    again = docs.join(ids.hint("merge"), F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    again = again.select(F.struct(*cols).alias("row"), F.col(text_col).cast("string").alias("text"))
    marked = arrow_map(again, _mark(words), again.select("row", F.lit(0).cast("long").alias("fp")).schema)
    hit = marked.withColumn("own_id", F.col("row")[id_col]).join(odd.hint("merge"), F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")))
    one = hit.groupBy("own_id", "fp").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return simple.unionByName(one.select("row.*").select(*cols))


def _mark(words: int):
    def run(batches: Batches) -> Batches:
        for batch in small_slices(batches, "text"):
            raw, off = text_bytes(batch.column(1))
            raw = raw.tobytes()
            fps = [fingerprint(raw[s:e], words) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["row", "fp"])

    return run
