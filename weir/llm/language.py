"""Language identification by bit-sliced Bloom filters of letter trigrams.

A filter's cell is a bit mask with one bit a language. A trigram of a language
sets that language's bit in the cells that its hashes name; looking a trigram up
is the AND of its cells, which gives all languages that hold it at once. A text's
trigrams are counted per language, the hits that a filter as full as the
language's would give by chance are taken off, and the most hits win.

Trigrams are over lower-case letters, with anything else between words as one
gap; a gap stands only at a trigram's ends. A language holds a trigram that makes
up at least ``floor`` of the language's own and is not far rarer there than in
another language (so passages of other languages in its texts don't count). All
learning texts are counted, on the executors; what reaches the driver are at most
1 / floor trigrams a language.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, crc32_of_id, materialize
from .runs import pieces

HASHES, MULTIPLIERS = 3, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
UNKNOWN = "und"
MOST_SENT = 50_000  # languages whose totals are broadcast


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def trigrams(raw: np.ndarray, off: np.ndarray, guards: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each trigram, trigram, texts that have a letter). A trigram holds its code points, 21 bits each.

    ``guards``: whether the first and the last character stand beside the piece and have no trigram of their own.
    """
    n = len(off) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])[off]  # of texts, in characters
    letters = np.insert(_letters()[points], starts[:-1], 0)
    text = np.repeat(np.arange(n), np.diff(starts) + 1)
    keep = np.ones(len(letters), bool)  # one gap between words, and one before each text
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0) | (text[1:] != text[:-1])
    letters, text = np.append(letters[keep], np.uint32(0)).astype(np.uint64), np.append(text[keep], n)
    has = np.zeros(n, bool)
    has[text[:-1][letters[:-1] != 0]] = True
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    c = np.where(text[2:] == text[1:-1], c, 0)  # behind a text's last letter is a gap
    at = np.flatnonzero(b != 0)  # the character before a letter is of the same text: each begins with a gap
    if any(guards) and len(points):
        at = at[int(guards[0] and _letters()[points[0]] != 0) : len(at) - int(guards[1] and _letters()[points[-1]] != 0)]
    return text[1:-1][at], a[at] << np.uint64(42) | b[at] << np.uint64(21) | c[at], has


def _count(batches: Batches) -> Batches:
    """Rows (lang, trigram, n), added up within the task in steps of bounded size."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merge():
        lang, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((gram, lang))
        lang, gram, n = lang[order], gram[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])]))
        return lang[first], gram[first], np.add.reduceat(n, first)

    def rows():
        lang, gram, n = merge()
        keys = list(names)
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in lang.tolist()], pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch, parts in pieces(batches):
        own = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()])
        for index, raw, off, guards in parts:
            text, gram, _ = trigrams(raw, off, guards)
            lang = own[index[text]] if len(text) else np.zeros(0, np.int64)
            for k in np.unique(lang).tolist():
                found, n = np.unique(gram[lang == k], return_counts=True)
                held.append((np.full(len(found), k), found, n))
                size += len(found)
            if size > 400_000:
                held = [merge()]
                size = len(held[0][0])
                if size > 400_000:
                    yield rows()
                    held, size = [], 0
    if held:
        yield rows()


class Filters:
    """The languages' bit-sliced Bloom filters."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray):
        self.languages = languages
        words = max(1, -(-len(languages) // 64))
        self.bits = max(16, int(16 * len(np.unique(gram)) or 1).bit_length())
        self.cells = np.zeros((1 << self.bits, words), np.uint64)
        flag = np.uint64(1) << (lang % 64).astype(np.uint64)
        for spot in self._spots(gram):
            np.bitwise_or.at(self.cells, (spot, lang // 64), flag)
        fill = np.array([(self.cells[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))])
        self.by_chance = fill**HASHES

    def _spots(self, gram: np.ndarray):
        for m in MULTIPLIERS:
            with np.errstate(over="ignore"):
                h = (gram ^ gram >> np.uint64(29)) * np.uint64(m)
                h ^= h >> np.uint64(32)
                yield ((h * np.uint64(m)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """For each trigram the languages that hold it (or seem to)."""
        out = None
        for spot in self._spots(gram):
            out = self.cells[spot] if out is None else out & self.cells[spot]
        return out

    def hits(self, text: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """Hits of each text and language."""
        mask = self.masks(gram)
        return np.stack([np.bincount(text[mask[:, k // 64] >> np.uint64(k % 64) & np.uint64(1) == 1], minlength=n) for k in range(len(self.languages))], 1)


def learn(docs: DataFrame, *, floor: float = 1e-5, ratio: float = 8, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from all rows whose text and language are not null. The first language is the most common one."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counted = arrow_map(rows, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "trigrams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    languages = sorted(totals, key=lambda k: (-totals[k], k))
    if not languages:
        return Filters([], np.zeros(0, np.int64), np.zeros(0, np.uint64))
    total = counted.sparkSession.createDataFrame([(k, float(totals[k])) for k in languages], "lang string, total double")
    total = F.broadcast(total) if len(languages) <= MOST_SENT else total.hint("merge")
    common = counted.join(total, "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= floor).toPandas()
    rate = common["rate"].to_numpy()
    _, at = np.unique(common["gram"].to_numpy(), return_inverse=True)
    top = np.zeros(at.max(initial=-1) + 1)
    np.maximum.at(top, at, rate)
    common = common[rate * ratio >= top[at]]
    index = {k: i for i, k in enumerate(languages)}
    return Filters(languages, common["lang"].map(index).to_numpy(np.int64), common["gram"].to_numpy(np.int64).view(np.uint64))


def guess(filters: Filters, batches: Batches, column: str):
    """(rows, numbers of their languages (-1: none), scores), slice by slice."""
    known = len(filters.languages)
    for batch, parts in pieces(batches, column):
        n = batch.num_rows
        hits, total, letters = np.zeros((n, known)), np.zeros(n), np.zeros(n, bool)
        for index, raw, off, guards in parts:
            text, gram, has = trigrams(raw, off, guards)
            letters[index] |= has
            total[index] += np.bincount(text, minlength=len(index))
            if len(gram) and known:
                hits[index] += filters.hits(text, gram, len(index))
        if not known:
            yield batch, np.full(n, -1), np.zeros(n)
            continue
        chance = filters.by_chance[None, :]
        true = np.clip((hits - total[:, None] * chance) / np.maximum(1 - chance, 1e-9), 0, None)
        best = true.argmax(1)
        share = np.clip(true[np.arange(n), best] / np.maximum(total, 1), 0, 1)
        yield batch, np.where(letters, best, -1), np.where(letters, share, 0.0)


def _taught(docs: DataFrame, folds: int, held: int, id_col: str) -> DataFrame:
    return docs.where(crc32_of_id(F.col(id_col)) % folds != held)


def identify(
    docs: DataFrame, *, folds: int = 3, held: int = 1, floor: float = 1e-5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``<id_col>, held_out, lang_pred, score`` for every row.

    Rows whose crc32 of the id (as text) leaves ``held`` by ``folds`` are held out
    and teach nothing, as do null texts and null languages. ``lang_pred`` is
    ``und`` for null texts and texts without a letter, and where nothing could be
    learned; else a learned language, ties going to the one with more text. The
    score is the share of the text's trigrams that the language holds, less what
    chance would give (0 for ``und``). Repeated rows are given back as often as
    they come. Empty tables give empty results. Other columns are ignored.
    """
    learned = learn(_taught(docs, folds, held, id_col), floor=floor, text_col=text_col, lang_col=lang_col)
    filters = docs.sparkSession.sparkContext.broadcast(learned)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Batches) -> Batches:
        names = np.array([*filters.value.languages, UNKNOWN], object)
        for batch, best, share in guess(filters.value, batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(share)], names=["id", "lang_pred", "score"])

    found = arrow_map(texts, run, f"id {dict(texts.dtypes)['id']}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), (crc32_of_id(F.col("id")) % folds == held).alias("held_out"), "lang_pred", "score")


def keep(
    docs: DataFrame,
    *,
    least: float = 0.2,
    folds: int = 3,
    held: int = 1,
    floor: float = 1e-5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The rows of ``docs``, whole, that are in a learned language with a score of ``least`` or more. Nothing is shuffled for it.

    Null, empty and letterless texts go, and all rows where nothing could be
    learned. Repeated rows and null ids are kept or go like any other. Empty tables
    give empty results. All columns are kept, whatever their names.
    """
    learned = learn(_taught(docs, folds, held, id_col), floor=floor, text_col=text_col, lang_col=lang_col)
    filters = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Batches) -> Batches:
        for batch, best, share in guess(filters.value, batches, text_col):
            yield batch.filter(pa.array((best >= 0) & (share >= least)))

    return arrow_map(docs, run, docs.schema)
