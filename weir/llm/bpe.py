"""BPE encoding with content-defined chunks that are encoded once.

Texts are cut where a rolling hash over 32 bytes says so (about every 1024
bytes, moved to the next character), so equal passages give equal chunks wherever
they stand. A chunk that occurs more than once in the corpus is encoded once;
texts take its ids from there.

Joins. The ids of two chunks side by side are not the ids of their text: a token
may reach over the cut, and what stands before a word changes how it is split.
From the last place before the cut up to which a chunk's ids are certain, the text
is therefore split into pre-tokens anew, further and further into the next chunk,
until a pre-token ends where one of that chunk ends as well. How a text is split
from some place on depends on nothing before it, so from there on both encodings
agree; the window between is encoded anew. A chunk whose pre-tokens never agree
with the text's joins the window whole. Nothing of this asks for any script: a run
of Chinese letters ends at its next comma.

A text that several rows have is encoded by one of them, and the others take its
ids; the rows of a text that has very many are dealt to several copies of them, and
so are the uses of a chunk that very many texts hold.

Sizes: hashes of chunks are shuffled, not chunks. Texts are read three times: for
the hashes; to encode each shared chunk and repeated text once, found by Bloom
filters of 8 MB at most, and to pick out the texts that hold shared chunks; and to
encode all others in place. Only texts that hold chunks of other texts are
shuffled, once, to meet their ids.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Batches, arrow_map, heavy, materialize, small_slices, text_bytes

WINDOW, CUT_BITS, LEAST_CHUNK = 32, 10, 64
SLICE = 1_000_000  # bytes of text worked on at a time
HOT_TEXT, HOT_CHUNK = 200, 20_000  # rows of a text, and texts of a chunk, that meet one copy of the ids
MOST_HOT = 50_000  # texts or chunks that can have more than their 50,000th part of all rows
HEADS, REACH = 32, 256  # places near its begin where a chunk can be joined; bytes behind a cut split at first
MARGIN = 16  # bytes before the end of a piece where its pre-tokens may not be the text's

#: Fixed value: how a byte-level vocabulary with ``use_regex`` splits words before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library.

    Byte-level BPE whose merges stand in the order of their ids is run by tiktoken
    (the same ids, several times faster); any other file by tokenizers itself. What
    is pickled is a list of the tokens' bytes (or the file), not the parsed file, so
    a worker holds little more than its encoder.
    """

    def __init__(self, file: str):
        spec = json.loads(file)
        letters = byte_letters()
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        vocab: dict[str, int] = model.get("vocab", {})
        added = {t["content"]: t for t in spec.get("added_tokens", [])}
        results = [vocab.get(a + b, -1) for a, b in merges]
        plain = (
            model.get("type") == "BPE"
            and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True}
            and spec.get("normalizer") is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(x < y for x, y in zip(results, results[1:], strict=False))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added.values())
            and all(set(t) <= letters.keys() for t in vocab if t not in added)
        )
        #: Bytes of an id in packed form.
        self.width = 2 if max([*vocab.values(), *(t["id"] for t in added.values())], default=0) < 1 << 16 else 4
        #: Whether texts are split by ``BYTE_LEVEL_PATTERN`` between special tokens, so that joins can be repaired.
        self.splits = plain
        self.digest = xxhash.xxh3_128_hexdigest(file)
        self._file, self._special, self._tokens = (None if plain else file), {t: x["id"] for t, x in added.items()}, None
        self._tool = None
        if plain:
            table = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added} | {i: t.encode() for t, i in self._special.items()}
            self._tokens = [table.get(i, b"") for i in range(max(table) + 1)]
            self.lengths = np.array([len(t) for t in self._tokens], np.int64)
            #: Special tokens may be cut in two near the end of a piece, too.
            self.margin = max([MARGIN, *(len(t.encode()) + 4 for t in self._special)])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tool": None}

    @property
    def tool(self):
        """The encoder, made where it is used."""
        if self._tool is None and self._tokens is not None:
            import tiktoken

            special = set(self._special.values())
            ranks = {t: i for i, t in enumerate(self._tokens) if t and i not in special}
            self._tool = tiktoken.Encoding(self.digest, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=self._special)
        elif self._tool is None:
            from tokenizers import Tokenizer

            self._tool = Tokenizer.from_str(self._file)
            self._tool.no_padding()
            self._tool.no_truncation()
        return self._tool

    def encode(self, text: str) -> np.ndarray:
        if self._tokens is not None:
            return np.asarray(self.tool.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: list[int]) -> str:
        if self._tokens is not None:
            table = self._tokens
            return b"".join([table[i] for i in ids]).decode("utf-8", errors="replace")
        return self.tool.decode(ids, skip_special_tokens=False)


@cache
def _split_pattern() -> regex.Pattern:
    return regex.compile(BYTE_LEVEL_PATTERN)


@cache
def _settled() -> np.ndarray:
    """Code points that every version of Unicode from 3.2 on puts into the same class, so all libraries split them alike."""
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    return np.array([old(c)[0] == now(c)[0] and old(c) != "Cn" for c in map(chr, range(0x110000))])


def pretokens(codec: Codec, raw: bytes) -> np.ndarray:
    """Where the pre-tokens of a piece of text end, in bytes; only up to a character that libraries may split differently."""
    text = raw.decode()
    if len(text) < len(raw):
        other = np.flatnonzero(~_settled()[np.frombuffer(text.encode("utf-32-le"), np.uint32)])
        if len(other):
            text = text[: int(other[0])]
            raw = text.encode()
            ends = pretokens(codec, raw)
            return ends[ends <= len(raw) - codec.margin]
    found, at = [], 0
    special = regex.compile("|".join(map(regex.escape, sorted(codec._special, key=len, reverse=True)))) if codec._special else None
    for m in special.finditer(text) if special else ():
        found += [x.end() for x in _split_pattern().finditer(text[:m.start()], at)]
        found.append(m.end())
        at = m.end()
    ends = np.array(found + [x.end() for x in _split_pattern().finditer(text, at)], np.int64)
    if len(text) == len(raw):
        return ends
    first = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
    return np.append(first, len(raw))[ends]


def load(vocabulary: str) -> Codec:
    """The codec of a file that the driver can read."""
    with open(vocabulary, encoding="utf-8") as f:
        return Codec(f.read())


_made: dict[str, Codec] = {}


def _codec(sent) -> Codec:
    """The broadcast codec, one a worker however many tasks it runs."""
    codec = sent.value
    return _made.setdefault(codec.digest, codec)


# --- cutting -----------------------------------------------------------------


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and powers of an odd number and of its inverse modulo 2**64."""
    odd = 0x9E3779B97F4A7C15
    table = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=3) for b in range(256)], np.uint64)
    size = SLICE + WINDOW
    up = np.cumprod(np.full(size, odd, np.uint64))
    down = np.cumprod(np.full(size, pow(odd, -1, 1 << 64), np.uint64))
    return table, up, down


def cuts(raw: np.ndarray) -> np.ndarray:
    """Positions after which a window of 32 bytes has a hash with ten leading zeros."""
    table, up, down = _powers()
    found = []
    for begin in range(0, len(raw), SLICE):
        lead = min(begin, WINDOW)
        part = raw[begin - lead : begin + SLICE]
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * down[: len(part)])])
            if len(part) < WINDOW:
                continue
            hashes = (total[WINDOW:] - total[:-WINDOW]) * up[WINDOW - 1 : len(part)]
        at = np.flatnonzero(hashes >> np.uint64(64 - CUT_BITS) == 0) + WINDOW + begin - lead
        found.append(at[at > begin] if begin else at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of all chunks of ``LEAST_CHUNK`` bytes or more, in order; positions in ``raw``."""
    where = cuts(raw)
    for _ in range(3):
        where = where + ((where < len(raw)) & (raw[np.minimum(where, len(raw) - 1)] & 0xC0 == 0x80) if len(raw) else 0)
    where = np.unique(where)
    text = np.searchsorted(off, where, side="right") - 1  # where == the end of a text: no cut in it
    ok = (text < len(off) - 1) & (where - off[np.minimum(text, len(off) - 2)] >= WINDOW) if len(off) > 1 else np.zeros(0, bool)
    # edges of all chunks: the texts' begins and the cuts
    filled = np.flatnonzero(off[1:] > off[:-1])
    first = np.concatenate([off[filled], where[ok]])
    owner = np.concatenate([filled, text[ok]])
    order = np.argsort(first, kind="stable")
    owner, first = owner[order], first[order]
    last = np.append(first[1:], len(raw))
    long_ = last - first >= LEAST_CHUNK
    return owner[long_], first[long_], last[long_]


def pack_chunk(codec: Codec, raw: bytes) -> bytes:
    """Ids of a chunk with its joints: (byte, ids before it), first the one up to which its ids are certain, then those near its begin."""
    ids = codec.encode(raw.decode())
    ends = np.cumsum(codec.lengths[ids])
    places = pretokens(codec, raw)
    places = places[places <= len(raw) - codec.margin]
    number = np.searchsorted(ends, places) + 1
    whole = ends[np.minimum(number, len(ends)) - 1] == places
    places, number = places[whole], number[whole]
    last = (places[-1:].tolist() or [0]) + (number[-1:].tolist() or [0])
    near = [i for i in range(min(len(places), 4 * HEADS)) if not _ends_blank(raw, int(places[i]))][:HEADS]
    joints = np.concatenate([last, np.stack([places[near], number[near]], 1).reshape(-1)]).astype("<u4")
    return np.uint32(len(joints)).tobytes() + joints.tobytes() + _pack(ids, codec.width)


def _ends_blank(raw: bytes, at: int) -> bool:
    """Whether white space stands before a place. There the split depends on what follows."""
    return raw[max(0, at - 4) : at].decode(errors="ignore")[-1:].isspace()


def join(codec: Codec, raw: bytes, known: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, int]:
    """Ids of a text from those of some of its chunks (begin, end, packed), and how many ids were taken from them."""
    parts, done, taken = [np.zeros(0, np.uint32)], 0, 0  # up to ``done`` all is encoded, and a pre-token ends there
    for begin, end, packed in known:
        size = 4 * int(np.frombuffer(packed, "<u4", 1)[0])
        joints = np.frombuffer(packed, "<u4", size // 4, 4).reshape(-1, 2).astype(np.int64)
        ids = np.frombuffer(packed, f"<u{codec.width}", offset=4 + size)
        at, number = (0, 0) if done == begin == 0 else _agreement(codec, raw, done, begin, end, joints[1:])
        if at is None:
            continue
        last, count = (end - begin, len(ids)) if end == len(raw) else joints[0].tolist()
        if last <= at:
            continue
        if begin + at > done:
            parts.append(codec.encode(raw[done : begin + at].decode()))
        parts.append(ids[number:count].astype(np.uint32))
        taken += count - number
        done = begin + last
    if done < len(raw):
        parts.append(codec.encode(raw[done:].decode()))
    return np.concatenate(parts), taken


def _agreement(codec: Codec, raw: bytes, done: int, begin: int, end: int, joints: np.ndarray) -> tuple[int | None, int]:
    """The first of a chunk's joints where a pre-token of the text ends, if the text is split from ``done`` on."""
    if not len(joints):
        return None, 0
    reach = REACH
    while True:
        to = min(begin + reach, end + codec.margin, len(raw))
        while to < len(raw) and raw[to] & 0xC0 == 0x80:
            to += 1
        found = pretokens(codec, raw[done:to]) + done
        if to < len(raw):
            found = found[found <= to - codec.margin]
        both = np.flatnonzero(np.isin(joints[:, 0] + begin, found))
        if len(both):
            return int(joints[both[0], 0]), int(joints[both[0], 1])
        if to >= min(begin + int(joints[-1, 0]) + codec.margin + 4, len(raw)):
            return None, 0
        reach *= 4


def _hash128(raw: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(raw)
    return x >> 64, x & (1 << 64) - 1


def _mix(*values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of several columns of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = np.full(len(values[0]), 0x51ED270B9F4A7C15, np.uint64)
        for v in values:
            x = (x ^ v.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(33)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            x ^= x >> np.uint64(29)
    return x


class _Slice:
    """Texts of a slice with their hashes and chunks."""

    def __init__(self, batch: pa.RecordBatch, with_chunks: bool = True):
        self.ids, self.n = batch.column(0), batch.num_rows
        raw, self.off = text_bytes(batch.column(1))
        self.raw = raw.tobytes()
        spans = list(zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True))
        both = np.array([_hash128(self.raw[s:e]) for s, e in spans], np.uint64).reshape(-1, 2)
        self.t1, self.t2 = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        if with_chunks:
            self.owner, self.begin, self.end = chunks(raw, self.off)
            both = np.array([_hash128(self.raw[s:e]) for s, e in zip(self.begin.tolist(), self.end.tolist(), strict=True)], np.uint64).reshape(-1, 2)
            self.h1, self.h2 = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
            key = self.row_keys()
            self.occurrence = _mix(key[self.owner], self.begin - self.off[self.owner])

    def row_keys(self) -> np.ndarray:
        """A hash of text and id. Only whole repetitions of a row share it."""
        return _mix(self.t1, self.t2, np.array([hash_id(i) for i in self.ids.to_pylist()], np.uint64))


def hash_id(value: object) -> int:
    return xxhash.xxh64_intdigest(repr(value).encode(), seed=5)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(batches: Batches) -> Batches:
    """A row for each text: id, its hash and its row's, hash and occurrence of each chunk."""
    for batch in small_slices(batches, "text", SLICE):
        s = _Slice(batch)
        at = pa.array(np.searchsorted(s.owner, np.arange(s.n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, _long(x)) for x in (s.h1, s.h2, s.occurrence)]
        yield pa.RecordBatch.from_arrays([s.ids, _long(s.t1), _long(s.t2), _long(s.row_keys()), *lists], names=["id", "t1", "t2", "k", "h1", "h2", "o"])


def _pack(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


class Routes:
    """How texts are encoded: Bloom filters of hashes, so every scan of the texts decides alike.

    ``repeated``: texts that several rows have. ``leading``: the row keys (one for
    each repeated text, and a few by chance) that encode them. ``shared``: texts
    that hold shared chunks. ``wanted``: the occurrences (one for each shared chunk,
    and a few by chance) that encode them. None: there is no such one.
    """

    def __init__(self, repeated=None, leading=None, shared=None, wanted=None):
        self.repeated, self.leading, self.shared, self.wanted = repeated, leading, shared, wanted

    def is_repeated(self, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        return bloom.holds(self.repeated, t1 ^ t2) if self.repeated is not None else np.zeros(len(t1), bool)

    def is_shared(self, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        return bloom.holds(self.shared, t1 ^ t2) if self.shared is not None else np.zeros(len(t1), bool)

    def alone(self, s: _Slice) -> np.ndarray:
        """Rows whose text is nowhere else, nor any chunk of it."""
        return np.flatnonzero(~self.is_repeated(s.t1, s.t2) & ~self.is_shared(s.t1, s.t2))

    def leads(self, s: _Slice, seen: set) -> np.ndarray:
        """Which rows encode a repeated text; ``seen`` keeps those that the task has met, so repetitions that stand together count once."""
        mine = self.is_repeated(s.t1, s.t2)
        if mine.any():
            mine &= bloom.holds(self.leading, s.row_keys())
            for i in np.flatnonzero(mine).tolist():
                key = (int(s.t1[i]), int(s.t2[i]))
                mine[i] = key not in seen
                seen.add(key)
                if len(seen) > 100_000:
                    seen.clear()
        return mine


def _repeated_rows(routes) -> Callable[[Batches], Batches]:
    """Of rows (id, t1, t2, k) those whose text is taken for a repeated one."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
            yield batch.filter(pa.array(routes.value.is_repeated(t1, t2)))

    return run


def _encode_alone(file, routes, decoded: bool = False) -> Callable[[Batches], Batches]:
    """Encode the texts that nothing is shared with."""

    def run(batches: Batches) -> Batches:
        codec = _codec(file)
        for batch in small_slices(batches, "text", SLICE):
            s = _Slice(batch, with_chunks=False)
            rows = routes.value.alone(s)
            ids = [codec.encode(s.raw[s.off[i] : s.off[i + 1]].decode()) for i in rows.tolist()]
            yield _plain(s.ids.take(pa.array(rows)), ids, codec, decoded)

    return run


CHUNK, WHOLE, SINGLE, LEAD = range(4)


def _share(file, routes) -> Callable[[Batches], Batches]:
    """Rows (kind, id, a, b, packed, text): a shared chunk (its hash, packed), a repeated text (its hash, packed
    ids), and of texts that hold shared chunks, single or leading, the text itself with its hash."""

    def run(batches: Batches) -> Batches:
        codec, way, seen = _codec(file), routes.value, set()
        for batch in small_slices(batches, "text", SLICE):
            s = _Slice(batch)
            mine = np.flatnonzero(bloom.holds(way.wanted, s.occurrence)) if way.wanted is not None else np.zeros(0, np.int64)
            repeated, shared, leads = way.is_repeated(s.t1, s.t2), way.is_shared(s.t1, s.t2), way.leads(s, seen)
            whole, single, lead = (np.flatnonzero(x) for x in (leads & ~shared, ~repeated & shared, leads & shared))
            packed = [pack_chunk(codec, s.raw[s.begin[i] : s.end[i]]) for i in mine.tolist()]
            packed += [_pack(codec.encode(s.raw[s.off[i] : s.off[i + 1]].decode()), codec.width) for i in whole.tolist()]
            texts = np.concatenate([single, lead])
            none = len(mine) + len(whole)
            rows = pa.array(np.concatenate([np.zeros(none, np.int64), texts]), mask=np.arange(none + len(texts)) < none)
            kind = np.repeat(np.array([CHUNK, WHOLE, SINGLE, LEAD], np.int32), [len(mine), len(whole), len(single), len(lead)])
            hashes = [np.concatenate([h[mine], t[whole], t[texts]]) for h, t in ((s.h1, s.t1), (s.h2, s.t2))]
            columns = [pa.array(kind), s.ids.take(rows), *map(_long, hashes), pa.array(packed + [None] * len(texts), pa.binary()), batch.column(1).take(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "id", "a", "b", "packed", "text"])

    return run


def _plain(row_ids: pa.Array, ids: list[np.ndarray], codec: Codec, decoded: bool) -> pa.RecordBatch:
    """(id, ids) of rows, and what the ids decode to."""
    columns, names = [row_ids, _ids_column(ids)], ["id", "ids"]
    if decoded:
        columns.append(pa.array([codec.decode(x.tolist()) for x in ids], pa.string()))
        names.append("decoded")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _ids_column(ids: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _assemble(file, repeated: bool, decoded: bool = False) -> Callable[[Batches], Batches]:
    """Ids of texts from those of their shared chunks, with the joins repaired."""

    def run(batches: Batches) -> Batches:
        codec = _codec(file)
        for batch in small_slices(batches, "text", SLICE):
            s, given = _Slice(batch), batch.column(2).to_pylist()
            first = np.searchsorted(s.owner, np.arange(s.n + 1))
            out = []
            for d in range(s.n):
                packed, at, k = {x["p"]: x["ids"] for x in given[d] or ()}, int(s.off[d]), int(first[d])
                known = [(int(s.begin[k + p]) - at, int(s.end[k + p]) - at, packed[p]) for p in sorted(packed)]
                out.append(join(codec, s.raw[at : s.off[d + 1]], known)[0])
            if repeated:
                columns = [_long(s.t1), _long(s.t2), pa.array([_pack(x, codec.width) for x in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "packed"])
            else:
                yield _plain(s.ids, out, codec, decoded)

    return run


def _unpack(file, decoded: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        codec = _codec(file)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [np.frombuffer(x, f"<u{codec.width}").astype(np.uint32) for x in part.column(1).to_pylist()]
                yield _plain(part.column(0), ids, codec, decoded)

    return run


def encode(docs: DataFrame, vocabulary: str, *, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids``: the token ids of every text, as the tokenizers library gives them.

    With ``decoded`` also the text that the ids decode to, from the same pass.

    ``vocabulary`` is the path of a tokenizers JSON file that the driver can read.
    Null texts count as empty and have no ids. Repeated rows are given back as
    often as they come; null ids are kept. Empty tables give empty results. Other
    columns are ignored. One row's text has to fit in memory.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    codec = load(vocabulary)
    file = send(codec)  # a vocabulary, a few MB
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(texts.dtypes)["id"]
    one_row, one_text = f"id {kind}, ids array<int>" + ", decoded string" * decoded, "t1 long, t2 long, packed binary"
    if not codec.splits:  # no place is known where a join is exact: every text as a whole
        return arrow_map(texts, _encode_alone(file, send(Routes()), decoded), one_row).withColumnRenamed("id", id_col)

    rows = materialize(arrow_map(texts, _scan, f"id {kind}, t1 long, t2 long, k long, h1 array<long>, h2 array<long>, o array<long>"), "chunk_hashes")
    # texts that several rows have: one row encodes, the others take its ids
    several = rows.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("t1").bitwiseXOR(F.col("t2")).alias("t"))
    routes = Routes(repeated=bloom.build(materialize(several, "repeated_texts"), "t"))
    narrow = materialize(arrow_map(rows.select("id", "t1", "t2", "k"), _repeated_rows(send(routes)), f"id {kind}, t1 long, t2 long, k long"), "rows_of_repeated_texts")
    leads = materialize(narrow.groupBy("t1", "t2").agg(F.min("k").alias("k"), F.count("*").alias("n")), "leading_rows")
    routes.leading = bloom.build(leads, "k")
    # chunks that several texts have, or one several times
    each = rows.select("t1", "t2", F.posexplode(F.arrays_zip("h1", "h2", "o")).alias("p", "x"))
    places = materialize(each.groupBy("t1", "t2", "p", "x.h1", "x.h2").agg(F.min("x.o").alias("o")), "chunk_places")
    several = places.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("o").alias("o")).where("n > 1")
    several = materialize(several, "shared_chunks")
    routes.wanted = bloom.build(several, "o")
    # of chunks that a false positive encodes besides, nothing asks for
    hot = F.broadcast(heavy(several, ["h1", "h2"], "n", HOT_CHUNK, MOST_HOT))
    uses = _dealt(places.select("t1", "t2", "p", "h1", "h2"), hot, F.xxhash64("t1", "t2", "p")).join(_copies(several.select("h1", "h2"), hot).hint("merge"), ["h1", "h2", "part"])
    uses = materialize(uses.select("t1", "t2", "p", "h1", "h2", "part"), "uses")
    routes.shared = bloom.build(uses.select("t1", "t2").distinct().select(F.col("t1").bitwiseXOR(F.col("t2")).alias("t")), "t")
    way = send(routes)
    given = materialize(arrow_map(texts, _share(file, way), f"kind int, id {kind}, a long, b long, packed binary, text string"), "shared_work")
    encoded = _copies(given.where(F.col("kind") == CHUNK).select(F.col("a").alias("h1"), F.col("b").alias("h2"), F.col("packed").alias("ids")), hot)

    def coded(repeated: bool, schema: str) -> DataFrame:
        own = uses.join(leads.select("t1", "t2").hint("merge"), ["t1", "t2"], "left_semi" if repeated else "left_anti")
        pieces = own.join(encoded.hint("merge"), ["h1", "h2", "part"]).groupBy("t1", "t2").agg(F.collect_list(F.struct("p", "ids")).alias("pieces"))
        routed = given.where(F.col("kind") == (LEAD if repeated else SINGLE)).select("id", F.col("a").alias("t1"), F.col("b").alias("t2"), "text")
        joined = routed.join(pieces.hint("merge"), ["t1", "t2"], "left").select("id", "text", "pieces")
        return arrow_map(joined, _assemble(file, repeated, decoded), schema)

    whole = given.where(F.col("kind") == WHOLE).select(F.col("a").alias("t1"), F.col("b").alias("t2"), "packed")
    once = coded(True, one_text).unionByName(whole).groupBy("t1", "t2").agg(F.max("packed").alias("packed"))  # two rows that encoded a text have equal ids
    once = materialize(once, "repeated_ids")
    # the rows of a text with very many are dealt to several copies of its ids
    hot_texts = F.broadcast(heavy(leads, ["t1", "t2"], "n", HOT_TEXT, MOST_HOT))
    ours = _dealt(narrow.select("id", "t1", "t2"), hot_texts, F.monotonically_increasing_id())
    again = ours.join(_copies(once, hot_texts).hint("merge"), ["t1", "t2", "part"]).select("id", "packed")
    both = coded(False, one_row).unionByName(arrow_map(again, _unpack(file, decoded), one_row))
    return both.unionByName(arrow_map(texts, _encode_alone(file, way, decoded), one_row)).withColumnRenamed("id", id_col)


def _dealt(df: DataFrame, hot: DataFrame, by: Column) -> DataFrame:
    """``df`` with the ``part`` of its key that each row belongs to; keys that are not ``hot`` have one."""
    key = [c for c in hot.columns if c != "parts"]
    part = F.pmod(by, F.coalesce("parts", F.lit(1).cast("long")))
    return df.join(hot, key, "left").withColumn("part", part).drop("parts")


def _copies(df: DataFrame, hot: DataFrame) -> DataFrame:
    """``df`` with a row for each ``part`` of its key."""
    key = [c for c in hot.columns if c != "parts"]
    last = F.coalesce("parts", F.lit(1).cast("long")) - 1
    return df.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("parts")


def decode(encoded: DataFrame, vocabulary: str, *, ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and ``decoded``: the text of ``ids_col``; null and no ids give an empty text.

    A column named ``decoded`` is replaced.
    """
    spark = encoded.sparkSession
    file = spark.sparkContext.broadcast(load(vocabulary))
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Batches) -> Batches:
        codec = _codec(file)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = part.column(kept.index(ids_col)).to_pylist()
                texts = pa.array([codec.decode(x or []) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*kept, "decoded"])

    schema = encoded.select(*kept, F.lit("").alias("decoded")).schema
    return arrow_map(encoded.select(*kept), run, schema)
