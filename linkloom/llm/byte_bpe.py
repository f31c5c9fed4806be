"""Byte-level BPE over a given rank file: encoding and decoding.

A text is cut into pre-tokens by the pattern. The first tier is a minimal perfect hash over the whole
vocabulary: two array reads and one comparison of bytes tell whether a pre-token is itself a token. The
second tier merges the bytes of the rest: a linked list of parts and a heap of ranks and places, so
even a pre-token of a million bytes takes n log n steps.

Most words of a text have been met before, so ids are remembered by stretches of text: a text is parted
before each space behind something other than white space. Where the pattern lets no match cross such a
place (``parts_at_spaces``), a stretch has the same ids wherever it stands. Stretches of many texts are
parted, hashed and looked up together in numpy; only those not met before are cut and merged one by one.
What the ids stand for is held against the text, so two stretches of one hash can't pass for each other.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.hashing import run_hashes

BUCKET_LOAD = 4
CACHE_ENTRIES = 1 << 17
CACHE_CHARS = 64
STRETCHES_HELD = 1 << 20
SLICE_BYTES = 1 << 18
BLOCK_BYTES = 1 << 18
#: Bytes of ASCII white space; last bytes of all other white space in UTF-8, and the bytes that stand before these.
_ASCII_SPACE, _SPACE_LAST, _SPACE_BEFORE = (np.zeros(256, bool) for _ in range(3))
for _c in (_raw.encode() for _raw in map(chr, range(0x3001)) if _raw.isspace()):
    if len(_c) == 1:
        _ASCII_SPACE[_c[0]] = True
    else:
        _SPACE_LAST[_c[-1]] = _SPACE_BEFORE[_c[-2]] = True


@dataclass(frozen=True)
class PerfectHash:
    """Hash and displace: ``shift[bucket]`` sends each of the n keys to its own slot of n."""

    shift: np.ndarray
    slots: np.ndarray

    @staticmethod
    def _parts(key: bytes, n: int, buckets: int) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF
        return a % buckets, b % n, 1 + (a ^ b >> 7) % max(1, n - 1)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        """Place the fullest buckets first; each takes the least shift that puts its keys on free slots."""
        n, buckets = len(keys), max(1, len(keys) // BUCKET_LOAD)
        held: list[list[tuple[int, int, int]]] = [[] for _ in range(buckets)]
        for i, key in enumerate(keys):
            b, first, step = cls._parts(key, n, buckets)
            held[b].append((i, first, step))
        shift, slots = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
        taken = bytearray(n)
        for b in sorted(range(buckets), key=lambda b: -len(held[b])):
            d = 0
            while held[b]:
                places = [(first + d * step + d // n) % n for _, first, step in held[b]]
                if len(set(places)) == len(places) and not any(taken[p] for p in places):
                    for (i, _, _), p in zip(held[b], places, strict=True):
                        taken[p], slots[p] = 1, i
                    shift[b] = d
                    break
                d += 1
                if d > 50 * n:
                    raise ValueError("two keys of the vocabulary can't be told apart")
        return cls(shift, slots)

    def place(self, key: bytes) -> int:
        """The index that ``key`` has if it is one of the keys, else that of some other key."""
        n = len(self.slots)
        b, first, step = self._parts(key, n, len(self.shift))
        d = self.shift.item(b)
        return self.slots.item((first + d * step + d // n) % n)


class Answers:
    """What was found for keys met before: two generations of ``CACHE_ENTRIES``, so that common keys outlive a full one."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, found: bytes) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self.young) >= CACHE_ENTRIES:
                self.young, self.old = {}, self.young
            self.young[key] = found


class Vocabulary:
    """Tokens by id, with the perfect hash over them. Ids are ranks: the lower, the earlier a merge."""

    def __init__(self, tokens: dict[bytes, int], pattern: str, parts_at_spaces: bool = False):
        self.keys = list(tokens)
        self.ids = [tokens[k] for k in self.keys]
        self.hash = PerfectHash.build(self.keys)
        self.pattern = pattern
        self.parts_at_spaces = parts_at_spaces
        self._fresh()

    def _fresh(self) -> None:
        """What each process fills for itself: the compiled pattern, answers so far, ranks, tokens by id."""
        self._cut, self._ranks, self._single, self._double, self._by_id, self._pieces = None, None, None, None, None, Answers()
        self._fresh_stretches()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._fresh()

    @classmethod
    def parse(cls, lines: bytes, pattern: str, parts_at_spaces: bool = False) -> Vocabulary:
        """From the text of a rank file: a line has a base64 token and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}, pattern, parts_at_spaces)

    def token_id(self, piece: bytes) -> int | None:
        """The id of a piece that is a token, by the perfect hash; None for any other."""
        at = self.hash.place(piece)
        return self.ids[at] if self.keys[at] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no token: always the pair of least rank first, the leftmost of equals.

        Part i begins at byte i and ends where the next begins. ``pair[i]`` is the rank of part i with its
        next one, and a heap entry that says otherwise is stale.
        """
        if self._ranks is None:
            self._ranks = dict(zip(self.keys, self.ids, strict=True))
            every = [bytes([b]) for b in range(256)]
            self._single = [self._ranks.get(b, -1) for b in every]
            self._double = [[self._ranks.get(a + b, -1) for b in every] for a in every]
        rank_of, double, push, pop = self._ranks.get, self._double, heapq.heappush, heapq.heappop
        n = len(piece)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        ids = list(map(self._single.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [double[a][b] for a, b in itertools.pairwise(piece)]
        pair.append(-1)
        heap = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i = top & mask
            rank = top >> shift
            if pair[i] != rank:
                continue
            gone = after[i]
            ids[i] = rank
            after[i] = end = after[gone]
            pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
                found = rank_of(piece[i : after[end]])
                if found is not None:
                    pair[i] = found
                    push(heap, found << shift | i)
            if i:
                i = before[i]
                found = rank_of(piece[i:end])
                if found is not None:
                    pair[i] = found
                    push(heap, found << shift | i)
                else:
                    pair[i] = -1
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        if -1 in out:
            raise ValueError("the vocabulary lacks a single byte")
        return out

    def _piece(self, piece: str) -> bytes:
        """The packed ids of a pre-token."""
        packed = self._pieces.get(piece)
        if packed is None:
            raw = piece.encode("utf-8")
            found = self.token_id(raw)
            ids = [found] if found is not None else self.merge(raw)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            self._pieces.put(piece, packed)
        return packed

    def _stretch(self, text: str) -> bytes:
        """The packed ids of a stretch of text, match by match."""
        if self._cut is None:
            self._cut = regex.compile(self.pattern)
        return b"".join(map(self._piece, self._cut.findall(text)))

    def _fresh_stretches(self) -> None:
        """Stretches met: their hashes in order, where their ids begin in ``_store``, and how many there are."""
        self._hashes, self._begins, self._counts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self._store = np.empty(0, np.uint32)

    def _block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches data[start:end], end to end, and how many each has."""
        base = starts[0]
        hashes = run_hashes(data[base : ends[-1]], starts - base, ends - base)
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._hashes) > STRETCHES_HELD:
            self._fresh_stretches()
        at = np.searchsorted(self._hashes, own)
        inside = at < len(self._hashes)
        met = np.zeros(len(own), bool)
        met[inside] = self._hashes[at[inside]] == own[inside]
        new = np.flatnonzero(~met)
        if len(new):
            made = [self._stretch(data[a:b].tobytes().decode("utf-8")) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            counts = np.fromiter(map(len, made), np.int64, len(made)) // 4
            begins = len(self._store) + np.cumsum(counts) - counts
            self._store = np.concatenate([self._store, np.frombuffer(b"".join(made), "<u4")])
            self._begins, self._counts = np.insert(self._begins, at[new], begins), np.insert(self._counts, at[new], counts)
            self._hashes = np.insert(self._hashes, at[new], own[new])
            at = np.searchsorted(self._hashes, own)
        counts = self._counts[at][back]
        ends_at = np.cumsum(counts)
        return self._store[np.repeat(self._begins[at][back] - (ends_at - counts), counts) + np.arange(ends_at[-1])], counts

    def _together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_block`` for any number of stretches, some ``BLOCK_BYTES`` of text at a time."""
        part = ends // BLOCK_BYTES
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(starts)]]).tolist()
        made = [self._block(data, starts[a:b], ends[a:b]) for a, b in itertools.pairwise(cuts)]
        return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])

    def _one_by_one(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = [self._stretch(data[a:b].tobytes().decode("utf-8")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids end, from 0 on. Null texts have none."""
        whole = pc.fill_null(texts.cast(pa.large_string()), "")
        _, held, data = whole.buffers()
        offsets = np.frombuffer(held, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        begins = np.zeros(len(data), bool)
        if self.parts_at_spaces:
            begins[2:] = (data[2:] == 32) & ~(_ASCII_SPACE[data[1:-1]] | (_SPACE_LAST[data[1:-1]] & _SPACE_BEFORE[data[:-2]]))
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        ids, counts = (self._together if self.parts_at_spaces else self._one_by_one)(data, starts, ends)
        spelt = self._spell(ids)
        if not np.array_equal(np.frombuffer(spelt.buffers()[2], np.uint8), data):
            ids, counts = self._one_by_one(data, starts, ends)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]

    def _spell(self, ids: np.ndarray) -> pa.Array:
        """The bytes of each id. Tokens are taken all at once, so their bytes lie end to end."""
        if self._by_id is None:
            tokens: list[bytes | None] = [None] * (max(self.ids, default=-1) + 1)
            for key, i in zip(self.keys, self.ids, strict=True):
                tokens[i] = key
            self._by_id = pa.array(tokens, pa.large_binary())
        taken = self._by_id.take(pa.array(ids))
        if taken.null_count:
            raise ValueError("an id is not in the vocabulary")
        return taken

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.large_string()))[0].astype("<u4").tobytes()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each text, whose ids ``encode_all`` laid end to end."""
        if not len(ids):
            return pa.array([b""] * (len(ends) - 1), pa.binary())
        _, at, data = self._spell(ids).buffers()
        return _binaries(np.frombuffer(at, np.int64, len(ids) + 1)[ends], data)

    def decode(self, ids: bytes | None) -> bytes | None:
        """The bytes that packed ids stand for; null for null."""
        return None if ids is None else self.decode_all(np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]))[0].as_py()


def _binaries(ends: np.ndarray, data) -> pa.Array:
    """The parts of a buffer between the given places."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), data]).cast(pa.binary())


def load_vocabulary(path: str, pattern: str, parts_at_spaces: bool = True) -> Vocabulary:
    """The rank file at ``path``, read on the driver; tasks get the vocabulary by broadcast (about 2 MB).

    ``parts_at_spaces`` says that no match of the pattern holds a space behind something other than white
    space, nor looks at what stands before it, as with patterns that take a space at most before a word.
    """
    with open(path, "rb") as f:
        return Vocabulary.parse(f.read(), pattern, parts_at_spaces)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``SLICE_BYTES``, so that what Python makes of one stays small."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]]).tolist()
    for at, upto in itertools.pairwise(cuts):
        yield batch.slice(at, upto - at)


def _apply(df: DataFrame, source: str, ids: str, decoded: str | None, encode: bool, vocabulary: Vocabulary) -> DataFrame:
    """``df`` with binary columns ``ids`` (where ``encode``, in place of ``source``) and ``decoded``. Other columns pass as they are."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    made = ([ids] if encode else []) + ([decoded] if decoded else [])
    kept = [c for c in df.columns if not (encode and c == source)]
    if clash := set(made) & set(kept):
        raise ValueError(f"columns of these names are there already: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in _slices(batch, source):
                if encode:
                    found, ends = own.encode_all(part[source])
                    new = [_binaries(ends * 4, pa.py_buffer(found.astype("<u4"))), *([own.decode_all(found, ends)] if decoded else [])]
                else:
                    new = [pa.array(map(own.decode, part[source].to_pylist()), pa.binary())]
                yield pa.RecordBatch.from_arrays([part[c] for c in kept] + new, kept + made)

    fields = [df.schema[c] for c in kept] + [T.StructField(c, T.BinaryType()) for c in made]
    return df.mapInArrow(run, T.StructType(fields))


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text in place of it, packed as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. With ``decoded``, what the ids stand for comes along, from the same pass.
    Repeated rows each give a row, an empty table gives no rows, all other columns pass unread. A column
    that has the name of a new one is an error, as neither may be lost; choose other names then.
    """
    return _apply(docs, text, ids, decoded, True, vocabulary)


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that the packed ids stand for; null for null. Clashing names are an error."""
    return _apply(encoded, ids, ids, decoded, False, vocabulary)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's encoding and of what it decodes to.

    Null and empty texts have no tokens; repeated rows each give a row; other columns aren't read; an
    empty table gives no rows.
    """
    return encode_texts(docs.select("doc_id", "text"), vocabulary, decoded="decoded").select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
