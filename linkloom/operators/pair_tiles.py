"""Proven pairs met by bits within a tile of two blocks of players, and given out as rows, degrees or totals.

A tile's rows are (low, high, number, node, asked, held, to): the players of block ``low`` with the groups they ask, those of block ``high`` with the
groups they are in, and dated pairs (number, to) between them, which have no node. A group is a code, odd for games. A tile holds its players' own facts
and a group's bits or places, whichever is less, so its memory doesn't grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

DATED, COUNTED, SEEN = 1, 2, 4
_ROWS = 1 << 16
_PLACE_BITS = 32

PAIRS = "a string, b string, kinds int"
_PAIRS = pa.schema([("a", pa.string()), ("b", pa.string()), ("kinds", pa.int32())])
DEGREES = "id string, n long"
_DEGREES = pa.schema([("id", pa.string()), ("n", pa.int64())])
TOTALS = "kinds int, n long"
_TOTALS = pa.schema([("kinds", pa.int32()), ("n", pa.int64())])


def by_tile(batches: Iterator[pa.RecordBatch], told: Callable[[pa.Table, int, int], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``told`` says of each tile's rows in turn; rows come by tile."""
    held, key = [], None
    for batch in batches:
        at = np.stack([batch["low"].to_numpy(), batch["high"].to_numpy()], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if held and tuple(at[start]) != key:
                yield from told(pa.Table.from_batches(held), *key)
                held = []
            key = tuple(at[start])
            held.append(batch.slice(start, end - start))
    if held:
        yield from told(pa.Table.from_batches(held), *key)


def _lists(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row each comes from; a null list has none."""
    lists = rows[column].combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(rows.num_rows), sizes)


def _set(bits: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
    np.bitwise_or.at(bits, (row, place >> 3), (1 << (place & 7)).astype(np.uint8))


class Tile:
    """One tile: ``left`` and ``right`` are the ids of its blocks in order, ``met`` goes through the left ones."""

    def __init__(self, rows: pa.Table, low: int, high: int, size: int):
        users, dated = rows.filter(rows["node"].is_valid()), rows.filter(rows["node"].is_null())
        users = users.sort_by("number")
        block = users["number"].to_numpy() // size
        mine, theirs = users.filter(pa.array(block == low)), users.filter(pa.array(block == high))
        self.same = low == high
        self.left, self.right = mine["node"].combine_chunks(), theirs["node"].combine_chunks()
        self.width = len(self.right)
        self.bytes = -(-self.width // 64) * 8
        codes, who = _lists(theirs, "held")
        order = np.argsort(codes, kind="stable")
        self.codes, self.starts, sizes = np.unique(codes[order], return_index=True, return_counts=True)
        self.ends, self.who = self.starts + sizes, who[order].astype(np.int32)
        many = sizes * _PLACE_BITS >= self.width
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.bits = np.zeros((int(many.sum()), self.bytes), np.uint8)
        row_of = np.repeat(self.row, sizes)
        _set(self.bits, row_of[row_of >= 0], self.who[row_of >= 0])
        asked, who = _lists(mine, "asked")
        at = np.minimum(np.searchsorted(self.codes, asked), max(len(self.codes) - 1, 0))
        some = self.codes[at] == asked if len(self.codes) else np.zeros(len(asked), bool)
        self.asked = {}
        for name, odd in ((COUNTED, 0), (SEEN, 1)):
            own = some & (asked & 1 == odd)
            self.asked[name] = at[own], np.searchsorted(who[own], np.arange(len(self.left) + 1))
        x = np.searchsorted(mine["number"].to_numpy(), dated["number"].to_numpy())
        y = np.searchsorted(theirs["number"].to_numpy(), dated["to"].to_numpy())
        order = np.argsort(x, kind="stable")
        self.dated = y[order], np.searchsorted(x[order], np.arange(len(self.left) + 1))

    def _asked(self, i: int, kind: int) -> np.ndarray:
        groups, starts = self.asked[kind]
        own = groups[starts[i] : starts[i + 1]]
        rows = self.row[own]
        dense = rows[rows >= 0]
        found = np.bitwise_or.reduce(self.bits[dense], axis=0) if len(dense) else np.zeros(self.bytes, np.uint8)
        few = own[rows < 0]
        if len(few):
            place = np.concatenate([self.who[self.starts[g] : self.ends[g]] for g in few])
            flags = np.zeros(self.bytes * 8, bool)
            flags[place] = True
            found |= np.packbits(flags, bitorder="little")
        return found

    def met(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(i, counted, seen, dated): for each left player the bits of those on the right it has a pair with, in its own block of later ones alone; dated is None if there is none."""
        for i in range(len(self.left)):
            own = self.dated[0][self.dated[1][i] : self.dated[1][i + 1]]
            kinds = [self._asked(i, COUNTED), self._asked(i, SEEN), None]
            if len(own):
                kinds[2] = np.zeros(self.bytes, np.uint8)
                _set(kinds[2][None, :], np.zeros(len(own), np.int64), own)
            if self.same:
                for bits in kinds:
                    if bits is not None:
                        bits[: i >> 3] = 0
                        bits[i >> 3] &= (0xFE << (i & 7)) & 0xFF
            yield i, *kinds

    def flags(self, bits: np.ndarray) -> np.ndarray:
        return np.unpackbits(bits, count=self.width, bitorder="little")


def pairs_of(size: int) -> Callable[[pa.Table, int, int], Iterator[pa.RecordBatch]]:
    """Rows of ``PAIRS``, a before b."""

    def told(rows: pa.Table, low: int, high: int) -> Iterator[pa.RecordBatch]:
        tile = Tile(rows, low, high, size)
        out, n_out = [], 0
        for i, counted, seen, dated in tile.met():
            kinds = tile.flags(counted) * np.uint8(COUNTED) + tile.flags(seen) * np.uint8(SEEN)
            if dated is not None:
                kinds += tile.flags(dated) * np.uint8(DATED)
            to = np.flatnonzero(kinds)
            if len(to):
                out.append((np.full(len(to), i, np.int32), to, kinds[to]))
                n_out += len(to)
            if n_out >= _ROWS or (n_out and i == len(tile.left) - 1):
                a, b, kinds = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([tile.left.take(pa.array(a)), tile.right.take(pa.array(b)), pa.array(kinds.astype(np.int32))], schema=_PAIRS)
                out, n_out = [], 0

    return told


def degrees_of(size: int) -> Callable[[pa.Table, int, int], Iterator[pa.RecordBatch]]:
    """Rows of ``DEGREES``: how many pairs of a tile a player is in."""

    def told(rows: pa.Table, low: int, high: int) -> Iterator[pa.RecordBatch]:
        tile = Tile(rows, low, high, size)
        own, other, part = np.zeros(len(tile.left), np.int64), np.zeros(tile.width, np.int64), np.zeros(tile.width, np.uint8)
        for i, counted, seen, dated in tile.met():
            every = tile.flags(counted | seen if dated is None else counted | seen | dated)
            own[i] = np.count_nonzero(every)
            part += every
            if i % 255 == 254:
                other += part
                part[:] = 0
        for ids, n in ((tile.left, own), (tile.right, other + part)):
            yield pa.RecordBatch.from_arrays([ids, pa.array(n)], schema=_DEGREES)

    return told


def totals_of(size: int) -> Callable[[pa.Table, int, int], Iterator[pa.RecordBatch]]:
    """Rows of ``TOTALS``: how many pairs of a tile have just these kinds of proof."""

    def told(rows: pa.Table, low: int, high: int) -> Iterator[pa.RecordBatch]:
        tile = Tile(rows, low, high, size)
        sums = np.zeros(8, np.int64)
        size_of = lambda bits: int(np.bitwise_count(bits.view(np.uint64)).sum())
        for _, counted, seen, dated in tile.met():
            parts = [(0, None)] if dated is None else [(0, ~dated), (DATED, dated)]
            for kind, mask in parts:
                c, s = (counted, seen) if mask is None else (counted & mask, seen & mask)
                both, n, m = size_of(c & s), size_of(c), size_of(s)
                sums[kind | COUNTED] += n - both
                sums[kind | SEEN] += m - both
                sums[kind | COUNTED | SEEN] += both
                if kind:
                    sums[kind] += size_of(mask) - (n + m - both)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(8, dtype=np.int32)), pa.array(sums)], schema=_TOTALS)

    return told
