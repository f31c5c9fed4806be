"""Repeated passages across documents, by seed and extend.

Seeds: the least hash among the runs of ``SEED`` words in a window of ``WINDOW`` words is the window's anchor, so equal windows
of two documents have one anchor at one place. Anchors that only one document has end there. Each other anchor is extended both
ways over the windows it is the anchor of; occurrences with the same stretch are one class, so copies are never paired. Where
an anchor has several classes, one text of each is cut into its windows, and equal windows meet by their hashes (128 bits). A
class so knows which of its windows start in an earlier document; neighbouring windows join to the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.hashing import run_hashes
from linkloom.scratch import materialise, remove, write_table

WINDOW = 50
SEED = 16
_SLICE = 1 << 14
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_OTHER = np.random.default_rng(77).permutation(256).astype(np.uint8)
_ROWS = 256


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a whole text as bytes joined by one space, with their starts and ends there. Words are parted by ASCII white space."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    space = _SPACE[data]
    keep = ~space
    keep[:-1] |= ~space[1:]
    data = np.where(space, np.uint8(32), data)[keep]
    if len(data) and data[0] == 32:
        data = data[1:]
    if not len(data):
        return data, np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(data == 32)
    return data, np.concatenate([[0], at + 1]), np.concatenate([at, [len(data)]])


def _hash_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return run_hashes(data, starts, ends), run_hashes(_OTHER[data], starts, ends)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    more = width - span
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def _slices(starts: np.ndarray, ends: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Runs (first, one past the last) of windows, each of ``_SLICE`` windows at most."""
    n = len(starts) - window + 1
    for at in range(0, max(0, n), _SLICE):
        yield at, min(n, at + _SLICE)


def seeds_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW, seed: int = SEED) -> Iterator[tuple[np.ndarray, ...]]:
    """Slice by slice: (anchor, a, b, first, span) arrays, one item for each anchor occurrence.

    ``anchor`` is the hash of the run of words; the windows first, ..., first + span - 1 have it as their least, leftmost run, and
    (a, b) hashes all their words with the span and the anchor's place in them.
    """
    for lo, hi in _slices(starts, ends, window):
        base, upto = starts[lo], ends[hi + window - 2]
        part, s, e = data[base:upto], starts[lo : hi + window - 1] - base, ends[lo : hi + window - 1] - base
        runs = run_hashes(part, s[: len(s) - seed + 1], e[seed - 1 :])
        order = (runs & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(runs), dtype=np.uint64)
        place = (_sliding_least(order, window - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        span = np.diff(np.append(first, len(place)))
        at = place[first]
        a, b = _hash_pairs(part, s[first], e[first + span + window - 2])
        shape = (span * window + at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield runs[at], a ^ shape, b ^ (shape >> np.uint64(7)), first + lo, span


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def seeds(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, mark, first, span, anchor, a, b) for each anchor occurrence; ``mark`` tells documents of one id apart by their text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                found = []
                for id_, mark, text in batch.iloc[at : at + _ROWS].itertuples(index=False):
                    for anchor, a, b, first, span in seeds_of(*words_of(text), window, seed):
                        found.append(pd.DataFrame({"id": id_, "mark": mark, "first": first, "span": span, "anchor": _signed(anchor), "a": _signed(a), "b": _signed(b)}))
                if found:
                    yield pd.concat(found)

    return docs.filter("id is not null").select("id", "mark", "text").mapInPandas(cut, "id long, mark long, first int, span int, anchor long, a long, b long")


def _window_keys(classes: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(a, b, least, k, x, y): the hashes (x, y) of window k of each class, cut from the text of one of its occurrences."""
    wanted = classes.groupBy("rep.id", "rep.mark").agg(F.collect_list(F.struct("a", "b", F.col("rep.first").alias("first"), F.col("rep.span").alias("span"))).alias("own"))
    held = docs.join(wanted, ["id", "mark"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for id_, text, own in zip(batch["id"], batch["text"], batch["own"], strict=True):
                data, starts, ends = words_of(text)
                rows = sorted((r["first"], r["span"], r["a"], r["b"]) for r in own)
                first, span = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
                for lo in range(0, len(rows), _ROWS):
                    f, s = first[lo : lo + _ROWS], span[lo : lo + _ROWS]
                    k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                    w = np.repeat(f, s) + k
                    base, upto = starts[w[0]], ends[w.max() + window - 1]
                    x, y = _hash_pairs(data[base:upto], starts[w] - base, ends[w + window - 1] - base)
                    a, b = (np.repeat(np.array([r[c] for r in rows[lo : lo + _ROWS]], np.int64), s) for c in (2, 3))
                    yield pd.DataFrame({"a": a, "b": b, "least": id_, "k": k, "x": _signed(x), "y": _signed(y)})

    return held.select("id", "text", "own").mapInPandas(cut, "a long, b long, least long, k int, x long, y long")


def earlier_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, mark, own): for each document (id, mark, text) the windows that also start in one of smaller id, as (first, bits) with a bit for each window from first."""
    spark = docs.sparkSession
    found, seeds_path = write_table(seeds(docs, window, seed), "seeds")
    # what a hot key meets is written first, so that the join has an exchange of its own, whose large partitions Spark can split
    common = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("anchor")
    anchors, anchors_path = write_table(common, "anchors")
    shared, shared_path = write_table(found.join(anchors, "anchor"), "shared_seeds")
    remove(spark, seeds_path)
    first = F.min(F.struct("id", "mark", "first", "span")).alias("rep")
    classes, classes_path = write_table(shared.groupBy("anchor", "a", "b").agg(first), "classes")
    several = classes.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    keys, keys_path = write_table(_window_keys(classes.join(several, "anchor"), docs, window), "window_keys")
    met = keys.groupBy("x", "y").agg(F.min("least").alias("low"), F.max("least").alias("high")).filter("low < high").drop("high")
    lowest, lowest_path = write_table(met, "lowest")
    late = keys.join(lowest, ["x", "y"]).filter("low < least")
    bits = late.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits"))
    known, known_path = write_table(classes.select("a", "b", F.col("rep.id").alias("least")).join(bits, ["a", "b"], "left"), "known")
    all_bits = F.expr("shiftleft(1L, span) - 1")
    told = shared.join(known, ["a", "b"]).withColumn("bits", F.when(F.col("id") > F.col("least"), all_bits).otherwise(F.col("bits"))).filter("bits <> 0")
    own = materialise(told.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "bits")).alias("own")), "earlier")
    for path in (anchors_path, shared_path, classes_path, keys_path, lowest_path, known_path):
        remove(spark, path)
    return own


def covered_words(n: int, own: list, window: int) -> np.ndarray:
    """Which of n words the windows marked in ``own`` cover."""
    turn = np.zeros(n + 1, np.int64)
    if len(own):
        first, bits = (np.array([r[c] for r in own], np.int64) for c in ("first", "bits"))
        row, k = np.nonzero((bits[:, None] >> np.arange(window)) & 1)
        np.add.at(turn, first[row] + k, 1)
        np.add.at(turn, first[row] + k + window, -1)
    return np.cumsum(turn[:-1]) > 0


def repeat_spans(covered: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs (first word, one past the last) of covered words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, kept, n_words, n_removed, spans) for each row of ``docs``: its text without the words that such a window covers.

    A window is ``window`` words in a row; it goes if its words also start in a document of smaller id, judged on the input. The
    words that stay are joined by one space; ``spans`` are the maximal runs (first, end) of removed words. Documents of one id don't
    rob each other, equal rows give equal rows, and rows without an id keep their words and take none. Null, empty and short
    texts keep all. Texts are hashed a slice at a time, however long. Only the two columns are read, so others can't clash. An
    empty table gives no rows.
    """
    if not (0 < seed <= window and window - seed < 63):
        raise ValueError("seed must lie from 1 to window, and window - seed below 63")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    own = earlier_windows(rows, window, seed)

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                out = []
                for id_, text, own in batch.iloc[at : at + _ROWS].itertuples(index=False):
                    data, starts, ends = words_of(text)
                    gone = covered_words(len(starts), [] if own is None else own, window)
                    spans = repeat_spans(gone)
                    if spans:
                        stays = np.repeat(~gone, np.append(starts[1:], len(data) + 1) - starts)[: len(data)]
                        data = data[stays]
                        if len(data) and data[-1] == 32:
                            data = data[:-1]
                    out.append((id_, data.tobytes().decode("utf-8", "surrogatepass"), len(starts), int(gone.sum()), [{"first": a, "end": b} for a, b in spans]))
                yield pd.DataFrame(out, columns=["id", "kept", "n_words", "n_removed", "spans"]).astype({"id": "Int64"})

    found = rows.join(own, ["id", "mark"], "left").select("id", "text", "own")
    return found.mapInPandas(strip, "id long, kept string, n_words long, n_removed long, spans array<struct<first: long, end: long>>").withColumnRenamed("id", id_col)


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, n_spans) for each row, from ``remove_repeats``."""
    return remove_repeats(docs, id_col, text_col).select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))
