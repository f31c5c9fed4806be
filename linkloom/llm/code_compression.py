"""Vector codes from product codebooks, trained by filtering Lloyd rounds.

Vectors are cut into parts; each part position has a codebook of its own. Every partition cuts its rows into blocks
and builds a balanced kd-tree over the parts of each position, once: boxes and sums of its nodes are written beside
the points. In a round a node keeps the entries that may be nearest somewhere in its box; where one is left, the whole
subtree goes to it by its cached sum and count, and only the points of undecided leaves are compared one by one.
All is in whole numbers, so rounds come out the same however rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.scratch import materialise

PARTS = 8
ENTRIES = 16
ROUNDS = 6
FACTOR = 4096
BLOCK_ROWS = 2048
LEAF_ROWS = 16
_LONG = (1 << 63) - 1


@dataclass
class Tree:
    """A balanced kd-tree: ``points`` in its order, ``rows`` their places in the block, and for each level the edges, boxes and sums of its nodes."""

    points: np.ndarray
    rows: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _edges(n: int, leaf_rows: int) -> list[np.ndarray]:
    """The first rows of the nodes of each level, and n; leaves have ``leaf_rows`` rows or fewer, nodes one at least."""
    depth = 0
    while (n + (1 << depth) - 1) >> depth > leaf_rows and 1 << (depth + 1) <= n:
        depth += 1
    return [(np.arange((1 << k) + 1, dtype=np.int64) * n) >> k for k in range(depth + 1)]


def build_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Every node is halved across the widest side of its box."""
    n = len(points)
    rows = np.arange(n)
    edges = _edges(n, leaf_rows)
    for cut in edges[:-1]:
        own = points[rows]
        wide = np.argmax(np.maximum.reduceat(own, cut[:-1]) - np.minimum.reduceat(own, cut[:-1]), axis=1)
        node = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        rows = rows[np.lexsort((own[np.arange(n), wide[node]], node))]
    own = points[rows]
    sides = [(cut, np.minimum.reduceat(own, cut[:-1]), np.maximum.reduceat(own, cut[:-1]), np.add.reduceat(own, cut[:-1])) for cut in edges]
    return Tree(own, rows, sides)


def _distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - book[None]) ** 2).sum(2)


def filter_tree(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point in the tree's order, and the sums and counts of the entries' points.

    Of equally near entries the lowest wins: an entry is dropped in a box if another is nearer everywhere in it, or
    nowhere farther and of lower index.
    """
    k, n = len(book), len(tree.points)
    entry, sums, counts = np.empty(n, np.int64), np.zeros(book.shape, np.int64), np.zeros(k, np.int64)
    nodes, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level, (cut, low, high, total) in enumerate(tree.levels):
        lo, hi = low[nodes], high[nodes]
        middle = np.where(may, _distances(lo + hi, 2 * book), _LONG)
        best = middle.argmin(1)
        star = book[best][:, None]
        corner = np.where(book[None] > star, hi[:, None], lo[:, None])
        behind = ((book[None] - corner) ** 2).sum(2) - ((star - corner) ** 2).sum(2)
        may &= (behind < 0) | ((behind == 0) & (np.arange(k) <= best[:, None]))
        alone = may.sum(1) == 1
        done, to = nodes[alone], best[alone]
        size = cut[done + 1] - cut[done]
        np.add.at(sums, to, total[done])
        np.add.at(counts, to, size)
        entry[_ranges(cut[done], size)] = np.repeat(to, size)
        nodes, may = nodes[~alone], may[~alone]
        if level + 1 < len(tree.levels):
            nodes, may = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(may, 2, axis=0)
    cut = tree.levels[-1][0]
    size = cut[nodes + 1] - cut[nodes]
    at = _ranges(cut[nodes], size)
    if len(at):
        entry[at] = np.where(np.repeat(may, size, axis=0), _distances(tree.points[at], book), _LONG).argmin(1)
        np.add.at(sums, entry[at], tree.points[at])
        counts += np.bincount(entry[at], minlength=k)
    return entry, sums, counts


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def whole_parts(vectors: DataFrame, vector_col: str, parts: int, factor: int) -> DataFrame:
    """``vectors`` with ``whole``, the components times ``factor`` rounded down, without the rows that take no part.

    Those are null, empty, hold null or non-finite components, or are not as long as that of the smallest vec_id.
    Components are held to a bound far beyond usual values, so that distances fit a long. Zeros fill up the last part.
    """
    able = vectors.filter(F.size(vector_col) > 0).filter(
        F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    )
    first = able.select(F.size(vector_col).alias("n"), "vec_id", vector_col).orderBy(F.col("vec_id").asc_nulls_last(), vector_col).first()
    if first is None:
        return able.limit(0).withColumn("whole", F.lit(None).cast("array<int>"))
    width = -(-first["n"] // parts)
    bound = float(1 << ((58 - (width * parts - 1).bit_length()) // 2))
    floor = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * factor, F.lit(-bound)), F.lit(bound))), F.lit(-int(bound))), F.lit(int(bound))).cast("int")
    filled = F.concat(F.transform(vector_col, floor), F.array_repeat(F.lit(0), width * parts - first["n"]))
    return able.filter(F.size(vector_col) == first["n"]).withColumn("whole", filled)


def _planted(kept: DataFrame, parts: int, block_rows: int) -> DataFrame:
    """Blocks of rows with their points and trees, a row each, built where the rows are."""
    kinds = {f.name: f.dataType for f in kept.schema}
    out = T.StructType([T.StructField("ids", T.ArrayType(kinds["vec_id"])), T.StructField("labels", T.ArrayType(kinds["label"]))])
    for name in ("points", "rows", "low", "high", "total"):
        out = out.add(name, T.BinaryType())
    out = out.add("n", T.IntegerType())

    def block(ids: pa.Array, labels: pa.Array, whole: pa.Array) -> pa.RecordBatch:
        n = len(ids)
        points = np.ascontiguousarray(whole.flatten().to_numpy(zero_copy_only=False).reshape(n, parts, -1).transpose(1, 0, 2)).astype(np.int64)
        trees = [build_tree(p) for p in points]
        pack = lambda k, kind: pa.array([b"".join(np.concatenate([level[k] for level in t.levels]).astype(kind).tobytes() for t in trees)], pa.binary())
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (ids, labels)]
        own = [pa.array([b"".join(t.points.astype(np.int32).tobytes() for t in trees)], pa.binary()), pa.array([b"".join(t.rows.astype(np.int32).tobytes() for t in trees)], pa.binary())]
        return pa.RecordBatch.from_arrays([*lists, *own, pack(1, np.int32), pack(2, np.int32), pack(3, np.int64), pa.array([n], pa.int32())], names=out.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(len(b) for b in held) >= block_rows:
                table = pa.Table.from_batches(held)
                yield block(*(table.column(c).slice(0, block_rows).combine_chunks() for c in ("vec_id", "label", "whole")))
                held = table.slice(block_rows).to_batches()
        if sum(len(b) for b in held):
            table = pa.Table.from_batches(held)
            yield block(*(table.column(c).combine_chunks() for c in ("vec_id", "label", "whole")))

    return kept.select("vec_id", "label", "whole").mapInArrow(cut, out)


def _trees(row: dict, parts: int) -> list[Tree]:
    """The trees of a block as ``_planted`` wrote them."""
    n = row["n"]
    points, rows = np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(parts, n, -1), np.frombuffer(row["rows"], np.int32).reshape(parts, n)
    edges = _edges(n, LEAF_ROWS)
    low, high, total = (np.frombuffer(row[c], kind).astype(np.int64).reshape(parts, -1, points.shape[2]) for c, kind in (("low", np.int32), ("high", np.int32), ("total", np.int64)))
    ends = np.cumsum([0, *(len(e) - 1 for e in edges)])
    return [Tree(points[p], rows[p], [(e, low[p, a:b], high[p, a:b], total[p, a:b]) for e, a, b in zip(edges, ends[:-1], ends[1:], strict=True)]) for p in range(parts)]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round. What meets is a row for each task, part and entry."""
    parts, entries, width = books.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("n", "points", "rows", "low", "high", "total")}
                for p, tree in enumerate(_trees(row, parts)):
                    _, s, c = filter_tree(tree, books[p])
                    sums[p] += s
                    counts[p] += c
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": p, "entry": e, "n": counts[p, e], "sums": list(sums[p, e])}), preserve_index=False)

    exact = [F.sum(F.col("sums")[j].cast("decimal(20,0)")) for j in range(width)]
    met = blocks.drop("ids", "labels").mapInArrow(gather, "part long, entry long, n long, sums array<long>")
    after = books.copy()
    for part, entry, n, *sums in met.groupBy("part", "entry").agg(F.sum("n"), *exact).collect():
        after[part, entry] = [int(s) // n for s in sums]
    return after


def _codes(blocks: DataFrame, books: np.ndarray, out: T.StructType) -> DataFrame:
    parts = len(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("n", "points", "rows", "low", "high", "total")}
                code, error = np.empty((row["n"], parts), np.int64), np.zeros(row["n"], np.int64)
                for p, tree in enumerate(_trees(row, parts)):
                    entry, _, _ = filter_tree(tree, books[p])
                    code[tree.rows, p] = entry
                    error[tree.rows] += ((tree.points - books[p][entry]) ** 2).sum(1)
                text = ["".join(f"{e:02x}" for e in c) for c in code.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text, pa.string()), pa.array(error)], names=out.names)

    return blocks.mapInArrow(assign, out)


def train(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, position) after the rounds; entries without points stay as they are."""
    for _ in range(rounds):
        books = _round(blocks, books)
    return books


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector that can be coded.

    Left out are null and empty vectors, those with null or non-finite components, and those not as long as that of the
    smallest id. A component beyond the bound that keeps errors within a long (2^26 at 64 components, so far from
    4096 times any embedding's) counts as the bound. Repeated rows and ids are coded each; the first entries come
    from the smallest rows by id (null ids last), then vector, and are fewer where the table has fewer rows. ``code`` has
    two hex digits a part, so 256 entries at most. Errors of equal labels, nulls together, sum to ``label_error``, held to
    the largest long. A length that isn't a multiple of ``parts`` is filled up with zeros. Only the three named columns
    are read, so others can't clash. An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie from 1 to 256")
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    kept = whole_parts(named, "v", parts, factor).select("vec_id", "label", "whole")
    seeds = [row["whole"] for row in kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()]
    out = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not seeds:
        coded, digest = vectors.sparkSession.createDataFrame([], out), ""
    else:
        blocks = materialise(_planted(kept, parts, block_rows), "trees")
        books = train(blocks, np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy(), rounds)
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        coded = materialise(_codes(blocks, books, out), "codes")
    totals = coded.groupBy(F.col("label").alias("own")).agg(
        F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_LONG).cast("decimal(20,0)")).cast("long").alias("label_error")
    )
    found = coded.join(totals, F.col("label").eqNullSafe(F.col("own")))
    return found.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
