"""Embedding near-duplicates by lattice hashing.

Each table projects a unit vector to eight dimensions at random and decodes the point to the nearest
point of the E8 lattice: its cell. A vector stands in its own cell of every table and looks into the
nearest of the neighbouring cells. Who meets in a cell is compared by cosine in double precision. At
cosine 0.93 one table misses a pair with probability 0.17, six tables with 0.00003; closer pairs are
missed less.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.simhash import star
from linkloom.operators.components import connected_components
from linkloom.scratch import materialise

LEAST_COSINE = 0.93
TABLES = 6
PROBES = 3
SCALE = 0.5
BLOCK_ROWS = 2048
_DIM = 8


def nearest_points(x: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` (8 at most) nearest of the E8 points tried for each row of ``x``, doubled to integers.

    E8 is the points with integer coordinates of even sum, and the same moved by a half in each. In each
    of these two sets the nearest point comes from rounding, with one coordinate rounded the other way
    where the sum is odd; rounding those next in line the other way gives the neighbouring cells.
    """
    found, far, rows = [], [], np.arange(len(x))
    for move in (0.0, 0.5):
        y = x - move
        r = np.rint(y)
        error = y - r
        order = np.argsort(-np.abs(error), axis=1, kind="stable")
        other = np.where(error >= 0, 1.0, -1.0)
        odd = r.sum(1) % 2 != 0
        for even_turns, odd_turns in (((), (0,)), ((0, 1), (1,)), ((0, 2), (2,)), ((1, 2), (3,))):
            z = r.copy()
            for pick, turns in ((~odd, even_turns), (odd, odd_turns)):
                at = rows[pick]
                for k in turns:
                    j = order[at, k]
                    z[at, j] += other[at, j]
            z += move
            found.append(z)
            far.append(((x - z) ** 2).sum(1))
    first = np.argsort(np.stack(far, 1), axis=1, kind="stable")[:, :many]
    return np.rint(2 * np.take_along_axis(np.stack(found, 1), first[:, :, None], 1)).astype(np.int64)


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int, scale: float) -> np.ndarray:
    """(tables, dim, 8), normal with deviation ``scale``, so distances between points don't depend on ``dim``; the same in every task."""
    return np.random.default_rng(811 + dim).normal(0, scale, (tables, dim, _DIM))


@lru_cache(maxsize=1)
def _mixers() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 62, _DIM, dtype=np.int64) | 1


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """(rows, tables, 1 + probes) hashes of lattice cells, each row's own cell first."""
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t, p in enumerate(_projections(unit.shape[1], tables, scale)):
        points = nearest_points(unit @ p, 1 + probes)
        h = np.zeros(points.shape[:2], np.int64)
        for k in range(_DIM):
            h = (h ^ points[:, :, k]) * _mixers()[k]
            h ^= (h >> 29) & 0x7FFFFFFFF
        out[:, t] = h
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Each is brought to a largest component of one first, as squares of very small or large ones leave a double's range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _comparable(vector: Column) -> Column:
    """Whether a vector can link: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _codes(vector: Column, tables: int, probes: int, scale: float) -> Column:
    @F.pandas_udf("array<long>")
    def of(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        lengths = vectors.map(len)
        for _, part in vectors.groupby(lengths, sort=False):
            for at, row in zip(part.index, cells(_unit(np.stack(part.to_numpy()).astype(np.float64)), tables, probes, scale).reshape(len(part), -1), strict=True):
                out[at] = row
        return out

    return of(vector)


def _earlier(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether rows i and j also meet in an earlier table, or in this table in another cell that counts for them."""
    done = np.zeros(len(i), bool)
    for t in range(table + 1):
        own_i, own_j = codes[i, t, 0], codes[j, t, 0]
        i_sees = (codes[i, t] == own_j[:, None]).any(1)
        j_sees = (codes[j, t] == own_i[:, None]).any(1)
        if t < table:
            done |= i_sees | j_sees
        else:
            counts = np.where(own_i == own_j, own_i, np.where(i_sees & j_sees, np.minimum(own_i, own_j), np.where(i_sees, own_j, own_i)))
            done |= counts != cell
    return done


def cell_links(members: DataFrame, least: float, tables: int, probes: int, scale: float, block_rows: int) -> DataFrame:
    """(node, links, root) for each node and cell it has links in, from (node, label, copies, vector).

    A pair counts once: in the first table in which the two meet. ``links`` adds the copies of the
    linked nodes, ``root`` is the least node reached within the cell. Cells of more than ``block_rows``
    rows are dealt to several groups, block against block, so none holds a whole hot cell. Groups lie
    side by side in sorted partitions and are compared as their rows come by.
    """
    coded = members.select("node", "label", "copies", F.size("vector").alias("dim"), _codes(F.col("vector"), tables, probes, scale).alias("codes"))
    places = coded.select("node", "label", "copies", "dim", F.posexplode("codes").alias("at", "cell")).select(
        "node", "label", "copies", "dim", F.floor(F.col("at") / (1 + probes)).cast("int").alias("table"), "cell", (F.col("at") % (1 + probes) == 0).alias("own")
    )
    places = materialise(places, "places")
    key = ["label", "dim", "table", "cell"]
    sizes = places.groupBy(*key).agg(F.count("*").alias("rows"), F.count_if("own").alias("owners")).filter("rows > 1 and owners > 0")
    blocks = F.ceil(F.col("rows") / block_rows).cast("int")
    met = places.join(sizes.select(*key, blocks.alias("blocks")), key)
    dealt = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(members.select("node", "vector"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        *key, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "copies", "own", "vector"
    )

    def compare(table: int, cell: int, group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        unit, own, block, node = group["unit"], group["own"], group["block"], group["node"]
        left, right = [], []
        for at in range(0, len(unit), 1024):
            near = unit[at : at + 1024] @ unit.T >= least
            near &= own[at : at + 1024, None] | own[None, :]
            if group["a"][0] != group["b"][0]:
                near &= block[at : at + 1024, None] != block[None, :]
            i, j = np.nonzero(near)
            i += at
            left.append(i[i < j])
            right.append(j[i < j])
        i, j = np.concatenate(left), np.concatenate(right)
        if not len(i):
            return None
        used = np.unique(np.concatenate([i, j]))
        i, j = np.searchsorted(used, i), np.searchsorted(used, j)
        codes, node, copies = cells(unit[used], tables, probes, scale), node[used], group["copies"][used]
        links = np.zeros(len(used), np.int64)
        for at in range(0, len(i), 1 << 18):
            p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            fresh = ~_earlier(codes, p, q, table, cell)
            np.add.at(links, p[fresh], copies[q[fresh]])
            np.add.at(links, q[fresh], copies[p[fresh]])
        return node, links, node[star(len(used), i, j, node)]

    names = [*key, "a", "b"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows come in; each group is compared when it is whole, the last of a batch with the next."""
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                batch = pa.Table.from_batches([batch])
                rest = batch if rest is None else pa.concat_tables([rest, batch])
            if rest is None or not rest.num_rows:
                continue
            rest = rest.combine_chunks()
            col = {n: rest[n].to_numpy() for n in [*names, "block", "node", "copies", "own"]}
            change = np.any([col[n][1:] != col[n][:-1] for n in names], axis=0)
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [rest.num_rows]])
            if batch is not None:
                cuts = cuts[:-1]
            vectors = rest["vector"].chunk(0)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            out = []
            for at, upto in itertools.pairwise(cuts.tolist()):
                if upto - at < 2:
                    continue
                x = flat[offsets[at] : offsets[upto]].reshape(upto - at, -1).astype(np.float64)
                group = {n: v[at:upto] for n, v in col.items()} | {"unit": _unit(x)}
                if (found := compare(int(col["table"][at]), int(col["cell"][at]), group)) is not None:
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["node", "links", "root"])
            rest = rest.slice(int(cuts[-1])) if batch is not None else None

    ordered = dealt.repartition(*names).sortWithinPartitions(*names, "node")
    return ordered.mapInArrow(walk, "node long, links long, root long")


def near_duplicates(
    vectors: DataFrame,
    least: float = LEAST_COSINE,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine is
    ``least`` or more. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do rows without a label or an id. Equal vectors of a label are one node that
    counts its copies, so copies aren't paired; repeated rows are copies. Rows of one id with different vectors under
    one label are one node that links as each of them does. Components may be of any finite size. Other columns
    aren't read; an empty table gives no rows.
    """
    rows = vectors.select(
        "vec_id", "label", F.col("embedding").alias("vector"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")
    )
    able = _comparable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = ["label", "h1", "h2"]
    nodes = rows.filter(able).groupBy(*key).agg(F.min("vec_id").cast("long").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = materialise(nodes, "vectors")
    found = materialise(cell_links(nodes.select("node", "label", "copies", "vector"), least, tables, probes, scale, block_rows), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    known = nodes.select(*key, "node", "copies").join(links, "node", "left").join(joined, "node", "left")
    known = materialise(
        known.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")),
        "known",
    )
    keyed = rows.select("vec_id", *[F.when(able, F.col(k)).alias(k) for k in key])
    out = keyed.join(known, key, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
