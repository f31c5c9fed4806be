"""SimHash near-duplicates by exact tiled comparison.

Documents with one fingerprint are one node. Fingerprints are cut into tiles by the population counts
of their bit blocks. Two fingerprints within ``radius`` bits have block counts that differ by
``radius`` in sum at most, so tile pairs that differ more are skipped without losing a link. What
remains is compared exactly, tile against tile, with numpy exclusive-or and bit counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.components import connected_components
from linkloom.scratch import materialise

SEED = 42
WORDS = 3
RADIUS = 2
BLOCKS = 4
TILE_ROWS = 1024
_SLICE = 1 << 16


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The 64-bit hashes of a whole text's runs of ``words`` words, slice by slice; none for a null or wordless text.

    A text of fewer words is one run. Only A-Z are lower-cased and only ASCII white space parts words, as
    bytes.lower and bytes.split do.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(words, len(tokens))
    n = len(tokens) - span + 1
    for at in range(0, n, _SLICE):
        upto = min(n, at + _SLICE)
        pieces = map(joined.__getitem__, map(slice, starts[at:upto].tolist(), ends[at + span - 1 : upto + span - 1].tolist()))
        yield np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, upto - at)


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a whole text as an unsigned integer; null or wordless texts have zero."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, words):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """``fingerprint_of`` as a column: the 64 bits as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint_of(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))

    return of(text)


def block_masks(blocks: int) -> list[tuple[int, int]]:
    """(first bit, mask) of each of ``blocks`` nearly equal runs of bits."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in itertools.pairwise(cuts)]


def _tile(fp: Column, blocks: int) -> Column:
    """The block counts as one long, eight bits a block."""
    out = F.lit(0).cast("long")
    for i, (first, mask) in enumerate(block_masks(blocks)):
        out = out + F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(mask))).cast("long"), 8 * i)
    return out


def _steps(blocks: int, radius: int) -> list[int]:
    """What is added to a tile for each tile within reach, one of each opposite pair."""
    found = []
    for x in itertools.product(range(-radius, radius + 1), repeat=blocks):
        step = sum(v << (8 * i) for i, v in enumerate(x))
        if sum(map(abs, x)) <= radius and step >= 0:
            found.append(step)
    return found


def star(n: int, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For links left-right among n nodes: the node of least rank that each node reaches."""
    order = np.argsort(rank, kind="stable")
    label = np.empty(n, np.int64)
    label[order] = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = np.minimum(after, after[order[after]])
        if (after == label).all():
            return order[label]
        label = after


def _links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius, between a and b or, without b, inside a. Compared 256 rows at a time."""
    other, left, right = (a if b is None else b), [], []
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ other[None, :]) <= radius)
        i = i + at
        if b is None:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (src, dst) that join the same fingerprints as all pairs within the radius do.

    ``prints`` has distinct longs in ``fingerprint``. For each tile pair the links found are reduced to
    one from each node to the least it reaches there, so rows out follow rows in. A tile with more than
    ``tile_rows`` rows is dealt to several, each compared with each.
    """
    spark = prints.sparkSession
    keyed = prints.select("fingerprint", _tile(F.col("fingerprint"), blocks).alias("tile"))
    chunks = keyed.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("chunks"))
    dealt = keyed.join(chunks, "tile").select(
        "tile", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int").alias("chunk"), "fingerprint"
    )
    tiles = materialise(dealt.groupBy("tile", "chunk").agg(F.collect_list("fingerprint").alias("prints")), "tiles")
    steps = F.array(*[F.lit(x).cast("long") for x in _steps(blocks, radius)])
    left = tiles.select("tile", "chunk", "prints", F.explode(steps).alias("step")).select(
        (F.col("tile") + F.col("step")).alias("tile"), F.col("chunk").alias("a_chunk"), F.col("prints").alias("a"), "step"
    )
    pairs = left.join(tiles, "tile").filter("step <> 0 or a_chunk <= chunk").select(
        "a", F.col("prints").alias("b"), ((F.col("step") == 0) & (F.col("a_chunk") == F.col("chunk"))).alias("same")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            src, dst = [], []
            for a, b, same in zip(batch["a"], batch["b"], batch["same"], strict=True):
                a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
                i, j = _links(a.view(np.uint64), None if same else b.view(np.uint64), radius)
                if len(i):
                    nodes = a if same else np.concatenate([a, b])
                    j = j if same else j + len(a)
                    root = star(len(nodes), i, j, nodes)
                    off = np.flatnonzero(root != np.arange(len(nodes)))
                    src.append(nodes[off])
                    dst.append(nodes[root[off]])
            if src:
                yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return spark.createDataFrame([], "src long, dst long").union(pairs.mapInPandas(compare, "src long, dst long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``.

    ``fingerprint`` is the signed long, ``component_id`` the smallest id among all documents that links
    reach. Null and wordless texts share the fingerprint zero and link like any other. Repeated rows
    each give a row. A null id takes its component's smallest id, null where no member has one. Only the
    two named columns are read, so further columns can't clash. An empty table gives an empty result.
    """
    prints = materialise(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fingerprint")), "prints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("id").alias("least")), "nodes")
    joined = connected_components(fingerprint_links(nodes, radius)).withColumnsRenamed({"node": "fingerprint", "component": "root"})
    rooted = materialise(nodes.join(joined, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialise(rooted.join(least, "root").select("fingerprint", "component_id"), "by_print")
    return prints.join(by_print, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def rows_of(docs: DataFrame, kept: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept`` (``_id``, distinct), one for each id, and all rows without an id.

    Where several rows have the id, the one stays whose columns, written as JSON, come first. Column names of ``docs`` can't
    clash with anything.
    """
    columns = docs.columns
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    own = f"c{columns.index(id_col)}"
    times = rows.filter(F.col(own).isNotNull()).groupBy(own).agg(F.count("*").alias("times"))
    named = rows.join(kept.select(F.col("_id").alias(own)).join(times, own).withColumnRenamed(own, "kept_id"), F.col(own) == F.col("kept_id"))
    every = [f"c{i}" for i in range(len(columns))]
    whole = F.struct(*every)
    first = named.filter("times > 1").groupBy("kept_id").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    found = named.filter("times = 1").select(every).union(first).union(rows.filter(F.col(own).isNull()))
    return found.select([F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of smallest id, all columns kept.

    Groups whose rows have no id keep all of them, as no row can be named. Of several rows of a kept id that
    one stays whose columns, written as JSON, come first. An empty table gives no rows; other columns pass unread.
    """
    found = near_duplicates(docs, id_col, text_col, radius).select(F.col(id_col).alias("_id"), F.col("component_id").alias("_root"))
    return rows_of(docs, found.filter("_id = _root").select("_id").distinct(), id_col)
