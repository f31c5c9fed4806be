"""Near duplicates by exact Jaccard similarity of word shingles, for the pipeline.

At similarity 0.8 two 64-bit SimHashes lie about ten bits apart, where tiles by bit counts skip hardly
any pair. So SimHash gives the closest candidates, and min-wise bands the others: each text has ``BANDS``
keys of ``BAND_ROWS`` minima, and texts with a common key are compared. A pair at similarity s is missed with probability
(1 - s^BAND_ROWS)^BANDS, which is 0.00007 at 0.8 and less above. Each candidate is linked only if
the whole shingle sets have the similarity. Texts of one shingle set are one node.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.hashing import run_hashes
from linkloom.llm.simhash import RADIUS, fingerprint_links, rows_of, star
from linkloom.operators.components import connected_components
from linkloom.scratch import materialise

WORDS = 5
LEAST = (4, 5)
BANDS = 24
BAND_ROWS = 5
TILE = 1 << 17
_ROWS = 2048
_COLUMNS = 2048
_SLICE = 1 << 16
_FACTORS = np.random.default_rng(42).integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32) | np.uint32(1)
_SALTS = np.random.default_rng(43).integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a whole text in order; none for a null or wordless text.

    Words are what SimHash takes: A-Z lower-cased, parted by ASCII white space. A text of fewer words is one shingle.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(tokens), np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    span = min(words, len(tokens))
    return np.unique(run_hashes(data, starts[: len(starts) - span + 1], ends[span - 1 :]))


def print_of(shingles: np.ndarray) -> np.uint64:
    """The 64-bit SimHash of a set of shingle hashes: bits that over half of them have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _SLICE):
        part = shingles[at : at + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band, mixed from its minima; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), _ROWS):
        least = np.minimum(least, ((high[None, at : at + _ROWS] ^ _SALTS[:, None]) * _FACTORS[:, None]).min(1))
    bands = least.reshape(BANDS, BAND_ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)), np.uint64, BANDS).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether two shingle sets have the Jaccard similarity ``least``, a fraction, or more; without rounding."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * common >= least[0] * (len(a) + len(b) - common)


def _sets(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) for each node of ``nodes``: its sorted set as packed 64-bit integers."""

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).tobytes() for t in column], dtype=object)

    own = texts.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return materialise(own.select("node", packed("text").alias("shingles")), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar; ``sets`` are the nodes' (node, shingles)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["x"], batch["y"], strict=True))
            yield batch.loc[[similar(x, y) for x, y in own], ["a", "b"]]

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return materialise(both.mapInPandas(compare, "a long, b long"), "verified")


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members the sets of ``left`` and ``right`` (places in ``sets``) have in common, by products of 0-1 matrices of few columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    met = times[column] > 1
    owner, column = owner[met], shared[column[met]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, n, _COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + _COLUMNS))
        has = np.zeros((len(sets), min(_COLUMNS, n - at)), np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        out += has[left] @ has[right].T
    return out


def _tile_links(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join the nodes of each band as all pairs of different components that are similar do.

    ``apart`` is (band, node, size, root, main), ``sets`` (node, shingles). A band's rows outside its main component and those inside are dealt to tiles of about
    ``TILE`` shingles, and each outer tile meets every tile. What is similar between two tiles is counted on the whole sets, and
    reduced to one link from each node to the least it reaches there: no row stands for a pair.
    """
    odd = F.col("root") != F.col("main")
    tiles = apart.groupBy("band").agg(
        F.ceil(F.sum(F.when(odd, F.col("size"))) / TILE).cast("int").alias("outer"), F.ceil(F.coalesce(F.sum(F.when(~odd, F.col("size"))), F.lit(0)) / TILE).cast("int").alias("inner")
    )
    tile = F.when(odd, F.pmod(F.xxhash64("node", "band"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("node", "band"), F.greatest("inner", F.lit(1)))).cast("int")
    placed = apart.join(tiles, "band").withColumns({"tile": tile, "odd": odd})
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("odd"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1))
    dealt = placed.withColumn("other", other).select("band", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "node", "root")
    ordered = dealt.join(sets, "node").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")

    def links(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray] | None:
        x, y = rows[0][1], rows[0][2]
        tile, node, root = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        left, right = np.flatnonzero(tile == x), np.flatnonzero(tile == y)
        if len(rows) < 2 or not len(left) or not len(right):
            return None
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets], np.float64)
        common = common_counts(sets, left, right).astype(np.float64)
        near = LEAST[1] * common >= LEAST[0] * (sizes[left][:, None] + sizes[right][None] - common)
        i, j = np.nonzero(near & (root[left][:, None] != root[right][None]))
        if not len(i):
            return None
        least = star(len(rows), left[i], right[j], node)
        moved = np.flatnonzero(least != np.arange(len(rows)))
        return node[moved], node[least[moved]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in itertools.chain(batches, [None]):
            found = []
            for row in batch.itertuples(index=False, name=None) if batch is not None else [None]:
                if held and (row is None or row[:3] != held[0][:3]):
                    if (pair := links(held)) is not None:
                        found.append(pair)
                    held = []
                if row is not None:
                    held.append(row)
            if found:
                yield pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    columns = ordered.select("band", "x", "y", "tile", "node", "root", "shingles")
    return materialise(columns.mapInPandas(compare, "a long, b long"), "tile_links")


def _in_reach(pairs: DataFrame) -> DataFrame:
    """Distinct pairs whose set sizes allow the similarity."""
    fits = F.least("a_size", "b_size") * LEAST[1] >= F.greatest("a_size", "b_size") * LEAST[0]
    return pairs.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``nodes``."""
    found = connected_components(links, "a", "b").withColumnRenamed("component", "root")
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after further links of nodes: only the roots that these join are searched again."""
    if links.isEmpty():
        return labels
    end = lambda e: labels.select(F.col("node").alias(e), F.col("root").alias(f"{e}_root"))
    met = links.join(end("a"), "a").join(end("b"), "b")
    found = connected_components(met, "a_root", "b_root").withColumnsRenamed({"node": "root", "component": "least_root"})
    return labels.join(found, "root", "left").select("node", F.coalesce("least_root", "root").alias("root"))


def _print_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs that SimHash finds: nodes of one fingerprint with the least of them, and the least of linked fingerprints."""
    by_print = materialise(nodes.groupBy("print").agg(F.min(F.struct("node", "size")).alias("first")), "prints")
    links = fingerprint_links(by_print.select(F.col("print").alias("fingerprint")), radius)
    end = lambda e, key: by_print.select(F.col("print").alias(key), F.col("first.node").alias(e), F.col("first.size").alias(f"{e}_size"))
    same = nodes.select("print", F.col("node").alias("a"), F.col("size").alias("a_size")).join(end("b", "print"), "print").filter("a <> b")
    near = links.join(end("a", "src"), "src").join(end("b", "dst"), "dst")
    columns = ["a", "b", "a_size", "b_size"]
    return same.select(columns).union(near.select(columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(least, root) for each distinct shingle set of ``docs``: its smallest id, null without one, and its component.

    Candidates are met twice. First SimHash tiles give the texts within ``radius`` bits, and each text of a band meets
    the band's smallest node; this joins most of a large group by few comparisons. Then those of a band that are not in
    its largest component meet all of the band in tiles. So what is linked is what all pairs of a band would link. Null and wordless texts are one set and link to nothing else. An empty table gives no rows.
    """

    @F.pandas_udf("node long, size int, print long, bands array<long>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            own = shingle_set(text, words)
            rows.append((np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64), len(own), print_of(own).astype(np.int64), band_keys(own)))
        return pd.DataFrame(rows, columns=["node", "size", "print", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialise(rows.select("id", "text", signed("text").alias("s")).select("id", "text", "s.*"), "signed")
    first = [F.first(c).alias(c) for c in ("size", "print", "bands")]
    nodes = materialise(rows.groupBy("node").agg(F.min("id").alias("least"), *first), "nodes")
    keyed = nodes.select("node", "size", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min(F.struct("node", "size")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = materialise(keyed.join(shared, "band").select("band", "node", "size", F.col("first.node").alias("b"), F.col("first.size").alias("b_size")), "bands")
    texts = rows.select("node", "text")
    stars = met.select(F.col("node").alias("a"), "b", F.col("size").alias("a_size"), "b_size")
    stars = stars.union(_print_pairs(nodes.filter("size > 0").select("node", "size", "print"), radius))
    stars = materialise(_in_reach(stars), "stars")
    # one reading of the texts serves both comparisons
    sets = _sets(met.select("node").union(stars.select(F.explode(F.array("a", "b")))), texts, words)
    labels = materialise(_labelled(nodes, _verified(stars, sets)), "labels")
    apart = met.select("band", "node", "size").join(labels, "node")
    roots = apart.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    apart = materialise(apart.join(roots.filter("roots > 1").select("band", "main"), "band"), "apart")
    return nodes.select("node", "least").join(_joined(labels, _tile_links(apart, sets)), "node").select("least", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of smallest id, all columns kept.

    Rows without an id stay, as none can be named. Of several rows of a kept id that one stays whose columns,
    written as JSON, come first. An empty table gives no rows; other columns pass unread.
    """
    kept = near_duplicates(docs, id_col, text_col).groupBy("root").agg(F.min("least").alias("_id")).filter("_id is not null")
    return rows_of(docs, kept.select("_id").distinct(), id_col)
