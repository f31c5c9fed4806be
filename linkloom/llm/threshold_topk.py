"""Exact top-k by inner product with the threshold algorithm over sorted lists.

Candidates are dealt to blocks; each block sorts its rows once by every dimension. A query goes down
the lists of its non-zero dimensions side by side (from the other end where its component is negative),
scores what it meets for the first time, and stops when the sum of what the lists can still give is
below its k-th best score. The blocks' results are merged to the k best of each query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
QUERY_STEP = 20
FACTOR = 64
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 512
STRIDE = 64


def usable_parts(vector: Column) -> Column:
    """The components as doubles; null if the vector has none or an unusable one."""
    usable = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(usable & (F.size(vector) > 0), F.transform(vector, lambda v: v.cast("double")))


def whole_number(x: float, factor: int) -> int:
    """floor(factor * x) exactly, however large."""
    return factor * int(x) if abs(x) >= 2.0**52 else math.floor(factor * x)


class SortedLists:
    """A block's rows with, for each dimension, their order by falling component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.falling = np.argsort(-self.vectors, axis=0, kind="stable")

    def top(self, query: np.ndarray, own_id, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, ties to smaller ids.

        The bound after depth d is the sum over dimensions of query times the component at d. The walk
        ends when the bound is below the k-th score, as at equality a row with a smaller id could still
        come, or when every row has been scored.
        """
        n, left = len(self.ids), len(self.ids)
        dims = np.flatnonzero(query)
        down = query < 0
        seen = np.zeros(n, bool)
        best_rows, best_scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)
        depth, stride = 0, STRIDE
        while left and len(dims):
            upto = min(n, depth + stride)
            met = np.where(down[None, :], self.falling[n - upto : n - depth][::-1], self.falling[depth:upto])
            met = met if len(dims) == len(query) else met[:, dims]
            new = np.zeros(n, bool)
            new[met.ravel()] = True
            new &= ~seen
            seen |= new
            fresh = np.flatnonzero(new)
            left -= len(fresh)
            fresh = fresh[self.ids[fresh] != own_id]
            scores = self.vectors[fresh] @ query
            least = best_scores[-1] if len(best_scores) == k else -np.inf
            if len(scores) > k:
                least = max(least, np.partition(scores, -k)[-k])
            near = scores >= least
            rows, scores = np.concatenate([best_rows, fresh[near]]), np.concatenate([best_scores, scores[near]])
            first = np.lexsort((rows, -scores))[:k]
            best_rows, best_scores = rows[first], scores[first]
            bound = int(self.vectors[met[-1], dims] @ query[dims])
            if len(first) == k and bound < best_scores[-1]:
                break
            depth, stride = upto, stride * 2
        if not len(dims):
            best_rows = np.flatnonzero(self.ids != own_id)[:k]
            best_scores = np.zeros(len(best_rows))
        return self.ids[best_rows], best_scores.astype(np.int64)


def _wide(x: np.ndarray, factor: int) -> np.ndarray:
    """Which rows have a component so large that products with the others' may not be exact in a double."""
    return (np.abs(x) >= (2.0**26 / math.sqrt(x.shape[1]) - 1) / factor).any(1)


def _whole_scores(query: list[int], rows: list[list[int]]) -> list[int]:
    """Inner products in whole numbers of any size, brought to the nearest that a long holds."""
    return [max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, query, r)))) for r in rows]


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the k best rows for each query. Rows and queries with very large components are scored in whole numbers."""
    wide, asks_wide = _wide(x, factor), _wide(queries, factor)
    lists = SortedLists(ids[~wide], np.floor(factor * x[~wide]))
    whole = [[whole_number(v, factor) for v in r] for r in x[wide].tolist()]
    every = [[whole_number(v, factor) for v in r] for r in x.tolist()] if asks_wide.any() else []
    found = []
    for query_id, query, odd in zip(query_ids, queries, asks_wide, strict=True):
        own = [whole_number(v, factor) for v in query.tolist()] if odd or whole else []
        if odd:
            near, scores = ids, np.array(_whole_scores(own, every), np.int64)
        else:
            near, scores = lists.top(np.floor(factor * query), query_id, k)
            near, scores = np.concatenate([near, ids[wide]]), np.concatenate([scores, np.array(_whole_scores(own, whole), np.int64)])
        if odd or whole:
            other = near != query_id
            near, scores = near[other], scores[other]
            first = np.lexsort((near, -np.maximum(scores, -(2**63) + 1)))[:k]
            near, scores = near[first], scores[first]
        found.append((near, scores))
    return found


def top_k(
    vectors: DataFrame,
    k: int = K,
    query_step: int = QUERY_STEP,
    factor: int = FACTOR,
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, embedding): the k best of each query.

    Queries are the rows whose vec_id is divisible by ``query_step``; each meets every other row of its
    length. Null vectors, empty ones and those with null or non-finite components take no part, nor do
    rows without an id. Rows with the query's id count as its own; other repeated rows are candidates
    each, so a repeated query gives one result. An empty table gives no rows. Blocks hold about
    ``candidate_block`` and ``query_block`` rows whatever the size of the table. Components of any finite size
    count exactly; a score beyond a long is the nearest long, and such scores tie.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), usable_parts(F.col("embedding")).alias("x"))
    rows = rows.filter("vec_id is not null and x is not null").withColumn("dim", F.size("x"))
    is_query = F.col("vec_id") % query_step == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))
    spread = lambda count, salt: F.pmod(F.xxhash64("vec_id", "x", F.lit(salt)), F.lit(count)).cast("int")
    candidates = rows.select(
        "dim", spread(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
        F.lit(False).alias("asks"), "vec_id", "x",
    )
    asked = rows.filter(is_query).dropDuplicates(["vec_id"])
    queries = asked.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), spread(query_blocks, 2).alias("query_block"),
        F.lit(True).alias("asks"), "vec_id", "x",
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        ids = pdf["vec_id"].to_numpy()
        asked, found_ids, found_scores = [], [], []
        if asks.any() and not asks.all():
            x = np.stack(pdf["x"].to_numpy())
            results = search_block(ids[~asks], x[~asks], ids[asks], x[asks], k, factor)
            for query_id, (found, scores) in zip(ids[asks], results, strict=True):
                asked.append(np.full(len(found), query_id))
                found_ids.append(found)
                found_scores.append(scores)
        columns = {"query_id": asked, "vec_id": found_ids, "score": found_scores}
        return pd.DataFrame({name: np.concatenate(parts) if parts else np.empty(0, np.int64) for name, parts in columns.items()})

    found = candidates.union(queries).groupBy("dim", "block", "query_block").applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
