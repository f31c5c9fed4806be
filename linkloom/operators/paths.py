"""Chains through the graph: distances, shortest chains, exact counts and pages of all of them.

Adjacency is (node, other) in both directions. Searches go level by level: a frontier joins the adjacency, and
as links go both ways, what it comes to is new unless it is in this level or the one before; each level is written to
the shared folder. The driver sees
sizes of levels, and, in paging, the successors of the few nodes on the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators import proof_groups
from linkloom.operators.proof_groups import ProofGroups
from linkloom.scratch import materialise

LIMB = 10**9
_CHUNK = 4000
MOST_PAGE = 500
U64 = 2**64 - 1


def _step(adjacency: DataFrame | ProofGroups, frontier: DataFrame) -> DataFrame:
    """``frontier`` (node, ...) with ``other`` for ``node``; a node itself may be among those it leads to."""
    if isinstance(adjacency, ProofGroups):
        return proof_groups.step(adjacency, frontier)
    return frontier.join(adjacency, "node").drop("node")


def _spark(adjacency: DataFrame | ProofGroups):
    return (adjacency.asks if isinstance(adjacency, ProofGroups) else adjacency).sparkSession


def distances(adjacency: DataFrame | ProofGroups, sources: DataFrame, max_depth: int | None = None, goal: str | None = None) -> DataFrame:
    """(source, node, distance) for every node that links reach from each of ``sources`` (source).

    ``goal`` ends the search after the level in which every source has reached it.
    """
    frontier = materialise(sources.select("source", F.col("source").alias("node")).distinct(), "level")
    before = frontier.limit(0)
    levels, depth = [frontier.withColumn("distance", F.lit(0))], 0
    wanted = frontier.count() if goal is not None else 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = _step(adjacency, frontier).select("source", F.col("other").alias("node")).distinct()
        before, frontier = frontier, materialise(step.join(frontier.union(before), ["source", "node"], "left_anti"), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("distance", F.lit(depth)))
        if goal is not None:
            wanted -= frontier.filter(F.col("node") == goal).count()
            if not wanted:
                break
    return reduce(DataFrame.union, levels)


def _one(spark, name: str, value: str) -> DataFrame:
    return spark.createDataFrame([(value,)], f"{name} string")


def _least(adjacency: DataFrame | ProofGroups, frontier: DataFrame) -> DataFrame:
    """(node, path) one link on from ``frontier`` (node, path): for each node the least path at least."""
    append = F.array_append("path", F.col("other")).alias("path")
    if not isinstance(adjacency, ProofGroups):
        return frontier.join(adjacency, "node").select(F.col("other").alias("node"), append)
    best = frontier.join(adjacency.asks, "node").groupBy("kind", "grp").agg(F.min("path").alias("path"))
    return best.join(adjacency.members, ["kind", "grp"]).select(F.col("other").alias("node"), append)


def shortest_chain(adjacency: DataFrame | ProofGroups, nodes: DataFrame, start: str, goal: str) -> DataFrame:
    """One row (status, path, degree): the shortest chain, of equals the first by its ids in order.

    No row if either id is unknown to ``nodes`` (id); a node's chain to itself is that node alone; status
    is ``connected`` or ``disconnected`` (path and degree null).
    """
    spark = _spark(adjacency)
    known = nodes.filter(F.col("id").isin(start, goal)).select("id").distinct().count()
    if known < len({start, goal}):
        return spark.createDataFrame([], "status string, path array<string>, degree int")
    frontier = _one(spark, "node", start).withColumn("path", F.array("node"))
    before = frontier.limit(0)
    while True:
        hit = frontier.filter(F.col("node") == goal)
        if not hit.isEmpty():
            return hit.select(F.lit("connected").alias("status"), "path", (F.size("path") - 1).alias("degree"))
        # a path by way of a group's least path is least for all its members
        step = _least(adjacency, frontier)
        fresh = step.join(frontier.select("node").union(before.select("node")), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        before, frontier = frontier, materialise(fresh, "level")
        if frontier.isEmpty():
            return spark.createDataFrame([("disconnected", None, None)], "status string, path array<string>, degree int")


def layers(adjacency: DataFrame | ProofGroups, start: str, goal: str) -> tuple[DataFrame, int] | None:
    """The links that shortest chains use, (node, other, left) with ``left`` links to go from node; None if none."""
    spark = _spark(adjacency)
    back = distances(adjacency, _one(spark, "source", goal), goal=start).select("node", "distance")
    found = back.filter(F.col("node") == start).first()
    if found is None:
        return None
    if isinstance(adjacency, ProofGroups):
        # only what the chains from the start come to: its links one nearer to the goal, and theirs
        here, parts = _one(spark, "node", start), []
        for left in range(found["distance"], 0, -1):
            nearer = back.filter(F.col("distance") == left - 1).select(F.col("node").alias("other"))
            part = materialise(proof_groups.links_of(adjacency, here).join(nearer, "other", "left_semi").select("node", "other", F.lit(left).alias("left")), "dag")
            parts.append(part)
            here = part.select(F.col("other").alias("node")).distinct()
        return reduce(DataFrame.union, parts), found["distance"]
    left = back.withColumnRenamed("distance", "left")
    after = back.select(F.col("node").alias("other"), F.col("distance").alias("after"))
    dag = adjacency.join(left, "node").join(after, "other").filter("after = left - 1").filter(F.col("left") <= found["distance"])
    return materialise(dag.select("node", "other", "left"), "dag"), found["distance"]


def all_shortest_chains(adjacency: DataFrame | ProofGroups, start: str, goal: str) -> DataFrame:
    """(path, degree) of every shortest chain; no rows if there is none. For pages of many, see ``chain_page``."""
    spark = _spark(adjacency)
    paths = _one(spark, "node", start).withColumn("path", F.array("node"))
    if start != goal:
        found = layers(adjacency, start, goal)
        if found is None:
            return spark.createDataFrame([], "path array<string>, degree int")
        dag, degree = found
        for _ in range(degree):
            paths = paths.join(dag, "node").select(F.col("other").alias("node"), F.array_append("path", F.col("other")).alias("path"))
    return paths.select("path", (F.size("path") - 1).alias("degree"))


def _carry(limbs: list[Column]) -> Column:
    """Limb sums brought below 10^9, what is over handed up to two limbs more; without zeros at the end."""
    out, over = [], F.lit(0).cast("long")
    for x in [*limbs, F.lit(0).cast("long"), F.lit(0).cast("long")]:
        total = x + over
        out.append(total % LIMB)
        over = F.call_function("div", total, F.lit(LIMB).cast("long"))
    last = F.array_max(F.array(*[F.when(x != 0, i + 1).otherwise(1) for i, x in enumerate(out)]))
    return F.slice(F.array(*out), F.lit(1), last)


def chain_counts(dag: DataFrame, goal: str, degree: int) -> DataFrame:
    """(node, left, limbs): how many shortest chains go on from each node to the goal, exactly.

    A count is an array of base 10^9 limbs, least first, summed limb by limb and carried; arrays grow as counts do.
    """
    spark = dag.sparkSession
    done = spark.createDataFrame([(goal, 0, [1])], "node string, left int, limbs array<long>")
    level, out, width = done, done, 1
    for left in range(1, degree + 1):
        step = dag.filter(F.col("left") == left).join(level.select(F.col("node").alias("other"), "limbs"), "other")
        sums = step.groupBy("node").agg(*[F.sum(F.coalesce(F.get("limbs", F.lit(i)), F.lit(0))).alias(f"s{i}") for i in range(width)])
        limbs = _carry([F.col(f"s{i}") for i in range(width)])
        level = materialise(sums.select("node", F.lit(left).alias("left"), limbs.alias("limbs")), "counts")
        width = level.agg(F.max(F.size("limbs"))).first()[0] or 1
        out = out.union(level)
    return out


def count_of(limbs: list[int]) -> int:
    return sum(x * LIMB**i for i, x in enumerate(limbs))


def parse_cursor(cursor: str, most_digits: int) -> int:
    """The rank in a cursor ``v1:<digits>`` of at most ``most_digits``, the number of nodes."""
    if not re.fullmatch(r"v1:[0-9]+", cursor) or len(cursor) - 3 > most_digits:
        raise ValueError(f"not a cursor: {cursor[:200]}")
    rank = 0
    for at in range(3, len(cursor), _CHUNK):
        part = cursor[at : at + _CHUNK]
        rank = rank * 10 ** len(part) + int(part)
    return rank


def decimal(n: int) -> str:
    """A number in decimal digits, also where it has more of them than ``str`` writes at once."""
    parts = []
    while n >= 10**_CHUNK:
        n, low = divmod(n, 10**_CHUNK)
        parts.append(f"{low:0{_CHUNK}d}")
    return "".join([str(n), *reversed(parts)])


@dataclass(frozen=True)
class ChainPage:
    """``total`` stops at 2^64 - 1, ``total_exact`` is its exact decimal text; next_offset is null beyond 2^64 - 1."""

    chains: list[list[str]]
    total: int
    total_exact: str
    next_offset: int | None
    next_cursor: str | None


def chain_page(adjacency: DataFrame | ProofGroups, nodes: DataFrame, start: str, goal: str, limit: int, offset: int | None = None, cursor: str | None = None) -> ChainPage | None:
    """The chains of rank ``offset`` (or ``cursor``) on, in order of their ids; None for an unknown id."""
    if not 1 <= limit <= MOST_PAGE:
        raise ValueError(f"limit must be from 1 to {MOST_PAGE}")
    if offset is not None and cursor is not None:
        raise ValueError("offset and cursor exclude each other")
    rank = parse_cursor(cursor, max(1, nodes.count())) if cursor is not None else offset or 0
    if rank < 0:
        raise ValueError("offset must not be negative")
    if nodes.filter(F.col("id").isin(start, goal)).select("id").distinct().count() < len({start, goal}):
        return None
    if start == goal:
        chains = [[start]] if rank == 0 else []
        return ChainPage(chains, 1, "1", None, None)
    found = layers(adjacency, start, goal)
    if found is None:
        return ChainPage([], 0, "0", None, None)
    dag, degree = found
    counts = chain_counts(dag, goal, degree).select("node", "limbs")
    total = count_of(counts.filter(F.col("node") == start).first()["limbs"])
    # Partial chains with the range of ranks wanted below each: (path, first, upto).
    open_ = [([start], rank, min(total, rank + limit))] if rank < total else []
    weighed = dag.join(counts.withColumnRenamed("node", "other"), "other").select("node", "other", "limbs")
    for _ in range(degree):
        here = sorted({path[-1] for path, _, _ in open_})
        after: dict[str, list[tuple[str, int]]] = {}
        for r in weighed.filter(F.col("node").isin(here)).collect():
            after.setdefault(r["node"], []).append((r["other"], count_of(r["limbs"])))
        grown = []
        for path, first, upto in open_:
            at = 0
            for other, n in sorted(after[path[-1]]):
                lo, hi = max(first, at), min(upto, at + n)
                if lo < hi:
                    grown.append(([*path, other], lo - at, hi - at))
                at += n
        open_ = grown
    end = rank + len(open_)
    more = end < total
    return ChainPage([p for p, _, _ in open_], min(total, U64), decimal(total), end if more and end <= U64 else None, f"v1:{decimal(end)}" if more else None)


def chain_links(path: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(chain, step, a, b, evidence) for each link of each chain of ``path`` (chain, path)."""
    steps = path.select("chain", "path", F.posexplode(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).alias("step", "x"))
    steps = steps.withColumn("y", F.col("path")[F.col("step") + 1])
    return steps.select("chain", "step", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).join(edge_rows, ["a", "b"]).select(
        "chain", "step", "a", "b", "evidence"
    )
