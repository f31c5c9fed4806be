"""Edge weights, and the sparse backbone of a graph: its maximum spanning forest and each node's best links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.components import connected_components
from linkloom.scratch import materialise

DAYS_SCALE = 1825
GAMES_SCALE = 246
LEAST_WEIGHT = 0.1
WITNESS_WEIGHT = 0.15
TOP_LINKS = 3
LANDMARK_PERCENT = 3


def measure(count: Column, scale: int) -> Column:
    """0.1 for nothing, rising with the logarithm of the count to 1 at ``scale``."""
    grown = F.lit(0.15) + F.lit(0.85) * F.log1p(count.cast("double")) / F.log1p(F.lit(float(scale)))
    return F.when(count == 0, F.lit(LEAST_WEIGHT)).otherwise(F.least(F.greatest(grown, F.lit(LEAST_WEIGHT)), F.lit(1.0)))


def _weight(days: Column, games: Column, seen: Column) -> Column:
    return F.greatest(measure(days, DAYS_SCALE), measure(games, GAMES_SCALE), F.when(seen, WITNESS_WEIGHT).otherwise(LEAST_WEIGHT))


def edge_weights(rows: DataFrame) -> DataFrame:
    """(a, b, weight, primary_team, days, games) from evidence rows.

    The weight comes from the totals of all teams; the primary team has the greatest weight of its own,
    of equals the first by name.
    """
    by_team = rows.groupBy("a", "b", "team").agg(
        F.coalesce(F.sum("overlap_days"), F.lit(0)).alias("days"),
        F.coalesce(F.sum(F.when(F.col("kind_rank") == 1, F.col("minimum_shared_games"))), F.lit(0)).alias("games"),
        F.max(F.col("kind_rank") == 2).alias("seen"),
    )
    own = by_team.withColumn("own", _weight(F.col("days"), F.col("games"), F.col("seen")))
    total = own.groupBy("a", "b").agg(
        F.sum("days").alias("days"), F.sum("games").alias("games"), F.max("seen").alias("seen"), F.min(F.struct((-F.col("own")).alias("own"), "team")).alias("best")
    )
    return total.select("a", "b", _weight(F.col("days"), F.col("games"), F.col("seen")).alias("weight"), F.col("best.team").alias("primary_team"), "days", "games")


def weights_of(totals: DataFrame) -> DataFrame:
    """``edge_weights`` of edges whose evidence is summed up, (a, b, days, games, seen, primary_team)."""
    return totals.select("a", "b", _weight(F.col("days"), F.col("games"), F.col("seen")).alias("weight"), "primary_team", "days", "games")


def primary_franchise(own: Column, teams: Column, team: Column) -> Column:
    """An edge's primary franchise where it has one, else the least of its franchises, else its team."""
    return F.coalesce(F.nullif(own, F.lit("")), F.array_min(teams), team)


def spanning_forest(weighted: DataFrame) -> DataFrame:
    """(a, b) of the maximum spanning forest of (a, b, weight).

    Edges are ordered by falling weight, then a, then b: a strict order, so there is one forest. In each
    round every component takes its first edge to another component; rounds at least halve the
    components that can still grow.
    """
    edges = materialise(weighted.select("a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb")), "forest")
    chosen: DataFrame | None = None
    while True:
        crossing = edges.filter("ca <> cb")
        if crossing.isEmpty():
            break
        entry = F.struct((-F.col("weight")).alias("w"), "a", "b", "ca", "cb").alias("e")
        sides = crossing.select(F.col("ca").alias("c"), entry).union(crossing.select(F.col("cb").alias("c"), entry))
        taken = materialise(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.ca", "e.cb").distinct(), "taken")
        chosen = taken.select("a", "b") if chosen is None else chosen.union(taken.select("a", "b"))
        merged = connected_components(taken, "ca", "cb")
        name = lambda c: merged.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}"))
        after = crossing.join(name("ca"), "ca", "left").join(name("cb"), "cb", "left")
        edges = materialise(after.select("a", "b", "weight", F.coalesce("new_ca", "ca").alias("ca"), F.coalesce("new_cb", "cb").alias("cb")), "forest")
    return chosen.distinct() if chosen is not None else edges.select("a", "b").limit(0)


def top_links(weighted: DataFrame, top: int = TOP_LINKS) -> DataFrame:
    """(a, b) of each node's ``top`` heaviest links, of equals the first by a, then b."""
    both = weighted.select("a", "b", "weight", F.col("a").alias("node")).union(weighted.select("a", "b", "weight", F.col("b").alias("node")))
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "a", "b")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("a", "b").distinct()


def backbone(weighted: DataFrame, top: int = TOP_LINKS) -> DataFrame:
    return spanning_forest(weighted).union(top_links(weighted, top)).distinct()


def landmarks(nodes: DataFrame, percent: int = LANDMARK_PERCENT) -> DataFrame:
    """(id, decade, place) of the best-linked ``percent`` of each debut decade, one at least; (id, debut, degree) in."""
    decade = nodes.filter("debut is not null").withColumn("decade", (F.floor(F.col("debut") / 10) * 10).cast("int"))
    by = Window.partitionBy("decade")
    ranked = decade.withColumn("place", F.row_number().over(by.orderBy(F.desc("degree"), "id"))).withColumn("n", F.count("*").over(by))
    return ranked.filter(F.col("place") <= F.ceil(F.col("n") * percent / 100)).select("id", "decade", "place")
