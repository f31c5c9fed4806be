"""What lies around a player: neighbourhoods, next steps, filtered views and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.paths import distances
from linkloom.operators.proof_groups import ProofGroups, first_links, links_among, links_of
from linkloom.scratch import materialise

MOST_LINKS = 600
ERAS = (1940, 1950, 1960, 1970, 1980, 1990, 2000, 2010)


def edge_page(edge_rows: DataFrame | ProofGroups, offset: int = 0, limit: int = 1000) -> DataFrame:
    """A page of edges in (a, b) order; limit from 1 to 5000. Of groups only the links of the first players up to the page are made."""
    if offset < 0 or not 1 <= limit <= 5000:
        raise ValueError("offset must not be negative, limit must be from 1 to 5000")
    if isinstance(edge_rows, ProofGroups):
        edge_rows = first_links(edge_rows, offset + limit)
    return edge_rows.orderBy("a", "b").offset(offset).limit(limit)


def edges_of(edge_rows: DataFrame, player: str) -> DataFrame:
    return edge_rows.filter((F.col("a") == player) | (F.col("b") == player)).orderBy("a", "b")


def edge_between(edge_rows: DataFrame, x: str, y: str) -> DataFrame:
    return edge_rows.filter((F.col("a") == min(x, y)) & (F.col("b") == max(x, y)))


def edge_page_facts(edge_rows: DataFrame, offset: int = 0, limit: int = 1000) -> DataFrame:
    """One row (total, next_offset) for ``edge_page``; next_offset is null on the last page."""
    return page_facts(edge_rows.agg(F.count("*").alias("total")), offset, limit)


def page_facts(size: DataFrame, offset: int, limit: int) -> DataFrame:
    """``edge_page_facts`` of edges that were counted, ``size`` (total)."""
    end = F.lit(offset + limit).cast("long")
    return size.select("total", F.when(F.col("total") > end, end).alias("next_offset"))


def neighbourhood(
    links: DataFrame | ProofGroups, edge_rows: DataFrame | None, player: str, depth: int = 1, limit: int = 60, path: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, distance) of the nearest nodes, (a, b, on_path) of the links among them, and one row (truncated).

    ``depth`` 1 or 2, ``limit`` 1 to 200 nodes by distance and id; the player and those of ``path`` are there in any case,
    without a distance if they are further off. Of the links the first 600 by (a, b) and those along ``path`` are
    given. ``truncated`` says whether a node within reach or a link is missing. With ``links`` as groups ``edge_rows`` isn't needed.
    """
    if depth not in (1, 2) or not 1 <= limit <= 200:
        raise ValueError("depth must be 1 or 2, limit from 1 to 200")
    spark = _spark(links)
    near = distances(links, spark.createDataFrame([(player,)], "source string"), max_depth=depth).select(F.col("node").alias("id"), "distance")
    named = spark.createDataFrame([(p,) for p in sorted({player, *(path or [])})], "id string")
    ids = materialise(near.orderBy("distance", "id").limit(limit).select("id").union(named).distinct(), "near")
    on_path = F.lit(False)
    for a, b in {tuple(sorted(p)) for p in zip(path or [], (path or [])[1:])}:
        on_path = on_path | ((F.col("a") == a) & (F.col("b") == b))
    if isinstance(links, ProofGroups):
        inside = links_among(links, ids.withColumnRenamed("id", "node"))
    else:
        inside = edge_rows.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    marked = materialise(inside.select("a", "b", on_path.alias("on_path")), "inside")
    shown = marked.orderBy("a", "b").limit(MOST_LINKS).union(marked.filter("on_path")).distinct()
    lost = near.join(ids, "id", "left_anti").select(F.lit(1).alias("x")).union(marked.join(shown, ["a", "b"], "left_anti").select(F.lit(1)))
    return ids.join(near, "id", "left"), shown, lost.agg((F.count("*") > 0).alias("truncated"))


def _spark(links: DataFrame | ProofGroups):
    return (links.asks if isinstance(links, ProofGroups) else links).sparkSession


def links_from(links: DataFrame | ProofGroups, *nodes: str) -> DataFrame:
    """(node, other): the links of some players."""
    if isinstance(links, ProofGroups):
        return links_of(links, _spark(links).createDataFrame([(n,) for n in nodes], "node string"))
    return links.filter(F.col("node").isin(*nodes))


def next_steps(links: DataFrame | ProofGroups, path: list[str], target: str | None = None) -> DataFrame:
    """(node) that can extend ``path`` and keep it a shortest chain from its first node, without shortcuts.

    A candidate is one link from the end, as far from the first node as the path is long, not on the
    path, and not linked to an earlier node of it; with a target it lies on a shortest chain to it.
    """
    spark = _spark(links)
    one = lambda x: spark.createDataFrame([(x,)], "source string")
    root = distances(links, one(path[0]), max_depth=len(path)).select("node", F.col("distance").alias("from_root"))
    found = links_from(links, path[-1]).select(F.col("other").alias("node")).join(root, "node").filter(F.col("from_root") == len(path))
    found = found.filter(~F.col("node").isin(path))
    if path[:-1]:
        found = found.join(links_from(links, *path[:-1]).select(F.col("other").alias("node")), "node", "left_anti")
    if target is not None:
        # whoever is on the way is nearer to the target than the path's first node
        to = distances(links, one(target), goal=path[0]).select("node", F.col("distance").alias("to_target"))
        whole = to.filter(F.col("node") == path[0]).select(F.col("to_target").alias("whole"))
        found = found.join(to, "node").join(whole, F.col("to_target") + len(path) == F.col("whole"), "left_semi")
    return found.select("node").distinct()


def focus_hops(links: DataFrame | ProofGroups, focus: str, hops: int = 2) -> DataFrame:
    """(node, distance) up to ``hops`` links from ``focus``."""
    spark = _spark(links)
    return distances(links, spark.createDataFrame([(focus,)], "source string"), max_depth=hops).select("node", "distance")


def view(
    tenures: DataFrame, counts: DataFrame, witnesses: DataFrame, records: DataFrame,
    team: str | None = None, first_season: int | None = None, last_season: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The facts of one team and range of seasons, from which the graph is built anew.

    A tenure has no season of its own: it stays if a record (player, team, season, start_day, end_day)
    with the same player, team and days has one in the range.
    """
    inside = F.lit(True)
    if first_season is not None:
        inside = inside & (F.col("season") >= first_season)
    if last_season is not None:
        inside = inside & (F.col("season") <= last_season)
    of_team = (F.col("team") == team) if team is not None else F.lit(True)
    kept = tenures.filter(of_team)
    if first_season is not None or last_season is not None:
        kept = kept.join(records.filter(inside), ["player", "team", "start_day", "end_day"], "left_semi")
    return kept, counts.filter(of_team & inside), witnesses.filter(of_team & inside)


def scoped_players(tenures: DataFrame, records: DataFrame, counts: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(id, teams, first_season, last_season) as a view's facts have them; ``witnesses`` are pairs (a, b, team, season) or whom they name (player, team, season)."""
    kept = records.join(tenures, ["player", "team", "start_day", "end_day"], "left_semi").select("player", "team", "season")
    rows = kept.union(counts.select("player", "team", "season"))
    if "player" in witnesses.columns:
        rows = rows.union(witnesses.select("player", "team", "season"))
    else:
        rows = rows.union(witnesses.select(F.col("a").alias("player"), "team", "season")).union(witnesses.select("b", "team", "season"))
    return rows.groupBy(F.col("player").alias("id")).agg(
        F.sort_array(F.collect_set("team")).alias("teams"), F.min("season").alias("first_season"), F.max("season").alias("last_season")
    )


def emphasised(nodes: DataFrame, eras: set[int], franchise: str | None = None, selected: str | None = None) -> DataFrame:
    """``nodes`` (id, debut, teams) with ``emphasised``: in an enabled era, and of the franchise or selected.

    Eras are 1940 to 2010, the last open-ended; an unknown debut counts only when all are enabled.
    """
    decade = F.when(F.col("debut").isNotNull(), F.least(F.floor((F.col("debut") - 1940) / 10), F.lit(7)) * 10 + 1940)
    in_era = F.coalesce(decade.isin(*sorted(eras)) if eras else F.lit(False), F.lit(set(ERAS) <= eras))
    of = F.lit(True) if franchise is None else F.array_contains("teams", franchise) | F.coalesce(F.col("id") == F.lit(selected), F.lit(False))
    return nodes.withColumn("emphasised", in_era & of)


def visible(
    nodes: DataFrame, hops: DataFrame, ego: bool = False, edge: tuple[str, str] | None = None, path: list[str] | None = None,
    walk: list[str] | None = None, walk_next: DataFrame | None = None,
) -> DataFrame:
    """``nodes`` (id) with ``visible``: what a walk, then the whole network, then an edge, a path or a player's direct links leave in view.

    On a walk its players and next steps (node) are; else all without ``ego``; else the ends of the chosen edge; else the path's; else
    those at most one link off by ``hops`` (node, distance).
    """
    if walk:
        ahead = nodes.sparkSession.createDataFrame([], "node string") if walk_next is None else walk_next.select("node")
        shown = ahead.distinct().withColumn("ahead", F.lit(True))
        joined = nodes.join(shown, nodes["id"] == shown["node"], "left")
        return joined.withColumn("visible", F.col("id").isin(walk) | F.coalesce("ahead", F.lit(False))).drop("node", "ahead")
    if not ego:
        return nodes.withColumn("visible", F.lit(True))
    if edge is not None or path:
        return nodes.withColumn("visible", F.col("id").isin(list(edge if edge is not None else path)))
    near = hops.filter("distance <= 1").select(F.col("node").alias("near")).distinct()
    joined = nodes.join(near, nodes["id"] == near["near"], "left")
    return joined.withColumn("visible", F.col("near").isNotNull()).drop("near")


def filter_status(nodes: DataFrame, eras: set[int], franchise: str | None = None) -> DataFrame:
    """One row (loaded, matching, visible, eras, franchise) of nodes with ``emphasised`` and ``visible``; the eras in words."""
    named = ", ".join(f"{e}s{'+' if e == ERAS[-1] else ''}" for e in ERAS if e in eras)
    said = "All eras emphasized" if set(ERAS) <= eras else f"Debut eras: {named}" if named else "No eras emphasized"
    counts = nodes.agg(F.count("*").alias("loaded"), F.count_if("emphasised").alias("matching"), F.count_if("visible").alias("visible"))
    return counts.select("*", F.lit(said).alias("eras"), F.lit(franchise or "all").alias("franchise"))


def walk_to(links: DataFrame, walk: list[str], node: str, target: str | None = None) -> list[str]:
    """The walk that choosing ``node`` makes of ``walk``: rewound to it where it is on the walk, one longer where it is a next step, else unchanged."""
    if node in walk:
        return walk[: walk.index(node) + 1]
    return [*walk, node] if not next_steps(links, walk, target).filter(F.col("node") == node).isEmpty() else walk


def compare(nodes: DataFrame, degree_rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: both players' degrees and the teams they share, in the order of the first's."""
    rows = nodes.filter(F.col("id").isin(x, y)).join(degree_rows, "id")
    side = lambda p, n: rows.filter(F.col("id") == p).select(F.col("id").alias(n), F.col("teams").alias(f"{n}_teams"), F.col("degree").alias(f"{n}_degree"), F.lit(1).alias("k"))
    both = side(x, "first").join(side(y, "second"), "k")
    return both.select("first", "second", "first_degree", "second_degree", F.array_intersect("first_teams", "second_teams").alias("shared_teams"))


def ring_places(links: DataFrame, weighted: DataFrame, debut: DataFrame, focus: str) -> DataFrame:
    """(id, place, of): direct neighbours of ``focus`` by falling weight, then debut (unknown first), then id."""
    own = weighted.filter((F.col("a") == focus) | (F.col("b") == focus)).select(F.when(F.col("a") == focus, F.col("b")).otherwise(F.col("a")).alias("id"), "weight")
    order = Window.orderBy(F.desc("weight"), F.asc_nulls_first("debut"), "id")
    return own.join(debut, "id", "left").select("id", F.row_number().over(order).alias("place"), F.count("*").over(Window.partitionBy()).alias("of"))
