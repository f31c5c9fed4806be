"""What is said of players and links: facts for a drawing, the whole network, listings, connections and scoped operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators import backbone, evidence, neighbourhood, paths
from linkloom.operators.proof_groups import ProofGroups

#: How a career is told, and how sure an answer is.
SEASONS, FIXTURE_DAYS, NO_TENURE = "%d–%d seasons", "Synthetic fixture days %d–%d", "Synthetic fixture; no roster tenure"
INSPECT = " · inspect evidence for dates"
CONNECTED, DISCONNECTED, NOT_FOUND = "connected", "disconnected", "player-not-found"
UNRESOLVED, VERIFIED, FILTERED, VERIFIED_FIXTURE = "unresolved_coverage", "verified_disconnected", "filtered_view", "verified_fixture"
WHOLE = "full_graph"


def node_facts(players: DataFrame, context: DataFrame | None, tenures: DataFrame, degree_rows: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """(id, name, era, teams, distance, debut_season, degree) for each player (id, name).

    ``context`` (id, name, first_season, last_season, teams) of the reports comes first; a player it lacks is told from tenures (player,
    team, start_day, end_day), and has no debut. ``distances`` (id, distance) may be missing, for a player or at all.
    """
    own = tenures.groupBy(F.col("player").alias("id")).agg(
        F.min("start_day").alias("start"), F.max("end_day").alias("end"), F.array_sort(F.collect_set("team")).alias("own_teams")
    )
    rows = players.select("id", "name").join(own, "id", "left").join(degree_rows.select("id", "degree"), "id", "left")
    empty = F.array().cast("array<string>")
    fixture = F.when(F.col("start").isNotNull(), F.format_string(FIXTURE_DAYS, "start", "end")).otherwise(NO_TENURE)
    if context is None:
        told = rows.select("id", "name", fixture.alias("era"), F.coalesce("own_teams", empty).alias("teams"), F.lit(None).cast("int").alias("debut_season"), "degree")
    else:
        known = context.select("id", F.col("name").alias("known_name"), "first_season", "last_season", F.col("teams").alias("known_teams"), F.lit(True).alias("known"))
        pick = lambda a, b: F.when(F.col("known"), a).otherwise(b)
        told = rows.join(known, "id", "left").select(
            "id", pick(F.col("known_name"), F.col("name")).alias("name"), pick(F.format_string(SEASONS, "first_season", "last_season"), fixture).alias("era"),
            pick(F.col("known_teams"), F.coalesce("own_teams", empty)).alias("teams"), pick(F.col("first_season"), F.lit(None)).cast("int").alias("debut_season"), "degree",
        )
    told = told.withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return told.withColumn("distance", F.lit(None).cast("int")) if distances is None else told.join(distances.select("id", "distance"), "id", "left")


def link_facts(rows: DataFrame) -> DataFrame:
    """(a, b, team, overlap_days, minimum_shared_games, franchises, weight, primary_franchise, in_backbone) of each edge.

    ``rows`` are evidence rows, written before: they are read for the strongest proof, the weight and the backbone. Team, days and games are
    the strongest proof's.
    """
    best = evidence.strongest_evidence(F.col("evidence"))
    told = evidence.edges(rows).select(
        "a", "b", best["team"].alias("team"), best["overlap_days"].alias("overlap_days"), best["minimum_shared_games"].alias("minimum_shared_games"),
        F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["team"]))).alias("franchises"),
    )
    weighted = backbone.edge_weights(rows)
    marked = backbone.backbone(weighted).withColumn("kept", F.lit(True))
    joined = told.join(weighted.select("a", "b", "weight", F.col("primary_team").alias("primary_franchise")), ["a", "b"]).join(marked, ["a", "b"], "left")
    return joined.withColumn("in_backbone", F.coalesce("kept", F.lit(False))).drop("kept")


def on_path(a: Column, b: Column, path: list[str]) -> Column:
    """Whether a link joins two neighbours of ``path``, in either direction."""
    steps = [F.struct(F.lit(min(p)).alias("a"), F.lit(max(p)).alias("b")) for p in zip(path, path[1:])]
    return F.array_contains(F.array(*steps), F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))) if steps else F.lit(False)


def graph_summary(edge_rows: DataFrame, players: DataFrame, offset: int = 0, limit: int = 1000) -> DataFrame:
    """One row (players, total_edges, offset, limit, next_offset, complete) of a page of edges."""
    return summary_of(edge_rows.agg(F.count("*").alias("total")), players, offset, limit)


def summary_of(size: DataFrame, players: DataFrame, offset: int, limit: int) -> DataFrame:
    """``graph_summary`` of edges that were counted, ``size`` (total)."""
    page = neighbourhood.page_facts(size, offset, limit).select(F.lit(1).alias("k"), F.col("total").alias("total_edges"), "next_offset")
    size = players.agg(F.count_distinct("id").alias("players")).select(F.lit(1).alias("k"), "players")
    return size.join(page, "k").select("players", "total_edges", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), "next_offset")


def player_listing(players: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(id, name, aliases, teams, first_season, last_season) of all players: the reports' where there are reports, else without aliases and teams."""
    if context is not None:
        return context.select("id", "name", "aliases", "teams", "first_season", "last_season")
    none = F.array().cast("array<string>")
    return players.select("id", "name", none.alias("aliases"), none.alias("teams"), F.lit(None).cast("int").alias("first_season"), F.lit(None).cast("int").alias("last_season"))


def connection(links: DataFrame | ProofGroups, nodes: DataFrame, rows: DataFrame | Callable[[list[str]], DataFrame], start: str, goal: str, reports: bool) -> DataFrame:
    """A row for each link of the shortest chain, or one row that tells why there is none.

    (result, place, from, to, team, overlap_days, minimum_shared_games, context, degree, certainty, missing). ``links`` is the adjacency,
    ``nodes`` (id), ``rows`` the evidence, or what gives that of the players of a path. The context of a link is the description of its strongest proof, with a hint where that has days.
    Disconnected players are so for certain only without reports; an unknown player is named, the first if both are.
    """
    spark = nodes.sparkSession
    have = {r["id"] for r in nodes.filter(F.col("id").isin(start, goal)).select("id").distinct().collect()}
    columns = "result string, place int, `from` string, `to` string, team string, overlap_days long, minimum_shared_games int, context string, degree int, certainty string, missing string"
    alone = lambda result, degree, certainty, missing: spark.createDataFrame([(result, *[None] * 7, degree, certainty, missing)], columns)
    if not {start, goal} <= have:
        return alone(NOT_FOUND, None, None, start if start not in have else goal)
    found = paths.shortest_chain(links, nodes, start, goal).first()
    if found["status"] == DISCONNECTED:
        return alone(DISCONNECTED, None, UNRESOLVED if reports else VERIFIED, None)
    path = found["path"]
    if len(path) == 1:
        return alone(CONNECTED, 0, None, None)
    steps = spark.createDataFrame([(k, x, y, min(x, y), max(x, y)) for k, (x, y) in enumerate(zip(path, path[1:]))], "place int, `from` string, `to` string, a string, b string")
    best = evidence.strongest_evidence(F.col("evidence"))
    known = rows(path) if callable(rows) else rows
    told = evidence.edges(known.join(F.broadcast(steps.select("a", "b")), ["a", "b"], "left_semi")).withColumn("best", best)
    text = evidence.describe(F.col("best.overlap_days"), F.col("best.minimum_shared_games"))
    return steps.join(told, ["a", "b"], "left").select(
        F.lit(CONNECTED).alias("result"), "place", "from", "to", "best.team", "best.overlap_days", "best.minimum_shared_games",
        F.concat(text, F.when(F.col("best.overlap_days").isNotNull(), INSPECT).otherwise("")).alias("context"),
        F.lit(len(path) - 1).alias("degree"), F.lit(None).cast("string").alias("certainty"), F.lit(None).cast("string").alias("missing"),
    )


def certainty(filtered: bool, reports: bool) -> tuple[str, str]:
    """(certainty, scope) of what an operation answers."""
    return (FILTERED if filtered else UNRESOLVED if reports else VERIFIED_FIXTURE), (FILTERED if filtered else WHOLE)


def connect(
    rows: DataFrame | ProofGroups, nodes: DataFrame, start: str, goal: str, reports: bool, view_rows: DataFrame | ProofGroups | None = None,
) -> DataFrame:
    """One row (result, path, degree, certainty, scope, unfiltered_degree) of the shortest chain, in the view where there is one.

    ``rows`` and ``view_rows`` are evidence (a, b, ...) or the groups that prove it. The unfiltered degree is told for views alone; unknown players give no row.
    """
    def chain(own: DataFrame | ProofGroups, name: str) -> DataFrame:
        links = own if isinstance(own, ProofGroups) else evidence.adjacency(own.select("a", "b").distinct())
        found = paths.shortest_chain(links, nodes, start, goal)
        return found.select(F.lit(1).alias("k"), F.col("status").alias("result"), "path", F.col("degree").alias(name))

    sure, scope = certainty(view_rows is not None, reports)
    found = chain(rows if view_rows is None else view_rows, "degree")
    whole = chain(rows, "unfiltered_degree").select("k", "unfiltered_degree") if view_rows is not None else found.select("k", F.lit(None).cast("int").alias("unfiltered_degree"))
    return found.join(whole, "k").select("result", "path", "degree", F.lit(sure).alias("certainty"), F.lit(scope).alias("scope"), "unfiltered_degree")


def neighbours(rows: DataFrame, catalog: DataFrame, player: str, reports: bool, filtered: bool = False) -> DataFrame:
    """(id, name, teams, proofs, certainty, scope): everyone linked to a player, from the catalog (id, name, teams), with the proofs of the link.

    ``proofs`` is an array of (team, overlap_days, minimum_shared_games) in the order of evidence. Of those the catalog lacks nothing is told.
    """
    sure, scope = certainty(filtered, reports)
    own = evidence.edges(rows.filter((F.col("a") == player) | (F.col("b") == player)))
    other = F.when(F.col("a") == player, F.col("b")).otherwise(F.col("a"))
    proofs = F.transform("evidence", lambda e: F.struct(e["team"].alias("team"), e["overlap_days"].alias("overlap_days"), e["minimum_shared_games"].alias("minimum_shared_games")))
    return own.select(other.alias("id"), proofs.alias("proofs")).join(catalog.select("id", "name", "teams"), "id").select("id", "name", "teams", "proofs", F.lit(sure).alias("certainty"), F.lit(scope).alias("scope"))


def direct_teammates(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (direct_teammates)."""
    return rows.filter((F.col("a") == min(x, y)) & (F.col("b") == max(x, y))).agg((F.count("*") > 0).alias("direct_teammates"))
