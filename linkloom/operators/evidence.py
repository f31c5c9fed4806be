"""Three kinds of proof, and the relationship graph they make.

An edge joins two players a < b. Its evidence is dated (summed overlap days), by count (in a season of
N games, A + B - N of them were shared at least), or a witnessed game. Unknown is never zero: an
undated edge has no overlap days at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.intervals import overlap_pairs

EVIDENCE = (
    "struct<kind_rank:int,team:string,season:int,game_id:string,overlap_days:bigint,"
    "minimum_shared_games:int,a_games:int,b_games:int,team_games:int,date:date>"
)


DEALS = 16


def admissible_counts(counts: DataFrame, players: DataFrame) -> DataFrame:
    """Rows of known players with 0 < games <= team_games."""
    return counts.filter("games > 0 and games <= team_games").join(players.select(F.col("id").alias("player")), "player", "left_semi")


def agreed_counts(counts: DataFrame) -> DataFrame:
    """Distinct rows of team seasons whose rows agree on team_games."""
    rows = counts.distinct()
    agreed = rows.groupBy("team", "season").agg(F.min("team_games").alias("lo"), F.max("team_games").alias("hi")).filter("lo = hi").select("team", "season")
    return rows.join(agreed, ["team", "season"], "left_semi")


def count_pairs(counts: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(a, b, team, season, a_games, b_games, team_games, minimum_shared_games) where A + B > N.

    ``counts`` is (player, team, season, games, team_games, ...). Equal rows count once; a team's season
    whose rows disagree on team_games proves nothing. A pair needs A + B > N, so one of the two played
    more than half: only those are joined with the rest, and pairs of two such count once. A team's season is
    dealt over ``DEALS`` places, so a few seasons with many players don't make a few tasks. With ``targets`` (player),
    pairs have one of them at least.
    """
    rows = agreed_counts(counts)
    if targets is not None:
        wanted = targets.select("player").distinct()
        some = rows.join(wanted, "player", "left_semi")
        rows = rows.join(wanted.withColumn("wanted", F.lit(True)), "player", "left")
        once = F.col("y.wanted").isNull() | (F.col("x.player") < F.col("y.player"))
    else:
        some = rows.filter("2 * games > team_games")
        once = (2 * F.col("y.games") <= F.col("y.team_games")) | (F.col("x.player") < F.col("y.player"))
    tasks = 4 * counts.sparkSession.sparkContext.defaultParallelism
    dealt = ["team", "season", "deal"]
    most = some.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))).repartition(tasks, *dealt).alias("x")
    other = rows.withColumn("deal", F.pmod(F.hash("player"), F.lit(DEALS))).repartition(tasks, *dealt).alias("y")
    pairs = most.join(
        other,
        (F.col("x.team") == F.col("y.team")) & (F.col("x.season") == F.col("y.season")) & (F.col("x.deal") == F.col("y.deal")) & (F.col("x.player") != F.col("y.player"))
        & (F.col("x.games") + F.col("y.games") > F.col("x.team_games")) & once,
    )
    first = F.col("x.player") < F.col("y.player")
    pick = lambda name, a: F.when(first == F.lit(a), F.col(f"x.{name}")).otherwise(F.col(f"y.{name}"))
    return pairs.select(
        pick("player", True).alias("a"), pick("player", False).alias("b"), F.col("x.team").alias("team"), F.col("x.season").alias("season"),
        pick("games", True).alias("a_games"), pick("games", False).alias("b_games"), F.col("x.team_games").alias("team_games"),
        (F.col("x.games") + F.col("y.games") - F.col("x.team_games")).cast("int").alias("minimum_shared_games"),
    )


def witnessed_players(appearances: DataFrame) -> DataFrame:
    """(player, team, season) of whom ``coparticipations`` name, without their pairs: who took part in a game with someone else."""
    key = ["team", "season", "date", "game_id"]
    rows = appearances.select("player", *key).dropna().distinct()
    shared = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(shared, key, "left_semi").select("player", "team", "season").distinct()


def coparticipations(appearances: DataFrame, targets: DataFrame | None = None, carry: str | None = None) -> DataFrame:
    """(a, b, team, season, game_id, date): the earliest game in which two players of a team both took part.

    ``appearances`` is (player, team, season, game_id, date). With ``targets`` (player), pairs have one
    of them at least. Ties of date go to the smaller game_id. Each appearance carries the player's earlier
    games of that team and season, so two who meet in a game see by themselves whether they met before: no pairs
    are brought together. ``carry`` names a column of ``appearances`` that each end's row brings along, as a_<carry> and b_<carry>; pairs have a row for
    each two of its values there.
    """
    key = ["team", "season", "date", "game_id"]
    more = [carry] if carry else []
    rows = appearances.select("player", *key, *more).dropna(subset=["player", *key]).distinct()
    place = F.dense_rank().over(Window.partitionBy("team", "season").orderBy("date", "game_id"))
    games = rows.select(*key).distinct().withColumn("place", place)
    own = Window.partitionBy("player", "team", "season").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.join(games, key).withColumn("earlier", F.collect_list("place").over(own))
    if targets is None:
        some, before = rows, F.col("x.player") < F.col("y.player")
    else:
        wanted = targets.select("player").distinct()
        some = rows.join(wanted, "player", "left_semi")
        rows = rows.join(wanted.withColumn("wanted", F.lit(True)), "player", "left")
        before = (F.col("x.player") < F.col("y.player")) | ((F.col("x.player") > F.col("y.player")) & F.col("y.wanted").isNull())
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in key]
    met = some.alias("x").join(rows.alias("y"), same[0] & same[1] & same[2] & same[3] & before & ~F.arrays_overlap("x.earlier", "y.earlier"))
    first = F.col("x.player") < F.col("y.player")
    brought = [F.when(first, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(f"{end}_{c}") for c in more for end, p, q in (("a", "x", "y"), ("b", "y", "x"))]
    return met.select(F.least("x.player", "y.player").alias("a"), F.greatest("x.player", "y.player").alias("b"), *[F.col(f"x.{c}") for c in ("team", "season", "game_id", "date")], *brought)


def admissible_witnesses(witnesses: DataFrame, players: DataFrame) -> DataFrame:
    """Rows with a < b and both players known; others are dropped."""
    ids = players.select("id")
    rows = witnesses.filter("a < b")
    return rows.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def evidence_rows(tenures: DataFrame, counts: DataFrame, witnesses: DataFrame, players: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(a, b, kind_rank, team, season, game_id, overlap_days, minimum_shared_games, a_games, b_games, team_games, date).

    With ``targets`` (player), of pairs with one of them at least; the witnesses are given so.
    """
    none = lambda t: F.lit(None).cast(t)
    dated = overlap_pairs(tenures, targets=targets).select(
        "a", "b", F.lit(0).alias("kind_rank"), "team", none("int").alias("season"), none("string").alias("game_id"), F.col("days").alias("overlap_days"),
        none("int").alias("minimum_shared_games"), none("int").alias("a_games"), none("int").alias("b_games"), none("int").alias("team_games"), none("date").alias("date"),
    )
    counted = count_pairs(admissible_counts(counts, players), targets).select(
        "a", "b", F.lit(1).alias("kind_rank"), "team", "season", none("string").alias("game_id"), none("long").alias("overlap_days"),
        "minimum_shared_games", "a_games", "b_games", "team_games", none("date").alias("date"),
    )
    seen = admissible_witnesses(witnesses, players).select(
        "a", "b", F.lit(2).alias("kind_rank"), "team", "season", "game_id", none("long").alias("overlap_days"),
        F.lit(1).alias("minimum_shared_games"), none("int").alias("a_games"), none("int").alias("b_games"), none("int").alias("team_games"), "date",
    )
    return dated.unionByName(counted).unionByName(seen)


def edges(rows: DataFrame) -> DataFrame:
    """(a, b, evidence): one row per pair, its evidence dated first, then by count, then witnessed."""
    entry = F.struct("kind_rank", "team", "season", "game_id", "overlap_days", "minimum_shared_games", "a_games", "b_games", "team_games", "date")
    return rows.groupBy("a", "b").agg(F.sort_array(F.collect_list(entry)).alias("evidence"))


def edge_overlap_days(rows: DataFrame) -> DataFrame:
    """(a, b, overlap_days): the sum of known days, null as soon as one team of the edge has no dated evidence."""
    by_team = rows.groupBy("a", "b", "team").agg(F.sum("overlap_days").alias("days"))
    return by_team.groupBy("a", "b").agg(F.when(F.count("days") == F.count("*"), F.sum("days")).alias("overlap_days"))


def strongest_evidence(evidence: Column) -> Column:
    """The entry with most overlap days, unknown below any; among equals the last in order."""
    ranked = F.transform(
        evidence, lambda e, i: F.struct(F.coalesce(e["overlap_days"], F.lit(-1).cast("long")).alias("days"), i.alias("at"), e.alias("entry"))
    )
    best = F.aggregate(ranked, ranked[0], lambda x, y: F.when((y["days"] > x["days"]) | ((y["days"] == x["days"]) & (y["at"] > x["at"])), y).otherwise(x))
    return best["entry"]


def describe(overlap: Column, games: Column) -> Column:
    return (
        F.when(overlap.isNotNull(), F.concat(overlap.cast("string"), F.lit(" overlapping days")))
        .when(games.isNotNull(), F.concat(F.lit("at least "), games.cast("string"), F.lit(" shared games")))
        .otherwise("overlap unknown")
    )


def adjacency(edge_rows: DataFrame) -> DataFrame:
    """(node, other) in both directions, each once."""
    return edge_rows.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edge_rows.select("b", "a")).distinct()


def degrees(edge_rows: DataFrame, players: DataFrame) -> DataFrame:
    """(id, degree) for every player, isolated ones included."""
    links = adjacency(edge_rows).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))
    return players.select("id").join(links, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def proof_audit(edge_rows: DataFrame, proofs: list[DataFrame]) -> DataFrame:
    """(side, a, b): pairs that only the admitted edges have, or only the union of the proofs. Empty if sound."""
    proven = proofs[0].select("a", "b")
    for more in proofs[1:]:
        proven = proven.union(more.select("a", "b"))
    proven, admitted = proven.distinct(), edge_rows.select("a", "b").distinct()
    side = lambda df, name: df.select(F.lit(name).alias("side"), "a", "b")
    return side(admitted.exceptAll(proven), "admitted_only").union(side(proven.exceptAll(admitted), "proven_only"))


def coverage_counters(rows: DataFrame, players: DataFrame) -> DataFrame:
    """One row: edges, edges proven by counts, edges with a witness, isolated players."""
    per_edge = rows.groupBy("a", "b").agg(F.max((F.col("kind_rank") == 1).cast("int")).alias("counted"), F.max((F.col("kind_rank") == 2).cast("int")).alias("seen"))
    totals = per_edge.agg(
        F.count("*").alias("edges"), F.coalesce(F.sum("counted"), F.lit(0)).alias("count_proven"), F.coalesce(F.sum("seen"), F.lit(0)).alias("witnessed")
    )
    linked = per_edge.select(F.col("a").alias("id")).union(per_edge.select("b"))
    alone = players.select("id").join(linked, "id", "left_anti").agg(F.count("*").alias("isolated_players"))
    return totals.withColumn("k", F.lit(1)).join(alone.withColumn("k", F.lit(1)), "k").drop("k")
