"""Several sources of the same facts: franchises as of a year, differences of memberships, what snapshots keep."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Summary rows of a season, not teams.
SUMMARY_TEAM = r"^\dTM$|^TOT$"
#: The seasons the other source covers by player, and why it lacks a membership.
FIRST_SEASON, LAST_SEASON = 1997, 2023
SHAPES = (
    "S1-no-per-player-evidence-pre-1997", "S1-pbp-no-event-for-player", "S1-pbp-shows-team-rowset-artifact",
    "S1-pbp-shows-other-teams-same-season", "S1-ends-2022-23",
)


def as_of(facts: DataFrame, eras: DataFrame) -> DataFrame:
    """``facts`` (fact, league, season, name) with the one franchise whose era has the name or abbreviation then.

    ``eras`` is (franchise, league, name, abbreviation, first_season, last_season), last open if null. No
    franchise is ``unresolved``, several are ``ambiguous``.
    """
    e = eras.select("franchise", "league", F.explode(F.array_distinct(F.array("name", "abbreviation"))).alias("name"), "first_season", "last_season").distinct()
    asked = facts.select("league", "season", "name").distinct()
    # a name's eras are few, so facts meet them by league and name, each season of a name once
    hit = asked.join(e, ["league", "name"]).filter("season >= first_season and season <= coalesce(last_season, season)")
    answers = hit.groupBy("league", "season", "name").agg(F.count_distinct("franchise").alias("n"), F.min("franchise").alias("one"))
    found = facts.select("fact", "league", "season", "name").join(answers, ["league", "season", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    franchise = F.when(F.col("n") == 1, F.col("one")).when(F.col("n") == 0, "unresolved").otherwise("ambiguous")
    return found.select("fact", "league", "season", "name", franchise.alias("franchise"))


def without_summaries(rows: DataFrame, team: str = "team") -> DataFrame:
    return rows.filter(~F.coalesce(F.col(team).rlike(SUMMARY_TEAM), F.lit(False)))


def membership_difference(left: DataFrame, right: DataFrame, key: list[str], cut: int | None = None, parts: int | None = None) -> DataFrame:
    """(side, key...): what only one of two membership sets has; seasons after ``cut`` are told apart.

    A membership with a null in its key is like no other. Both sets meet in one grouping; ``parts`` says into how many parts it is dealt.
    """
    name = lambda side: F.lit(side) if cut is None else F.when(F.col("season") > cut, f"{side}-after-{cut}").otherwise(side)
    both = left.select(*key, F.lit(1).alias("mark")).union(right.select(*key, F.lit(2).alias("mark")))
    both = both if parts is None else both.repartition(parts, *key)
    alone = reduce(or_, [F.col(k).isNull() for k in key])
    marks = both.groupBy(*key).agg(F.bit_or("mark").alias("marks")).filter((F.col("marks") < 3) | alone)
    told = marks.select(*key, F.explode(F.when(F.col("marks") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array("marks"))).alias("mark"))
    return told.select(F.when(F.col("mark") == 1, name("left-only")).otherwise(name("right-only")).alias("side"), *key)


def difference_shape(diff: DataFrame, seen: DataFrame) -> DataFrame:
    """``diff`` (player, team, season) with why the other source lacks the membership, from ``seen`` (player, season, team), all it shows.

    Before its first season it names no players; after its last it shows nothing; between, it has nothing of the player that
    season, or this very team (so that only the row sets differ), or other teams alone.
    """
    shown = seen.groupBy("player", "season").agg(F.collect_set("team").alias("shown"))
    shape = (
        F.when(F.col("season") > LAST_SEASON, SHAPES[4]).when(F.col("season") < FIRST_SEASON, SHAPES[0]).when(F.col("shown").isNull(), SHAPES[1])
        .when(F.array_contains("shown", F.col("team")), SHAPES[2]).otherwise(SHAPES[3])
    )
    return diff.join(shown, ["player", "season"], "left").withColumn("shape", shape).drop("shown")


def headline_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (both, left_only, right_only, either) of two id sets."""
    x, y = a.select("id").distinct().withColumn("l", F.lit(1)), b.select("id").distinct().withColumn("r", F.lit(1))
    joined = x.join(y, "id", "full")
    return joined.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"),
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count("*").alias("either"),
    )


def appearance_export(memberships: DataFrame, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Count rows with exactly one record on either side, and the rest with the reason.

    ``memberships`` is (player, team, season, games, record), ``games`` (team, season, team_games, record).
    """
    own = memberships.groupBy("player", "team", "season").agg(
        F.count_distinct("games").alias("n_own"), F.min("games").alias("games"), F.min("record").alias("player_record")
    )
    every = games.groupBy("team", "season").agg(F.count_distinct("team_games").alias("n_team"), F.min("team_games").alias("team_games"), F.min("record").alias("team_record"))
    joined = own.join(every, ["team", "season"], "left")
    reason = (
        F.when(F.col("n_own") != 1, "conflicting-player-games").when(F.col("n_team").isNull(), "no-team-record").when(F.col("n_team") != 1, "conflicting-team-games")
        .when((F.col("games") <= 0) | (F.col("games") > F.col("team_games")), "games-out-of-range")
    )
    marked = joined.withColumn("reason", reason)
    columns = ["player", "team", "season", "games", "team_games", "player_record", "team_record"]
    return marked.filter("reason is null").select(*columns), marked.filter("reason is not null").select(*columns, "reason")


def snapshot_join(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """``before`` with the rows of the same key in ``after``: whether one has the same days, and how many there are."""
    same = (F.col("b.start_day").eqNullSafe(F.col("a.start_day"))) & (F.col("b.end_day").eqNullSafe(F.col("a.end_day")))
    joined = before.alias("b").join(after.alias("a"), [F.col(f"b.{k}") == F.col(f"a.{k}") for k in key], "left")
    return joined.groupBy(*[F.col(f"b.{k}").alias(k) for k in key], F.col("b.start_day").alias("start_day"), F.col("b.end_day").alias("end_day")).agg(
        F.count(f"a.{key[0]}").alias("rows_after"), F.coalesce(F.max(same & F.col(f"a.{key[0]}").isNotNull()), F.lit(False)).alias("same_days")
    )


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``child`` without a parent; referential integrity holds when there are none."""
    return child.join(parent.select(*key).distinct(), key, "left_anti")


def latest(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The last ``most`` rows of each kind: what a ring buffer of that size would hold."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
