"""Overlap of dated memberships."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.days import overlap_days
from linkloom.operators.order import before

BUCKET_DAYS = 64


def overlap_pairs(tenures: DataFrame, bucket_days: int = BUCKET_DAYS, targets: DataFrame | None = None) -> DataFrame:
    """(a, b, team, days) with a < b: the sum of pairwise overlaps of two players' intervals with a team.

    ``tenures`` is (player, team, start_day, end_day), half-open. Equal rows count once; touching
    intervals don't overlap; empty and inverted ones never do. Intervals meet only in the stretches of
    ``bucket_days`` they share, and a pair counts in the stretch where its overlap begins, so a team with
    any number of rows is dealt over its stretches and never compared whole. With ``targets`` (player), pairs have one of them at least.
    """
    rows = tenures.select("player", "team", "start_day", "end_day").filter("start_day < end_day").distinct()
    if targets is not None:
        wanted = targets.select("player").distinct()
        rows = rows.join(rows.join(wanted, "player", "left_semi").select("team").distinct(), "team", "left_semi")
        rows = rows.join(wanted.withColumn("wanted", F.lit(True)), "player", "left")
    days = overlap_days(F.col("a.start_day"), F.col("a.end_day"), F.col("b.start_day"), F.col("b.end_day"))
    met = meetings(rows, bucket_days)
    met = met if targets is None else met.filter("a.wanted or b.wanted")
    pairs = met.select(F.col("a.player").alias("a"), F.col("b.player").alias("b"), F.col("a.team").alias("team"), days.alias("days"))
    return pairs.groupBy("a", "b", "team").agg(F.sum("days").cast("long").alias("days"))


def meetings(rows: DataFrame, bucket_days: int = BUCKET_DAYS, keys: tuple[str, ...] = ("team",)) -> DataFrame:
    """Rows ``a`` and ``b`` of the same ``keys`` whose intervals overlap, a's player before b's, each two once."""
    spread = F.sequence(F.floor(F.col("start_day") / bucket_days), F.floor((F.col("end_day") - 1) / bucket_days))
    placed = rows.withColumn("stretch", F.explode(spread))
    a, b = placed.alias("a"), placed.alias("b")
    meet = (
        reduce(and_, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "stretch")]) & (F.col("a.player") < F.col("b.player"))
        & (F.col("a.start_day") < F.col("b.end_day")) & (F.col("b.start_day") < F.col("a.end_day"))
        & (F.floor(F.greatest("a.start_day", "b.start_day") / bucket_days) == F.col("a.stretch"))
    )
    return a.join(b, meet)


def record_overlaps(records: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """(a, b, team, a_record, b_record, start_day, end_day): which two records make each dated evidence.

    ``records`` is (player, team, record, start_day, end_day). They meet as intervals do in ``overlap_pairs``, so the records' own
    overlaps, summed by pair and team, are its days; nothing is joined by pair afterwards.
    """
    rows = records.select("player", "team", "record", "start_day", "end_day").filter("start_day < end_day").distinct()
    return meetings(rows, bucket_days).select(
        F.col("a.player").alias("a"), F.col("b.player").alias("b"), F.col("a.team").alias("team"), F.col("a.record").alias("a_record"), F.col("b.record").alias("b_record"),
        F.greatest("a.start_day", "b.start_day").alias("start_day"), F.least("a.end_day", "b.end_day").alias("end_day"),
    )


def invalid_intervals(tenures: DataFrame) -> DataFrame:
    """Rows that a strict interval constructor rejects: empty, inverted or without an end."""
    return tenures.filter(F.col("start_day").isNull() | F.col("end_day").isNull() | (F.col("start_day") >= F.col("end_day")))


def games_inside(games: DataFrame, stints: DataFrame, keys: tuple[str, ...] = ("team",)) -> DataFrame:
    """(player, keys..., games): distinct games on days inside any of the player's stints.

    ``games`` is (keys..., game_id, day), a game on one day; ``stints`` (player, keys..., start_day, end_day), half-open. Games are counted by day
    once and summed up to each day; a stint's games are the sum at its end less the sum at its start, so stints and games
    never meet. Stints of a player that touch or overlap are merged first. Players without such a game have no row.
    """
    own = stints.select("player", *keys, "start_day", "end_day").filter("start_day < end_day")
    w = Window.partitionBy("player", *keys).orderBy("start_day", "end_day")
    reach = F.max("end_day").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start_day") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = own.withColumn("reach", reach).withColumn("run", run).groupBy("player", *keys, "run").agg(F.min("start_day").alias("start_day"), F.max("end_day").alias("end_day"))
    daily = games.select(*keys, F.col("day").cast("long").alias("day"), "game_id").distinct().groupBy(*keys, "day").agg(F.count("game_id").alias("n"))
    sign = lambda day, by: F.struct(F.col(day).cast("long").alias("day"), F.lit(by).alias("sign"))
    ends = merged.select("player", *keys, F.explode(F.array(sign("start_day", -1), sign("end_day", 1))).alias("e")).select("player", *keys, "e.day", "e.sign")
    asked = ends.select(*keys, "day", F.lit(None).cast("long").alias("n")).distinct()
    points = daily.union(asked).groupBy(*keys, "day").agg(F.sum("n").alias("n"))
    # a team has a row for each day at most, so a window over its days stays small however many games there are
    sums = before(points, list(keys), "day", "n", "earlier", levels=0).select(*keys, "day", F.coalesce("earlier", F.lit(0)).alias("earlier"))
    met = ends.join(sums, [*keys, "day"])
    return met.groupBy("player", *keys).agg(F.sum(F.col("sign") * F.col("earlier")).cast("long").alias("games")).filter("games > 0")
