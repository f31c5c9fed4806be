"""Domain facts out of the driver's star-schema tables.

Players are customers, teams are parts: an order makes its customer a member of each ordered part's team
for 30 days from the order's date. Events give appearances: a user's days, and the hours in which users
met, count as games of the event type's team.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.days import day_number

TENURE_DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def player_id(key: Column) -> Column:
    return F.concat(F.lit("P"), F.lpad(key.cast("string"), 9, "0"))


def team_id(key: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(key.cast("string"), 9, "0"))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(player_id(F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"))


def tenures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    start = day_number(F.col("o_orderdate"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(player_id(F.col("o_custkey")).alias("player"), team_id(F.col("l_partkey")).alias("team"), start.alias("start_day"), (start + TENURE_DAYS).alias("end_day"))
        .distinct()
    )


def _season() -> Column:
    """Weeks of eight days of the events' month, named 1993 to 1996, so that ranges of seasons part counts and dated facts alike."""
    return (F.lit(1993) + F.floor(F.dayofmonth("ts") / 8)).cast("int")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(player, team, season, games, team_games): distinct active days of a user and of the event type."""
    days = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("team"), _season().alias("season"), F.to_date("ts").alias("day")).distinct()
    own = days.groupBy("user_id", "team", "season").agg(F.count("*").cast("int").alias("games"))
    every = days.select("team", "season", "day").distinct().groupBy("team", "season").agg(F.count("*").cast("int").alias("team_games"))
    return own.join(every, ["team", "season"]).select(player_id(F.col("user_id")).alias("player"), "team", "season", "games", "team_games")


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(player, team, season, game_id, date): a game is an hour of an event type."""
    return (
        table(spark, sf_dir, "events")
        .select(
            player_id(F.col("user_id")).alias("player"), F.col("event_type").alias("team"), _season().alias("season"),
            F.date_format("ts", "yyyyMMddHH").alias("game_id"), F.to_date("ts").alias("date"),
        )
        .distinct()
    )
