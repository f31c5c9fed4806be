"""Facts from streams: the same season windows and shared games, kept up as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_participants(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(team, hour, players): who took part in each team's hours; an hour is final once the watermark has passed it.

    ``events`` is a stream of (ts, user_id, event_type). In append mode each hour is given once, when no
    event for it is awaited any more.
    """
    hour = F.window("ts", "1 hour")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.col("event_type").alias("team"), hour.alias("hour"))
        .agg(F.sort_array(F.collect_set("user_id")).alias("players"))
        .select("team", F.col("hour.start").alias("hour"), "players")
    )


def daily_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(team, day, events, users): a team's activity by day, users counted approximately."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.col("event_type").alias("team"), F.window("ts", "1 day").alias("day"))
        .agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))
        .select("team", F.col("day.start").alias("day"), "events", "users")
    )
