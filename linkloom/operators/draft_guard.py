"""Trades of players just drafted: no roster place moves unless an earlier contract is on record.

A leg's verdict depends on the verdicts before it, so a player's legs are folded in order: what is under contract is known from the
days before, the day's legs are judged by that, and only then do they change it. Only players drafted into a first
season yet to come can be held back, so no other legs, and none after such a year, enter the fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.scratch import materialise

#: Leagues, the scope and actions that move roster places, and what a leg held back is called.
LEAGUES = ("NBA", "BAA")
ROSTER, TRADE, ARRIVING = "nba-roster", "trade", ("sign", "resign", "claim", "trade", "dispersal")
UNRESOLVED, HELD_ACTION, MIXED = "unresolved", "draft-roster-status-unresolved", "mixed"
HELD_REASON = "draft-year=%d;prior-dated-active-contract-unestablished;missing-signing-is-uncertainty-not-absence"
ABSENT = "draft-or-rookie-context-unavailable"


def entrant_years(drafts: DataFrame, seasons: DataFrame) -> DataFrame:
    """(slug, year): the years in which a player was drafted before a first season later than that, or without any.

    Both are (season, league, player); seasons that aren't whole numbers don't count.
    """
    able = lambda df: df.filter(F.col("league").isin(*LEAGUES)).select(F.col("player").alias("slug"), F.expr("try_cast(season as int)").alias("season")).filter("season is not null")
    first = able(seasons).groupBy("slug").agg(F.min("season").alias("first"))
    drafted = able(drafts).distinct().join(first, "slug", "left").filter("first is null or first > season")
    return drafted.select("slug", F.col("season").alias("year"))


def _held(legs: DataFrame) -> DataFrame:
    """(row, leg) of the legs held back. ``legs`` (slug, date, row, leg, scope, action, depart, arrive, entrant) of possible entrants."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slug, day, known, now = None, None, frozenset(), set()
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                if x.slug != slug:
                    slug, day, now = x.slug, None, set()
                if x.date != day:
                    day, known = x.date, frozenset(now)
                if x.scope == ROSTER and x.action == TRADE and x.entrant and x.depart not in known:
                    out.append((x.row, x.leg))
                elif x.scope == ROSTER:
                    now.discard(x.depart)
                    if x.arrive and x.action in ARRIVING:
                        now.add(x.arrive)
            yield pd.DataFrame(out, columns=["row", "leg"])

    dealt = legs.repartition("slug").sortWithinPartitions("slug", "date", "row", "leg")
    return dealt.mapInPandas(fold, "row long, leg long")


def guard(legs: DataFrame, drafts: DataFrame | None, seasons: DataFrame | None) -> DataFrame:
    """``legs`` with scope and action as far as a contract is established, the reason where it isn't, and ``row_scope``, the one scope of a row's legs or ``mixed``.

    ``legs`` is (row, leg, date, date_precision, league, slug, scope, action, depart, arrive), row and leg whole numbers in the order of the
    source. Legs without a precise date or of other leagues stay as they are and establish nothing. Without drafts or seasons
    (None) no leg is judged: the reason then says that the context is absent. A player's legs up to the draft year stream
    through one task; what is kept of them is the teams under contract.
    """
    if drafts is None or seasons is None:
        judged = legs.withColumns({"scope_reason": F.lit(ABSENT)})
    else:
        years = materialise(entrant_years(drafts, seasons), "entrants")
        until = years.groupBy("slug").agg(F.max("year").alias("until"))
        own = legs.filter((F.col("date_precision") == "precise") & F.col("league").isin(*LEAGUES)).select("slug", "date", "row", "leg", "scope", "action", "depart", "arrive", F.year("date").alias("year"))
        near = own.join(until, "slug").filter("year <= until").join(years.withColumn("entrant", F.lit(True)), ["slug", "year"], "left")
        held = _held(near.select("slug", "date", "row", "leg", "scope", "action", "depart", "arrive", F.coalesce("entrant", F.lit(False)).alias("entrant")))
        marked = legs.join(held.withColumn("held", F.lit(True)), ["row", "leg"], "left")
        reason = F.when(F.col("held"), F.format_string(HELD_REASON, F.year("date")))
        judged = marked.withColumns({"scope_reason": reason, "scope": F.when(F.col("held"), UNRESOLVED).otherwise(F.col("scope")), "action": F.when(F.col("held"), HELD_ACTION).otherwise(F.col("action"))}).drop("held")
    judged = materialise(judged, "judged")
    rows = judged.groupBy("row").agg(F.min("scope").alias("low"), F.max("scope").alias("high"))
    return judged.join(rows, "row").withColumn("row_scope", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.when(F.col("low").isNotNull(), MIXED))).drop("low", "high")


def guard_summary(judged: DataFrame, drafts: DataFrame | None, seasons: DataFrame | None) -> DataFrame:
    """One row (applied, reason, reviewed_legs, reviewed_players, drafted_players)."""
    if drafts is None or seasons is None:
        return judged.sparkSession.createDataFrame([(False, ABSENT, None, None, None)], "applied boolean, reason string, reviewed_legs long, reviewed_players long, drafted_players long")
    drafted = drafts.filter(F.col("league").isin(*LEAGUES)).filter(F.expr("try_cast(season as int)").isNotNull()).agg(F.count_distinct("player").alias("drafted_players"))
    held = judged.filter(F.col("action") == HELD_ACTION).agg(F.count("*").alias("reviewed_legs"), F.count_distinct("slug").alias("reviewed_players"))
    return held.join(F.broadcast(drafted)).select(F.lit(True).alias("applied"), F.lit(None).cast("string").alias("reason"), "reviewed_legs", "reviewed_players", "drafted_players")
