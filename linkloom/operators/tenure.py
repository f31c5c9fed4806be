"""Dated tenures out of season memberships and movement events.

A movement is an arrival (A) or departure (D) of a player with a team on a day; days carry their season's
window. Walking a group's days in order gives stints; what the walk could not know is told by flags, and
every row is graded by the evidence its two ends rest on. Seasons have half-open day windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.intervals import games_inside, meetings
from linkloom.scratch import materialise

GROUP = ["player", "team", "season"]

# Classes, notes and reasons that readers of the tables compare.
DIRECT, CROSS, INFERRED, UNRESOLVED = "directly-evidenced", "cross-checked", "inferred", "unresolved"
REPEATED = "repeat-signing-prior-end-unknown"
PRIOR_EXIT = "departure-after-closed-stint(prior-spell-exit,or-source-noise)"
SAME_DAY = "same-day-arrival-and-departure"
AFTER_WINDOW = "arrival-after-window-end(next-season-move)"
NO_WINDOW_OPEN = "open-stint-without-window"
BRACKET_ONLY = (
    "multi-team-season(ordering-unresolved): player has dated moves to other franchises this season; bracket-only stint cannot be ordered against them"
)
NOTHING_DATED = "no-dated-evidence(membership-season-only; S1-window-missing-or-season-past-2022-23)"
SEVERAL_TEAMS = "same-day-arrival-to-multiple-franchises(ordering-unresolved)"
SAME_DAY_FLAGGED = "same-day-arrival-and-departure(ordering-flagged)"
NO_WINDOW = "no-season-window(S1-game-table-ends-2022-23-or-season-absent-from-S1)"
FUZZY = "fuzzy-dated-rows-bear-on-this-tenure"
FUZZY_STINT = "fuzzy-dated-rows-bear-on-this-tenure(fuzzy-not-guessed)"
OUTSIDE = "stint-entirely-outside-team-season-window(stands-on-transactions-alone)"
COUNT_CONFLICT, DAY_ORDER = "appearance-count-conflict", "same-day-game-order-unresolved"


def season_windows(games: DataFrame) -> DataFrame:
    """(team, season, window_start, window_end): first day, and the day after the last, of a team's games."""
    return games.groupBy("team", "season").agg(F.min("day").alias("window_start"), (F.max("day") + 1).alias("window_end"))


def memberships(base: DataFrame, extra: DataFrame) -> DataFrame:
    """(player, team, season, membership_source): all of ``base``, and of ``extra`` what base lacks."""
    key = ["player", "team", "season"]
    own = base.select(*key).distinct().withColumn("membership_source", F.lit("base"))
    return own.union(extra.select(*key).distinct().join(own, key, "left_anti").withColumn("membership_source", F.lit("supplement")))


def franchise_lookup(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(season, abbreviation, franchise), the last row of each key winning, and one row (conflicts, skipped).

    ``rows`` is (record_no, season, abbreviation, franchise); unresolved and ambiguous ids are skipped.
    """
    usable = rows.filter(~F.col("franchise").isin("unresolved", "ambiguous"))
    found = usable.groupBy("season", "abbreviation").agg(F.max_by("franchise", "record_no").alias("franchise"), F.count_distinct("franchise").alias("n"))
    skipped = rows.agg((F.count("*") - F.count_if(~F.col("franchise").isin("unresolved", "ambiguous"))).alias("skipped"))
    conflicts = found.agg(F.count_if(F.col("n") > 1).alias("conflicts"))
    return found.select("season", "abbreviation", "franchise"), conflicts.join(F.broadcast(skipped))


def leg_season(legs: DataFrame, windows: DataFrame) -> DataFrame:
    """``legs`` (team, day, date_season, page_season) with ``season``: the page's if a team's window has the day, else the date's."""
    w = windows.select("team", F.col("season").alias("page_season"), "window_start", "window_end")
    inside = (F.col("day") >= F.col("window_start")) & (F.col("day") < F.col("window_end"))
    return legs.join(w, ["team", "page_season"], "left").withColumn(
        "season", F.when(F.coalesce(inside, F.lit(False)), F.col("page_season")).otherwise(F.col("date_season"))
    ).drop("window_start", "window_end")


def leg_flags(precision: Column, iso: Column, low: Column, high: Column, slugs: Column) -> Column:
    """Flags of a movement row: no or fuzzy date, outside its page's window (compared as ISO text), no player named."""
    return F.array_compact(
        F.array(
            F.when(precision == "unknown", "no-date"),
            F.when(precision == "fuzzy", "fuzzy-date"),
            F.when(iso.isNotNull() & ((iso < low) | (iso > high)), "outside-page-window"),
            F.when(F.size(slugs) == 0, "no-player-anchor"),
        )
    )


def anchors(legs: DataFrame) -> DataFrame:
    """(player, team, season, day, kind): days with an arrival (A), a departure (D) or both (B), each once.

    ``legs`` is (player, depart, arrive, season, day); a leg from a team to itself says nothing.
    """
    rows = legs.filter(~F.coalesce(F.col("depart") == F.col("arrive"), F.lit(False)))
    out = rows.filter("depart is not null").select("player", F.col("depart").alias("team"), "season", "day", F.lit("D").alias("kind"))
    into = rows.filter("arrive is not null").select("player", F.col("arrive").alias("team"), "season", "day", F.lit("A").alias("kind"))
    both = F.when(F.count_distinct("kind") == 2, "B").otherwise(F.min("kind"))
    return out.union(into).groupBy("player", "team", "season", "day").agg(both.alias("kind"))


def carry_arrivals(legs: DataFrame, members: DataFrame, windows: DataFrame) -> DataFrame:
    """(player, depart, arrive, season, day): arrivals after a season's games and before the team's next ones, for the next season.

    Only where the player is a member of the team in that season, and both windows are known. The legs
    themselves stay where they are; ``depart`` is null in what is carried.
    """
    moved = legs.filter("arrive is not null").select("player", F.col("arrive").alias("team"), (F.col("season") + 1).alias("season"), "day")
    own = windows.select("team", (F.col("season") + 1).alias("season"), F.col("window_end").alias("ended"))
    after = windows.select("team", "season", F.col("window_start").alias("begins"))
    between = moved.join(own, ["team", "season"]).join(after, ["team", "season"]).filter("ended <= day and day < begins")
    found = between.join(members.select(*GROUP).distinct(), GROUP, "left_semi").distinct()
    return found.select("player", F.lit(None).cast("string").alias("depart"), F.col("team").alias("arrive"), "season", "day")


def stints(days: DataFrame) -> DataFrame:
    """(player, team, season, start_day, end_day, start_anchored, end_anchored, note, day) from a walk over each group's days.

    ``days`` is (player, team, season, day, kind, window_start, window_end), windows nullable. A stint is
    open exactly when the day before was an arrival, so the walk is a lag. An arrival on an open stint
    ends it without evidence; a departure with none open counts from the window's start if it is the
    group's first stint and lies within; a day of both closes and does not reopen; an arrival at the end
    runs to the window's end. Rows without dates carry a note only. ``day`` is that of the movement that gave the row.
    """
    w = Window.partitionBy(*GROUP).orderBy("day")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    has_window = F.col("window_start").isNotNull() & F.col("window_end").isNotNull()
    gives = (F.col("kind") == "A") | ((F.col("kind") == "B") & has_window) | ((F.col("kind") == "D") & has_window & (F.col("day") > F.col("window_start")))
    walked = days.withColumns(
        {
            "open": F.coalesce(F.lag("kind").over(w) == "A", F.lit(False)),
            "since": F.lag("day").over(w),
            "given": F.coalesce(F.sum(gives.cast("int")).over(before), F.lit(0)),
            "last": F.lead("day").over(w).isNull(),
        }
    )
    none = F.lit(None).cast("int")

    def stint(start: Column, end: Column, a: bool, b: bool, note: str | None) -> Column:
        return F.struct(
            start.alias("start_day"), end.alias("end_day"), F.lit(a).alias("start_anchored"), F.lit(b).alias("end_anchored"), F.lit(note).cast("string").alias("note")
        )

    kind, day, opened = F.col("kind"), F.col("day"), F.col("open")
    closes = (
        F.when((kind == "A") & opened, stint(F.col("since"), day, True, False, REPEATED))
        .when((kind == "D") & opened, stint(F.col("since"), day, True, True, None))
        .when((kind == "D") & has_window & (day > F.col("window_start")) & (F.col("given") == 0), stint(F.col("window_start"), day, False, True, None))
        .when(kind == "D", stint(none, none, False, False, PRIOR_EXIT))
        .when((kind == "B") & opened, stint(F.col("since"), day, True, True, SAME_DAY))
        .when((kind == "B") & has_window, stint(F.col("window_start"), day, False, True, SAME_DAY))
        .when(kind == "B", stint(none, none, False, False, SAME_DAY))
    )
    runs_on = F.when(
        (kind == "A") & F.col("last"),
        F.when(has_window & (day < F.col("window_end")), stint(day, F.col("window_end"), True, False, None))
        .when(has_window, stint(none, none, False, False, AFTER_WINDOW))
        .otherwise(stint(none, none, False, False, NO_WINDOW_OPEN)),
    )
    found = walked.select(*GROUP, "day", F.explode(F.array_compact(F.array(closes, runs_on))).alias("s"))
    return found.select(*GROUP, "s.*", "day")


def evidence_class(start_anchored: Column, end_anchored: Column, agrees: Column, reasons: Column) -> Column:
    """Unresolved for any reason against it; else by anchors: both, one that the window agrees with, or less."""
    return (
        F.when(F.size(reasons) > 0, UNRESOLVED)
        .when(start_anchored & end_anchored, DIRECT)
        .when((start_anchored | end_anchored) & agrees, CROSS)
        .otherwise(INFERRED)
    )


def clouded_seasons(anchor_rows: DataFrame) -> DataFrame:
    """(player, season, clouded) of each player and season with movements: whether several teams share a day of arrival."""
    teams = F.count_distinct(F.when(F.col("kind") != "D", F.col("team")))
    by_day = anchor_rows.groupBy("player", "season", "day").agg(teams.alias("n"))
    return by_day.groupBy("player", "season").agg((F.max("n") > 1).alias("clouded"))


def reconstruct(members: DataFrame, windows: DataFrame, legs: DataFrame, fuzzy: DataFrame | None = None) -> DataFrame:
    """One row or more per membership: (player, team, season, start_day, end_day, start_anchored, end_anchored, evidence_class, reasons), then
    the further columns of ``members``.

    ``legs`` is (player, depart, arrive, season, day) and may have ``leg_flags``; a flagged leg dates nothing but tells
    on the player's season, as a row of ``fuzzy`` (player, season) does. Arrivals between two seasons also count for the next
    one. A membership that nothing bears on has its season's window, unresolved if the player has dated moves elsewhere.
    Arrivals at several teams on one day leave all of the player's season undated. Else each stint of the walk is a row, with
    what the group's walk has noted; without any the membership is undated. Reasons are joined by "; ".
    """
    flags = F.coalesce(F.col("leg_flags").cast("string") if "leg_flags" in legs.columns else F.lit(None).cast("string"), F.lit(""))
    told = legs.select("player", "depart", "arrive", "season", "day", flags.alias("leg_flags"))
    usable = told.filter("leg_flags = ''").drop("leg_flags")
    days = anchors(usable.union(carry_arrivals(usable, members, windows)))
    flagged = told.filter("leg_flags <> ''").groupBy("player", "season").agg(
        F.concat(F.lit("flagged-transaction-legs("), F.array_join(F.array_sort(F.collect_set("leg_flags")), ";"), F.lit(")")).alias("flagged")
    )
    vague = (fuzzy if fuzzy is not None else told.filter("false")).select("player", "season").distinct().withColumn("fuzzy", F.lit(True))
    ends = days.groupBy(*GROUP).agg(F.bool_or(F.col("kind") != "D").alias("arrived"), F.bool_or(F.col("kind") != "A").alias("departed"))
    walked = stints(days.join(windows, ["team", "season"], "left"))
    noted = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("note").isin(*kinds), F.struct("day", "note"))))
    told_by_walk = walked.groupBy(*GROUP).agg(
        F.bool_or(F.coalesce(F.col("note") == SAME_DAY, F.lit(False))).alias("same_day"), noted(AFTER_WINDOW, NO_WINDOW_OPEN).alias("anomalies"),
        noted(REPEATED, PRIOR_EXIT).alias("notes"),
    )
    dated = walked.filter("start_day is not null").select(*GROUP, "start_day", "end_day", F.col("start_anchored").alias("from_move"), F.col("end_anchored").alias("to_move"))
    season = ["player", "season"]
    m = members.join(windows, ["team", "season"], "left").join(ends, GROUP, "left").join(told_by_walk, GROUP, "left")
    m = m.join(clouded_seasons(days), season, "left").join(flagged, season, "left").join(vague, season, "left")
    m = m.withColumns({"clouded": F.coalesce("clouded", F.lit(False)), "moves": F.col("clouded").isNotNull(), "fuzzy": F.coalesce("fuzzy", F.lit(False))})
    m = m.withColumn("bare", F.col("arrived").isNull() & F.col("flagged").isNull() & ~F.col("fuzzy"))
    # a clouded season takes no stints
    m = m.join(dated.withColumn("clouded", F.lit(False)), [*GROUP, "clouded"], "left")
    window, stint = F.col("window_start").isNotNull() & F.col("window_end").isNotNull(), F.col("start_day").isNotNull()
    valid = F.coalesce(F.col("start_day") < F.col("end_day"), F.lit(False))
    agrees = valid & window & (F.greatest("start_day", "window_start") < F.least("end_day", "window_end"))
    empty = F.array().cast("array<string>")
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<day:int,note:string>>")), lambda x: x["note"])
    one = lambda condition, reason: F.array(F.when(condition, reason))
    same_day = one(F.coalesce("same_day", F.lit(False)), SAME_DAY_FLAGGED)
    own_notes = F.filter(
        F.coalesce("notes", F.array().cast("array<struct<day:int,note:string>>")),
        lambda x: (x["note"] != REPEATED) | ((x["day"] == F.col("end_day")) & ~F.col("to_move")),
    )
    failed = F.format_string("interval-construction-failed(bound-outside-season-context,start=%d,end=%d)", "start_day", "end_day")
    of_stint = F.concat(
        same_day, F.filter(names("anomalies"), lambda x: ~((x == NO_WINDOW_OPEN) & window)), names(own_notes), one(F.col("fuzzy"), FUZZY_STINT), F.array("flagged"),
        one(~valid, failed), one(valid & window & ~agrees, OUTSIDE),
    )
    undated = F.concat(same_day, one(~window, NO_WINDOW), names("anomalies"), names("notes"), F.array("flagged"), one(F.col("fuzzy"), FUZZY))
    reasons = (
        F.when(F.col("bare") & window, one(F.col("moves"), BRACKET_ONLY))
        .when(F.col("bare"), F.array(F.lit(NOTHING_DATED)))
        .when(F.col("clouded"), F.concat(F.array(F.lit(SEVERAL_TEAMS)), F.array("flagged"), one(F.col("fuzzy"), FUZZY)))
        .when(~stint, undated)
        .otherwise(of_stint)
    )
    m = m.withColumns({"told": F.coalesce(F.array_compact(reasons), empty), "agrees": agrees, "valid": valid})
    graded = evidence_class(F.coalesce("from_move", F.lit(False)), F.coalesce("to_move", F.lit(False)), F.col("agrees"), F.col("told"))
    undatable = ~F.col("bare") & ~stint
    m = m.withColumn("evidence_class", F.when(undatable, UNRESOLVED).otherwise(graded))
    sure = F.col("evidence_class").isin(DIRECT, CROSS)
    span = lambda by_window, by_stint: F.when(F.col("bare"), F.col(by_window)).when(F.col("valid"), F.col(by_stint))
    return m.select(
        *GROUP, span("window_start", "start_day").alias("start_day"), span("window_end", "end_day").alias("end_day"),
        (sure & F.coalesce("arrived", F.lit(False))).alias("start_anchored"), (sure & F.coalesce("departed", F.lit(False))).alias("end_anchored"),
        "evidence_class", F.array_join("told", "; ").alias("reasons"), *[c for c in members.columns if c not in GROUP],
    )


def certified(tenures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose evidence certifies them, and the rest: directly evidenced, both ends anchored, no reason against them."""
    clean = ~F.exists(F.split(F.coalesce("reasons", F.lit("")), ";"), lambda r: F.trim(r) != "")
    sure = F.coalesce((F.col("evidence_class") == DIRECT) & F.col("start_anchored") & F.col("end_anchored") & clean, F.lit(False))
    return tenures.filter(sure), tenures.filter(~sure)


def _more_reasons(tenures: DataFrame, more: Column) -> DataFrame:
    """``tenures`` with those of ``more`` that aren't there yet added, and unresolved where ``more`` has any."""
    held = F.filter(F.split(F.coalesce("reasons", F.lit("")), "; "), lambda r: r != "")
    hit = F.size(more) > 0
    reasons = F.when(hit, F.array_join(F.concat(held, F.array_except(more, held)), "; ")).otherwise(F.col("reasons"))
    return tenures.withColumns({"evidence_class": F.when(hit, UNRESOLVED).otherwise(F.col("evidence_class")), "reasons": reasons})


def fetch_failures(tenures: DataFrame, failed: DataFrame) -> DataFrame:
    """Unresolves rows of ``tenures`` (with ``league``) whose own or previous season's page could not be read; absence there proves nothing.

    ``failed`` (page) names pages as league and season, like ``NBA_1999``. The page of the league's last season under
    its old name, ``BAA_1949``, also counts for ``NBA`` 1950. All classes are unresolved, with a reason for each page.
    """
    season, league = F.col("season"), F.col("league")
    page = lambda back: F.concat_ws("_", league, (season - back).cast("string"))
    looked_at = {"_own": page(0), "_before": F.when(season > 1947, page(1)), "_old": F.when((league == "NBA") & (season == 1950), "BAA_1949")}
    rows = tenures.withColumns(looked_at)
    unread = failed.select("page").distinct()
    for name in looked_at:
        rows = rows.join(unread.select(F.col("page").alias(name), F.col("page").alias(f"{name}_unread")), name, "left")
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.col(f"{name}_unread") for name in looked_at]))))
    return _more_reasons(rows, F.transform(found, lambda p: F.concat(F.lit("fetch-failure:"), p))).select(*tenures.columns)


def capacity_audit(tenures: DataFrame, games: DataFrame, appearances: DataFrame) -> DataFrame:
    """(player, team, season, played, listed, team_games, capacity, missing, departure_games, review) for memberships that can be audited.

    Can be: every row of the membership is dated, one at least is directly evidenced or cross-checked, and the schedule
    lists games, no more than the team played. Capacity is the games on days inside any stint, ``missing`` the games that
    the schedule lacks. More games than both allow with those on the stints' end days is a conflict; more than
    both allow without them leaves the order within a day open.
    """
    days = materialise(games.groupBy("team", "season", "game_id").agg(F.max("day").alias("day")), "days")
    tenures = materialise(tenures.select(*GROUP, "start_day", "end_day", "evidence_class"), "audited")
    usable = tenures.groupBy(*GROUP).agg(
        F.bool_and(F.col("start_day").isNotNull() & F.col("end_day").isNotNull()).alias("dated"), F.bool_or(F.col("evidence_class").isin(DIRECT, CROSS)).alias("sure")
    )
    listed = days.groupBy("team", "season").agg(F.count("*").alias("listed"))
    rows = appearances.select(*GROUP, F.col("games").cast("long").alias("played"), F.col("team_games").cast("long").alias("team_games"))
    rows = rows.join(usable.filter("dated and sure").select(*GROUP), GROUP, "left_semi").join(listed, ["team", "season"])
    rows = rows.filter("played is not null and listed > 0 and team_games > 0 and listed <= team_games")
    rows = materialise(rows, "memberships")
    spans = tenures.select(*GROUP, "start_day", "end_day").join(rows.select(*GROUP), GROUP, "left_semi")
    keys = ("team", "season")
    inside = games_inside(days, spans, keys).withColumnRenamed("games", "capacity")
    reached = games_inside(days, spans.withColumn("end_day", F.col("end_day") + 1), keys).withColumnRenamed("games", "reached")
    capacity = reached.join(inside, GROUP, "left").withColumn("departure_games", F.col("reached") - F.coalesce("capacity", F.lit(0)))
    zero = F.lit(0)
    joined = rows.join(capacity, GROUP, "left").select(
        *GROUP, "played", "listed", "team_games", F.coalesce("capacity", zero).cast("long").alias("capacity"), (F.col("team_games") - F.col("listed")).alias("missing"),
        F.coalesce("departure_games", zero).cast("long").alias("departure_games"),
    )
    room = F.col("capacity") + F.col("missing")
    review = F.when(F.col("played") > room + F.col("departure_games"), COUNT_CONFLICT).when(F.col("played") > room, DAY_ORDER)
    return joined.withColumn("review", review)


def appearance_conflicts(tenures: DataFrame, games: DataFrame, appearances: DataFrame) -> DataFrame:
    """``tenures`` with every row of a membership that ``capacity_audit`` reviews unresolved, and the counts as its reason."""
    bound = F.col("capacity") + F.col("departure_games") + F.col("missing")
    reason = F.format_string(
        "%s(S2-player-games=%d,S1-season-games=%d,S2-team-games=%d,interval-capacity=%d,departure-day-allowance=%d,missing-games-allowance=%d,capacity-upper-bound=%d)",
        "review", "played", "listed", "team_games", "capacity", "departure_games", "missing", bound,
    )
    found = capacity_audit(tenures, games, appearances).filter("review is not null").select(*GROUP, reason.alias("_conflict"))
    rows = tenures.join(found, GROUP, "left")
    return _more_reasons(rows, F.array_compact(F.array("_conflict"))).select(*tenures.columns)


def coverage(tenures: DataFrame, era: Column) -> DataFrame:
    """(era, evidence_class, tenures, dated): counts by era and class, and totals over either and both (null keys)."""
    rows = tenures.select(era.alias("era"), "evidence_class", "start_day")
    return rows.cube("era", "evidence_class").agg(F.count("*").alias("tenures"), F.count("start_day").alias("dated"))


def pair_classes(tenures: DataFrame) -> DataFrame:
    """(mixture, pairs): distinct pairs that overlap in a team and season, by the classes of the first overlap found.

    First is by team, season, then the two rows' players and days.
    """
    t = tenures.filter("start_day < end_day").select("player", "team", "season", "start_day", "end_day", "evidence_class")
    met = meetings(t, keys=("team", "season"))
    order = F.struct("a.team", "a.season", "a.start_day", "b.start_day", "a.end_day", "b.end_day")
    mixture = F.array_join(F.array_sort(F.array("a.evidence_class", "b.evidence_class")), "+")
    first = met.groupBy(F.col("a.player").alias("p"), F.col("b.player").alias("q")).agg(F.min_by(mixture, order).alias("mixture"))
    return first.groupBy("mixture").agg(F.count("*").alias("pairs"))


def active_contracts(moves: DataFrame) -> DataFrame:
    """``moves`` (player, team, day, kind) with ``active``: whether a contract with the team held before that day.

    Moves of the same day count only after all of that day's questions, so the frame ends the day before.
    """
    w = Window.partitionBy("player", "team").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("day"))).over(w)
    return moves.withColumn("active", F.coalesce(last("A") > last("D"), last("A").isNotNull()))


def first_and_last(rows: DataFrame, by: str, order: list[str], each: int = 2) -> DataFrame:
    """The first and last ``each`` rows of every class."""
    up = Window.partitionBy(by).orderBy(*order)
    down = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    ranked = rows.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    return ranked.filter((F.col("_up") <= each) | (F.col("_down") <= each)).drop("_up", "_down")
