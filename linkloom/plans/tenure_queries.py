"""Queries of the tenure and reconciliation operators on the driver's tables.

Users move in and out of an event type's team: some events are arrivals, departures or moves, on the
event's day. Customers buying from suppliers are the memberships two sources differ on:
by the order's date and by the shipping date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import days, text
from linkloom.operators import intervals, reconcile, tenure
from linkloom.operators.order import parts_for
from linkloom.sources import tables


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a month as three seasons of ten days, 2000 to 2002; the last three days of each have no games."""
    k = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return tables.table(spark, sf_dir, "events").select(
        "event_id", tables.player_id(F.col("user_id")).alias("player"), F.col("event_type").alias("team"), (2000 + F.floor(k / 10)).cast("int").alias("season"),
        (k % 10).alias("of_season"), days.day_number(F.col("ts")).alias("day"), F.date_format("ts", "yyyyMMddHH").alias("game_id"),
    )


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 12 event ids two are arrivals, one is a departure and one a move to another team; some are flagged."""
    k = F.col("event_id") % 12
    return _events(spark, sf_dir).filter(k.isin(0, 1, 3, 5)).select(
        "player", F.when(k.isin(1, 5), F.col("team")).alias("depart"), F.when(k.isin(0, 3), F.col("team")).when(k == 5, "click").alias("arrive"), "season", "day",
        F.when(F.col("event_id") % 41 == 7, "outside-page-window").when(F.col("event_id") % 43 == 7, "no-player-anchor").alias("leg_flags"),
    )


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A game is an hour of a team; one team lacks the games of the last season."""
    return _events(spark, sf_dir).filter("of_season < 7 and not (team = 'error' and season = 2002)").select("team", "season", "game_id", "day").distinct()


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    league = F.when(F.col("season") == 2000, "BAA").otherwise("NBA")
    return _events(spark, sf_dir).select("player", "team", "season", league.alias("league")).distinct()


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = _legs(spark, sf_dir).filter("leg_flags is null").drop("leg_flags")
    return tenure.anchors(usable.union(tenure.carry_arrivals(usable, _members(spark, sf_dir), season_windows(spark, sf_dir))))


def _reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fuzzy = _events(spark, sf_dir).filter("event_id % 47 = 11").select("player", "season")
    return tenure.reconstruct(_members(spark, sf_dir), season_windows(spark, sf_dir), _legs(spark, sf_dir), fuzzy)


def _appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of each player and of each team, all hours counted, so that a schedule may lack some."""
    hours = _events(spark, sf_dir)
    team_games = hours.groupBy("team", "season").agg(F.count_distinct("game_id").alias("team_games"))
    return hours.groupBy("player", "team", "season").agg(F.count_distinct("game_id").alias("games")).join(team_games, ["team", "season"])


def _sides(spark: SparkSession, sf_dir: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides' memberships; where ``parts`` are given, dealt into so many and with repeats, which a grouping may take out."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    if parts is not None:
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    side = lambda d: joined.select(F.col("o_custkey").alias("player"), F.col("l_suppkey").alias("team"), F.year(d).alias("season"))
    if parts is None:
        return side("o_orderdate").distinct(), side("l_shipdate").distinct()
    return side("o_orderdate"), side("l_shipdate")


def season_windows(spark, sf_dir):
    return tenure.season_windows(_games(spark, sf_dir))


def anchors(spark, sf_dir):
    return _days(spark, sf_dir)


def stints(spark, sf_dir):
    return tenure.stints(_days(spark, sf_dir).join(season_windows(spark, sf_dir), ["team", "season"], "left"))


def reconstructed_tenures(spark, sf_dir):
    return _reconstructed(spark, sf_dir)


def tenure_coverage(spark, sf_dir):
    return tenure.coverage(_reconstructed(spark, sf_dir), days.era_label(F.col("league"), F.col("season")))


def certified_tenures(spark, sf_dir):
    return tenure.certified(_reconstructed(spark, sf_dir))[0].select("player", "team", "season", "start_day", "end_day")


def coverage_gaps(spark, sf_dir):
    return tenure.certified(_reconstructed(spark, sf_dir))[1].groupBy("evidence_class").agg(F.count("*").alias("excluded"))


def fetch_failures(spark, sf_dir):
    """Two pages could not be read: that of a season of one league, and one that nothing asks for."""
    failed = spark.createDataFrame([("NBA_2001",), ("BAA_1949",)], "page string")
    return tenure.fetch_failures(_reconstructed(spark, sf_dir), failed)


def capacity_audit(spark, sf_dir):
    return tenure.capacity_audit(_reconstructed(spark, sf_dir), _games(spark, sf_dir), _appearances(spark, sf_dir))


def appearance_conflicts(spark, sf_dir):
    return tenure.appearance_conflicts(_reconstructed(spark, sf_dir), _games(spark, sf_dir), _appearances(spark, sf_dir))


def pair_classes(spark, sf_dir):
    t = _reconstructed(spark, sf_dir)
    return tenure.pair_classes(t)


def active_contracts(spark, sf_dir):
    return tenure.active_contracts(anchors(spark, sf_dir).filter("kind <> 'B'").select("player", "team", "day", "kind"))


def carried_arrivals(spark, sf_dir):
    usable = _legs(spark, sf_dir).filter("leg_flags is null").drop("leg_flags")
    return tenure.carry_arrivals(usable, _members(spark, sf_dir), season_windows(spark, sf_dir))


def games_inside_stints(spark, sf_dir):
    return intervals.games_inside(_games(spark, sf_dir).select("team", "game_id", "day"), stints(spark, sf_dir).filter("start_day is not null").drop("day"))


def membership_difference(spark, sf_dir):
    parts = parts_for(tables.table(spark, sf_dir, "lineitem").count(), spark)
    a, b = _sides(spark, sf_dir, parts)
    return reconcile.membership_difference(a, b, ["player", "team", "season"], cut=1996, parts=parts)


def difference_shape(spark, sf_dir):
    """The sides with a season every ten years; the other source shows every fourth player's teams all the same."""
    apart = (1994 + (F.col("season") - 1993) * 10).cast("int")
    a, b = (x.withColumn("season", apart) for x in _sides(spark, sf_dir))
    seen = b.union(a.filter("player % 4 = 0").select(b.columns))
    return reconcile.difference_shape(a.join(b, ["player", "team", "season"], "left_anti"), seen)


def membership_union(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return tenure.memberships(a, b)


def headline_counts(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return reconcile.headline_counts(a.filter("season = 1995").select(F.col("player").alias("id")), b.filter("season = 1996").select(F.col("player").alias("id")))


def franchise_as_of(spark, sf_dir):
    """Which era of a supplier's nation an order falls into; two nations of a region swap names in 1995."""
    n = tables.table(spark, sf_dir, "nation")
    eras = n.select(
        F.col("n_nationkey").cast("string").alias("franchise"), F.col("n_regionkey").cast("string").alias("league"), F.col("n_name").alias("name"),
        F.substring("n_name", 1, 3).alias("abbreviation"), (F.lit(1990) + F.col("n_nationkey") % 4).alias("first_season"),
        F.when(F.col("n_nationkey") % 3 == 0, 1996).alias("last_season"),
    )
    c = tables.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = tables.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    facts = o.select(
        F.col("o_orderkey").alias("fact"), F.col("n_regionkey").cast("string").alias("league"), F.year("o_orderdate").alias("season"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("n_name")).otherwise(F.substring("n_name", 1, 3)).alias("name"),
    )
    return reconcile.as_of(facts, eras)


def appearance_export(spark, sf_dir):
    c = tables.counts(spark, sf_dir)
    own = c.select("player", "team", "season", "games", F.concat_ws(":", "player", "team").alias("record"))
    every = c.select("team", "season", F.col("team_games"), F.col("team").alias("record")).distinct()
    good, bad = reconcile.appearance_export(own, every)
    return good.withColumn("reason", F.lit(None).cast("string")).union(bad)


def snapshot_join(spark, sf_dir):
    t = tables.tenures(spark, sf_dir)
    after = t.filter("start_day % 2 = 0").unionByName(t.filter("start_day % 5 = 0").withColumn("end_day", F.col("end_day") + 1))
    return reconcile.snapshot_join(t, after, ["player", "team"])


def orphan_lines(spark, sf_dir):
    parents = tables.table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return reconcile.orphans(tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), parents, ["l_orderkey"])


def ring_buffer(spark, sf_dir):
    return reconcile.latest(tables.table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 128)


def class_examples(spark, sf_dir):
    return tenure.first_and_last(tables.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", ["o_orderkey"])


def day_arithmetic(spark, sf_dir):
    d = F.col("o_orderdate")
    m, y = days.month_window(F.year(d), F.month(d)), days.year_window(F.year(d))
    return tables.table(spark, sf_dir, "orders").select(
        "o_orderkey", days.day_number(d).alias("day"), days.season_of(d).alias("season"), m[0].alias("month_low"), m[1].alias("month_high"),
        y[0].alias("year_low"), y[1].alias("year_high"), days.interval_text(days.day_number(d), days.day_number(d) + 30).alias("span"), days.era_label(F.when(F.col("o_orderkey") % 5 == 0, "BAA").otherwise("NBA"), F.year(d) - (F.col("o_orderkey") % 50).cast("int")).alias("era"),
    )


def bounded_texts(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.bounded_text(F.col("text"), 500).alias("short"), text.contains_phrase(F.col("text"), F.lit("the")).alias("has_the"))


QUERIES = {
    f.__name__: f
    for f in (
        season_windows, anchors, stints, reconstructed_tenures, tenure_coverage, certified_tenures, coverage_gaps, fetch_failures, capacity_audit, appearance_conflicts, pair_classes, active_contracts,
        carried_arrivals, games_inside_stints, membership_difference, difference_shape, membership_union, headline_counts, franchise_as_of, appearance_export,
        snapshot_join, orphan_lines, ring_buffer, class_examples, day_arithmetic, bounded_texts,
    )
}

_ERA = """CASE WHEN {0} = 'BAA' THEN 'BAA 1946-49' WHEN {0} <> 'NBA' THEN NULL WHEN {1} BETWEEN 1950 AND 1966 THEN '1950-66' WHEN {1} BETWEEN 1967 AND 1980 THEN '1967-80'
  WHEN {1} BETWEEN 1981 AND 1999 THEN '1981-99' WHEN {1} BETWEEN 2000 AND 2026 THEN '2000-2025/26' END"""
MOVES = """ev AS (
  SELECT event_id, 'P' || lpad(user_id::VARCHAR, 9, '0') AS player, event_type AS team, (2000 + (ts::DATE - DATE '2024-01-01') // 10)::INTEGER AS season,
    (ts::DATE - DATE '2024-01-01') % 10 AS of_season, (ts::DATE - DATE '1946-01-01')::INTEGER AS day, strftime(ts, '%Y%m%d%H') AS game_id FROM events
), game AS (SELECT DISTINCT team, season, game_id, day FROM ev WHERE of_season < 7 AND NOT (team = 'error' AND season = 2002)
), win AS (SELECT team, season, min(day) AS window_start, max(day) + 1 AS window_end FROM game GROUP BY ALL
), member AS (SELECT DISTINCT player, team, season, CASE WHEN season = 2000 THEN 'BAA' ELSE 'NBA' END AS league FROM ev
), leg AS (
  SELECT player, CASE WHEN event_id % 12 IN (1, 5) THEN team END AS depart, CASE event_id % 12 WHEN 5 THEN 'click' WHEN 1 THEN NULL ELSE team END AS arrive, season, day,
    CASE WHEN event_id % 41 = 7 THEN 'outside-page-window' WHEN event_id % 43 = 7 THEN 'no-player-anchor' END AS leg_flags FROM ev WHERE event_id % 12 IN (0, 1, 3, 5)
), usable AS (SELECT * FROM leg WHERE leg_flags IS NULL
), carried AS (
  SELECT DISTINCT u.player, u.arrive AS team, n.season, u.day FROM usable u JOIN win o ON o.team = u.arrive AND o.season = u.season JOIN win n ON n.team = u.arrive AND n.season = u.season + 1
    JOIN member m ON m.player = u.player AND m.team = u.arrive AND m.season = n.season WHERE u.day BETWEEN o.window_end AND n.window_start - 1
), move AS (
  SELECT player, depart AS team, season, day, 'D' AS kind FROM usable WHERE depart IS NOT NULL AND depart IS DISTINCT FROM arrive
  UNION SELECT player, arrive, season, day, 'A' FROM usable WHERE arrive IS NOT NULL AND depart IS DISTINCT FROM arrive
  UNION SELECT player, team, season, day, 'A' FROM carried
), anchor AS (SELECT player, team, season, day, CASE count(*) WHEN 2 THEN 'B' ELSE min(kind) END AS kind FROM move GROUP BY ALL)"""
STINTS = f"""{MOVES}, w1 AS (
  SELECT anchor.*, window_start AS ws, window_end AS we, coalesce(lag(kind) OVER w = 'A', false) AS opened, lag(day) OVER w AS since, lead(day) OVER w IS NULL AS final,
    kind = 'A' OR (kind = 'B' AND window_start IS NOT NULL) OR (kind = 'D' AND coalesce(day > window_start, false)) AS gives
  FROM anchor LEFT JOIN win USING (team, season) WINDOW w AS (PARTITION BY player, team, season ORDER BY day)
), w2 AS (
  SELECT *, coalesce(sum(gives::INTEGER) OVER (PARTITION BY player, team, season ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM w1
), w3 AS (SELECT *, opened OR (kind = 'B' AND ws IS NOT NULL) OR (kind = 'D' AND coalesce(day > ws, false) AND given = 0) AS ends FROM w2
), stint AS (
  SELECT player, team, season, CASE WHEN opened THEN since WHEN ends THEN ws END AS start_day, CASE WHEN ends THEN day END AS end_day, opened AS start_anchored, kind <> 'A' AND ends AS end_anchored,
    CASE kind WHEN 'A' THEN 'repeat-signing-prior-end-unknown' WHEN 'B' THEN 'same-day-arrival-and-departure'
      ELSE CASE WHEN NOT ends THEN 'departure-after-closed-stint(prior-spell-exit,or-source-noise)' END END AS note, day
  FROM w3 WHERE kind <> 'A' OR opened
  UNION ALL
  SELECT player, team, season, CASE WHEN day < we THEN day END, CASE WHEN day < we THEN we END, coalesce(day < we, false), false,
    CASE WHEN we IS NULL THEN 'open-stint-without-window' WHEN day >= we THEN 'arrival-after-window-end(next-season-move)' END, day
  FROM w3 WHERE kind = 'A' AND final
)"""
TENURE = f"""{STINTS}, season_of AS (
  SELECT player, season, bool_or(n > 1) AS clouded FROM (SELECT player, season, day, count(DISTINCT team) FILTER (kind <> 'D') AS n FROM anchor GROUP BY ALL) GROUP BY ALL
), grp AS (SELECT player, team, season, bool_or(kind <> 'D') AS arr, bool_or(kind <> 'A') AS dep, bool_or(kind = 'B') AS twice FROM anchor GROUP BY ALL
), flag AS (SELECT player, season, 'flagged-transaction-legs(' || string_agg(DISTINCT leg_flags, ';' ORDER BY leg_flags) || ')' AS flagged FROM leg WHERE leg_flags IS NOT NULL GROUP BY ALL
), vague AS (SELECT DISTINCT player, season, true AS fuzzy FROM ev WHERE event_id % 47 = 11
), said AS (
  SELECT player, team, season, list(note ORDER BY day) FILTER (note IN ('open-stint-without-window', 'arrival-after-window-end(next-season-move)')) AS anomalies,
    list({{'note': note, 'day': day}} ORDER BY day, note) FILTER (note IN ('repeat-signing-prior-end-unknown', 'departure-after-closed-stint(prior-spell-exit,or-source-noise)')) AS notes
  FROM stint GROUP BY ALL
), x AS (
  SELECT m.*, w.window_start AS ws, w.window_end AS we, w.window_start IS NOT NULL AS has_window, coalesce(g.arr, false) AS arr, coalesce(g.dep, false) AS dep, coalesce(g.twice, false) AS twice,
    coalesce(so.clouded, false) AS clouded, so.player IS NOT NULL AS moves, f.flagged, coalesce(v.fuzzy, false) AS fuzzy, coalesce(t.anomalies, []) AS anomalies, coalesce(t.notes, []) AS notes,
    g.player IS NULL AND f.flagged IS NULL AND v.fuzzy IS NULL AS bare, s.start_day AS s0, s.end_day AS e0, s.start_anchored AS sa, s.end_anchored AS ea
  FROM member m LEFT JOIN win w USING (team, season) LEFT JOIN grp g USING (player, team, season) LEFT JOIN season_of so USING (player, season) LEFT JOIN flag f USING (player, season)
    LEFT JOIN vague v USING (player, season) LEFT JOIN said t USING (player, team, season)
    LEFT JOIN (SELECT * FROM stint WHERE start_day IS NOT NULL) s ON s.player = m.player AND s.team = m.team AND s.season = m.season AND NOT coalesce(so.clouded, false)
), y AS (
  SELECT *, coalesce(s0 < e0, false) AS valid, coalesce(s0 < e0 AND greatest(s0, ws) < least(e0, we), false) AND has_window AS agrees FROM x
), z AS (
  SELECT *, list_filter(CASE
    WHEN bare AND has_window THEN [CASE WHEN moves THEN 'multi-team-season(ordering-unresolved): player has dated moves to other franchises this season; bracket-only stint cannot be ordered against them' END]
    WHEN bare THEN ['no-dated-evidence(membership-season-only; S1-window-missing-or-season-past-2022-23)']
    WHEN clouded THEN ['same-day-arrival-to-multiple-franchises(ordering-unresolved)', flagged, CASE WHEN fuzzy THEN 'fuzzy-dated-rows-bear-on-this-tenure' END]
    WHEN s0 IS NULL THEN [CASE WHEN twice THEN 'same-day-arrival-and-departure(ordering-flagged)' END, CASE WHEN NOT has_window THEN 'no-season-window(S1-game-table-ends-2022-23-or-season-absent-from-S1)' END]
      || anomalies || list_transform(notes, lambda n: n.note) || [flagged, CASE WHEN fuzzy THEN 'fuzzy-dated-rows-bear-on-this-tenure' END]
    ELSE [CASE WHEN twice THEN 'same-day-arrival-and-departure(ordering-flagged)' END] || list_filter(anomalies, lambda a: a <> 'open-stint-without-window' OR NOT has_window)
      || list_transform(list_filter(notes, lambda n: n.note <> 'repeat-signing-prior-end-unknown' OR (n.day = e0 AND NOT ea)), lambda n: n.note)
      || [CASE WHEN fuzzy THEN 'fuzzy-dated-rows-bear-on-this-tenure(fuzzy-not-guessed)' END, flagged,
          CASE WHEN NOT valid THEN 'interval-construction-failed(bound-outside-season-context,start=' || s0 || ',end=' || e0 || ')' END,
          CASE WHEN valid AND has_window AND NOT agrees THEN 'stint-entirely-outside-team-season-window(stands-on-transactions-alone)' END]
    END, lambda r: r IS NOT NULL) AS told FROM y
), graded AS (
  SELECT *, CASE WHEN len(told) > 0 OR (NOT bare AND s0 IS NULL) THEN 'unresolved' WHEN sa AND ea THEN 'directly-evidenced' WHEN (sa OR ea) AND agrees THEN 'cross-checked' ELSE 'inferred' END AS evidence_class FROM z
), tenure AS (
  SELECT player, team, season, CASE WHEN bare THEN ws WHEN valid THEN s0 END AS start_day, CASE WHEN bare THEN we WHEN valid THEN e0 END AS end_day,
    evidence_class IN ('directly-evidenced', 'cross-checked') AND arr AS start_anchored, evidence_class IN ('directly-evidenced', 'cross-checked') AND dep AS end_anchored,
    evidence_class, array_to_string(told, '; ') AS reasons, league FROM graded
)"""
AUDIT = f"""{TENURE}, hours AS (
  SELECT player, team, season, count(DISTINCT game_id) AS games, any_value(team_games) AS team_games FROM ev JOIN (SELECT team, season, count(DISTINCT game_id) AS team_games FROM ev GROUP BY ALL) USING (team, season) GROUP BY ALL
), able AS (SELECT player, team, season FROM tenure GROUP BY ALL HAVING bool_and(start_day IS NOT NULL) AND bool_or(evidence_class IN ('directly-evidenced', 'cross-checked'))
), slot AS (SELECT DISTINCT team, season, game_id, day FROM game
), fits AS (
  SELECT player, team, season, games AS played, listed, team_games,
    (SELECT count(*) FROM slot WHERE slot.team = a.team AND slot.season = a.season AND EXISTS (SELECT 1 FROM tenure t WHERE t.player = a.player AND t.team = a.team AND t.season = a.season AND start_day <= day AND day < end_day)) AS capacity,
    team_games - listed AS missing,
    (SELECT count(*) FROM slot WHERE slot.team = a.team AND slot.season = a.season AND EXISTS (SELECT 1 FROM tenure t WHERE t.player = a.player AND t.team = a.team AND t.season = a.season AND start_day <= day AND day <= end_day)) AS reach
  FROM hours a JOIN able USING (player, team, season) JOIN (SELECT team, season, count(*) AS listed FROM slot GROUP BY ALL) USING (team, season) WHERE listed <= team_games
), audit AS (
  SELECT player, team, season, played, listed, team_games, capacity, missing, reach - capacity AS departure_games,
    CASE WHEN played > reach + missing THEN 'appearance-count-conflict' WHEN played > capacity + missing THEN 'same-day-game-order-unresolved' END AS review FROM fits
)"""
SIDES = """joined AS (SELECT o_custkey AS player, l_suppkey AS team, year(o_orderdate)::INTEGER AS x, year(l_shipdate)::INTEGER AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), a AS (SELECT DISTINCT player, team, x AS season FROM joined), b AS (SELECT DISTINCT player, team, y AS season FROM joined)"""

SQL = {
    "season_windows": f"WITH {MOVES} SELECT * FROM win",
    "anchors": f"WITH {MOVES} SELECT * FROM anchor",
    "stints": f"WITH {STINTS} SELECT * FROM stint",
    "reconstructed_tenures": f"WITH {TENURE} SELECT * FROM tenure",
    "tenure_coverage": f"""WITH {TENURE} SELECT {_ERA.format('league', 'season')} AS era, evidence_class, count(*) AS tenures, count(start_day) AS dated FROM tenure GROUP BY CUBE (1, 2)""",
    "certified_tenures": f"WITH {TENURE} SELECT player, team, season, start_day, end_day FROM tenure WHERE evidence_class = 'directly-evidenced' AND start_anchored AND end_anchored",
    "coverage_gaps": f"WITH {TENURE} SELECT evidence_class, count(*) AS excluded FROM tenure WHERE evidence_class <> 'directly-evidenced' OR NOT (start_anchored AND end_anchored) GROUP BY 1",
    "fetch_failures": f"""WITH {TENURE} SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'unresolved' ELSE evidence_class END AS evidence_class,
        CASE WHEN hit THEN CASE WHEN reasons = '' THEN '' ELSE reasons || '; ' END || 'fetch-failure:NBA_2001' ELSE reasons END AS reasons)
      FROM (SELECT *, league = 'NBA' AND season IN (2001, 2002) AS hit FROM tenure)""",
    "appearance_conflicts": f"""WITH {AUDIT} SELECT t.player, t.team, t.season, start_day, end_day, start_anchored, end_anchored, CASE WHEN review IS NULL THEN evidence_class ELSE 'unresolved' END AS evidence_class,
        CASE WHEN review IS NULL THEN reasons ELSE CASE WHEN reasons = '' THEN '' ELSE reasons || '; ' END || review || '(S2-player-games=' || played || ',S1-season-games=' || listed || ',S2-team-games=' || team_games
          || ',interval-capacity=' || capacity || ',departure-day-allowance=' || departure_games || ',missing-games-allowance=' || missing || ',capacity-upper-bound=' || (capacity + departure_games + missing) || ')' END AS reasons, league
      FROM tenure t LEFT JOIN audit USING (player, team, season)""",
    "capacity_audit": f"WITH {AUDIT} SELECT * FROM audit",
    "pair_classes": f"""WITH {TENURE}, t AS (SELECT * FROM tenure WHERE start_day < end_day),
      r AS (SELECT a.player AS p, b.player AS q, least(a.evidence_class, b.evidence_class) || '+' || greatest(a.evidence_class, b.evidence_class) AS mixture,
        row_number() OVER (PARTITION BY a.player, b.player ORDER BY a.team, a.season, a.start_day, b.start_day, a.end_day, b.end_day) AS n
        FROM t a JOIN t b ON a.team = b.team AND a.season = b.season AND a.player < b.player AND a.start_day < b.end_day AND b.start_day < a.end_day)
      SELECT mixture, count(*) AS pairs FROM r WHERE n = 1 GROUP BY mixture""",
    "active_contracts": f"""WITH {MOVES}, x AS (SELECT player, team, day, kind, max(CASE WHEN kind = 'A' THEN day END) OVER w AS a, max(CASE WHEN kind = 'D' THEN day END) OVER w AS d
        FROM anchor WHERE kind <> 'B' WINDOW w AS (PARTITION BY player, team ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT player, team, day, kind, coalesce(a > d, a IS NOT NULL) AS active FROM x""",
    "carried_arrivals": f"WITH {MOVES} SELECT player, NULL::VARCHAR AS depart, team AS arrive, season, day FROM carried",
    "games_inside_stints": f"""WITH {STINTS}, st AS (SELECT * EXCLUDE (day) FROM stint) SELECT player, s.team, count(DISTINCT game_id) AS games FROM game JOIN st s ON game.team = s.team AND start_day <= day AND day < end_day GROUP BY ALL""",
    "membership_difference": f"""WITH {SIDES} SELECT CASE WHEN season > 1996 THEN 'left-only-after-1996' ELSE 'left-only' END AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
      UNION ALL SELECT CASE WHEN season > 1996 THEN 'right-only-after-1996' ELSE 'right-only' END, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "difference_shape": f"""WITH {SIDES}, p AS (SELECT player, team, 1994 + (season - 1993) * 10 AS season FROM a), q AS (SELECT player, team, 1994 + (season - 1993) * 10 AS season FROM b),
      d AS (SELECT * FROM p EXCEPT SELECT * FROM q), s AS (SELECT * FROM q UNION SELECT * FROM p WHERE player % 4 = 0)
      SELECT player, team, season::INTEGER AS season, CASE WHEN season > 2023 THEN 'S1-ends-2022-23' WHEN season < 1997 THEN 'S1-no-per-player-evidence-pre-1997'
        WHEN EXISTS (FROM s WHERE s.player = d.player AND s.season = d.season AND s.team = d.team) THEN 'S1-pbp-shows-team-rowset-artifact'
        WHEN EXISTS (FROM s WHERE s.player = d.player AND s.season = d.season) THEN 'S1-pbp-shows-other-teams-same-season' ELSE 'S1-pbp-no-event-for-player' END AS shape FROM d""",
    "membership_union": f"WITH {SIDES} SELECT *, 'base' AS membership_source FROM a UNION ALL SELECT *, 'supplement' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "headline_counts": f"""WITH {SIDES}, x AS (SELECT DISTINCT player AS id FROM a WHERE season = 1995), y AS (SELECT DISTINCT player AS id FROM b WHERE season = 1996)
      SELECT count(*) FILTER (x.id IS NOT NULL AND y.id IS NOT NULL) AS "both", count(*) FILTER (y.id IS NULL) AS left_only, count(*) FILTER (x.id IS NULL) AS right_only, count(*) AS either
      FROM x FULL JOIN y ON x.id = y.id""",
    "franchise_as_of": """WITH e AS (SELECT n_nationkey::VARCHAR AS franchise, n_regionkey::VARCHAR AS league, n_name AS name, n_name[1:3] AS abbreviation, 1990 + n_nationkey % 4 AS lo,
        CASE WHEN n_nationkey % 3 = 0 THEN 1996 END AS hi FROM nation),
      f AS (SELECT o_orderkey AS fact, n_regionkey::VARCHAR AS league, year(o_orderdate)::INTEGER AS season, CASE WHEN o_orderkey % 2 = 0 THEN n_name ELSE n_name[1:3] END AS name
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
      SELECT fact, f.league, season, f.name, CASE count(DISTINCT franchise) WHEN 0 THEN 'unresolved' WHEN 1 THEN min(franchise) ELSE 'ambiguous' END AS franchise
      FROM f LEFT JOIN e ON f.league = e.league AND (f.name = e.name OR f.name = e.abbreviation) AND season >= lo AND season <= coalesce(hi, season) GROUP BY 1, 2, 3, 4""",
    "appearance_export": """WITH d AS (SELECT DISTINCT user_id, event_type AS team, (1993 + day(ts) // 8)::INTEGER AS season, ts::DATE AS day FROM events),
      t AS (SELECT team, season, count(DISTINCT day)::INTEGER AS team_games FROM d GROUP BY ALL),
      c AS (SELECT 'P' || lpad(user_id::VARCHAR, 9, '0') AS player, team, season, count(*)::INTEGER AS games, any_value(team_games) AS team_games FROM d JOIN t USING (team, season) GROUP BY ALL)
      SELECT player, team, season, games, team_games, player || ':' || team AS player_record, team AS team_record, NULL::VARCHAR AS reason FROM c""",
    "snapshot_join": """WITH t AS (SELECT DISTINCT 'P' || lpad(o_custkey::VARCHAR, 9, '0') AS player, 'T' || lpad(l_partkey::VARCHAR, 9, '0') AS team,
        (o_orderdate::DATE - DATE '1946-01-01')::INTEGER AS start_day, (o_orderdate::DATE - DATE '1946-01-01')::INTEGER + 30 AS end_day FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      n AS (SELECT * FROM t WHERE start_day % 2 = 0 UNION ALL SELECT player, team, start_day, end_day + 1 FROM t WHERE start_day % 5 = 0)
      SELECT t.player, t.team, t.start_day, t.end_day, count(n.player) AS rows_after, coalesce(bool_or(n.start_day = t.start_day AND n.end_day = t.end_day), false) AS same_days
      FROM t LEFT JOIN n ON t.player = n.player AND t.team = n.team GROUP BY 1, 2, 3, 4""",
    "orphan_lines": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)",
    "ring_buffer": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 128",
    "class_examples": """SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 2
      OR row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) <= 2""",
    "day_arithmetic": f"""SELECT o_orderkey, (d - e)::INTEGER AS day, (year(d) + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END)::INTEGER AS season,
        (date_trunc('month', d)::DATE - e)::INTEGER AS month_low, ((date_trunc('month', d) + INTERVAL 1 MONTH)::DATE - e)::INTEGER AS month_high,
        (date_trunc('year', d)::DATE - e)::INTEGER AS year_low, ((date_trunc('year', d) + INTERVAL 1 YEAR)::DATE - e)::INTEGER AS year_high,
        '[' || d || ', ' || (d + 30) || ')' AS span, {_ERA.format("CASE WHEN o_orderkey % 5 = 0 THEN 'BAA' ELSE 'NBA' END", "(year(d) - o_orderkey % 50)")} AS era
      FROM (SELECT o_orderkey, o_orderdate::DATE AS d, DATE '1946-01-01' AS e FROM orders)""",
    "bounded_texts": r"""SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:500] || '…' ELSE text END AS short,
        regexp_matches(text, '(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])') AS has_the FROM documents""",
}
