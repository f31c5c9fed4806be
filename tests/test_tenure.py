import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import days
from linkloom.operators import reconcile, tenure

DAYS = "player string, team string, season int, day int, kind string, window_start int, window_end int"


def _walk(spark, steps, window=(None, None)):
    df = spark.createDataFrame([("p", "t", 1, d, k, *window) for d, k in steps], DAYS)
    return [tuple(r)[3:8] for r in tenure.stints(df).orderBy(F.asc_nulls_last("start_day"), "note").collect()]


def test_stints(spark):
    w = (0, 100)
    assert _walk(spark, [(10, "A"), (50, "D")], w) == [(10, 50, True, True, None)]
    assert _walk(spark, [(50, "B")], w) == [(0, 50, False, True, "same-day-arrival-and-departure")]
    assert _walk(spark, [(50, "B")]) == [(None, None, False, False, "same-day-arrival-and-departure")]
    assert _walk(spark, [(150, "A")], w) == [(None, None, False, False, "arrival-after-window-end(next-season-move)")]
    assert _walk(spark, [(50, "D")], w) == [(0, 50, False, True, None)]
    assert _walk(spark, [(50, "A")], w) == [(50, 100, True, False, None)]
    assert _walk(spark, [(50, "A")]) == [(None, None, False, False, "open-stint-without-window")]
    assert _walk(spark, [(50, "D")]) == [(None, None, False, False, "departure-after-closed-stint(prior-spell-exit,or-source-noise)")]
    assert _walk(spark, [(10, "A"), (30, "A"), (40, "D")], w) == [(10, 30, True, False, "repeat-signing-prior-end-unknown"), (30, 40, True, True, None)]
    assert _walk(spark, [(10, "D"), (20, "D")], w)[0] == (0, 10, False, True, None)


def _loop(steps, ws, we):
    """The walk as a loop, to check the windows against."""
    out, opened, emitted = [], None, False
    for day, kind in sorted(steps):
        if kind == "A":
            if opened is not None:
                out.append((opened, day, True, False))
                emitted = True
            opened = day
        elif kind == "D":
            if opened is not None:
                out.append((opened, day, True, True))
                emitted, opened = True, None
            elif ws is not None and day > ws and not emitted:
                out.append((ws, day, False, True))
                emitted = True
        else:
            if opened is not None:
                out.append((opened, day, True, True))
                emitted, opened = True, None
            elif ws is not None:
                out.append((ws, day, False, True))
                emitted = True
    if opened is not None and we is not None and opened < we:
        out.append((opened, we, True, False))
    return sorted(out)


def test_windows_walk_as_a_loop_does(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(300):
        window = (None, None) if rng.random() < 0.2 else (rng.randrange(0, 20), rng.randrange(25, 60))
        steps = [(d, rng.choice("AADDB")) for d in rng.sample(range(70), rng.randrange(1, 8))]
        rows += [(f"p{i}", "t", 1, d, k, *window) for d, k in steps]
        want[f"p{i}"] = _loop(steps, *window)
    got = {}
    for r in tenure.stints(spark.createDataFrame(rows, DAYS)).filter("start_day is not null").collect():
        got.setdefault(r["player"], []).append(tuple(r)[3:7])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_anchors_collapse_and_ignore_moves_to_oneself(spark):
    legs = [("p", "X", "Y", 1, 5), ("p", "X", "Y", 1, 5), ("p", "X", "X", 1, 6), ("p", None, "X", 1, 5)]
    got = tenure.anchors(spark.createDataFrame(legs, "player string, depart string, arrive string, season int, day int")).collect()
    assert sorted(tuple(r) for r in got) == [("p", "X", 1, 5, "B"), ("p", "Y", 1, 5, "A")]


LEGS = "player string, depart string, arrive string, season int, day int, leg_flags string"
WINDOWS = "team string, season int, window_start int, window_end int"
MEMBERS = "player string, team string, season int"


def test_arrivals_between_seasons_are_copied_to_members_of_the_next(spark):
    windows = spark.createDataFrame([("H", 2001, 100, 200), ("H", 2002, 300, 400)], WINDOWS)
    rows = [("p", "X", "H", 2001, 250, None), ("p", None, "H", 2001, 150, None), ("p", None, "H", 2001, 200, None), ("p", None, "H", 2001, 300, None), ("q", "H", None, 2001, 250, None), ("r", None, "H", 2001, 250, None)]
    members = spark.createDataFrame([("p", "H", 2002), ("q", "H", 2002), ("r", "H", 2001)], MEMBERS)
    got = tenure.carry_arrivals(spark.createDataFrame(rows, LEGS).drop("leg_flags"), members, windows).collect()
    assert sorted(tuple(r) for r in got) == [("p", None, "H", 2002, 200), ("p", None, "H", 2002, 250)]


TENURE = "player string, team string, season int, start_day int, end_day int, start_anchored boolean, end_anchored boolean, evidence_class string, reasons string"


@pytest.mark.parametrize(
    ("spans", "listed", "played", "team_games", "want"),
    [
        ([(0, 45)], range(60), 60, 60, ("appearance-count-conflict", 45)),
        ([(0, 45)], range(40), 60, 60, (None, 40)),
        ([(0, 30), (30, 60)], range(60), 60, 60, (None, 60)),
        ([(0, 25)], range(71), 72, 72, ("appearance-count-conflict", 25)),
        ([(0, 45)], range(60), 46, 60, ("same-day-game-order-unresolved", 45)),
    ],
)
def test_capacity(spark, spans, listed, played, team_games, want):
    t = spark.createDataFrame([("p", "t", 1, a, b, True, True, "directly-evidenced", "") for a, b in spans], TENURE)
    games = spark.createDataFrame([("t", 1, f"g{d}", d) for d in listed], "team string, season int, game_id string, day int")
    seen = spark.createDataFrame([("p", "t", 1, played, team_games)], "player string, team string, season int, games int, team_games int")
    r = tenure.capacity_audit(t, games, seen).first()
    assert (r["review"], r["capacity"]) == want
    marked = tenure.appearance_conflicts(t, games, seen).collect()
    assert {x["evidence_class"] for x in marked} == {"unresolved" if want[0] else "directly-evidenced"}
    assert all(x["reasons"].startswith(f"{want[0]}(S2-player-games={played},S1-season-games={len(listed)},") if want[0] else not x["reasons"] for x in marked)


def test_capacity_is_not_audited_without_grounds(spark):
    games = spark.createDataFrame([("t", 1, f"g{d}", d) for d in range(60)], "team string, season int, game_id string, day int")
    seen = spark.createDataFrame([("p", "t", 1, 60, 60)], "player string, team string, season int, games int, team_games int")
    rows = lambda *spans: spark.createDataFrame([("p", "t", 1, a, b, True, True, c, "") for a, b, c in spans], TENURE)
    for t in (rows((0, 45, "inferred")), rows((0, 45, "directly-evidenced"), (None, None, "unresolved"))):
        assert tenure.capacity_audit(t, games, seen).collect() == [] and tenure.appearance_conflicts(t, games, seen).exceptAll(t).isEmpty()
    assert tenure.capacity_audit(rows((0, 45, "directly-evidenced")), games, seen.withColumn("team_games", F.lit(59))).collect() == []


def test_reconstruct_branches(spark):
    """Expected rows are worked out by hand from the rules: one player for each branch."""
    members = [("a", "X"), ("b", "X"), ("b", "Y"), ("c", "Z"), ("d", "X"), ("e", "X"), ("e", "Y"), ("f", "X"), ("f", "Y"), ("g", "X"), ("h", "X"), ("i", "X"), ("j", "X"), ("k", "Z"), ("l", "X"), ("m", "X"), ("n", "X")]
    windows = spark.createDataFrame([("X", 1, 0, 100), ("Y", 1, 0, 90)], WINDOWS)
    legs = [
        ("d", None, "X", 10, None), ("d", "X", None, 60, None), ("e", None, "X", 5, None), ("e", None, "Y", 5, None), ("f", "W", "X", 30, None), ("g", None, "X", 10, "no-date"),
        ("h", None, "X", 10, None), ("h", None, "X", 30, None), ("h", "X", None, 40, None), ("i", None, "X", 20, None), ("i", "X", None, 20, None), ("j", None, "X", 150, None), ("j", "X", None, 160, None),
        ("k", None, "Z", 7, None), ("m", "X", None, 50, None), ("m", "X", None, 55, None), ("n", "X", "X", 5, None),
    ]
    fuzzy = spark.createDataFrame([("l", 1)], "player string, season int")
    rows = tenure.reconstruct(
        spark.createDataFrame([(*m, 1, "NBA") for m in members], MEMBERS + ", league string"), windows, spark.createDataFrame([(p, d, a, 1, day, f) for p, d, a, day, f in legs], LEGS), fuzzy
    ).cache()
    got = sorted((tuple(r)[:2] + tuple(r)[3:9] for r in rows.collect()), key=str)
    sibling = "multi-team-season(ordering-unresolved): player has dated moves to other franchises this season; bracket-only stint cannot be ordered against them"
    clouded = "same-day-arrival-to-multiple-franchises(ordering-unresolved)"
    prior = "departure-after-closed-stint(prior-spell-exit,or-source-noise)"
    both = "same-day-arrival-and-departure(ordering-flagged)"
    assert got == sorted([
        ("a", "X", 0, 100, False, False, "inferred", ""), ("b", "X", 0, 100, False, False, "inferred", ""), ("b", "Y", 0, 90, False, False, "inferred", ""),
        ("c", "Z", None, None, False, False, "unresolved", "no-dated-evidence(membership-season-only; S1-window-missing-or-season-past-2022-23)"),
        ("d", "X", 10, 60, True, True, "directly-evidenced", ""), ("e", "X", None, None, False, False, "unresolved", clouded), ("e", "Y", None, None, False, False, "unresolved", clouded),
        ("f", "X", 30, 100, True, False, "cross-checked", ""), ("f", "Y", 0, 90, False, False, "unresolved", sibling),
        ("g", "X", None, None, False, False, "unresolved", "flagged-transaction-legs(no-date)"),
        ("h", "X", 10, 30, False, False, "unresolved", "repeat-signing-prior-end-unknown"), ("h", "X", 30, 40, True, True, "directly-evidenced", ""),
        ("i", "X", 0, 20, False, False, "unresolved", both), ("j", "X", 150, 160, False, False, "unresolved", "stint-entirely-outside-team-season-window(stands-on-transactions-alone)"),
        ("k", "Z", None, None, False, False, "unresolved", "no-season-window(S1-game-table-ends-2022-23-or-season-absent-from-S1); open-stint-without-window"),
        ("l", "X", None, None, False, False, "unresolved", "fuzzy-dated-rows-bear-on-this-tenure"), ("m", "X", 0, 50, False, False, "unresolved", prior),
        ("n", "X", 0, 100, False, False, "inferred", ""),
    ], key=str)
    failed = tenure.fetch_failures(rows, spark.createDataFrame([("NBA_0",), ("BAA_1949",)], "page string"))
    assert failed.exceptAll(rows).isEmpty()
    failed = tenure.fetch_failures(rows, spark.createDataFrame([("NBA_1",)], "page string")).collect()
    by = {(r["player"], r["team"]): (r["evidence_class"], r["reasons"]) for r in failed}
    assert by["d", "X"] == ("unresolved", "fetch-failure:NBA_1") and by["e", "X"] == ("unresolved", f"{clouded}; fetch-failure:NBA_1")


def test_pages_of_the_season_before_and_of_the_old_league_count(spark):
    t = [("p", "T", s, 1, 2, True, True, "directly-evidenced", "", lg) for s, lg in ((1947, "BAA"), (1949, "BAA"), (1950, "NBA"), (1951, "NBA"))]
    rows = spark.createDataFrame(t, TENURE + ", league string")
    failed = spark.createDataFrame([("BAA_1949",), ("BAA_1946",), ("NBA_1950",), ("BAA_1949",)], "page string")
    got = {r["season"]: r["reasons"] for r in tenure.fetch_failures(rows, failed).collect()}
    assert got == {1947: "", 1949: "fetch-failure:BAA_1949", 1950: "fetch-failure:BAA_1949; fetch-failure:NBA_1950", 1951: "fetch-failure:NBA_1950"}


def test_eras_go_by_league_and_season(spark):
    rows = spark.createDataFrame([("BAA", 1948), ("NBA", 1950), ("NBA", 1966), ("NBA", 1967), ("NBA", 1981), ("NBA", 2026), ("NBA", 2027), ("ABA", 1970)], "league string, season int")
    got = [r[0] for r in rows.select(days.era_label(F.col("league"), F.col("season"))).collect()]
    assert got == ["BAA 1946-49", "1950-66", "1950-66", "1967-80", "1981-99", "2000-2025/26", None, None]


def test_contracts_count_only_from_the_day_after(spark):
    rows = [("p", "t", 5, "A"), ("p", "t", 5, "D"), ("p", "t", 9, "D"), ("p", "t", 12, "A"), ("p", "t", 15, "D")]
    df = spark.createDataFrame([r for r in rows if r != ("p", "t", 5, "D")], "player string, team string, day int, kind string")
    assert [(r["day"], r["active"]) for r in tenure.active_contracts(df).orderBy("day").collect()] == [(5, False), (9, True), (12, False), (15, True)]


def test_days(spark):
    r = spark.range(1).select(
        days.day_number(F.lit("1946-01-02")).alias("d"), days.season_of(F.lit("2000-06-30").cast("date")).alias("s"), days.season_of(F.lit("2000-07-01").cast("date")).alias("t"),
        days.season_from_code(F.lit("21999")).alias("c"), days.interval_text(F.lit(0), F.lit(31)).alias("i"), F.struct(*days.month_window(F.lit(1946), F.lit(2))).alias("m"),
        days.date_precision(F.lit("January 5, 2024"))[0].alias("p1"), days.date_precision(F.lit("January ?, 1950"))[0].alias("p2"), days.date_precision(F.lit("unknown"))[0].alias("p3"),
    ).first()
    assert (r["d"], r["s"], r["t"], r["c"], r["i"], tuple(r["m"])) == (1, 2000, 2001, 2000, "[1946-01-01, 1946-02-01)", (31, 59))
    assert (r["p1"], r["p2"], r["p3"]) == ("precise", "fuzzy", "unknown")
    said = [" January  5,\n2001", "January ??, 1950", "1950", "? 1950", "January 2001", "on January 5, 2001", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(*days.date_precision(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("precise", "2001-01-05"), ("fuzzy", "1950-01"), ("fuzzy", "1950"), ("fuzzy", "1950")] + [("unknown", None)] * 4
    with pytest.raises(Exception, match="unknown bound kind"):
        spark.range(1).select(days.dated_bound(F.lit("week"), F.lit(1), F.lit(1), F.lit(1), F.lit(0), F.lit(1))[0].alias("x")).collect()


def test_as_of_needs_exactly_one(spark):
    eras = spark.createDataFrame([("F1", "N", "Reds", "RED", 1950, 1960), ("F2", "N", "Reds", "RDS", 1960, None), ("F2", "N", "Blues", "BLU", 1950, 1959)], "franchise string, league string, name string, abbreviation string, first_season int, last_season int")
    facts = spark.createDataFrame([(1, "N", 1955, "RED"), (2, "N", 1960, "Reds"), (3, "N", 1999, "Reds"), (4, "A", 1955, "RED")], "fact int, league string, season int, name string")
    assert {r["fact"]: r["franchise"] for r in reconcile.as_of(facts, eras).collect()} == {1: "F1", 2: "ambiguous", 3: "F2", 4: "unresolved"}


def test_export_reasons(spark):
    m = spark.createDataFrame([("a", "T", 1, 5, "r1"), ("b", "T", 1, 5, "r2"), ("b", "T", 1, 6, "r3"), ("c", "U", 1, 5, "r4"), ("d", "T", 1, 99, "r5")], "player string, team string, season int, games int, record string")
    g = spark.createDataFrame([("T", 1, 82, "g1")], "team string, season int, team_games int, record string")
    good, bad = reconcile.appearance_export(m, g)
    assert [r["player"] for r in good.collect()] == ["a"]
    assert {r["player"]: r["reason"] for r in bad.collect()} == {"b": "conflicting-player-games", "c": "no-team-record", "d": "games-out-of-range"}
