import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.operators import draft_guard, identity, order
from linkloom.plans import person_queries

PERSON = "id string, names array<string>, born date, first_season int, last_season int, other_league_only boolean"


def _bridge(spark, left, right):
    """Rules and persons by left id; births are given as texts, careers as pairs."""
    row = lambda id_, names, born, span=(None, None), other=False: (id_, names if isinstance(names, list) else [names], date.fromisoformat(born) if born else None, *span, other)
    found = identity.bridge(spark.createDataFrame([row(*x) for x in left], PERSON), spark.createDataFrame([row(*x) for x in right], PERSON))
    return {r["left"]: (r["rule"], r["right"], r["form"]) for r in found.collect()}


def test_published_bridge_cases(spark):
    """The names, births and careers by which the rules are described."""
    got = _bridge(spark, [("1", ["charles kupec", "kupec charles"], "1953-01-16")], [("kupeccj01", "C.J. Kupec", "1953-01-26"), ("charlke01", "Ken Charles", "1951-07-10")])
    assert got["1"][:2] == ("initial-surname+dob-window", "kupeccj01")
    got = _bridge(spark, [("1", "herbert hill", "1984-10-01", (2008, 2008))], [("hillgr01", "Grant Hill", "1972-10-05", (1995, 2013)), ("hillge01", "George Hill", "1986-05-04", (2009, 2023))])
    assert got["1"][0] == "no-match"
    got = _bridge(spark, [("1", "johnny kerr", "1932-08-17", (1955, 1966))], [("kerrre01", "Red Kerr", "1932-07-17", (1955, 1966)), ("kerrst01", "Steve Kerr", "1965-09-27", (1989, 2003))])
    assert got["1"] == ("surname+career-span", "kerrre01", "")
    got = _bridge(spark, [("1", "buckshot obrien", "1928-04-28", (1952, 1953))], [("obriebo01", "Bob O'Brien", "1927-01-26", (1948, 1949)), ("obriera01", "Ralph O'Brien", "1928-04-08", (1952, 1953))])
    assert got["1"][0] == "no-match"
    got = _bridge(spark, [("1", "norman richardson", "1977-07-24")], [("richano01", "Norm Richardson", "1979-07-24")])
    assert got["1"][:2] == ("initial-surname+dob-window", "richano01")


def test_each_rule_and_odd_rows(spark):
    right = [
        ("a", "José Calderón", "1981-09-28"), ("b", "Rod Strickland", "1966-07-11"), ("c", "Solo Unknown", None), ("d", "Dob Conflict", "1970-01-01"), ("e", "F Crossin", "1923-01-01"),
        ("f1", "Twin Name", "1960-02-02"), ("f2", "Twin Name", "1960-02-02"), ("g1", "Same Person", "1950-01-01"), ("g2", "Same Person", "1990-01-01"), ("h", "Ann Rickert", "1955-05-05"),
        ("z", "Aba Only", None, (None, None), True), ("y", "Aba Dated", "1940-01-01", (None, None), True), (None, "José Calderón", "1981-09-28"), ("n", [], None),
    ]
    left = [
        ("1", "Jose Calderon", "1981-09-28"), ("2", "Roderick Strickland", "1966-07-11"), ("3", "Solo Unknown Jr.", "1960-01-01"), ("4", "Dob Conflict", "1971-05-05"), ("5", "Fr Crossin", None),
        ("6", "Twin Name", "1960-02-02"), ("7", "Same Person", None), ("8", "Al Rickerd", "1956-09-09"), ("9", "Aba Only", "1950-01-01"), ("10", "Aba Dated", "1950-01-01"), ("11", None, None), ("12", ["", "..."], None), (None, "x", None),
    ]
    got = _bridge(spark, left, right)
    assert got == {
        "1": ("name+dob", "a", "jose calderon"), "2": ("lastname+dob", "b", "roderick strickland"), "3": ("name-match-s2-dob-NA", "c", "solo unknown"), "4": ("DOB-conflict", "d", "dob conflict"),
        "5": ("initial+surname", "e", "fr crossin"), "6": ("ambiguous-name+dob", None, "twin name"), "7": ("ambiguous-name", None, "same person"), "8": ("surname-fuzzy+dob-window", "h", "al rickerd"),
        "9": ("matches-ABA-only-player", "z", "aba only"), "10": ("no-match", None, None), "11": ("no-match", None, None), "12": ("no-match", None, None),
    }
    assert set(_bridge(spark, left, [])) == {str(i) for i in range(1, 13)} and _bridge(spark, [], right) == {}


def test_a_name_of_thousands_stays_a_row(spark):
    left = [(f"l{i}", "John Smith", f"19{50 + i % 40}-01-0{1 + i % 9}") for i in range(2000)]
    right = [(f"r{i}", "John Smith", f"19{50 + i % 40}-02-1{i % 9}") for i in range(2000)] + [("one", "John Smith", "1950-01-01")]
    got = _bridge(spark, left, right)
    assert {r for r, _, _ in got.values()} == {"name+dob", "ambiguous-name"} and got["l0"] == ("name+dob", "one", "john smith")


def test_supplements_and_aliases(spark):
    """The identities by which the supplement is described."""
    classed = spark.createDataFrame([("42", None, identity.PLAYED, None), ("43", None, identity.INACTIVE, None), ("44", "known01", "name+dob", None), ("45", "aba01", "matches-ABA-only-player", None), ("46", None, identity.PLAYED, None)], "left string, right string, rule string, form string")
    names = spark.createDataFrame([("42", "Playoff Only"), ("43", "Inactive Only"), ("44", "Already Known"), ("45", "ABA Only"), ("46", "")], "id string, name string")
    games = spark.createDataFrame([(2022, "42", "MIL"), (2022, "44", "MIL"), (2022, "46", "MIL"), (2021, "42", "MIL"), (2022, "42", "BOS")], "season int, id string, team string")
    assert [tuple(r) for r in identity.official_supplements(classed, names, games).collect()] == [("42", "nba:42", "Playoff Only", [2021, 2022])]
    bridged = spark.createDataFrame([("1", None, "no-match", None), ("2", "r", "name+dob", "x"), ("3", None, "no-match", None), ("4", None, "no-match", None), ("5", None, "no-match", None)], "left string, right string, rule string, form string")
    named = spark.createDataFrame([("1", "Ál Ias"), ("2", "Al Ias"), ("3", "Other"), ("4", None)], "id string, name string")
    aliased = identity.with_aliases(bridged, named, spark.createDataFrame([("al ias", "t")], "name string, right string"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    years = spark.createDataFrame([("5", 2024), ("4", 2023)], "id string, first_year int")
    got = {r["left"]: (r["rule"], r["right"]) for r in identity.with_subclasses(aliased, ids("3", "3", None), ids("3", "4"), years).collect()}
    assert got == {"1": ("curated-alias-pbp-only", "t"), "2": ("name+dob", "r"), "3": (identity.PLAYED, None), "4": (identity.INACTIVE, None), "5": (identity.LATE_DEBUT, None)}


LEG = "row long, leg long, date date, date_precision string, league string, slug string, scope string, action string, depart string, arrive string"


def _guarded(legs, entrants):
    """The guard as a loop over days; legs are dicts in the order of the source."""
    active, held = {}, set()
    for day in sorted({x["date"] for x in legs}):
        todo = []
        for x in (x for x in legs if x["date"] == day and x["date_precision"] == "precise" and x["league"] in ("NBA", "BAA")):
            known = active.get(x["slug"], set())
            if x["scope"] == "nba-roster" and x["action"] == "trade" and day.year in entrants.get(x["slug"], ()) and x["depart"] not in known:
                held.add((x["row"], x["leg"]))
            elif x["scope"] == "nba-roster":
                todo.append(x)
        for x in todo:
            mine = active.setdefault(x["slug"], set())
            mine.discard(x["depart"])
            if x["arrive"] and x["action"] in ("sign", "resign", "claim", "trade", "dispersal"):
                mine.add(x["arrive"])
    return held


def _context(spark, drafted, first):
    row = "season string, league string, player string"
    return spark.createDataFrame([(str(y), "NBA", p) for p, y in drafted], row), spark.createDataFrame([(str(y), "NBA", p) for p, y in first], row)


@pytest.mark.parametrize("seed", [1, 2])
def test_guard_equals_a_loop_over_days(spark, seed):
    rng = random.Random(seed)
    legs = []
    for k in range(600):
        depart, arrive = rng.choice([None, "A", "B", "C"]), rng.choice([None, "A", "B", "C"])
        legs.append({
            "row": k // 2, "leg": k % 2, "date": date(2014, 11, 1) + timedelta(days=rng.randrange(60)) if k % 2 == 0 else legs[-1]["date"],
            "date_precision": "fuzzy" if rng.random() < 0.1 else "precise", "league": rng.choice(["NBA", "NBA", "BAA", "ABA"]), "slug": rng.choice(["p", "q", "r", "s", "hot", "hot"]),
            "scope": rng.choice(["nba-roster"] * 4 + ["non-roster"]), "action": rng.choice(["trade", "trade", "sign", "waive", "dispersal"]), "depart": depart, "arrive": arrive,
        })
    drafts, seasons = _context(spark, [("p", 2014), ("q", 2014), ("q", 2015), ("r", 2015), ("hot", 2014), ("hot", 2015), ("x", 2014)], [("p", 2015), ("r", 2015), ("hot", 2016)])
    entrants = {"p": {2014}, "q": {2014, 2015}, "hot": {2014, 2015}}
    found = draft_guard.guard(spark.createDataFrame([tuple(x.values()) for x in legs], LEG), drafts, seasons).collect()
    held = _guarded(legs, entrants)
    assert {(r["row"], r["leg"]) for r in found if r["action"] == "draft-roster-status-unresolved"} == held and len(found) == len(legs) and held
    scopes = {}
    for x in legs:
        scopes.setdefault(x["row"], set()).add("unresolved" if (x["row"], x["leg"]) in held else x["scope"])
    assert all(r["row_scope"] == (next(iter(scopes[r["row"]])) if len(scopes[r["row"]]) == 1 else "mixed") for r in found)


def _story(spark, events, drafted, first):
    """(slug, date, action after the guard) of one-leg rows."""
    rows = [(i, 0, date.fromisoformat(d), "precise", "NBA", slug, "nba-roster", action, depart, arrive) for i, (d, slug, action, depart, arrive) in enumerate(events)]
    found = draft_guard.guard(spark.createDataFrame(rows, LEG), *_context(spark, drafted, first))
    return [r["action"] for r in found.orderBy("row").collect()]


def test_published_guard_cases(spark):
    """The players and days by which the guard is described."""
    held, rookie = "draft-roster-status-unresolved", ([("oubreke01", 2015)], [("oubreke01", 2016)])
    trade, sign = ("2015-06-25", "oubreke01", "trade", "ATL", "WAS"), ("2015-07-09", "oubreke01", "sign", None, "WAS")
    assert _story(spark, [trade, sign], *rookie) == [held, "sign"]
    later = ("2015-07-10", "oubreke01", "trade", "WAS", "BOS")
    assert _story(spark, [trade, sign, later], *rookie) == [held, "sign", "trade"]
    assert _story(spark, [trade, ("2015-06-26", "oubreke01", "trade", "WAS", "BOS")], *rookie) == [held, held]
    assert _story(spark, [sign, ("2015-07-09", "oubreke01", "trade", "WAS", "BOS")], *rookie) == ["sign", held]
    first = ("2015-07-01", "oubreke01", "sign", None, "ATL")
    last = ("2015-07-03", "oubreke01", "trade", "ATL", "WAS")
    assert _story(spark, [first, last], *rookie) == ["sign", "trade"]
    assert _story(spark, [first, ("2015-07-02", "oubreke01", "waive", "ATL", None), last], *rookie) == ["sign", "waive", held]
    veteran = ([("oubreke01", 2015), ("hardati02", 2013)], [("oubreke01", 2016), ("hardati02", 2014)])
    assert _story(spark, [trade, ("2015-06-25", "hardati02", "trade", "NYK", "ATL")], *veteran) == [held, "trade"]


def test_guard_without_context_judges_nothing(spark):
    legs = spark.createDataFrame([(1, 0, date(2015, 6, 25), "precise", "NBA", "p", "nba-roster", "trade", "A", "B"), (2, 0, None, "unknown", None, None, None, None, None, None)], LEG)
    drafts, seasons = _context(spark, [("p", 2015)], [])
    assert {r["scope_reason"] for r in draft_guard.guard(legs, None, seasons).collect()} == {draft_guard.ABSENT}
    assert draft_guard.guard_summary(legs, drafts, None).first()["applied"] is False
    judged = draft_guard.guard(legs, drafts, seasons)
    assert tuple(draft_guard.guard_summary(judged, drafts, seasons).first()) == (True, None, 1, 1, 1)
    assert draft_guard.guard(legs.limit(0), drafts, seasons).collect() == []


def test_places_and_running_values(spark):
    rng = random.Random(3)
    keys = [rng.randrange(50) for _ in range(500)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(7)
    got = order.positions(df, ["k"], "at", ["i"]).collect()
    assert [(r["k"], r["i"]) for r in sorted(got, key=lambda r: r["at"])] == sorted(zip(keys, range(500), strict=True)) and {r["at"] for r in got} == set(range(500))
    assert order.positions(df.limit(0), ["k"], "at").collect() == []
    rows = [(g, p, rng.choice([None, 1, 2, 3])) for g in "ab" for p in rng.sample(range(-200, 200), 90)]
    table = spark.createDataFrame(rows, "g string, p long, x long")
    for r in order.before(table, ["g"], "p", "x", "sum", span=4, levels=2).collect():
        assert (r["sum"] or 0) == sum(x or 0 for g, p, x in rows if g == r["g"] and p < r["p"])
    spread = order.before(table.filter("g = 'a'").withColumn("q", -F.col("p")), [], "q", "p", "next", "min", span=5, levels=3)
    for r in spread.collect():
        assert r["next"] == min((p for g, p, _ in rows if g == "a" and p > r["p"]), default=None)


def test_several_running_values_go_by_the_same_windows(spark):
    rng = random.Random(4)
    rows = [(p, rng.choice([None, 1, 2, 3]), p if p % 7 == 0 else None) for p in range(300)]
    table = spark.createDataFrame(rows, "p long, x long, y long")
    both = order.before_all(table, [], "p", {"sum": ("x", "sum"), "last": ("y", "last")}, span=5, levels=2)
    for r in both.collect():
        assert (r["sum"] or 0) == sum(x or 0 for p, x, _ in rows if p < r["p"]) and r["last"] == max((y for p, _, y in rows if y is not None and p < r["p"]), default=None)
    windows = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Window ")
    assert windows(both) == windows(order.before(table, [], "p", "x", "sum", span=5, levels=2))


def test_person_queries_run(spark):
    for name, query in person_queries.QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
