import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import judgments, provenance, search
from linkloom.sources import reports, transactions


def test_normal_forms():
    assert text.normalize_text("  José  O'Neal-Smith, Jr.") == "jose oneal smith jr"
    assert text.normalize_text("...") == "" and text.normalize_text(None) == ""
    assert text.canonical_text("Łukasz Øst’by-ß") == "lukasz ostbyss"
    assert text.name_variants("J.R. Smith III") == ["j r smith iii", "j r smith", "j smith"]
    assert text.name_variants("George G. Gervin") == ["george g gervin", "george gervin"] and text.name_variants("Brian Bowen II") == ["brian bowen ii", "brian bowen"]
    assert text.name_variants("Luc Richard Mbah a Moute") == ["luc richard mbah a moute", "luc richard mbah moute", "luc moute"]
    assert text.name_variants("Kelly Jr. Oubre") == ["kelly jr oubre", "kelly oubre"] and text.name_variants("Nene") == ["nene"] and text.name_variants("J R J") == ["j r j", "j j"]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_swaps_cost_one_and_no_part_is_edited_twice(a, b):
    def whole(i, j):
        if not i or not j:
            return max(i, j)
        best = min(whole(i - 1, j) + 1, whole(i, j - 1) + 1, whole(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, whole(i - 2, j - 2) + 1)
        return best

    want = whole(len(a), len(b))
    for most in (1, 2, 6):
        assert text.osa_distance(a, b, most) == (want if want <= most else None)


def test_osa_is_not_the_unrestricted_distance():
    assert text.osa_distance("ca", "abc", 3) == 3


CATALOG = [
    ("jordami01", "Michael Jordan", [], 1985, 2003, ["BULLS", "WIZARDS"]),
    ("onealsh01", "Shaquille O'Neal", ["Shaq"], 1993, 2011, ["MAGIC", "LAKERS"]),
    ("ervinju01", "Julius Erving", ["Dr. J"], 1977, 1987, ["SIXERS"]),
    ("iversal01", "Allen Iverson", ["The Answer"], 1997, 2010, ["SIXERS"]),
    ("smithjo01", "Joe Smith", [], 1996, 2011, ["WARRIORS"]),
    ("smithjo02", "Joe Smith", [], 1947, 1948, ["STAGS"]),
    ("alpha", "José Calderón", ["Jose Calderon"], 2006, 2019, ["RAPTORS"]),
]


def test_search(spark):
    c = spark.createDataFrame(CATALOG, "id string, name string, aliases array<string>, first_season int, last_season int, teams array<string>").cache()
    names = search.catalog_names(c).cache()
    find = lambda q, **more: search.search(c, names, q, **more).collect()
    assert [(r["id"], r["status"]) for r in find("Michael Jordan")] == [("jordami01", "exact_match")]
    for q, who in (("Shaq", "onealsh01"), ("Dr. J", "ervinju01"), ("Jose Calderon", "alpha")):
        assert [r["id"] for r in find(q)] == [who]
    typo = find("Micheal Jordan")
    assert [(r["id"], r["match_kind"], r["status"]) for r in typo] == [("jordami01", "typo", "candidates")]
    assert find("intergalactic banana") == [] and find("...") == []
    assert [(r["id"], r["status"], r["matches_total"]) for r in find("Smith")] == [("smithjo01", "ambiguous", 2), ("smithjo02", "ambiguous", 2)]
    one = find("Joe Smith", limit=1)
    assert [(r["status"], r["matches_total"], r["has_more"]) for r in one] == [("ambiguous", 2, True)]
    assert [r["id"] for r in find("Smith", era=1940)] == ["smithjo02"]
    # eras go by the first season; a name is hit as it is, an alias also without its spaces; several words are no token
    assert find("Erving", era=1980) == [] and [r["id"] for r in find("Erving", era=1970)] == ["ervinju01"]
    assert [r["id"] for r in find("theanswer")] == ["iversal01"] and [(r["id"], r["match_kind"]) for r in find("allenivers")] == []
    assert [(r["id"], r["match_kind"]) for r in find("jordan michael")] == [] and find("j") == []
    assert [(r["matches_total"], r["has_more"]) for r in find("", franchise="SIXERS", limit=1)] == [(2, True)]
    for bad in ({"era": 1941}, {"franchise": "NONE"}, {"limit": 0}, {"limit": 51}):
        with pytest.raises(ValueError):
            find("x", **bad)
    with pytest.raises(ValueError):
        find("x" * 161)


def test_text_columns(spark):
    r = spark.range(1).select(
        text.mention_spans(F.lit("(Joe) Smith, and")).alias("spans"), text.contains_phrase(F.lit("the Reds."), F.lit("Reds")).alias("yes"), text.contains_phrase(F.lit("Redskin"), F.lit("Red")).alias("no"),
        text.bounded_text(F.lit("abcdef"), 3).alias("cut"), text.bounded_json(F.lit('{"a":1}'), 3).alias("json"), text.surname(F.lit("bob jones jr")).alias("surname"),
    ).first()
    more = spark.range(1).select(
        text.mention_spans(F.lit("a  b\n(é)")).alias("s"), text.mention_spans(F.lit(" ")).alias("none"), text.contains_phrase(F.lit(r"the a\Eb."), F.lit(r"a\Eb")).alias("quoted")
    ).first()
    assert more["s"] == ["a", "a  b", "a  b\n(é", "b", "b\n(é", "é"] and more["none"] == [] and more["quoted"]
    assert r["spans"] == ["Joe", "Joe) Smith", "Joe) Smith, and", "Smith", "Smith, and", "and"]
    assert r["yes"] and not r["no"] and r["cut"] == "abc…" and r["json"] == '{"truncated":true,"bytes":7}' and r["surname"] == "jones"


PAGE = """<p>Transactions listed are from <strong>July 1, 2000</strong> to <strong>June 30, 2001</strong>.</p><ul><li>not this</li></ul>
<span class="x" id="transactions_link"></span><ul><li><span>January 5, 2001</span>
<p>The <a data-attr-from="ATL" href="/teams/ATL/2001.html">Hawks</a> traded <a href="/players/g/gasolpa01.html">Pau Gasol</a> to the <a data-attr-to="VAN">Grizzlies</a> for
<a href="/players/a/abdursh01.html">Shareef A.</a> and <a href="/players/t/tinslja01.html">Tinsley</a>.</p>
<li><span>January ?, 2001</span><p>The <a data-attr-to="BOS">Celtics</a> signed <a href="/players/x/xx01.html">X &amp; Y</a>. The <a data-attr-from="NYK">Knicks</a> waived <a href="/players/y/yy01.html">Y</a>.</p>
<ul><li>nested</li></ul></li></ul><ul><li><span>d</span><p><a href="/players/z/zz01.html">Z</a></p></li></ul>"""


def test_transaction_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<ul><li>x")], "page_id int, html string")
    items = transactions.page_items(pages).cache()
    assert {r["date_text"] for r in items.collect()} == {"January 5, 2001", "January ?, 2001"}
    legs = {r["slug"]: (r["depart"], r["arrive"], r["action"], r["scope"]) for r in transactions.movements(items).collect()}
    assert legs == {
        "gasolpa01": ("ATL", "VAN", "trade", "nba-roster"), "abdursh01": ("VAN", "ATL", "trade", "nba-roster"), "tinslja01": ("VAN", "ATL", "trade", "nba-roster"),
        "xx01": (None, "BOS", "sign", "nba-roster"), "yy01": ("NYK", None, "waive", "nba-roster"),
    }
    more = """<span id="transactions_link"></span><ul><li><span>June 1, 2001</span><p><a href="/players/q/qq01.html">Q</a> was not re-signed by the <a data-attr-from="NYK">Knicks</a>; contract expires.</p>
      <p>The <a data-attr-from="ATL">Hawks</a> traded <a href="/players/g/gasolpa01.html">G</a> to the <a data-attr-to="VAN">Grizzlies</a> for\n      <a href="/players/a/abdursh01.html">A</a>.</p></li></ul>"""
    page = transactions.page_items(spark.createDataFrame([(4, more)], "page_id int, html string"))
    legs = {r["slug"]: (r["depart"], r["arrive"], r["action"], r["scope"]) for r in transactions.movements(page).collect()}
    assert legs["qq01"] == ("NYK", None, "contract-expiration", "nba-roster")
    assert legs["gasolpa01"] == ("ATL", "VAN", "trade", "nba-roster") and legs["abdursh01"] == ("VAN", "ATL", "trade", "nba-roster")
    low, high = transactions.page_window(F.col("html"))
    assert tuple(pages.filter("page_id = 1").select(low, high).first()) == ("July 1, 2000", "June 30, 2001")


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("The X assigned P to the G-League", "g-league-assignment"), ("re-signed P", "resign"), ("signed P", "sign"), ("not re-signed", "other"), ("contract expires", "contract-expiration"),
        ("sold the player rights to P", "rights-transfer"), ("hired P as head coach", "coach-hire"), ("P was claimed on waivers", "claim"), ("nothing", "other"), ("signed an extension", "extension"),
    ],
)
def test_event_classes(spark, said, want):
    assert spark.range(1).select(transactions.event_class(F.lit(said)).alias("c")).first()["c"] == want


def test_eras():
    r = transactions.era_ranges
    assert r("from 1990 to 2000") == r("between 1990 and 2000") == r("1990-2000") == [(1990, 2000)]
    assert r("compare 1990 with 2000") == [(1990, 1990), (2000, 2000)] and r("the 1990s") == [(1990, 1999)]
    assert r("from 2000 to 1990") == [(2000, 2000), (1990, 1990)] and r("1945 and 2101") == [] and r(None) == []


def test_choices_and_scores(spark):
    m = lambda a, b: F.create_map(F.lit("x"), F.lit(a), F.lit("y"), F.lit(b))
    keys = F.array(F.lit("x"), F.lit("y"))
    accept = lambda p, c, k=keys, s="x": spark.range(1).select(judgments.accepted_choice(F.lit(s), p, F.lit(c), k).alias("k")).first()["k"]
    assert accept(m(0.96, 0.04), 0.96) == "x" and accept(m(0.96, 0.1), 0.96) is None and accept(m(0.9, 0.1), 0.96) is None
    assert accept(m(0.96, 0.04), 0.1) is None and accept(m(float("nan"), 0.1), 0.96) is None and accept(m(0.96, 0.04), 0.96, F.array(F.lit("x"))) is None
    # the provider's own choice is judged, not the likeliest one
    assert accept(m(0.96, 0.04), 0.96, s="y") is None and accept(m(0.96, 0.04), 0.96, s="z") is None
    assert (judgments.Policy().existence, judgments.Policy().ranking, judgments.Policy().margin) == (0.5, 0.25, 0.25)
    chains = spark.createDataFrame([(0, ["s", "b", "g"]), (1, ["s", "c", "g"])], "place int, path array<string>")
    scores = [(0, "q", [0.0, 0.0, 1.0], 2.0), (1, "q", [1.0, 0.0, 0.0], 0.0), (0, "r", [1.0, 0.0, 0.0], 0.0), (1, "r", [0.0, 0.0, 1.0], 2.0)]
    ddl = "place int, dimension string, probabilities array<double>, mean double"
    ranked = lambda s: {r["place"]: r["rank"] for r in judgments.rank_chains(chains, spark.createDataFrame(s, ddl), {"q": 0.25, "r": 0.75}).collect()}
    assert ranked(scores) == {1: 1, 0: 2}
    assert ranked(scores[:3]) == {0: 1, 1: 2} and ranked([*scores[:3], (1, "r", [0.0, 0.0, 1.0], 1.0)]) == {0: 1, 1: 2}


def test_provider_failures_leave_no_answer():
    q = judgments.Question("choice", "who", ("a", "b"))
    assert judgments.guarded(None, [q])[0].failure == "unconfigured"
    assert judgments.guarded(judgments.Scripted([[]]), [q])[0].failure == "malformed"
    assert judgments.guarded(judgments.Scripted([[judgments.Answer()] * 9]), [q] * 9)[0].failure == "payload-too-large"
    s = judgments.Scripted([[judgments.Answer({"a": 1.0})], [judgments.Answer({"b": 1.0})]])
    assert [judgments.guarded(s, [q])[0].probabilities for _ in range(3)] == [{"a": 1.0}, {"b": 1.0}, {"b": 1.0}] and s.calls == 3
    assert judgments.option_keys(["p", "q"], backwards=True) == {"o000": "q", "o001": "p"}


PLAYERS = "bbr_player_id,display_name,first_season,last_season,aba_only,s1_display_name,extra\na,Alpha,2000,2001,N,Alpha Alternative,1\nb,Beta,2000,2001,N,Beta,1\nc,Gamma,2000,2001,N,,1\nd,Delta,2000,2001,N,,1\nx,Aba,2000,2001,Y,,1\n"
HEAD = "bbr_player_id,season,lg,canonical_franchise,membership_source,evidence_class,start_day,end_day,start_anchored,end_anchored,unresolved_reasons\n"
TENURES = "a,2000,NBA,RED,m,directly-evidenced,1,5,1,1,\nb,2000,NBA,RED,m,directly-evidenced,2,4,1,1, ; \nb,2001,NBA,BLUE,m,directly-evidenced,10,13,1,1,\nc,2001,NBA,BLUE,m,directly-evidenced,11,12,1,1,\nd,2000,NBA,RED,m,inferred,1,5,0,0,\nx,2000,ABA,RED,m,directly-evidenced,1,5,1,1,\n"


def _load(spark, tmp_path, tenures=TENURES, counts=None, witnesses=None):
    def csv(name, text_, ddl):
        (tmp_path / name).write_text("﻿" + text_, encoding="utf-8")
        return reports.read_csv(spark, str(tmp_path / name), ddl)

    return reports.load(
        spark, csv("p.csv", PLAYERS, reports.PLAYERS), csv("t.csv", HEAD + tenures, reports.TENURES),
        None if counts is None else csv("c.csv", "player,team,season,lg,games,team_games,player_record,team_record\n" + counts, reports.COUNTS),
        None if witnesses is None else csv("w.csv", "a,b,team,season,game_id,date,a_source,b_source\n" + witnesses, reports.WITNESSES),
    )


def test_import(spark, tmp_path):
    r = _load(spark, tmp_path, counts="a,RED,2000,NBA,40,82,r,t\nd,RED,2000,NBA,42,82,r,t\n", witnesses="a,d,RED,2000,0029900001,1999-11-01,s,s\n")
    assert sorted((p["id"], tuple(p["aliases"]), tuple(p["teams"])) for p in r.players.collect()) == [("a", ("Alpha Alternative",), ("RED",)), ("b", (), ("BLUE", "RED")), ("c", (), ("BLUE",)), ("d", (), ("RED",))]
    assert r.tenures.count() == 4 and [g["record"] for g in r.gaps.collect()] == ["t4/tenures.csv:6"]
    assert r.counts.count() == 2 and r.witnesses.count() == 1
    c = reports.report_coverage(r).first()
    assert (c["certified"], c["excluded"], c["players_without"], c["complete"]) == (4, {"inferred": 1}, 1, False)


@pytest.mark.parametrize(
    "more",
    [
        {"tenures": TENURES + "nobody,2000,NBA,RED,m,inferred,1,5,0,0,\n"}, {"tenures": TENURES + "a,2000,NBA,RED,m,directly-evidenced,,5,1,1,\n"},
        {"counts": "a,RED,2000,NBA,80,82,r,t\nd,RED,2000,NBA,80,81,r,t\n"}, {"counts": "a,RED,2000,NBA,80,82,r,t\na,RED,2000,NBA,80,82,r2,t\n"}, {"counts": "a,BLUE,2000,NBA,1,82,r,t\n"},
        {"witnesses": "a,a,RED,2000,0029900001,1999-11-01,s,s\n"}, {"witnesses": "a,ghost,RED,2000,0029900001,1999-11-01,s,s\n"}, {"witnesses": "a,d,RED,2000,29900001,1999-11-01,s,s\n"},
        {"witnesses": "a,d,RED,2000,0029900001,1997-11-01,s,s\n"},
    ],
)
def test_import_fails_on_bad_rows(spark, tmp_path, more):
    with pytest.raises(reports.ImportFailure):
        _load(spark, tmp_path, **more)


def test_lookups_and_digests(spark, tmp_path):
    ddl = "player string, team string, record string"
    sure, gaps = spark.createDataFrame([("a", "X", "r2"), ("a", "X", "r1")], ddl), spark.createDataFrame([("a", "X", "r0"), ("b", "X", "r3")], ddl)
    wanted = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "X")], "player string, team string")
    assert sorted(tuple(r) for r in provenance.record_lookup(sure, gaps, wanted).collect()) == [("a", "X", "certified", "r1"), ("b", "X", "gap", "r3"), ("c", "X", "not_found", None)]
    for name in ("one", "two"):
        (tmp_path / name).write_text(name)
    before = provenance.file_digests(spark, str(tmp_path)).collect()
    (tmp_path / "two").write_text("changed")
    (tmp_path / "three").write_text("new")
    old = spark.createDataFrame(before, "path string, length long, sha256 string")
    got = {r["path"].rsplit("/", 1)[-1]: r["problem"] for r in provenance.altered_files(old, provenance.file_digests(spark, str(tmp_path))).collect()}
    assert got == {"two": "changed", "three": "unexpected"}
    rng = random.Random(0)
    df = spark.createDataFrame([(i, rng.random()) for i in range(50)], "a int, b double")
    a, b = (provenance.snapshot_identity({"t": x}).first() for x in (df, df.orderBy(F.desc("b"))))
    assert a == b and a["rows"] == 50
