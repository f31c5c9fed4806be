import hashlib
import json
import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.operators import audit, facts, layout, neighbourhood, page_ranking, phrases
from linkloom.sources import incremental, reports
from linkloom.streaming import rings


def _says(text, phrase):
    """Whether a phrase stands whole in a text, letter by letter."""
    text, phrase = text.lower(), phrase.lower()
    at = text.find(phrase) if phrase else -1
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or not text[at - 1].isalnum()) and (end == len(text) or not text[end].isalnum()):
            return True
        at = text.find(phrase, at + 1)
    return False


def test_phrases_equal_a_search_for_each(spark):
    rng = random.Random(6)
    words = ["la", "LA", "st.", "louis", "Hawks", "76ers", "x-y", "(the", "é", "new", "york", "Σίγμα"]
    said = lambda n: rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(n))
    texts = [(i, said(rng.randrange(30))) for i in range(60)] + [(60, None), (61, ""), (62, "xLA la2"), (1, "louis new york"), (63, "new york " * 5000 + "Hawks!")]
    made = sorted({said(rng.randrange(1, 6)) for _ in range(150)} | {"LA", "St. Louis", "new york", "76ers", "***", "", "York Hawks"})
    named = list(enumerate(made)) + [(1000, made[5]), (1001, None)]
    got = phrases.phrase_matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(named, "phrase_id long, phrase string"))
    want = {(i, k, p) for i, t in texts if t is not None for k, p in named if p is not None and re.search(r"\w", p) and _says(t, p)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_ten_thousand_phrases_in_one_pass(spark):
    named = spark.createDataFrame([(i, f"team {i} of town {i % 100}") for i in range(10_000)], "phrase_id long, phrase string")
    texts = spark.createDataFrame([(j, f"Once team {j} of town {j % 100}, then team {j} of town {(j + 1) % 100}") for j in range(0, 10_000, 7)], "id long, text string")
    assert sorted((r["id"], r["phrase_id"]) for r in phrases.phrase_matches(texts, named).collect()) == [(j, j) for j in range(0, 10_000, 7)]


def test_team_candidates(spark):
    teams = spark.createDataFrame([("HAWKS", "Atlanta Hawks"), ("LAKERS", "Los Angeles Lakers")], "id string, name string")
    cross = spark.createDataFrame([("St. Louis Hawks", "STL", "HAWKS"), ("Minneapolis Lakers", "MNL", "LAKERS"), ("Old Team", "OLD", "GONE")], "name string, abbreviation string, team string")
    texts = [(1, "the st. louis hawks and MNL"), (2, "old team"), (3, "Hawks"), (4, "stlx"), (5, "Atlanta  Hawks"), (6, "LAKERS!")]
    got = {r["id"]: r["teams"] for r in phrases.team_candidates(spark.createDataFrame(texts, "id int, text string"), teams, cross).collect()}
    assert got == {1: ["HAWKS", "LAKERS"], 3: ["HAWKS"], 5: ["HAWKS"], 6: ["LAKERS"]}


def test_planted_faults_are_found(spark):
    df = lambda rows, a="a", b="b": spark.createDataFrame(rows, f"{a} string, {b} string")
    players = spark.createDataFrame([(x,) for x in "abcdefgh"] + [("a",), (None,)], "id string")
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("g", "f"), ("h", "h"), ("a", "z")]
    links = [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("c", "b"), ("d", "e"), ("e", "d"), ("f", "g"), ("g", "f"), ("c", "d"), ("a", "z"), ("z", "a")]
    proofs = [[("a", "b"), ("a", "c"), ("f", "g"), ("a", "z")], [("b", "c"), ("b", "d"), ("a", "b"), ("h", "h")]]
    got = audit.audit_links(df(edges), df(links, "node", "other"), [df(p) for p in proofs], df([("b", "a"), ("f", "a")]), df([("c", "b"), ("a", "d"), (None, "x")]), players)
    found = {tuple(r) for r in got.collect()}
    assert found == {
        ("a", "c", "one-way"), ("d", "e", "unsupported"), ("b", "d", "missing-proved"), ("c", "d", "stray-link"), ("a", "f", "missing-known"), ("b", "c", "forbidden"),
        ("f", "g", "disordered"), ("h", "h", "self-link"), ("a", "z", "unknown-player"),
    }
    sound = [("a", "b"), ("b", "c")]
    both = sound + [(y, x) for x, y in sound]
    assert audit.audit_links(df(sound), df(both, "node", "other"), [df(sound)], df([("b", "a")]), df([("a", "c")]), players).collect() == []
    summary = audit.audit_summary(df(sound), {"interval": df(sound), "witness": df(sound[:1] * 2)}, got, players.filter("id is not null")).first().asDict()
    assert summary == {"total_edges": 2, "interval_pairs": 2, "witness_pairs": 1, "isolates": 5, "unsupported_edges": 1, "missing_proved_edges": 1}


def test_nearest_edge_equals_brute_force(spark):
    rng = random.Random(9)
    at = lambda: round(rng.uniform(-900, 900), 3)
    segments = [(f"e{i:03d}", at(), at(), at(), at()) for i in range(80)] + [("up", 5.0, -900.0, 5.0, 900.0), ("dot", 40.0, 40.0, 40.0, 40.0), ("flat", -900.0, 80.0, 900.0, 80.0), ("copy", 5.0, -900.0, 5.0, 900.0), ("none", None, 0.0, 1.0, 1.0)]
    clicks = [(i, at(), at()) for i in range(300)] + [(300, 5.0, 3.0), (301, 42.0, 41.0), (302, None, 1.0), (303, 100.0, 88.0), (304, 1e6, 1e6)]

    def away(x, y, x1, y1, x2, y2):
        w, h = x2 - x1, y2 - y1
        t = 0 if w == h == 0 else min(max(((x - x1) * w + (y - y1) * h) / (w * w + h * h), 0), 1)
        return math.hypot(x - x1 - t * w, y - y1 - t * h)

    want = {}
    for k, x, y in clicks:
        near = [(away(x, y, *s[1:]), s[0]) for s in segments if None not in s and x is not None]
        if near and min(near)[0] < 8:
            want[k] = min(near)
    found = layout.nearest_edge(spark.createDataFrame(segments, "edge string, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(clicks, "click int, x double, y double"), cell=50.0)
    got = {r["click"]: (r["distance"], r["edge"]) for r in found.collect()}
    assert got.keys() == want.keys() and got[300][1] == "copy"
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in got)


def test_record_numbers_of_split_and_several_files(spark, tmp_path):
    rows = [f"r{i},{i}" for i in range(5000)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.csv").write_text("﻿name,n\n" + "\n".join(rows) + "\n")
    (tmp_path / "one/b.csv").write_text("﻿name,n\n" + "\n".join(rows[:10]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = reports.read_csv(spark, str(tmp_path / "one"), "name string, n int", multiline=False)
        assert got.rdd.getNumPartitions() > 5 and got.count() == 5010
        assert got.filter("record_no <> n + 2").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "lines.csv").write_text('name,n\n"a\nb",0\n"c\n\nd",1\nplain,2\n')
    table = reports.read_csv(spark, str(tmp_path / "lines.csv"), "name string, n int")
    facts_ = spark.createDataFrame([(k, p) for k, p in enumerate(["lines.csv:2", "lines.csv:3", "lines.csv:4", "lines.csv:5", "other.csv:2", "lines.csv", None, "lines.csv:99999999999999999999"])], "k int, pointer string")
    got = {r["k"]: (r["resolved"], r["source_name"]) for r in audit.resolve_pointers(facts_, "pointer", table, "lines.csv", ["name"]).collect()}
    assert got == {0: (True, "a\nb"), 1: (True, "c\n\nd"), 2: (True, "plain")} | {k: (False, None) for k in range(3, 8)}


def test_reports_are_written_in_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n"))
    reports.write_report(df, str(tmp_path / "parts"), ["n"], files=5)
    reports.write_report(df, str(tmp_path / "whole"), ["n"], files=1)
    for name, many in (("parts", True), ("whole", False)):
        files = sorted((tmp_path / name).glob("part-*.csv"))
        lines = [x for f in files for x in f.read_text().splitlines()[1:]]
        assert [int(x) for x in lines] == list(range(1000)) and (len(files) > 1) is many


def test_facts_of_players_and_connections(spark):
    players = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "id string, name string")
    context = spark.createDataFrame([("a", "Ann", ["x"], ["T2", "T1"], 1990, 1999)], "id string, name string, aliases array<string>, teams array<string>, first_season int, last_season int")
    tenures = spark.createDataFrame([("a", "T1", 1, 5), ("b", "T1", 2, 9), ("b", "T0", 20, 30)], "player string, team string, start_day int, end_day int")
    degrees = spark.createDataFrame([("a", 1), ("b", 2)], "id string, degree long")
    got = {r["id"]: r for r in facts.node_facts(players, context, tenures, degrees).collect()}
    assert (got["a"]["name"], got["a"]["era"], got["a"]["teams"], got["a"]["debut_season"]) == ("Ann", "1990–1999 seasons", ["T2", "T1"], 1990)
    assert (got["b"]["era"], got["b"]["teams"], got["b"]["debut_season"], got["b"]["degree"]) == ("Synthetic fixture days 2–30", ["T0", "T1"], None, 2)
    assert (got["c"]["era"], got["c"]["teams"], got["c"]["degree"]) == ("Synthetic fixture; no roster tenure", [], 0)
    assert {r["era"] for r in facts.node_facts(players, None, tenures, degrees).collect()} == {"Synthetic fixture days 1–5", "Synthetic fixture days 2–30", "Synthetic fixture; no roster tenure"}
    row = "a string, b string, kind_rank int, team string, season int, game_id string, overlap_days long, minimum_shared_games int, a_games int, b_games int, team_games int, date date"
    rows = spark.createDataFrame([("a", "b", 0, "T1", None, None, 3, None, None, None, None, None), ("b", "c", 1, "T0", 2000, None, None, 4, 5, 5, 6, None)], row)
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "node string, other string")
    ask = lambda x, y, reports_=True: [r.asDict() for r in facts.connection(links, players, rows, x, y, reports_).orderBy("place").collect()]
    first, second = ask("c", "a")
    assert (first["from"], first["to"], first["context"], first["degree"]) == ("c", "b", "at least 4 shared games", 2)
    assert (second["context"], second["overlap_days"]) == ("3 overlapping days · inspect evidence for dates", 3)
    assert ask("a", "d")[0]["certainty"] == "unresolved_coverage" and ask("a", "d", False)[0]["certainty"] == "verified_disconnected"
    assert (ask("nobody", "else")[0]["missing"], ask("a", "else")[0]["missing"]) == ("nobody", "else") and ask("a", "a")[0]["degree"] == 0
    whole = facts.connect(rows, players, "a", "c", True).first()
    view = facts.connect(rows, players, "a", "c", True, rows.filter("kind_rank = 0")).first()
    assert (whole["degree"], whole["certainty"], whole["scope"], whole["unfiltered_degree"]) == (2, "unresolved_coverage", "full_graph", None)
    assert (view["result"], view["degree"], view["certainty"], view["unfiltered_degree"]) == ("disconnected", None, "filtered_view", 2)
    assert [r["id"] for r in facts.neighbours(rows, players.withColumn("teams", F.array()), "b", False).orderBy("id").collect()] == ["a", "c"]


def _envelope(request, level=1, confidence=0.9, **changes):
    answers = {k: {"type": "score", "score": float(level), "probabilities": {"0": 0.0, "1": 0.0, "2": 0.0} | {str(level): 1.0}, "confidence": confidence} for k in request["questions"]}
    return json.dumps({"answers": answers | changes})


def _by_number(key, request):
    answers = json.loads(_envelope(request))["answers"]
    for i, c in enumerate(request["chains"]):
        for name in ("era", "fit"):
            answers[f"chain_{i:02d}_{name}"] |= {"score": float(c["n"] % 3), "probabilities": {str(k): float(k == c["n"] % 3) for k in range(3)}}
    return json.dumps({"answers": answers})


def _fails_in_second_batch(key, request):
    if request["chains"][0]["n"] >= 4:
        raise TimeoutError("no answer")
    return _by_number(key, request)


def _pages(spark, sizes):
    rows = [(p, k, json.dumps({"n": k})) for p, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "page string, place long, chain string")


@pytest.mark.parametrize("backwards", [False, True])
def test_pages_are_ranked_whole_or_not_at_all(spark, backwards):
    pages = _pages(spark, {"many": 10, "few": 3, "one": 1})
    ranking = page_ranking.Ranking("long careers", backwards=backwards)
    read = lambda ask, r=ranking: {p: [(x["place"], x["status"], x["reason"]) for x in sorted(rows, key=lambda x: x["rank"])] for p, rows in _grouped(page_ranking.rank_pages(pages, r, ask)).items()}
    got = read(_by_number)
    assert [p for p, _, _ in got["many"]] == sorted(range(10), key=lambda n: (-(n % 3), n)) and got["many"][0][1:] == ("ranked", "semantic_suggestion")
    assert got["one"] == [(0, "deterministic", "only_alternative")]
    broken = read(_fails_in_second_batch)
    assert broken["many"] == [(k, "unavailable", "semantic_unavailable") for k in range(10)] and broken["few"][0][:2] == (2, "ranked")
    assert read(None)["few"] == [(k, "unavailable", "semantic_unavailable") for k in range(3)]
    doubtful = lambda key, request: _envelope(request, confidence=0.2)
    assert read(doubtful)["few"] == [(k, "uncertain", "low_confidence") for k in range(3)]
    lopsided = lambda key, request: _envelope(request, **{k: json.loads(_envelope(request, confidence=0.1))["answers"][k] for k in request["questions"] if k.endswith("fit")})
    assert read(lopsided, page_ranking.Ranking("x", 1.0, 0.0, backwards=backwards))["few"][0][1] == "ranked"
    for bad in ("{", "[]", '{"answers": {}}', '{"answers": {"chain_00_era": {"type": "score"}}}', None):
        assert read(lambda key, request, bad=bad: bad)["few"][0][1] == "unavailable"
    short = lambda key, request: json.dumps({"answers": dict(list(json.loads(_envelope(request))["answers"].items())[1:])})
    assert read(short)["few"][0][1] == "unavailable"


def _grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["page"], []).append(r)
    return out


def test_a_request_is_keyed_by_its_whole_text():
    for ranking in (page_ranking.Ranking("long é"), page_ranking.Ranking("x", backwards=True, era_levels=("a", "b"))):
        for n in (1, 3, 4):
            request = ranking.request([json.dumps({"z": k, "a": "é", "n": [k]}) for k in range(n)])
            assert ranking.key(request) == hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()
            assert list(request["questions"]) == [f"chain_{i:02d}_{name}" for i in range(n) for name in ("era", "fit")]
            request["questions"]["chain_00_era"]["criteria"].append("more")  # a judge's own copy
            assert ranking.request(["{}"])["questions"]["chain_00_era"]["criteria"] == list(ranking.era_levels)


def test_judging_builds_what_is_the_same_for_all_pages_once(monkeypatch):
    """The figure that grew too dear is time in Python for each page: a key's fixed part is written once, whatever the number of requests."""
    ranking, said = page_ranking.Ranking("only here"), []
    dumps = json.dumps
    monkeypatch.setattr(page_ranking.json, "dumps", lambda x, **how: said.append(x) or dumps(x, **how))
    for k in range(50):
        ranking.key(ranking.request([dumps({"n": k})] * 4))
    assert sum("questions" in x for x in said) == 1 and len(said) == 51


def test_envelopes_are_read_strictly():
    ok = {"type": "choice", "choice": "o000", "probabilities": {"o000": 1}, "confidence": 0.5}
    assert page_ranking.parse_envelope(json.dumps({"answers": {"q": ok, "r": {"type": "noul", "noul": 0.5}}}))["q"]["value"] == "o000"
    for bad in ({"confidence": "0.5"}, {"choice": 1}, {"probabilities": [1]}, {"probabilities": {"o000": None}}, {"type": "other"}, {"confidence": True}, {"type": "score"}):
        assert page_ranking.parse_envelope(json.dumps({"answers": {"good": ok, "q": ok | bad}})) is None
    score = {"type": "score", "score": 1, "probabilities": {"10": 0.5, "2": 0.5}, "confidence": 1}
    assert list(page_ranking.parse_envelope(json.dumps({"answers": {"q": score}}))["q"]["probabilities"]) == [2, 10]
    assert page_ranking.parse_envelope(json.dumps({"answers": {"q": score | {"probabilities": {"256": 1.0}}}})) is None
    for wrong in ({"interest": " "}, {"interest": "x" * 161}, {"era_weight": -1.0}, {"era_weight": 0.0, "interest_weight": 0.0}, {"era_levels": ("a",)}, {"confidence": 2.0}):
        with pytest.raises(ValueError):
            page_ranking.Ranking(**({"interest": "x"} | wrong))


def test_stream_rings_equal_the_last_records(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), start + timedelta(seconds=rng.randrange(500)), i) for i in range(900)] + [("rare", start, 1000), ("cold", None, 7)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], "kind string, at timestamp, id long").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, at timestamp, id long").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    for idle in (None, "1 hour"):
        got = {r["kind"]: r["ids"] for r in rings.replay(rings.rings(stream, 20, idle), f"rings-{idle is None}").collect()}
        want = {}
        for kind, at, i in sorted((r for r in rows if None not in r), key=lambda r: r[1:]):
            want[kind] = [*want.get(kind, []), i][-20:]
        assert got == want


def test_only_changed_pages_are_parsed(spark, tmp_path):
    store, seen = str(tmp_path / "store"), []

    def parse(pages):
        seen.append(sorted(r["page_id"] for r in pages.collect()))
        return pages.filter("html <> 'empty'").select("page_id", F.explode(F.split("html", ",")).alias("row"))

    table = lambda rows: spark.createDataFrame(rows, "page_id long, html string, bucket int")
    pages = {i: f"a{i},b{i}" for i in range(30)} | {30: None, 31: "empty"}
    read = lambda: sorted((r["page_id"], r["row"]) for r in incremental.read(spark, store).collect())
    want = lambda p: sorted((k, x) for k, v in p.items() if v and v != "empty" for x in v.split(","))
    rows = [(k, v, 1) for k, v in pages.items()] + [(3, pages[3], 2), (None, "x", 1)]
    assert incremental.update(table(rows), store, parse, 4) == {"parsed": 32, "kept": 0, "removed": 0} and read() == want(pages)
    assert incremental.update(table(rows), store, parse, 4) == {"parsed": 0, "kept": 32, "removed": 0} and len(seen) == 1
    pages[5] = "new"
    del pages[9]
    again = table([(k, v, 1) for k, v in pages.items()])
    assert incremental.update(again, store, parse, 4) == {"parsed": 1, "kept": 30, "removed": 1} and seen[-1] == [5] and read() == want(pages)
    assert incremental.update(again, store, parse, 4) == {"parsed": 0, "kept": 31, "removed": 0} and read() == want(pages)
    assert incremental.update(again.limit(0), store, parse, 4)["removed"] == 31 and read() == []


def test_a_log_is_not_doubled(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("request", 1), ("failure", 2)], "kind string, n int")
    for run in ("r1", "r2", "r1"):
        incremental.append_log(rows, path, run)
    got = incremental.read_log(spark, path, "kind string, n int").collect()
    assert sorted((r["run"], r["kind"], r["n"]) for r in got) == [("r1", "failure", 2), ("r1", "request", 1), ("r2", "failure", 2), ("r2", "request", 1)]
    with pytest.raises(ValueError):
        incremental.append_log(rows.drop("kind"), path, "r3")


def test_visibility_and_walks(spark):
    nodes = spark.createDataFrame([(x, d) for x, d in zip("abcde", (1955, 1975, None, 2015, 1948), strict=True)], "id string, debut int").withColumn("teams", F.array(F.lit("T")))
    pairs = [("a", "b"), ("b", "c"), ("c", "d")]
    links = spark.createDataFrame(pairs + [(y, x) for x, y in pairs], "node string, other string")
    hops = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "node string, distance int")
    see = lambda **v: {r["id"] for r in neighbourhood.visible(nodes, hops, **v).filter("visible").collect()}
    assert see() == set("abcde") and see(ego=True) == {"a", "b"} and see(ego=True, path=["a", "d"]) == {"a", "d"} and see(ego=True, path=["a"], edge=("c", "d")) == {"c", "d"}
    assert see(ego=True, edge=("c", "d"), walk=["a"], walk_next=spark.createDataFrame([("b",)], "node string")) == {"a", "b"} and see(walk=["e"]) == {"e"}
    assert neighbourhood.walk_to(links, ["a", "b"], "c") == ["a", "b", "c"] and neighbourhood.walk_to(links, ["a", "b", "c"], "a") == ["a"] and neighbourhood.walk_to(links, ["a", "b"], "d") == ["a", "b"]
    marked = neighbourhood.visible(neighbourhood.emphasised(nodes, {1950, 2010}), hops, ego=True)
    assert tuple(neighbourhood.filter_status(marked, {1950, 2010}).first()) == (5, 2, 2, "Debut eras: 1950s, 2010s+", "all")
    assert neighbourhood.filter_status(marked, set(neighbourhood.ERAS)).first()["eras"] == "All eras emphasized" and neighbourhood.filter_status(marked, set(), "T").first()["eras"] == "No eras emphasized"
