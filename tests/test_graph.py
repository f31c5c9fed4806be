import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.operators import backbone, components, evidence, intervals, neighbourhood, paths, statistics
from linkloom.operators.components import connected_components

TENURES = [
    ("A", "Red", 1, 5), ("A", "Green", 6, 11), ("B", "Red", 2, 4), ("B", "Blue", 10, 13), ("C", "Blue", 11, 12), ("C2", "Blue", 11, 15),
    ("D", "Red", 20, 25), ("E", "Green", 6, 8), ("E", "Green", 9, 11),
]
T = "player string, team string, start_day int, end_day int"


@pytest.fixture(scope="module")
def roster(spark):
    players = spark.createDataFrame([(p,) for p in ("A", "B", "C", "C2", "D", "E")], "id string").cache()
    edges = intervals.overlap_pairs(spark.createDataFrame(TENURES, T)).cache()
    return players, edges, evidence.adjacency(edges).cache()


def test_overlap_edges_of_the_small_roster(roster):
    assert sorted(tuple(r) for r in roster[1].select("a", "b", "days").collect()) == [("A", "B", 2), ("A", "E", 4), ("B", "C", 1), ("B", "C2", 2), ("C", "C2", 1)]


def test_overlaps_equal_brute_force_at_any_bucket(spark):
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(9)}", f"t{rng.randrange(3)}", s := rng.randrange(200), s + rng.randrange(-3, 60)) for _ in range(120)]
    rows += rows[:10]
    want = {}
    for x, y in itertools.permutations(set(rows), 2):
        days = min(x[3], y[3]) - max(x[2], y[2])
        if x[1] == y[1] and x[0] < y[0] and days > 0 and x[2] < x[3] and y[2] < y[3]:
            want[x[0], y[0], x[1]] = want.get((x[0], y[0], x[1]), 0) + days
    for days in (1, 7, 1000):
        got = intervals.overlap_pairs(spark.createDataFrame(rows, T), bucket_days=days).collect()
        assert {tuple(r)[:3]: r["days"] for r in got} == want


def test_statistics_of_the_small_roster(roster):
    players, edges, links = roster
    r = statistics.graph_statistics(players, edges, links).first()
    assert tuple(r) == (6, 2, 3, 5, "1:5,2:3,3:2")
    histogram, longest = statistics.pair_distances(players, links)
    first = [tuple(x) for x in longest.collect()]
    assert len(first) == 10 and first[0] == ("C", "E", 3) and all("D" not in x for x in first)
    assert sorted(map(tuple, histogram.collect())) == [(1, 5), (2, 3), (3, 2)]
    assert [x.count() for x in statistics.pair_distances(players, links.limit(0))] == [0, 0]
    hubs = statistics.hubs(evidence.degrees(edges, players)).collect()
    assert [tuple(h) for h in hubs] == [("B", 3), ("A", 2), ("C", 2), ("C2", 2), ("E", 1), ("D", 0)]


@pytest.mark.parametrize("words", [1, 16])
def test_statistics_of_more_than_one_row_of_sources(spark, monkeypatch, words):
    monkeypatch.setattr(statistics, "WORDS", words)
    monkeypatch.setattr(statistics, "_SOURCES", 64 * words)
    rng, n = random.Random(7), 150
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(170)} | {(i, i + 1) for i in range(140, 147)}
    far = {}
    near = {i: {y if x == i else x for x, y in edges if i in (x, y)} for i in range(n)}
    for i in range(n):
        seen, level, d = {i}, {i}, 0
        while level:
            d += 1
            level = {k for j in level for k in near[j]} - seen
            seen |= level
            far |= {(i, j): d for j in level if i < j}
    name = lambda i: f"n{i:03d}"
    players = spark.createDataFrame([(name(i),) for i in range(n)], "id string")
    rows = spark.createDataFrame([(name(a), name(b)) for a, b in edges] + [("other", name(0))], "a string, b string")
    histogram, longest = statistics.pair_distances(players, evidence.adjacency(rows), top=25)
    assert {r["distance"]: r["pairs"] for r in histogram.collect()} == dict(Counter(far.values()))
    want = sorted((-d, a, b) for (a, b), d in far.items())[:25]
    assert [tuple(r) for r in longest.collect()] == [(name(a), name(b), -d) for d, a, b in want]


def test_chains(spark, roster):
    players, edges, links = roster
    chain = lambda x, y: [tuple(r) for r in paths.shortest_chain(links, players, x, y).collect()]
    assert chain("A", "C") == [("connected", ["A", "B", "C"], 2)]
    assert chain("A", "A") == [("connected", ["A"], 0)]
    assert chain("A", "D") == [("disconnected", None, None)]
    assert chain("A", "nobody") == []
    page = paths.chain_page(links, players, "A", "D", 5)
    assert (page.chains, page.total_exact) == ([], "0")
    links_of = paths.chain_links(spark.createDataFrame([(1, ["A", "B", "C"])], "chain int, path array<string>"), evidence.edges(_rows(spark)))
    assert sorted((r["step"], r["a"], r["b"]) for r in links_of.collect()) == [(0, "A", "B"), (1, "B", "C")]


def _layers(spark, n, marks="ab"):
    nodes = [["s"]] + [[f"l{i:02d}{m}" for m in marks] for i in range(n)] + [["g"]]
    edges = [tuple(sorted((x, y))) for u, v in itertools.pairwise(nodes) for x in u for y in v]
    edge_rows = spark.createDataFrame(edges, "a string, b string")
    players = spark.createDataFrame([(x,) for layer in nodes for x in layer], "id string")
    return players, evidence.adjacency(edge_rows).cache()


def test_pages_join_to_the_whole_list(spark):
    players, links = _layers(spark, 4)
    every = sorted(r["path"] for r in paths.all_shortest_chains(links, "s", "g").collect())
    assert len(every) == 16
    got, offset = [], 0
    while offset is not None:
        page = paths.chain_page(links, players, "s", "g", 5, offset=offset)
        assert page.total_exact == "16"
        got += page.chains
        offset = page.next_offset
    assert got == every
    assert paths.chain_page(links, players, "s", "g", 3, offset=16).chains == []
    with pytest.raises(ValueError):
        paths.chain_page(links, players, "s", "g", 501)
    with pytest.raises(ValueError):
        paths.chain_page(links, players, "s", "g", 1, offset=0, cursor="v1:0")
    for bad in ("v2:0", "v1:", "v1:-1", "v1:x", "v1:" + "0" * 12):
        with pytest.raises(ValueError):
            paths.parse_cursor(bad, 11)


def test_limbs_carry_beyond_any_width(spark):
    dag = [(f"n{i + 1:02d}", f"n{i:02d}", i + 1) for i in range(20)]
    rows = spark.createDataFrame(dag, "node string, other string, left int").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(200000)))).drop("x")
    limbs = paths.chain_counts(rows.coalesce(1), "n00", 3).filter("left = 3").first()["limbs"]
    assert paths.count_of(limbs) == 200000**3
    carried = spark.range(1).select(paths._carry([F.lit(10**9 - 1) + F.lit(10**9), F.lit(7 * 10**18)]).alias("c")).first()["c"]
    assert paths.count_of(carried) == 2 * 10**9 - 1 + 7 * 10**27 and carried[-1] > 0
    big = 7**6000
    assert paths.parse_cursor("v1:" + paths.decimal(big), 10000) == big


def test_counts_beyond_ten_to_the_144(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        left = 10**144 - 1
        limbs = [left // 10 ** (9 * i) % 10**9 for i in range(16)]
        sums = [F.lit(2 * x) for x in limbs]
        assert paths.count_of(spark.range(1).select(paths._carry(sums).alias("c")).first()["c"]) == 2 * left
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_counts_are_exact_beyond_any_built_in_number(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        n, marks = 12, "".join(chr(ord("!") + i) for i in range(48))
        players, links = _layers(spark, n, marks)
        total = len(marks) ** n
        page = paths.chain_page(links, players, "s", "g", 1, cursor=f"v1:{total - 1}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert total > 2**64 and page.total_exact == str(total) and page.total == 2**64 - 1
    assert page.chains[0][1] == f"l00{marks[-1]}" and page.chains[0][n] == f"l{n - 1:02d}{marks[-1]}"
    assert page.next_cursor is None and page.next_offset is None


COUNTS = "player string, team string, season int, games int, team_games int"
WITNESS = "a string, b string, team string, season int, game_id string, date date"


def _rows(spark, counts=(), witnesses=()):
    players = spark.createDataFrame([(p,) for p in ("A", "B", "C", "C2", "D", "E")], "id string")
    w = spark.createDataFrame(list(witnesses), "a string, b string, team string, season int, game_id string, date string").withColumn("date", F.to_date("date"))
    return evidence.evidence_rows(spark.createDataFrame(TENURES, T), spark.createDataFrame(list(counts), COUNTS), w, players)


def test_counts_prove_shared_games_by_pigeonhole(spark):
    rows = [
        ("a", "X", 1, 73, 82), ("b", "X", 1, 27, 82), ("c", "X", 1, 9, 82), ("a", "Y", 1, 40, 82), ("b", "Y", 1, 42, 82), ("a", "Z", 1, 80, 82), ("b", "Z", 1, 80, 81),
        ("a", "W", 1, 60, 82), ("b", "W", 1, 70, 82), ("a", "X", 1, 73, 82),
    ]
    got = sorted(tuple(r) for r in evidence.count_pairs(spark.createDataFrame(rows, COUNTS)).select("a", "b", "team", "minimum_shared_games").collect())
    assert got == [("a", "b", "W", 48), ("a", "b", "X", 18)]


def test_unknown_days_are_not_zero(spark):
    rows = _rows(spark, [("A", "Gold", 3, 50, 82), ("B", "Gold", 3, 60, 82)], [("D", "E", "Red", 9, "0000000001", "2001-01-02"), ("E", "A", "Red", 9, "0000000002", "2001-01-02"), ("D", "ghost", "Red", 9, "0000000003", "2001-01-02")])
    totals = {(r["a"], r["b"]): r["overlap_days"] for r in evidence.edge_overlap_days(rows).collect()}
    assert totals[("A", "B")] is None and totals[("D", "E")] is None and totals[("A", "E")] == 4 and ("E", "A") not in totals
    edges = evidence.edges(rows)
    best = {(r["a"], r["b"]): r["s"] for r in edges.select("a", "b", evidence.strongest_evidence(F.col("evidence")).alias("s")).collect()}
    assert best[("A", "B")]["overlap_days"] == 2 and best[("D", "E")]["minimum_shared_games"] == 1
    assert evidence.proof_audit(edges, [rows]).count() == 0
    assert evidence.proof_audit(edges, [rows.filter("kind_rank < 2")]).count() == 1


def test_strongest_of_unknown_days_is_the_last(spark):
    rows = _rows(spark, [], [("C", "D", "Red", s, f"000000000{s}", "2001-01-02") for s in (1, 2, 3)])
    got = evidence.edges(rows).filter("a = 'C' and b = 'D'").select(evidence.strongest_evidence(F.col("evidence"))["season"].alias("s")).first()
    assert got["s"] == 3


def test_first_shared_game_is_the_witness(spark):
    rows = [("a", "T", 1, "g2", "2000-01-02"), ("b", "T", 1, "g2", "2000-01-02"), ("a", "T", 1, "g1", "2000-01-03"), ("b", "T", 1, "g1", "2000-01-03"), ("c", "T", 1, "g1", "2000-01-03")]
    df = spark.createDataFrame(rows, "player string, team string, season int, game_id string, date string")
    assert {tuple(r)[:5] for r in evidence.coparticipations(df).collect()} == {("a", "b", "T", 1, "g2"), ("a", "c", "T", 1, "g1"), ("b", "c", "T", 1, "g1")}
    only = evidence.coparticipations(df, spark.createDataFrame([("c",)], "player string"))
    assert {(r["a"], r["b"]) for r in only.collect()} == {("a", "c"), ("b", "c")}


def _graph(spark, edges):
    return evidence.adjacency(spark.createDataFrame(edges, "a string, b string")).cache()


def test_next_steps_on_a_six_cycle(spark):
    links = _graph(spark, [(str(i), str((i + 1) % 6)) for i in range(6)])
    step = lambda path, target=None: sorted(r["node"] for r in neighbourhood.next_steps(links, [str(p) for p in path], target).collect())
    assert [step(p) for p in ([0], [0, 1], [0, 1, 2], [0, 1, 2, 3], [0, 5])] == [["1", "5"], ["2"], ["3"], [], ["4"]]
    assert step([0, 1], "2") == ["2"] and step([0], "9") == []


def test_neighbourhood_is_cut_by_distance_then_id(spark):
    edges = [("a", x) for x in "bcd"] + [("b", "e"), ("c", "d")]
    links = _graph(spark, edges)
    edge_rows = spark.createDataFrame(edges, "a string, b string")
    nodes, inside, facts = neighbourhood.neighbourhood(links, edge_rows, "a", depth=2, limit=4, path=["a", "c"])
    assert facts.first()["truncated"] and not neighbourhood.neighbourhood(links, edge_rows, "a", depth=2)[2].first()["truncated"]
    assert sorted(map(tuple, nodes.collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 1)]
    assert {(r["a"], r["b"]): r["on_path"] for r in inside.collect()} == {("a", "b"): False, ("a", "c"): True, ("a", "d"): False, ("c", "d"): False}
    for bad in ({"depth": 3}, {"limit": 0}):
        with pytest.raises(ValueError):
            neighbourhood.neighbourhood(links, edge_rows, "a", **bad)


def _kruskal(edges):
    root = {x: x for e in edges for x in e[:2]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = set()
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b))
    return out


def test_forest_is_the_one_that_greedy_choice_gives(spark):
    rng = random.Random(3)
    edges = [(f"n{a:02d}", f"n{b:02d}", rng.randrange(4) / 4) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.12]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    assert {tuple(r) for r in backbone.spanning_forest(df).collect()} == _kruskal(edges)
    assert backbone.spanning_forest(df.limit(0)).collect() == []
    clique = [(str(a), str(b), 0.2 + (a + b) / 20) for a in range(8) for b in range(a + 1, 8)] + [("x", "y", 0.1)]
    kept = {tuple(r) for r in backbone.backbone(spark.createDataFrame(clique, "a string, b string, weight double")).collect()}
    assert ("x", "y") in kept and _kruskal(clique) <= kept and len(kept) < len(clique)


def test_weights(spark):
    rows = _rows(spark, [], [("D", "E", "Red", 9, "0000000001", "2001-01-02")])
    w = {(r["a"], r["b"]): r for r in backbone.edge_weights(rows).collect()}
    assert w[("D", "E")]["weight"] == pytest.approx(0.15) and w[("A", "E")]["weight"] > w[("A", "B")]["weight"] > 0.15
    tie = rows.filter("a = 'A' and b = 'B'").withColumn("team", F.lit("BLUE")).union(rows.filter("a = 'A' and b = 'B'").withColumn("team", F.lit("RED")))
    assert backbone.edge_weights(tie).first()["primary_team"] == "BLUE"


def test_components_with_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    edges = chain + star + chain[:5] + [(b, a) for a, b in star[:5]] + [(7, 7), (None, 3), (500, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_a_round_of_components_is_a_small_plan(spark):
    """The driver holds a round's plan again at each of its stages."""
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 3)], "u long, v long")
    round_ = components._stars(edges)
    assert round_._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 9
    assert {tuple(r) for r in round_.collect()} == {(2, 1), (3, 1), (9, 2)}


def test_view_keeps_tenures_with_a_record_in_the_range(spark):
    rec = spark.createDataFrame([("a", "RED", 2000, 1, 5), ("b", "RED", 2000, 2, 6), ("a", "BLUE", 2001, 10, 15), ("a", "RED", 2002, 20, 25)], "player string, team string, season int, start_day int, end_day int")
    t = rec.drop("season")
    c = spark.createDataFrame([("b", "BLUE", 2001, 50, 82)], COUNTS)
    w = spark.createDataFrame([], WITNESS)
    kept, counts, _ = neighbourhood.view(t, c, w, rec, team="RED", first_season=2000, last_season=2001)
    assert sorted((r["player"], r["start_day"]) for r in kept.collect()) == [("a", 1), ("b", 2)] and counts.count() == 0
    assert neighbourhood.view(t, c, w, rec.limit(0), first_season=2000)[0].count() == 0
    scoped = {r["id"]: (r["teams"], r["first_season"], r["last_season"]) for r in neighbourhood.scoped_players(t, rec, c, w).collect()}
    assert scoped == {"a": (["BLUE", "RED"], 2000, 2002), "b": (["BLUE", "RED"], 2000, 2001)}
