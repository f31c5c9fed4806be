import itertools
import random

from pyspark.sql import functions as F

from linkloom.operators import evidence, paths, proof_groups
from linkloom.operators.components import connected_components

T = "player string, team string, start_day int, end_day int"
C = "player string, team string, season int, games int, team_games int"
W = "player string, team string, season int, game_id string, date date"


def _facts(spark, seed=5):
    r = random.Random(seed)
    ids = [f"p{i:03d}" for i in range(150)]
    who = lambda n: [r.choice(ids[:n]) for _ in range(120)]
    tenures = [(p, r.choice("XYZ"), s := r.randrange(400), s + r.randrange(6)) for p in who(150)]
    counts = [(p, r.choice("XY"), r.randrange(6), r.randrange(0, 9), 8) for p in who(100)] + [("p001", "Q", 1, 5, 8), ("p002", "Q", 1, 7, 9)]
    seen = [(p, r.choice("XY"), 1, f"g{r.randrange(30)}", None) for p in who(120)] + [("nobody", "X", 1, "g1", None)]
    seen = [(p, t, s, g, __import__("datetime").date(2024, 1, 1 + int(g[1:]) % 7)) for p, t, s, g, _ in seen]
    return [spark.createDataFrame(rows, kind) for rows, kind in ((tenures, T), (counts, C), (seen, W), ([(i,) for i in ids], "id string"))]


def test_groups_give_the_pairs_of_the_evidence(spark):
    tenures, counts, seen, players = _facts(spark)
    rows = evidence.evidence_rows(tenures, counts, evidence.coparticipations(seen), players).collect()
    kinds = {}
    for r in rows:
        kinds[r["a"], r["b"]] = kinds.get((r["a"], r["b"]), 0) | 1 << r["kind_rank"]
    assert {1, 2, 4} < set(kinds.values())
    groups = proof_groups.proof_groups(tenures, counts, seen, players)
    bits = proof_groups.pair_bits(groups, tile=64)
    got = [tuple(r) for r in proof_groups.proven_pairs(bits).collect()]
    assert len(got) == len(kinds) and {(a, b): k for a, b, k in got} == kinds
    degree = dict.fromkeys([r["id"] for r in players.collect()], 0)
    for p in itertools.chain(*kinds):
        degree[p] += 1
    assert {r["id"]: r["degree"] for r in proof_groups.degrees(bits, players).collect()} == degree
    assert sum(r["pairs"] for r in proof_groups.kind_totals(bits).collect()) == len(kinds)
    sparse = proof_groups.spanning_links(groups)
    assert {tuple(r) for r in sparse.collect()} <= set(kinds)
    whole = connected_components(spark.createDataFrame(list(kinds), "a string, b string"), "a", "b")
    assert sorted(connected_components(sparse, "a", "b").collect()) == sorted(whole.collect())
    adjacency = spark.createDataFrame([p for a, b in kinds for p in ((a, b), (b, a))], "node string, other string")
    one = spark.createDataFrame([("p001",)], "source string")
    assert sorted(paths.distances(groups, one).collect()) == sorted(paths.distances(adjacency, one).collect())
    goal = max(paths.distances(adjacency, one).collect(), key=lambda r: (r["distance"], r["node"]))["node"]
    assert paths.shortest_chain(groups, players, "p001", goal).collect() == paths.shortest_chain(adjacency, players, "p001", goal).collect()
    assert sorted(paths.all_shortest_chains(groups, "p001", goal).collect()) == sorted(paths.all_shortest_chains(adjacency, "p001", goal).collect())
    assert paths.chain_page(groups, players, "p001", goal, 3, 1) == paths.chain_page(adjacency, players, "p001", goal, 3, 1)


def test_evidence_of_targets_is_that_of_all_filtered(spark):
    tenures, counts, seen, players = _facts(spark)
    wanted = spark.createDataFrame([("p002",), ("p007",), ("p140",)], "player string")
    every = evidence.evidence_rows(tenures, counts, evidence.coparticipations(seen), players)
    own = evidence.evidence_rows(tenures, counts, evidence.coparticipations(seen, wanted), players, wanted)
    ends = ["p002", "p007", "p140"]
    text = lambda df: sorted(map(str, df.collect()))
    assert text(own) == text(every.filter(F.col("a").isin(ends) | F.col("b").isin(ends))) and own.count() > 0


def test_witnesses_are_found_without_shuffling_pairs(spark):
    seen = _facts(spark)[2]
    plan = evidence.coparticipations(seen)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("Join Inner")
    assert "Aggregate" not in plan[:joined] and "Window" not in plan[:joined]
