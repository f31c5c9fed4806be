"""The links that ranks depend on, held against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from linkloom.operators import backbone, evidence, strong_links


def test_backbone_of_the_facts_equals_that_of_all_pairs(spark):
    rng = random.Random(5)
    ids = [f"p{i:02d}" for i in range(24)]
    # players of equal counts in any number, and seasons of several lengths
    kinds = [[(t, s, rng.randrange(0, n + 1), n) for t, s, n in (("A", 1, 4), ("A", 2, 3), ("B", 1, 9))] for _ in range(4)]
    counts = [(p, *row) for p in ids[:20] for row in rng.choice(kinds)]
    tenures = [(rng.choice(ids), rng.choice("AB"), d, d + rng.randrange(1, 9)) for d in rng.choices(range(60), k=25)]
    played = [(rng.choice(ids), "C", 1, f"g{g}", f"2000-01-0{g}") for g in range(1, 8) for _ in range(3)]
    t = spark.createDataFrame(tenures, "player string, team string, start_day int, end_day int")
    c = spark.createDataFrame(counts, "player string, team string, season int, games int, team_games int")
    a = spark.createDataFrame(played, "player string, team string, season int, game_id string, date string").withColumn("date", F.to_date("date"))
    players = spark.createDataFrame([(p,) for p in ids[1:]], "id string")
    weighted = backbone.edge_weights(evidence.evidence_rows(t, c, evidence.coparticipations(a), players))
    want = {tuple(r) for r in backbone.backbone(weighted).collect()}
    assert {tuple(r) for r in strong_links.backbone(t, c, a, players).collect()} == want
    rounded = backbone.top_links(weighted.withColumn("weight", F.round("weight", 6)))
    assert {tuple(r) for r in backbone.top_links(strong_links.candidates(t, c, a, players, digits=6)[1]).collect()} == {tuple(r) for r in rounded.collect()}
    # tiles of four players, so that forests of many tiles meet
    small = strong_links.counted_links(evidence.admissible_counts(c, players), tile=4)
    pairs = evidence.count_pairs(evidence.admissible_counts(c, players)).groupBy("a", "b").agg(F.sum("minimum_shared_games").alias("games"))
    kept = lambda df: {tuple(r) for r in backbone.backbone(df.select("a", "b", backbone.measure(F.col("games"), 246).alias("weight"))).collect()}
    assert kept(small) == kept(pairs)


def test_links_stay_few_where_pairs_are_many(spark):
    """Sixty players of one season are 1,770 pairs, of which a forest and three links each are kept."""
    c = spark.createDataFrame([(f"p{i:02d}", "A", 1, 5 + i % 2, 6) for i in range(60)], "player string, team string, season int, games int, team_games int")
    assert strong_links.counted_links(c).count() < 60 * 4


def test_nearest_nodes_of_a_crowd_are_sought_in_small_cells(spark, monkeypatch):
    from linkloom.operators import layout

    rng = random.Random(3)
    # a crowd within one cell as wide as the reach, a pair of one place, and some far away
    points = [(f"n{i:03d}", rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(300)] + [("z", 5.0, 5.0), ("y", 5.0, 5.0), ("far", 70.0, 0.0), ("farther", 900.0, 0.0)]
    clicks = [(f"c{i}", rng.uniform(-90, 120), rng.uniform(-90, 120)) for i in range(200)] + [("on", 5.0, 5.0), ("again", 5.0, 5.0), ("none", None, 1.0), ("edge", 900.0, 80.0)]
    widths, real = [], layout._nearest_in
    monkeypatch.setattr(layout, "_nearest_in", lambda p, s, wide: widths.append(wide) or real(p, s, wide))
    got = layout.nearest_node(spark.createDataFrame(points, "id string, x double, y double"), spark.createDataFrame(clicks, "click string, x double, y double"))
    want = {}
    for c, x, y in clicks:
        near = [] if x is None else sorted(((x - px) ** 2 + (y - py) ** 2, i) for i, px, py in points)
        if near and near[0][0] <= 6400:
            want[c] = near[0][1]
    assert {r["click"]: r["id"] for r in got.collect()} == want
    assert widths[0] < 80.0 and widths[-1] == 80.0


def test_equal_texts_are_looked_up_once(spark):
    from linkloom.operators import phrases

    texts = spark.createDataFrame([(i, "The Hawks and kings" if i % 2 else "the HAWKS") for i in range(50)] + [(1, "of Kings")], "id int, text string")
    once, found = phrases._looked_up(texts, spark.createDataFrame([("h", "hawks"), ("k", "Kings")], "phrase_id string, phrase string"))
    assert once.count() == 3 and found.count() == 4
    teams = spark.createDataFrame([("h", "hawks"), ("k", "Kings")], "id string, name string")
    got = {r["id"]: r["teams"] for r in phrases.team_candidates(texts, teams, spark.createDataFrame([], "name string, abbreviation string, team string")).collect()}
    assert got == {i: ["h", "k"] if i % 2 else ["h"] for i in range(50)}
