"""Answers that need no row for each pair, and pairs that are never shuffled, against the plainer ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import audit, evidence, neighbourhood
from linkloom.plans import graph_queries
from linkloom.sources import play_by_play
from tests.test_proof_groups import _facts


def test_players_of_witnesses_without_their_pairs(spark):
    tenures, counts, seen, _ = _facts(spark)
    pairs = evidence.coparticipations(seen)
    records = tenures.withColumn("season", F.lit(1))
    got, want = (neighbourhood.scoped_players(tenures, records, counts, w) for w in (evidence.witnessed_players(seen), pairs))
    assert sorted(got.collect()) == sorted(want.collect())
    named = pairs.select(F.col("a").alias("player"), "team", "season").union(pairs.select("b", "team", "season")).distinct()
    assert sorted(evidence.witnessed_players(seen).collect()) == sorted(named.collect())


def test_sources_of_witnesses_are_carried_along(spark):
    seen = _facts(spark)[2]
    parts = seen.withColumn("source", F.concat("player", "game_id")).union(seen.limit(9).withColumn("source", F.lit("again"))).union(seen.limit(3).withColumn("source", F.lit(None)))
    got = play_by_play.export_witnesses(parts)
    own = lambda p: parts.distinct().select(F.col("player").alias(p), "team", "season", "game_id", "date", F.col("source").alias(f"{p}_source"))
    key = ["team", "season", "game_id", "date"]
    want = evidence.coparticipations(parts).join(own("a"), ["a", *key]).join(own("b"), ["b", *key]).select(*got.columns)
    text = lambda df: sorted(map(str, df.collect()))
    assert text(got) == text(want) and got.filter("a_source is null or b_source is null").count() > 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == evidence.coparticipations(parts)._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_faults_of_pairs_that_are_there_once(spark):
    rows = [("a", "b", 0), ("a", "c", 1), ("b", "c", 3), ("b", "x", 7), ("c", "d", 15), ("d", "e", 31), ("e", "f", 63), ("f", "g", 48), ("f", "h", 9)]
    pairs = spark.createDataFrame(rows, "a string, b string, t int")
    has = lambda k: F.col("t").bitwiseAND(F.lit(1 << k)) != 0
    players = spark.createDataFrame([(p,) for p in "abcdefgh"], "id string")
    got = audit.audit_pairs(pairs.select("a", "b", audit.tags(*[has(k) for k in range(6)]).alias("tags")), spark.createDataFrame([("x",)], "id string"))
    some = lambda k: pairs.filter(has(k)).select("a", "b")
    ways = some(1).select(F.col("a").alias("node"), F.col("b").alias("other")).union(some(2).select("b", "a"))
    want = audit.audit_links(some(0), ways, [some(3)], some(4), some(5), players)
    assert sorted(got.filter("not (a = 'a' and b = 'b')").collect()) == sorted(want.collect()) and got.count() > 5


def test_a_views_witnesses_come_from_its_own_games(spark, monkeypatch):
    met, seasons = evidence.coparticipations, set()

    def watched(appearances, *more):
        seasons.update(r["season"] for r in appearances.select("season").distinct().collect())
        return met(appearances, *more)

    monkeypatch.setattr(evidence, "coparticipations", watched)
    assert graph_queries.filtered_view_edges(spark, "/root/testdata/sf0.001").columns and seasons == {1994, 1995}
