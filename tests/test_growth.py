"""What keeps a task's and the driver's memory from growing with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import identity, order, reconcile
from linkloom.sources import incremental, transactions


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_memberships_meet_in_one_dealt_grouping(spark):
    ddl = "player int, team int, season int"
    left = spark.createDataFrame([(1, 1, 1990), (1, 1, 1990), (2, 2, 2000), (None, 3, 1990), (4, 4, 1990)], ddl)
    right = spark.createDataFrame([(1, 1, 1990), (None, 3, 1990), (5, 5, 2000), (5, 5, 2000)], ddl)
    got = reconcile.membership_difference(left, right, ["player", "team", "season"], cut=1996, parts=7)
    assert {tuple(r) for r in got.collect()} == {
        ("left-only-after-1996", 2, 2, 2000), ("left-only", None, 3, 1990), ("left-only", 4, 4, 1990), ("right-only", None, 3, 1990), ("right-only-after-1996", 5, 5, 2000),
    } and got.count() == 5
    assert "Anti" not in _plan(got)


def test_parts_grow_with_the_rows(spark):
    assert order.parts_for(10, spark) == 4 and order.parts_for(100, spark, 10) == 10 and order.parts_for(101, spark, 10) == 11


def test_a_pages_items_are_shuffled_once(spark):
    pages = spark.createDataFrame([("p", "<p/>")], "page_id string, html string")
    plan = transactions.movements(transactions.page_items(pages))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_persons_are_not_broadcast(spark):
    people = spark.createDataFrame([("1", ["Al Low"], None, 1990, 1995, False)], "id string, names array<string>, born date, first_season int, last_season int, other_league_only boolean")
    found = identity.bridge(people, people)
    assert "BroadcastHashJoin" not in _plan(found) and found.first()["rule"] == "name-match-s2-dob-NA"
    third = identity.third_source(people.withColumn("id", F.lit("9")), people, found)
    assert "BroadcastHashJoin" not in _plan(third) and third.first()["third"] == "1"


def test_the_manifest_holds_plain_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a"), (2, None)], "page_id long, html string")
    incremental.update(pages, str(tmp_path / "s"), lambda p: p.select("page_id", F.length("html").alias("n")))
    held = spark.read.parquet(str(tmp_path / "s/manifest")).filter("page_id is not null")
    assert {r["page_id"]: len(r["digest"]) for r in held.collect()} == {1: 32, 2: 32} and isinstance(held.first()["digest"], (bytes, bytearray))
