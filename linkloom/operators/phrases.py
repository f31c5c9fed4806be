"""Many phrases looked up in many texts in one pass.

A phrase has the letters and digits of its words in a row wherever it stands. Its first words, three at most, are its key; every text
gives the runs of one to three words that keys have, and only where a key is met is the phrase itself looked for. So
neither texts nor phrases are compared with all of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import contains_phrase
from linkloom.scratch import materialise

KEY_WORDS = 3


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), 0)


def _runs(words: Column, n: int) -> Column:
    """The hashes of all runs of n words."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))


def _looked_up(texts: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, text) of the distinct texts in lower case, and (tid, phrase_id, phrase) of the phrases that stand in them, once each."""
    keyed = phrases.filter("phrase is not null").distinct().withColumn("words", _words(F.col("phrase"))).filter("size(words) > 0")
    n = F.least(F.size("words"), F.lit(KEY_WORDS))
    keys = keyed.select("phrase_id", "phrase", F.xxhash64(F.array_join(F.slice("words", F.lit(1), n), " ")).alias("key"))
    once = texts.filter("text is not null").select(F.lower("text").alias("text")).distinct()
    once = materialise(once.withColumn("tid", F.monotonically_increasing_id()), "texts")
    words = once.select("tid", _words(F.col("text")).alias("words"))
    runs = F.array_distinct(F.flatten(F.array(*[_runs(F.col("words"), k) for k in range(1, KEY_WORDS + 1)])))
    hits = words.select("tid", F.explode(runs).alias("key")).join(keys, "key")
    wanted = hits.groupBy("tid").agg(F.collect_set(F.struct("phrase_id", "phrase")).alias("wanted"))
    met = once.join(wanted, "tid").select("tid", "text", F.explode("wanted").alias("w"))
    found = met.filter(contains_phrase(F.col("text"), F.lower("w.phrase"))).select("tid", "w.phrase_id", "w.phrase")
    return once, materialise(found, "found")


def phrase_matches(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase_id, phrase): each phrase that stands in a text as whole words, whatever their case, once.

    ``texts`` is (id, text), ``phrases`` (phrase_id, phrase). What stands before and after a phrase is no letter and no digit. Phrases
    without any are never met, null texts and phrases neither. Rows of one id are looked through each. Equal texts are looked up
    once. A text's keys are distinct, so what meets of it is bounded by its words; its phrases are checked in the row of the text.
    """
    once, found = _looked_up(texts, phrases)
    whose = texts.filter("text is not null").select("id", F.lower("text").alias("text")).join(once, "text").select("id", "tid")
    return whose.join(found, "tid").select("id", "phrase_id", "phrase").distinct()


def team_candidates(texts: DataFrame, teams: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(id, teams): the teams that a text names, sorted; by id, name, or a published name or abbreviation.

    ``teams`` is (id, name), ``crosswalk`` (name, abbreviation, team); rows of it for other teams don't count. Texts that name
    none have no row. A text's teams are gathered once for all ids that have it.
    """
    known = teams.select(F.col("id").alias("phrase_id"))
    own = teams.select(F.col("id").alias("phrase_id"), F.explode(F.array("id", "name")).alias("phrase"))
    more = crosswalk.select(F.col("team").alias("phrase_id"), F.explode(F.array("name", "abbreviation")).alias("phrase")).join(known, "phrase_id", "left_semi")
    once, found = _looked_up(texts, own.union(more).filter("phrase <> ''"))
    named = found.groupBy("tid").agg(F.collect_set("phrase_id").alias("teams"))
    named = materialise(once.join(named, "tid").select("text", "teams"), "named")
    met = texts.filter("text is not null").select("id", F.lower("text").alias("text")).join(named, "text").select("id", "teams")
    return met.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("teams")))).alias("teams"))
