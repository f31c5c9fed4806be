"""Where facts come from: record lookups, evidence pages, coverage and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions.days import date_of
from linkloom.operators.evidence import describe

SHOWN_GAPS = 100


def record_lookup(sure: DataFrame, gaps: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (player, team) with found (certified, gap, not_found) and the record of it; certified rows come first.

    ``sure`` and ``gaps`` are (player, team, record, ...). Of several records the first by name is given.
    """
    rows = sure.select("player", "team", F.struct(F.lit(0).alias("rank"), "record").alias("r")).union(
        gaps.select("player", "team", F.struct(F.lit(1).alias("rank"), "record").alias("r"))
    )
    best = rows.groupBy("player", "team").agg(F.min("r").alias("r"))
    found = F.when(F.col("r.rank") == 0, "certified").when(F.col("r.rank") == 1, "gap").otherwise("not_found")
    return wanted.join(best, ["player", "team"], "left").select("player", "team", found.alias("found"), F.col("r.record").alias("record"))


def evidence_page(rows: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(a, b, kind_rank, team, season, game_id, text, overlaps): each entry explained, dated ones with their records.

    ``rows`` are evidence rows, ``overlaps`` record overlaps (a, b, team, a_record, b_record, start_day,
    end_day). Entries by count or witness carry no overlaps, even where the team has dated ones too.
    """
    span = F.struct(date_of(F.col("start_day")).alias("since"), date_of(F.col("end_day")).alias("until"), "a_record", "b_record")
    dated = overlaps.groupBy("a", "b", "team").agg(F.sort_array(F.collect_list(span)).alias("overlaps")).withColumn("kind_rank", F.lit(0))
    text = (
        F.when(F.col("kind_rank") == 0, F.concat(F.lit("Memberships overlap by "), describe(F.col("overlap_days"), F.lit(None).cast("int"))))
        .when(
            F.col("kind_rank") == 1,
            F.format_string("%d and %d of %d games: %d shared at least", "a_games", "b_games", "team_games", "minimum_shared_games"),
        )
        .otherwise(F.concat(F.lit("Both took part in game "), F.col("game_id"), F.lit(" on "), F.col("date").cast("string")))
    )
    joined = rows.join(dated, ["a", "b", "team", "kind_rank"], "left")
    return joined.select("a", "b", "kind_rank", "team", "season", "game_id", text.alias("text"), "overlaps")


def player_gaps(gaps: DataFrame, shown: int = SHOWN_GAPS) -> DataFrame:
    """(player, record, place, total): each player's first gaps and how many there are."""
    by = Window.partitionBy("player")
    ranked = gaps.select("player", "record", F.row_number().over(by.orderBy("record")).alias("place"), F.count("*").over(by).alias("total"))
    return ranked.filter(F.col("place") <= shown)


def certainty(connected: Column, complete: Column) -> Column:
    """What a missing connection means: that there is none only where coverage is complete."""
    return F.when(connected, "connected").when(complete, "verified_disconnected").otherwise("unresolved_coverage")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def altered_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): files missing, unexpected or changed between two digest tables."""
    e, f = expected.select("path", F.col("sha256").alias("want")), found.select("path", F.col("sha256").alias("got"))
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("got"), "changed")
    return e.join(f, "path", "full").select("path", problem.alias("problem")).filter("problem is not null")


def content_id(*columns: str) -> Column:
    """A name derived from content alone: sixteen digits of the digest of its JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def snapshot_identity(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, digest): counts and digests that don't depend on the order of rows.

    A row's text is its columns' by name, as strings, parted by the unit separator, nulls as a NUL; the first 60 bits of the texts'
    MD5 are summed without rounding, and the digest is the sum's SHA-256. An empty table's is that of 0.
    """
    found = []
    for name, df in sorted(tables.items()):
        text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
        row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
        whole = F.coalesce(F.sum(row).cast("string"), F.lit("0"))
        found.append(df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.sha2(whole, 256).alias("digest")).select("table", "rows", "digest"))
    return reduce(DataFrame.union, found)


def telemetry_summary(events: DataFrame) -> DataFrame:
    """(kind, n, first, last, mean_value): request telemetry by kind; (ts, kind, value) in."""
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.avg("value").alias("mean_value"))
