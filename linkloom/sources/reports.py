"""Import of published reports: strict reads of CSV tables with the rules that make them usable facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.tenure import certified

PLAYERS = "bbr_player_id string, display_name string, first_season int, last_season int, aba_only string, s1_display_name string"
TENURES = (
    "bbr_player_id string, season int, lg string, canonical_franchise string, membership_source string, evidence_class string, start_day int, end_day int, "
    "start_anchored int, end_anchored int, unresolved_reasons string, arrival_days string, departure_days string"
)
COUNTS = "player string, team string, season int, lg string, games int, team_games int, player_record string, team_record string"
WITNESSES = "a string, b string, team string, season int, game_id string, date string, a_source string, b_source string"
LEAGUES = ("NBA", "BAA")
MOST_GAMES = 1000


class ImportFailure(ValueError):
    """A row that no fact can be made of; the whole import fails."""


@dataclass(frozen=True)
class Report:
    """The facts of an import; ``gaps`` holds the tenures that aren't certified, ``tenures`` those that are."""

    players: DataFrame
    tenures: DataFrame
    gaps: DataFrame
    counts: DataFrame
    witnesses: DataFrame


def read_csv(spark: SparkSession, path: str, ddl: str, multiline: bool = True) -> DataFrame:
    """A CSV with a header, bound by name: extra columns are ignored, missing ones are empty, bad numbers fail.

    A byte-order mark at the head is no part of the first name. ``record_no`` is the record's line in its file as the reports count
    it: the header is 1. With ``multiline`` a field may hold line breaks, and a file is read by one task, as nothing but a read
    from its head tells where a record begins; without, large files are read in splits, and a split's records are counted on from
    those of the splits before it. What meets on the driver is a count for each split.
    """
    schema = T.StructType.fromDDL(ddl)
    raw = spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", multiline).option("encoding", "UTF-8").csv(path)
    names = [c.removeprefix("\ufeff") for c in raw.columns]
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    raw = raw.select("*", split.alias("_split"), F.monotonically_increasing_id().alias("_row")).toDF(*names, "_split", "_row")
    raw = raw.join(F.broadcast(_split_starts(raw)), "_split").withColumn("record_no", F.col("_row") - F.col("_first") + F.col("_before") + 2)
    have = set(raw.columns)

    def field(f: T.StructField):
        if f.name not in have:
            return F.lit("").cast("string").alias(f.name) if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType).alias(f.name)
        value = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(value, F.lit("")).alias(f.name)
        return F.when(F.trim(value) != "", F.trim(value).cast(f.dataType)).alias(f.name)

    return raw.select(*[field(f) for f in schema], "record_no")


def _split_starts(raw: DataFrame) -> DataFrame:
    """(_split, _first, _before): the first row id of each split, and how many records of its file come before it."""
    found = raw.groupBy("_split").agg(F.min("_row").alias("first"), F.count("*").alias("n")).collect()
    rows, file, before = [], None, 0
    for r in sorted(found, key=lambda r: (r["_split"]["file"], r["_split"]["at"])):
        before = before if r["_split"]["file"] == file else 0
        rows.append((r["_split"], r["first"], before))
        file, before = r["_split"]["file"], before + r["n"]
    return raw.sparkSession.createDataFrame(rows, T.StructType([raw.schema["_split"], T.StructField("_first", T.LongType()), T.StructField("_before", T.LongType())]))


def _none(df: DataFrame, what: str) -> None:
    bad = df.first()
    if bad is not None:
        raise ImportFailure(f"{what}: {bad.asDict()}")


def players(raw: DataFrame) -> DataFrame:
    """(id, name, aliases, first_season, last_season): without the players of another league alone; ids unique."""
    rows = raw.filter("aba_only <> 'Y'")
    _none(rows.filter("bbr_player_id = ''"), "empty player id")
    _none(rows.groupBy("bbr_player_id").count().filter("count > 1"), "repeated player id")
    other = (F.col("s1_display_name") != "") & (F.col("s1_display_name") != F.col("display_name"))
    aliases = F.when(other, F.array("s1_display_name")).otherwise(F.array().cast("array<string>"))
    return rows.select(F.col("bbr_player_id").alias("id"), F.col("display_name").alias("name"), aliases.alias("aliases"), "first_season", "last_season")


def with_aliases(catalog: DataFrame, extra: DataFrame) -> DataFrame:
    """``catalog`` with further aliases (player_id, alias) of players that exist, each once."""
    more = extra.groupBy(F.col("player_id").alias("id")).agg(F.sort_array(F.collect_set("alias")).alias("_more"))
    return catalog.join(more, "id", "left").withColumn("aliases", F.array_union("aliases", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def tenure_rows(raw: DataFrame, known: DataFrame) -> DataFrame:
    """(player, team, season, ..., record) of the leagues kept; an unknown player fails the import."""
    rows = raw.filter(F.col("lg").isin(*LEAGUES)).withColumnsRenamed({"bbr_player_id": "player", "canonical_franchise": "team", "unresolved_reasons": "reasons"})
    _none(rows.join(known.select(F.col("id").alias("player")), "player", "left_anti"), "unknown player")
    rows = rows.withColumns({"start_anchored": F.col("start_anchored") == 1, "end_anchored": F.col("end_anchored") == 1})
    return rows.withColumn("record", F.concat(F.lit("t4/tenures.csv:"), F.col("record_no").cast("string")))


def catalog_teams(player_rows: DataFrame, all_tenures: DataFrame) -> DataFrame:
    """Players with the teams of all their rows, certified or not."""
    teams = all_tenures.groupBy(F.col("player").alias("id")).agg(F.sort_array(F.collect_set("team")).alias("teams"))
    return player_rows.join(teams, "id", "left").withColumn("teams", F.coalesce("teams", F.array().cast("array<string>")))


def counts(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """Count rows whose player was with the team in those seasons, 0 < games <= team_games <= 1000, both records named.

    Seasons of a team that disagree on its games, and differing rows of one player, team and season, fail
    the import; equal rows are one.
    """
    rows = raw.drop("record_no", "lg").distinct()
    own = rows.join(catalog.select(F.col("id").alias("player"), "teams", "first_season", "last_season"), "player", "left")
    good = (
        F.col("teams").isNotNull() & F.array_contains("teams", F.col("team")) & F.col("season").between(F.col("first_season"), F.col("last_season"))
        & (F.col("games") > 0) & (F.col("games") <= F.col("team_games")) & (F.col("team_games") <= MOST_GAMES) & (F.col("player_record") != "") & (F.col("team_record") != "")
    )
    _none(own.filter(~F.coalesce(good, F.lit(False))), "unusable count")
    _none(rows.groupBy("team", "season").agg(F.count_distinct("team_games").alias("n")).filter("n > 1"), "team games disagree")
    _none(rows.groupBy("player", "team", "season").count().filter("count > 1"), "counts disagree")
    return rows


def witnesses(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """Witness rows with a < b, a ten-digit game, a date in the season, and both players with the team then.

    Any other row fails the import, as do differing rows of one pair, team and season.
    """
    rows = raw.drop("record_no").distinct().withColumn("day", F.try_to_date("date"))
    for side in ("a", "b"):
        own = catalog.select(F.col("id").alias(side), F.col("teams").alias(f"{side}_teams"), F.col("first_season").alias(f"{side}_first"), F.col("last_season").alias(f"{side}_last"))
        rows = rows.join(own, side, "left")
    good = (F.col("a") < F.col("b")) & F.col("game_id").rlike("^[0-9]{10}$") & F.year("day").isin(F.col("season") - 1, F.col("season"))
    for side in ("a", "b"):
        good = good & F.array_contains(f"{side}_teams", F.col("team")) & F.col("season").between(F.col(f"{side}_first"), F.col(f"{side}_last"))
    _none(rows.filter(~F.coalesce(good, F.lit(False))), "unusable witness")
    _none(rows.groupBy("a", "b", "team", "season").count().filter("count > 1"), "witnesses disagree")
    return rows.select("a", "b", "team", "season", "game_id", F.col("day").alias("date"), "a_source", "b_source")


def load(spark: SparkSession, players_csv: DataFrame, tenures_csv: DataFrame, counts_csv: DataFrame | None = None, witnesses_csv: DataFrame | None = None) -> Report:
    """All the facts of a report, from tables as ``read_csv`` gives them; counts and witnesses may be missing."""
    people = players(players_csv)
    rows = tenure_rows(tenures_csv, people)
    sure, gaps = certified(rows)
    _none(sure.filter("start_day is null or end_day is null"), "certified row without days")
    catalog = catalog_teams(people, rows)
    empty = lambda ddl: spark.createDataFrame([], f"{ddl}, record_no long")
    return Report(
        catalog, sure, gaps,
        counts(counts_csv if counts_csv is not None else empty(COUNTS), catalog),
        witnesses(witnesses_csv if witnesses_csv is not None else empty(WITNESSES), catalog),
    )


def report_coverage(report: Report) -> DataFrame:
    """One row: certified tenures, excluded ones by class, players without a certified one, and that it isn't complete."""
    classes = report.gaps.groupBy("evidence_class").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("evidence_class", "n")))).alias("excluded"))
    bare = report.players.join(report.tenures.select(F.col("player").alias("id")), "id", "left_anti").agg(F.count("*").alias("players_without"))
    return report.tenures.agg(F.count("*").alias("certified")).join(F.broadcast(classes)).join(F.broadcast(bare)).withColumn("complete", F.lit(False))


def write_report(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """CSV files with headers whose names are in a total order of the rows: every file's rows come before the next one's.

    Rows are dealt out by ranges of ``order``, so no task holds the table; ``files`` = 1 is for small reports that must be one file.
    """
    dealt = df.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    dealt.write.option("header", True).option("lineSep", "\n").csv(path)
