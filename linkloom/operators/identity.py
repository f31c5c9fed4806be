"""One source's persons matched to another's by names, births and careers, in an order of rules.

The persons of the second source become small indexes: a key (a name, a surname with a birth year, ...) with the smallest and
the largest id that has it, equal where just one has it. So a name that millions share is one row, and the first
source's persons look their keys up without pairing people with people.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import canonical, variants
from linkloom.scratch import materialise

#: The classes of a match, first to last, and of persons without one.
RULES = (
    "name+dob", "lastname+dob", "name-match-s2-dob-NA", "DOB-conflict", "name-only", "initial-surname+dob-window", "surname-fuzzy+dob-window",
    "lastname-s2dob-NA", "initial+surname", "surname+career-span", "ambiguous-name+dob", "ambiguous-name", "matches-ABA-only-player",
    "curated-alias-pbp-only", "no-match",
)
#: What is known of a person without a match.
PLAYED, INACTIVE, LATE_DEBUT, NO_EVIDENCE, OFFICIAL = (
    "S1-only-has-play-by-play", "S1-only-inactive-list-only", "S1-only-debut-2024-plus", "S1-only-no-pbp-evidence", "S1-official-appearance"
)
#: How the third source's id was found.
VIA_FIRST, NAME_AND_BIRTH, NAME_BIRTH_TOLD, NAME_ALONE, BIRTH_CONFLICT, SEVERAL = (
    "via-S1-bridge", "name-+dob", "name+dob", "name-only", "name-DOB-conflict", "ambiguous"
)
YEARS = 2
NEAR_LETTERS = 6
INITIAL_LETTERS = 5
_LATE_YEAR = 2024
_SUFFIX_PATTERN = r" (?:jr|sr|ii|iii|iv|v)(?= |$)"


def _table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once; it is joined by sorting, as what grows with the persons must not pass through the driver."""
    return materialise(df, name).hint("merge")


def _forms(people: DataFrame) -> DataFrame:
    """(id, form, last, initial, words): every variant of every name of a person, once."""
    named = people.select("id", F.explode("names").alias("name")).select("id", F.explode(variants(F.col("name"))).alias("form")).distinct()
    words = F.split("form", " ")
    return named.select("id", "form", F.element_at(words, -1).alias("last"), F.substring("form", 1, 1).alias("initial"), F.size(words).alias("words"), F.length(words[0]).alias("first_letters"))


def _index(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, low, high): the smallest and largest id with a key."""
    return rows.groupBy(*keys).agg(F.min("id").alias("low"), F.max("id").alias("high"))


def _decided(hits: DataFrame, rank: int, rule: str | Column) -> DataFrame:
    """(left, rank, rule, form, right) for the first form, in order, whose hits (left, form, low, high) all mean one person."""
    one = hits.groupBy("left", "form").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low = high")
    first = one.groupBy("left").agg(F.min(F.struct("form", "low")).alias("f")).select("left", "f.form", F.col("f.low").alias("right"))
    return first.select("left", F.lit(rank).alias("rank"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), "form", "right")


def _deletions(word: Column) -> Column:
    """A word and what is left when one letter goes: two words one edit apart have one of these in common."""
    one_less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), one_less))


def bridge(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right, rule, form): the class of each person of ``left`` (id) and the person of ``right`` it names, if any.

    Both are (id, names, born, first_season, last_season), ``names`` an array, all but id nullable; ``right`` also says
    ``other_league_only``, and such persons answer the last rule alone. The rules of ``RULES`` go in order; within one, a
    person's name forms go in order and the first that just one person has decides. Name with birth, then surname with birth;
    a name that one person has, by what the births say; initial and surname with births two years apart at most that share
    the year or the month and day; the same initial with a surname of six letters or more one edit away and a birth two years apart at
    most; a surname and name that one person of unknown birth has (rule three leaves it nothing); a first name of one or
    two letters with a surname of five or more and a person known by that initial; and a surname of several persons of whom one
    had a whole career within the person's own, unless an initial and surname near in birth were turned down. Then a name of
    several persons is ambiguous. Rows without an id or names match nothing; equal ids are one person.
    """
    right = right.hint("merge")
    people = _table(left.filter("id is not null"), "people")
    forms = _table(_forms(people).withColumnRenamed("id", "left"), "forms")
    spans = people.groupBy(F.col("id").alias("left")).agg(*[F.min(c).alias(c) for c in ("born", "first_season", "last_season")])
    own = _table(forms.join(spans, "left"), "own_forms")
    known = right.filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("born", "first_season", "last_season")], F.max(F.coalesce("other_league_only", F.lit(False))).alias("other"))
    every = _table(_forms(right.filter("id is not null")).join(known, "id"), "right_forms")
    held, other = every.filter("not other"), every.filter("other")
    by_name = _table(held.groupBy("form").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("born").alias("their_born")), "by_name")
    by_birth = _index(held.filter("born is not null"), "form", "born")
    dated = own.filter("born is not null")
    full = own.join(by_name, "form")

    said = F.when(F.col("their_born").isNull(), RULES[2]).when(~F.col("their_born").eqNullSafe(F.col("born")), RULES[3]).otherwise(RULES[4])
    named = _decided(full, 3, "").join(by_name.select("form", "their_born"), "form").join(spans.select("left", "born"), "left")
    found = [
        _decided(dated.join(by_birth, ["form", "born"]), 1, RULES[0]),
        _decided(dated.join(_index(held.filter("born is not null"), "last", "born"), ["last", "born"]), 2, RULES[1]),
        named.select("left", "rank", said.alias("rule"), "form", "right"),
    ]

    near, probes = _near_births(held, dated)
    found.append(_decided(near, 4, RULES[5]))
    found.append(_decided(_near_surnames(held, dated), 5, RULES[6]))
    surnames = _table(_index(held, "last"), "surnames")
    unknown = _index(held.filter("born is null"), "form")
    found.append(_decided(own.join(unknown, "form").join(surnames.filter("low = high").select("last"), "last").filter("words > 1"), 6, RULES[7]))
    short = own.filter(f"words > 1 and first_letters <= 2 and length(last) >= {INITIAL_LETTERS}")
    found.append(_decided(short.join(_by_initials(right, known), ["initial", "last"]), 7, RULES[8]))
    found.append(_careers(held, own, surnames, probes, near))
    for rank, rows, rule in ((9, dated.join(by_birth, ["form", "born"]), RULES[10]), (10, full, RULES[11])):
        many = rows.filter("low < high").groupBy("left").agg(F.min("form").alias("form"))
        found.append(many.select("left", F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), "form", F.lit(None).cast("string").alias("right")))
    found.append(_decided(own.join(other.groupBy("form").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("born").alias("theirs")), "form").filter("low < high or theirs is null or theirs = born"), 11, RULES[12]))
    kind = right.schema["id"].dataType
    whole = reduce(DataFrame.union, [x.withColumn("right", F.col("right").cast(kind)) for x in found])
    best = whole.groupBy("left").agg(F.min_by(F.struct("right", "rule", "form"), "rank").alias("b")).select("left", "b.*")
    return spans.select("left").join(best, "left", "left").select("left", "right", F.coalesce("rule", F.lit(RULES[-1])).alias("rule"), "form")


def _near_births(held: DataFrame, dated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits of initial and surname with a birth near and agreeing in part, and all (left) whose initial and surname have a birth near."""
    year, day = F.year("born"), F.date_format("born", "MMdd")
    theirs = held.filter("born is not null and words > 0").select("id", "initial", "last", year.alias("year"), day.alias("day"))
    by_year = _table(_index(theirs, "initial", "last", "year"), "by_year")
    by_day = _index(theirs, "initial", "last", "year", "day")
    probe = dated.filter("words > 1").select("left", "form", "initial", "last", day.alias("day"), year.alias("own_year"), F.explode(F.array(*[year + d for d in range(-YEARS, YEARS + 1)])).alias("year"))
    same = probe.filter("year = own_year").join(by_year, ["initial", "last", "year"]).select("left", "form", "low", "high")
    shifted = probe.filter("year <> own_year").join(by_day, ["initial", "last", "year", "day"]).select("left", "form", "low", "high")
    any_near = probe.join(by_year.select("initial", "last", "year"), ["initial", "last", "year"]).select("left", "form").distinct()
    return _table(same.union(shifted), "near"), any_near


def _near_surnames(held: DataFrame, dated: DataFrame) -> DataFrame:
    """Hits of the same initial and a surname one edit away with a birth near, by the letters left when one goes."""
    year = F.year("born")
    theirs = _index(held.filter("born is not null").withColumn("year", year), "initial", "last", "year")
    keys = theirs.select("initial", "year", F.col("last").alias("theirs"), "low", "high", F.explode(_deletions(F.col("last"))).alias("key"))
    wide = dated.filter(f"words > 1 and length(last) >= {NEAR_LETTERS}")
    asked = wide.select("initial", "last", F.explode(F.array(*[year + d for d in range(-YEARS, YEARS + 1)])).alias("year"), F.year("born").alias("own_year")).distinct()
    spread = asked.withColumn("key", F.explode(_deletions(F.col("last"))))
    met = spread.join(keys, ["initial", "year", "key"]).filter(F.levenshtein("last", "theirs", 1) == 1)
    met = met.groupBy("initial", "last", "own_year").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return wide.withColumn("own_year", F.year("born")).join(met, ["initial", "last", "own_year"]).select("left", "form", "low", "high")


def _by_initials(right: DataFrame, known: DataFrame) -> DataFrame:
    """The persons that a name of one letter and a surname stands for."""
    named = right.filter("id is not null").select("id", F.explode("names").alias("name")).join(known.filter("not other").select("id"), "id")
    bare = F.regexp_replace(F.concat(F.lit(" "), canonical(F.col("name"))), _SUFFIX_PATTERN, "")
    words = F.split(F.trim(bare), " ")
    two = named.select("id", words.alias("w")).filter((F.size("w") == 2) & (F.length(F.col("w")[0]) == 1))
    return _index(two.select("id", F.col("w")[0].alias("initial"), F.col("w")[1].alias("last")), "initial", "last")


def _careers(held: DataFrame, own: DataFrame, surnames: DataFrame, probes: DataFrame, near: DataFrame) -> DataFrame:
    """The career rule. Careers of one surname and seasons are one row on either side."""
    turned_down = probes.join(near.select("left", "form").distinct(), ["left", "form"], "left_anti").select("left").distinct().hint("merge")
    spans = _index(held.filter("first_season is not null"), "last", "first_season", "last_season").join(surnames.filter("low < high").select("last"), "last")
    theirs = spans.select("last", F.col("first_season").alias("a"), F.col("last_season").alias("b"), "low", "high")
    mine = own.filter("words > 1 and first_season is not null and last_season is not null").select("left", "last", "first_season", "last_season")
    asked = mine.select("last", "first_season", "last_season").distinct()
    inside = asked.join(theirs, "last").filter("first_season <= a and b <= last_season").groupBy("last", "first_season", "last_season").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hits = mine.join(inside, ["last", "first_season", "last_season"]).join(turned_down, "left", "left_anti")
    return _decided(hits.select("left", F.col("last").alias("form"), "low", "high"), 8, RULES[9]).withColumn("form", F.lit(""))


def with_aliases(bridged: DataFrame, unlisted: DataFrame, aliases: DataFrame) -> DataFrame:
    """``bridged`` with curated aliases for persons without a match whom only events name: ``unlisted`` (id, name), ``aliases`` (name, right).

    An alias counts where its name, in canonical form, is the person's; of several for one name the smallest.
    """
    wanted = aliases.select(canonical(F.col("name")).alias("key"), F.col("right").alias("alias")).groupBy("key").agg(F.min("alias").alias("alias"))
    told = unlisted.select(F.col("id").alias("left"), canonical(F.col("name")).alias("key")).join(wanted, "key").groupBy("left").agg(F.min("alias").alias("alias"))
    open_ = (F.col("rule") == RULES[-1]) & F.col("alias").isNotNull()
    return bridged.join(told, "left", "left").select(
        "left", F.when(open_, F.col("alias")).otherwise(F.col("right")).alias("right"), F.when(open_, RULES[13]).otherwise(F.col("rule")).alias("rule"), "form"
    )


def with_subclasses(bridged: DataFrame, events: DataFrame, inactive: DataFrame, first_years: DataFrame) -> DataFrame:
    """``bridged`` with what is known of each person without a match: in events, on inactive lists, a debut from 2024 on, or nothing.

    ``events`` and ``inactive`` have ids, ``first_years`` (id, first_year) the year a career began.
    """
    mark = lambda df, c: df.select(F.col("id").alias("left")).filter("left is not null").distinct().withColumn(c, F.lit(True))
    years = first_years.groupBy(F.col("id").alias("left")).agg(F.min("first_year").alias("year"))
    known = F.when(F.col("played"), PLAYED).when(F.col("listed"), INACTIVE).when(F.col("year") >= _LATE_YEAR, LATE_DEBUT).otherwise(NO_EVIDENCE)
    joined = bridged.join(mark(events, "played"), "left", "left").join(mark(inactive, "listed"), "left", "left").join(years, "left", "left")
    return joined.select("left", "right", F.when(F.col("rule") == RULES[-1], known).otherwise(F.col("rule")).alias("rule"), "form")


def official_supplements(classed: DataFrame, names: DataFrame, appearances: DataFrame) -> DataFrame:
    """(id, key, name, seasons) of the persons without a match who appear in official games, under a key of their own namespace.

    ``names`` is (id, name), ``appearances`` (season, id, team). Persons without a name stay out.
    """
    seasons = appearances.groupBy("id").agg(F.array_sort(F.collect_set("season")).alias("seasons"))
    open_ = classed.filter((F.col("rule") == PLAYED) & F.col("right").isNull()).select(F.col("left").alias("id"))
    named = names.filter("name <> ''").groupBy("id").agg(F.min("name").alias("name"))
    return open_.join(named, "id").join(seasons, "id").select("id", F.concat(F.lit("nba:"), F.col("id").cast("string")).alias("key"), "name", "seasons")


def third_source(people: DataFrame, third: DataFrame, bridged: DataFrame) -> DataFrame:
    """(id, third, method): the id of a person in a third source, which shares the first source's ids.

    ``people`` (id, names, born) are of the second source, ``third`` is (id, names, born), ``bridged`` what ``bridge`` found. The smallest
    bridged id that the third source has comes first; else a name that one person there has, by what the births say; else the one
    among several with the same birth. Several without are ambiguous, persons without a candidate have no row.
    """
    people, third = people.hint("merge"), third.hint("merge")
    via = bridged.filter("right is not null").join(third.select(F.col("id").alias("left")).distinct(), "left").groupBy(F.col("right").alias("id")).agg(F.min("left").alias("third"))
    births = third.groupBy("id").agg(F.min("born").alias("born"))
    named = _forms(third).join(births, "id")
    by_name = named.groupBy("form").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("born").alias("theirs"))
    by_birth = named.filter("born is not null").groupBy("form", "born").agg(F.min("id").alias("b_low"), F.max("id").alias("b_high")).hint("merge")
    own = people.groupBy("id").agg(F.min("born").alias("born"))
    asked = _table(_forms(people).select("id", "form").join(own, "id").join(via.select("id"), "id", "left_anti"), "asked")
    hits = asked.join(by_name, "form").join(by_birth, ["form", "born"], "left").groupBy("id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("born").alias("born"), F.min("theirs").alias("theirs"), F.min("b_low").alias("b_low"), F.max("b_high").alias("b_high")
    )
    one, told = F.col("low") == F.col("high"), F.coalesce(F.col("b_low") == F.col("b_high"), F.lit(False))
    method = (
        F.when(one & (F.col("born").isNull() | F.col("theirs").isNull()), NAME_ALONE).when(one & (F.col("born") == F.col("theirs")), NAME_AND_BIRTH)
        .when(one, BIRTH_CONFLICT).when(told, NAME_BIRTH_TOLD).otherwise(SEVERAL)
    )
    found = hits.select("id", F.when(one, F.col("low")).when(told, F.col("b_low")).alias("third"), method.alias("method"))
    return via.select("id", "third", F.lit(VIA_FIRST).alias("method")).union(found)
