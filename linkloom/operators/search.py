"""Name search over a catalog: exact and alias hits first, else tokens, prefixes and small typing errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import normalize_text, normalized, osa
from linkloom.operators.neighbourhood import ERAS

MOST_QUERY = 160
FIRST_YEAR = 1940


def catalog_names(catalog: DataFrame) -> DataFrame:
    """(id, name, form, is_alias): each player's name and aliases with their normal forms. Made once, not per query."""
    rows = catalog.select("id", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("place", "name"))
    return rows.select("id", "place", "name", normalized(F.col("name")).alias("form"), (F.col("place") > 0).alias("is_alias"))


def in_era(first: Column, era: int) -> Column:
    """Whether a career began in a decade; the last is open-ended; unknown seasons never match."""
    if era not in ERAS:
        raise ValueError(f"no such era: {era}")
    return F.coalesce((first >= era) & (F.lit(True) if era == ERAS[-1] else first < era + 10), F.lit(False))


def filtered_catalog(catalog: DataFrame, era: int | None = None, franchise: str | None = None) -> DataFrame:
    if franchise is not None and catalog.filter(F.array_contains("teams", franchise)).isEmpty():
        raise ValueError(f"no such franchise: {franchise}")
    if era is not None:
        catalog = catalog.filter(in_era(F.col("first_season"), era))
    return catalog if franchise is None else catalog.filter(F.array_contains("teams", franchise))


def _score(form: Column, query: str, one: bool) -> tuple[Column, Column]:
    """Kind and score of one name in the second phase; ``one`` says that the query is a single word."""
    tokens = F.split(form, " ")
    token = F.lit(one) & F.array_contains(tokens, query)
    whole_most = 2 if len(query) >= 8 else 1
    whole = osa(form, F.lit(query), whole_most) if len(query) >= 4 else F.lit(None).cast("int")
    kind = F.when(token, F.lit("token")).when(form.startswith(query), F.lit("prefix"))
    score = F.when(token, F.lit(850)).when(form.startswith(query), F.lit(800))
    if one and len(query) >= 3:
        begins = F.exists(tokens, lambda t: t.startswith(query))
        kind, score = kind.when(begins, F.lit("prefix")), score.when(begins, F.lit(750))
    kind, score = kind.when(whole.isNotNull(), F.lit("typo")), score.when(whole.isNotNull(), 600 - 20 * whole)
    return kind, score


def search(catalog: DataFrame, names: DataFrame, text: str, limit: int = 20, era: int | None = None, franchise: str | None = None) -> DataFrame:
    """(id, match_kind, matched_name, score, status, matches_total, has_more) by falling score, then id.

    ``names`` is ``catalog_names`` of the whole catalog. A name is hit as it is, an alias also by other spaces. Words,
    beginnings and typing errors are looked for only when nothing is hit, by queries of two letters or more. The status is settled before the list is cut. An empty query lists the
    filtered catalog if there is a filter, else nothing.
    """
    if not 1 <= limit <= 50 or len(text) > MOST_QUERY:
        raise ValueError(f"limit must be from 1 to 50, a query at most {MOST_QUERY} characters")
    query = normalize_text(text)
    kept = filtered_catalog(catalog, era, franchise)
    own = names.join(kept.select("id"), "id", "left_semi")
    if not query:
        if era is None and franchise is None:
            found = kept.select("id", F.lit("context").alias("match_kind"), F.lit("").alias("matched_name"), F.lit(0).alias("score")).limit(0)
        else:
            found = kept.select("id", F.lit("context").alias("match_kind"), F.col("name").alias("matched_name"), F.lit(0).alias("score"))
    else:
        squeezed, words = query.replace(" ", ""), query.split(" ")
        exact = ~F.col("is_alias") & (F.col("form") == query)
        hit = exact | (F.col("is_alias") & (F.replace("form", F.lit(" "), F.lit("")) == squeezed))
        # of equal aliases the first one tells
        scored = own.filter(hit).select(
            "id", (-F.col("place")).alias("place"), "name", F.when(exact, "exact_name").otherwise("alias").alias("match_kind"), F.when(exact, 1000).otherwise(950).alias("score")
        )
        if len(query) >= 2 and scored.isEmpty():
            kind, score = _score(F.col("form"), query, len(words) == 1)
            by_name = own.select("id", "place", "name", kind.alias("match_kind"), score.alias("score"))
            parts = own.filter(F.lit(len(query) >= 4 and len(words) == 1)).select("id", "place", "name", F.explode(F.split("form", " ")).alias("word"))
            by_word = parts.select("id", "place", "name", F.lit("typo").alias("match_kind"), (550 - 20 * osa(F.col("word"), F.lit(query), 1)).alias("score"))
            scored = by_name.union(by_word).filter("score is not null")
        best = scored.groupBy("id").agg(F.max(F.struct("score", "place", "match_kind", "name")).alias("best"))
        found = best.select("id", "best.match_kind", F.col("best.name").alias("matched_name"), "best.score")
    top = found.orderBy(F.desc("score"), "id").limit(max(limit, 2)).collect()
    total = found.count()
    if not query and not total:
        status = "empty_query"
    elif not total:
        status = "no_match"
    elif total > 1 and top[0]["score"] == top[1]["score"]:
        status = "ambiguous"
    elif top[0]["match_kind"] == "exact_name":
        status = "exact_match"
    else:
        status = "candidates"
    page = found.orderBy(F.desc("score"), "id").limit(limit)
    return page.select(
        "id", "match_kind", "matched_name", F.col("score").cast("int").alias("score"), F.lit(status).alias("status"),
        F.lit(total).cast("long").alias("matches_total"), F.lit(total > limit).alias("has_more"),
    )
