"""Persons of several sources and the draft guard, over customers and orders, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import draft_guard as drafts
from linkloom.operators import identity
from linkloom.sources.tables import table

#: Names are made of these by a customer's number; Spark and the SQL read the same expressions.
_GIVEN = "split_part('john,jo,jane,carl,c,kim,karl,lee,ann,a,bob', ',', CAST(({0}) % 11 + 1 AS INT))"
_SURNAME = (
    "split_part('har,mol,tre,vin,cas,dor,wel', ',', CAST(k % 7 + 1 AS INT)) || split_part('ton,man,ber,rick,den,low', ',', CAST(floor(k / 7) % 6 + 1 AS INT))"
    " || split_part(',s,sen,ard,well', ',', CAST(floor(k / 42) % 5 + 1 AS INT))"
)
_G, _KIND = _GIVEN.format("k"), "k % 12"
_LEFT = {
    "id": "CAST(k AS {text})",
    "name": f"CASE WHEN k % 13 = 0 THEN {_G} || ' Q. ' || {_SURNAME} || ' Jr.' ELSE {_G} || ' ' || {_SURNAME} END",
    "born_day": "CASE WHEN k % 17 = 0 THEN NULL ELSE (k * 37) % 9000 END",
    "first_season": "CAST(1970 + k % 30 AS INT)",
    "last_season": "CAST(1975 + k % 30 + k % 7 AS INT)",
}
_RIGHT = {
    "id": "'r' || lpad(CAST(k AS {text}), 9, '0')",
    "name": f"""CASE {_KIND} WHEN 1 THEN {_GIVEN.format("k + 3")} || ' ' || {_SURNAME} WHEN 4 THEN substr({_G}, 1, 1) || 'x ' || {_SURNAME}
      WHEN 5 THEN substr({_G}, 1, 1) || 'z ' || substr({_SURNAME}, 1, length({_SURNAME}) - 1) || 'q' WHEN 6 THEN substr({_G}, 1, 1) || ' ' || {_SURNAME}
      WHEN 7 THEN 'red ' || {_SURNAME} WHEN 9 THEN {_G} || ' Q ' || {_SURNAME} ELSE {_G} || ' ' || {_SURNAME} END""",
    "born_day": f"CASE {_KIND} WHEN 2 THEN NULL WHEN 6 THEN NULL WHEN 8 THEN NULL WHEN 3 THEN (k * 37) % 9000 + 400 WHEN 4 THEN (k * 37) % 9000 + 20 WHEN 5 THEN (k * 37) % 9000 + 300 WHEN 7 THEN (k * 37) % 9000 + 9000 ELSE (k * 37) % 9000 END",
    "first_season": "CAST(1970 + k % 30 + k % 3 AS INT)",
    "last_season": "CAST(1975 + k % 30 + k % 7 - k % 2 AS INT)",
    "other_league_only": f"{_KIND} = 8",
}


def _people(spark: SparkSession, sf_dir: str, columns: dict[str, str], kept: str = "true") -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).filter(kept)
    made = k.select(*[F.expr(e.format(text="STRING")).alias(c) for c, e in columns.items()])
    born = F.date_add(F.lit("1950-01-01").cast("date"), F.col("born_day").cast("int"))
    return made.withColumns({"names": F.array("name"), "born": born}).drop("born_day")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _people(spark, sf_dir, _LEFT), _people(spark, sf_dir, _RIGHT, f"{_KIND} < 10")


def name_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers bridged to customers under changed names, births and careers, a change for each rule."""
    return identity.bridge(*_both(spark, sf_dir)).drop("form")


def bridge_subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with aliases and what is known of those without a match, and the official supplement's key."""
    left, right = _both(spark, sf_dir)
    k = F.col("id").cast("long")
    aliases = left.filter(k % 19 == 0).select("name", F.concat(F.lit("alias"), "id").alias("right"))
    found = identity.with_aliases(identity.bridge(left, right), left.filter(k % 2 == 0), aliases)
    users = table(spark, sf_dir, "events").filter("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("id"))
    years = left.select("id", (F.col("first_season") + 30).alias("first_year"))
    classed = identity.with_subclasses(found, users, left.filter(k % 5 == 0).select("id"), years)
    games = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), F.col("o_custkey").cast("string").alias("id"), F.lit("T").alias("team"))
    keys = identity.official_supplements(classed, left.select("id", "name"), games).select(F.col("id").alias("left"), "key", F.array_join(F.transform("seasons", lambda s: s.cast("string")), ",").alias("seasons"))
    return classed.join(keys, "left", "left").select("left", "rule", F.coalesce("right", "key").alias("right"), "seasons")


def third_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in a third source for the second source's persons; it lacks every fourth id of the first and renames others."""
    left, right = _both(spark, sf_dir)
    k = F.col("id").cast("long")
    third = left.filter(k % 4 != 0).select("id", "names", F.when(k % 6 != 1, F.col("born")).alias("born"))
    bridged = identity.bridge(left, right).filter(F.col("left").cast("long") % 3 != 1)
    return identity.third_source(right.select("id", "names", "born"), third, bridged)


_LEGS = {
    "row": "o_orderkey", "leg": "0", "slug": "o_custkey", "date": "CAST(o_orderdate AS DATE)",
    "date_precision": "CASE WHEN o_orderkey % 29 = 3 THEN 'fuzzy' ELSE 'precise' END",
    "league": "CASE WHEN o_orderkey % 31 = 3 THEN 'ABA' ELSE 'NBA' END",
    "scope": "CASE WHEN o_orderkey % 7 = 6 THEN 'non-roster' ELSE 'nba-roster' END",
    "action": "CASE o_orderkey % 7 WHEN 2 THEN 'sign' WHEN 3 THEN 'waive' WHEN 4 THEN 'claim' WHEN 6 THEN 'extension' ELSE 'trade' END",
    "depart": "CASE o_orderkey % 7 WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 6 THEN NULL ELSE 'T' || CAST(floor(o_orderkey / 7) % 3 AS {text}) END",
    "arrive": "CASE o_orderkey % 7 WHEN 3 THEN NULL ELSE 'T' || CAST(floor(o_orderkey / 21) % 3 AS {text}) END",
}


def draft_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as movements of customers between three teams, held back in the draft year unless a contract is on record."""
    legs = table(spark, sf_dir, "orders").select(*[F.expr(e.format(text="STRING")).alias(c) for c, e in _LEGS.items()])
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    drafted = c.filter(k % 4 != 3).select((1992 + k % 7).cast("string").alias("season"), F.when(k % 23 == 0, "ABA").otherwise("NBA").alias("league"), k.alias("player"))
    seasons = c.filter(k % 5 != 0).select((1992 + k % 7 + k % 3).cast("string").alias("season"), F.lit("NBA").alias("league"), k.alias("player"))
    return drafts.guard(legs, drafted, seasons).select("row", "slug", "scope", "action", "scope_reason", "row_scope")


QUERIES = {f.__name__: f for f in (name_bridge, bridge_subclasses, third_source_ids, draft_guard)}


def _made(columns: dict[str, str], kept: str) -> str:
    made = ", ".join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in columns.items())
    return f"SELECT * EXCLUDE (born_day), DATE '1950-01-01' + CAST(born_day AS INT) AS born FROM (SELECT k, {made} FROM (SELECT c_custkey AS k FROM customer) WHERE {kept})"


def _spelt(people: str) -> str:
    """Each name, and it without its suffix and its middle letter."""
    bare = "lower(replace(name, '.', ''))"
    forms = f"list_distinct([{bare}, regexp_replace({bare}, ' jr$', ''), regexp_replace(regexp_replace({bare}, ' jr$', ''), ' q ', ' ')])"
    return f"SELECT *, string_split(form, ' ')[-1] AS last, form[1] AS ini, len(string_split(form, ' ')) AS words FROM (SELECT *, unnest({forms}) AS form FROM {people})"


def _rule(rank: int, rule: str, hits: str) -> str:
    return f"SELECT id, {rank} AS rank, {rule} AS rule, arg_min(rid, form) AS rid FROM (SELECT id, form, min(rid) AS rid FROM ({hits}) GROUP BY ALL HAVING count(DISTINCT rid) = 1) GROUP BY id"


_PAIR = "SELECT l.id, l.form, r.id AS rid FROM lf l JOIN rf r ON "
_AGREE = "(year(l.born) = year(r.born) OR strftime(l.born, '%m%d') = strftime(r.born, '%m%d'))"
_NEAR = "l.words > 1 AND l.ini = r.ini AND l.last = r.last AND abs(year(l.born) - year(r.born)) <= 2"
_BRIDGE = f"""l AS ({_made(_LEFT, "true")}), every AS ({_made(_RIGHT, f"{_KIND} < 10")}), r AS (SELECT * FROM every WHERE NOT other_league_only),
  lf AS ({_spelt("l")}), rf AS ({_spelt("r")}), af AS ({_spelt("(SELECT * FROM every WHERE other_league_only)")}),
  vetoed AS (SELECT DISTINCT n.id FROM (SELECT l.id, l.form, bool_or({_AGREE}) AS ok FROM lf l JOIN rf r ON {_NEAR} GROUP BY l.id, l.form) n WHERE NOT ok),
  holders AS (SELECT last, count(DISTINCT id) AS n FROM rf GROUP BY last),
  one AS ({_rule(3, "''", _PAIR + "l.form = r.form")}),
  ruled AS (
    {_rule(1, "'name+dob'", _PAIR + "l.form = r.form AND l.born = r.born")}
    UNION ALL {_rule(2, "'lastname+dob'", _PAIR + "l.last = r.last AND l.born = r.born")}
    UNION ALL SELECT one.id, 3, CASE WHEN r.born IS NULL THEN 'name-match-s2-dob-NA' WHEN r.born IS DISTINCT FROM l.born THEN 'DOB-conflict' ELSE 'name-only' END, rid FROM one JOIN l USING (id) JOIN r ON r.id = rid
    UNION ALL {_rule(4, "'initial-surname+dob-window'", _PAIR + _NEAR + " AND " + _AGREE)}
    UNION ALL {_rule(5, "'surname-fuzzy+dob-window'", _PAIR + "l.words > 1 AND length(l.last) >= 6 AND l.ini = r.ini AND levenshtein(l.last, r.last) = 1 AND abs(year(l.born) - year(r.born)) <= 2")}
    UNION ALL {_rule(6, "'lastname-s2dob-NA'", _PAIR + "l.form = r.form AND l.words > 1 AND r.born IS NULL JOIN holders h ON h.last = l.last AND h.n = 1")}
    UNION ALL {_rule(7, "'initial+surname'", _PAIR + "l.words > 1 AND length(string_split(l.form, ' ')[1]) <= 2 AND length(l.last) >= 5 AND l.last = r.last AND l.ini = r.ini AND regexp_matches(lower(r.name), '^. [a-z]+$')")}
    UNION ALL {_rule(8, "'surname+career-span'", "SELECT l.id, l.last AS form, r.id AS rid FROM lf l JOIN rf r ON l.last = r.last AND l.words > 1 AND l.first_season <= r.first_season AND r.last_season <= l.last_season JOIN holders h ON h.last = l.last AND h.n > 1 WHERE l.id NOT IN (SELECT id FROM vetoed)")}
    UNION ALL SELECT id, 9, 'ambiguous-name+dob', NULL FROM (SELECT l.id, l.form FROM lf l JOIN rf r ON l.form = r.form AND l.born = r.born GROUP BY ALL HAVING count(DISTINCT r.id) > 1) GROUP BY id
    UNION ALL SELECT id, 10, 'ambiguous-name', NULL FROM (SELECT l.id, l.form FROM lf l JOIN rf r ON l.form = r.form GROUP BY ALL HAVING count(DISTINCT r.id) > 1) GROUP BY id
    UNION ALL SELECT id, 11, 'matches-ABA-only-player', arg_min(rid, form) FROM (SELECT l.id, l.form, min(r.id) AS rid FROM lf l JOIN af r ON l.form = r.form GROUP BY ALL HAVING count(DISTINCT r.id) = 1 AND (min(r.born) IS NULL OR min(r.born) = min(l.born))) GROUP BY id
  ), bridged AS (SELECT l.id AS left_id, b.rid, coalesce(b.rule, 'no-match') AS rule FROM l LEFT JOIN (SELECT * FROM ruled QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1) b ON b.id = l.id)"""

SQL = {
    "bridge_subclasses": f"""WITH {_BRIDGE}, aliased AS (
        SELECT left_id, CASE WHEN open THEN alias ELSE rid END AS rid, CASE WHEN open THEN 'curated-alias-pbp-only' ELSE rule END AS rule FROM (
          SELECT b.*, a.alias, b.rule = 'no-match' AND a.alias IS NOT NULL AND l.id::BIGINT % 2 = 0 AS open FROM bridged b JOIN l ON l.id = left_id
            LEFT JOIN (SELECT name, min('alias' || id) AS alias FROM l WHERE id::BIGINT % 19 = 0 GROUP BY name) a ON a.name = l.name)
      ), classed AS (
        SELECT left_id, rid, CASE WHEN rule <> 'no-match' THEN rule WHEN left_id::BIGINT IN (SELECT user_id FROM events WHERE user_id % 3 = 0) THEN 'S1-only-has-play-by-play'
          WHEN left_id::BIGINT % 5 = 0 THEN 'S1-only-inactive-list-only' WHEN first_season + 30 >= 2024 THEN 'S1-only-debut-2024-plus' ELSE 'S1-only-no-pbp-evidence' END AS rule
        FROM aliased JOIN l ON l.id = left_id
      ), seasons AS (SELECT o_custkey AS k, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS seasons FROM orders GROUP BY 1)
      SELECT left_id AS "left", rule, coalesce(rid, CASE WHEN seasons IS NOT NULL THEN 'nba:' || left_id END) AS "right", seasons
      FROM classed LEFT JOIN seasons ON k = left_id::BIGINT AND rule = 'S1-only-has-play-by-play'""",
    "third_source_ids": f"""WITH {_BRIDGE}, t AS (SELECT id, name, form, CASE WHEN id::BIGINT % 6 <> 1 THEN born END AS born FROM lf WHERE id::BIGINT % 4 <> 0),
      via AS (SELECT rid AS id, min(left_id) AS third FROM bridged WHERE rid IS NOT NULL AND left_id::BIGINT % 3 <> 1 AND left_id::BIGINT % 4 <> 0 GROUP BY rid),
      ef AS ({_spelt("every")}), met AS (
        SELECT e.id, min(t.id) AS third, count(DISTINCT t.id) AS n, min(e.born) AS mine, min(t.born) AS theirs, count(DISTINCT t.id) FILTER (t.born = e.born) AS dated, min(t.id) FILTER (t.born = e.born) AS dated_id
        FROM ef e JOIN t ON t.form = e.form WHERE e.id NOT IN (SELECT id FROM via) GROUP BY e.id)
      SELECT id, third, 'via-S1-bridge' AS method FROM via
      UNION ALL SELECT id, CASE WHEN n = 1 THEN third WHEN dated = 1 THEN dated_id END, CASE WHEN n = 1 AND (mine IS NULL OR theirs IS NULL) THEN 'name-only' WHEN n = 1 AND mine = theirs THEN 'name-+dob'
        WHEN n = 1 THEN 'name-DOB-conflict' WHEN dated = 1 THEN 'name+dob' ELSE 'ambiguous' END FROM met""",
    "name_bridge": f"""WITH {_BRIDGE} SELECT left_id AS "left", rid AS "right", rule FROM bridged""",
    "draft_guard": f"""WITH RECURSIVE leg AS (SELECT {", ".join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in _LEGS.items())} FROM orders),
      d AS (SELECT c_custkey AS slug, 1992 + c_custkey % 7 AS year FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 23 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 3 > 0)),
      o AS (SELECT leg.*, d.year IS NOT NULL AS entrant, row_number() OVER (PARTITION BY leg.slug ORDER BY date, row) AS n
        FROM leg LEFT JOIN d ON d.slug = leg.slug AND d.year = year(leg.date) WHERE date_precision = 'precise' AND league IN ('NBA', 'BAA')),
      walk AS (
        SELECT slug, 0::BIGINT AS n, NULL::DATE AS day, []::VARCHAR[] AS known, []::VARCHAR[] AS now, NULL::BIGINT AS row, false AS held FROM (SELECT DISTINCT slug FROM o)
        UNION ALL
        SELECT slug, n, date, known, CASE WHEN held OR scope <> 'nba-roster' THEN now
            ELSE list_distinct(list_concat(list_filter(now, lambda t: t IS DISTINCT FROM depart), CASE WHEN arrive IS NOT NULL AND action IN ('sign', 'claim', 'trade') THEN [arrive] ELSE [] END)) END, row, held
        FROM (SELECT *, coalesce(scope = 'nba-roster' AND action = 'trade' AND entrant AND NOT list_contains(known, depart), false) AS held
          FROM (SELECT o.*, w.now, CASE WHEN w.day IS NOT DISTINCT FROM o.date THEN w.known ELSE w.now END AS known FROM walk w JOIN o ON o.slug = w.slug AND o.n = w.n + 1)))
      SELECT leg.row, leg.slug, CASE WHEN w.held THEN 'unresolved' ELSE leg.scope END AS scope, CASE WHEN w.held THEN 'draft-roster-status-unresolved' ELSE leg.action END AS action,
        CASE WHEN w.held THEN 'draft-year=' || year(leg.date) || ';prior-dated-active-contract-unestablished;missing-signing-is-uncertainty-not-absence' END AS scope_reason,
        CASE WHEN w.held THEN 'unresolved' ELSE leg.scope END AS row_scope
      FROM leg LEFT JOIN walk w ON w.row = leg.row""",
}
