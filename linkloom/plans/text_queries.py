"""Queries of the text, search, page, judgment and provenance operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import backbone, evidence, intervals, judgments, layout, neighbourhood, provenance, search, tenure
from linkloom.plans.graph_queries import EVIDENCE, START, WEIGHED, evidence_of, evidence_rows, groups
from linkloom.scratch import materialise
from linkloom.sources import tables, transactions


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = (1940 + F.col("p_size")).cast("int")
    return tables.table(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("Alias "), F.col("p_partkey").cast("string"))).alias("aliases"),
        season.alias("first_season"), (season + 12).alias("last_season"), F.array("p_brand").alias("teams"),
    )


def _found(spark, sf_dir, query, **more):
    c = _catalog(spark, sf_dir)
    return search.search(c, search.catalog_names(c), query, **more)


def _a_name(spark, sf_dir) -> str:
    return tables.table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]


def search_exact(spark, sf_dir):
    return _found(spark, sf_dir, _a_name(spark, sf_dir), limit=50)


def search_alias(spark, sf_dir):
    return _found(spark, sf_dir, "ALIAS 17!")


def search_context(spark, sf_dir):
    return _found(spark, sf_dir, "", era=1950, limit=50)


def search_fuzzy(spark, sf_dir):
    """A word with two letters swapped, which is near the word "small" alone."""
    return _found(spark, sf_dir, "smlal", limit=50)


def search_words(spark, sf_dir):
    """A whole word of many names, which also begins others."""
    return _found(spark, sf_dir, "re", limit=50)


def normalized_names(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.normalized("c_name").alias("normalized"), text.canonical(F.col("c_name")).alias("canonical"))


def document_spans(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(text.mention_spans(F.col("p_name")), "|").alias("spans"))


def escaped_urls(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    return p.select("page_id", text.escape_html(F.col("url")).alias("html"), F.octet_length(text.bounded_json(F.col("html"))).alias("bounded_bytes"))


def era_mentions(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    y = F.year("o_orderdate").cast("string")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("from "), y, F.lit(" to 2010"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("in "), y)).otherwise("the 1990s")
    return o.select("o_orderkey", F.explode(transactions.eras(said)).alias("e")).select("o_orderkey", "e.first", "e.last")


def _trade_pages(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    team = lambda k, mark: F.concat(F.lit(f'<a data-attr-{mark}="T'), (k % 30).cast("string"), F.lit('">Team</a>'))
    player = lambda k: F.concat(F.lit('<a href="/players/c/c'), k.cast("string"), F.lit('.html">Player &amp; '), k.cast("string"), F.lit("</a>"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    trade = F.concat(F.lit("The "), team(k, "from"), F.lit(" traded "), player(c), F.lit(" to the "), team(k + 1, "to"), F.lit(" for "), player(c + 1), F.lit("."))
    sign = F.concat(F.lit("The "), team(k, "to"), F.lit(" signed "), player(c), F.lit(" as a free agent."))
    body = F.when(F.col("o_orderstatus") == "O", sign).otherwise(trade)
    html = F.concat(F.lit('<p>x</p><span id="transactions_link"></span><ul><li><span>January 5, 2024</span><p>'), body, F.lit("</p></ul><p>after</p>"))
    return o.select(k.alias("page_id"), html.alias("html"))


def transaction_movements(spark, sf_dir):
    legs = transactions.movements(transactions.page_items(_trade_pages(spark, sf_dir)))
    return legs.select("page_id", "slug", "name", "depart", "arrive", "scope", "action")


#: A sentence of each shape, and what it reports.
_SAID = (
    ("The Hawks traded Al Low to the Kings for a pick.", "trade", "nba-roster"),
    ("The Hawks signed Al Low as a free agent.", "sign", "nba-roster"),
    ("The Hawks re-signed Al Low.", "resign", "nba-roster"),
    ("The Hawks waived Al Low.", "waive", "nba-roster"),
    ("The Hawks released Al Low.", "release", "nba-roster"),
    ("Al Low was claimed on waivers by the Hawks.", "claim", "nba-roster"),
    ("The contract expires for Al Low, who was not re-signed.", "contract-expiration", "nba-roster"),
    ("Al Low did not sign with the Hawks.", "other", "unresolved"),
    ("The Hawks fired Al Low as head coach.", "coach-fire", "non-roster"),
    ("The Hawks hired Al Low as Assistant Coach.", "coach-hire", "non-roster"),
    ("Al Low, head coach, was signed.", "coach-other", "non-roster"),
    ("The Hawks converted Al Low from a two-way contract to a regular contract.", "contract-conversion", "non-roster"),
    ("The Hawks sold the player rights to Al Low to the Kings.", "rights-transfer", "non-roster"),
    ("The Hawks assigned Al Low to the Skyforce of the G-League.", "g-league-assignment", "non-roster"),
    ("The Hawks recalled Al Low from the D-League.", "g-league-recall", "non-roster"),
    ("Al Low was transferred to the development league.", "g-league-loan-or-transfer", "non-roster"),
    ("The Hawks signed Al Low to a contract extension.", "extension", "non-roster"),
    ("Al Low was selected in the dispersal draft.", "dispersal", "nba-roster"),
    ("Al Low retired.", "other", "unresolved"),
    ("The waiver of Al Low ran out.", "claim", "nba-roster"),
)


def event_classes(spark, sf_dir):
    """Orders as sentences, one of each shape in turn, half of them in capitals."""
    said = F.get(F.array(*[F.lit(s) for s, _, _ in _SAID]), (F.col("o_orderkey") % len(_SAID)).cast("int"))
    o = tables.table(spark, sf_dir, "orders").withColumn("said", F.when(F.col("o_custkey") % 2 == 0, F.upper(said)).otherwise(said))
    c = transactions.event_class(F.col("said"))
    return o.select("o_orderkey", c.alias("event_class"), transactions.event_scope(c).alias("event_scope"))


def accepted_choices(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    k = F.col("event_id")
    p = (k % 101) / F.lit(100.0)
    probabilities = F.create_map(F.lit("o000"), p, F.lit("o001"), F.lit(1.0) - p + F.when(k % 13 == 0, 0.03).otherwise(0.0))
    chosen = judgments.accepted_choice(F.when(k % 3 == 0, "o001").otherwise("o000"), probabilities, (k % 7) / F.lit(6.0), F.array(F.lit("o000"), F.lit("o001")))
    return e.select("event_id", chosen.alias("chosen"))


def valid_scores(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    p = (F.col("event_id") % 11) / F.lit(10.0)
    levels = F.array(p, F.lit(1.0) - p, F.lit(0.0))
    off = F.when(F.col("event_id") % 4 == 0, 0.5).when(F.col("event_id") % 4 == 1, 0.01).otherwise(0.0)
    ok = judgments.valid_score(levels, F.lit(1.0) - p + off, F.when(F.col("event_id") % 9 == 0, 2).otherwise(3))
    return e.select("event_id", ok.alias("valid"))


def threshold_sweep(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(((F.col("event_id") % 97) / F.lit(96.0)).alias("confidence"), (F.col("event_id") % 5 != 0).alias("correct"))
    return judgments.threshold_sweep(e, [0.1, 0.25, 0.5, 0.75, 0.9])


def experiment_summary(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    k = F.col("event_id")
    runs = e.select(
        F.when(k % 2 == 0, "held-out").otherwise("tuning").alias("split"), F.col("event_type").alias("component"), (k % 3).cast("string").alias("variant"), (k % 5 != 0).alias("correct"),
        (k % 7 != 0).alias("automatic"), F.when(k % 3 != 0, k).alias("tokens"), (k * 2).alias("cost"), (k % 100).cast("double").alias("latency"),
    )
    return judgments.experiment_summary(runs)


def record_lookup(spark, sf_dir):
    t = tables.tenures(spark, sf_dir).withColumn("record", F.concat_ws(":", "player", "team", F.col("start_day").cast("string")))
    wanted = t.select("player", "team").union(t.select("player", F.lit("T000000000"))).distinct()
    return provenance.record_lookup(t.filter("start_day % 2 = 0"), t.filter("start_day % 2 = 1 and start_day % 3 = 0"), wanted)


def player_gaps(spark, sf_dir):
    t = tables.tenures(spark, sf_dir).withColumn("record", F.concat_ws(":", "team", F.col("start_day").cast("string")))
    return provenance.player_gaps(t, 10)


def evidence_pages(spark, sf_dir):
    t = tables.tenures(spark, sf_dir)
    witnesses = evidence.coparticipations(tables.appearances(spark, sf_dir))
    rows = evidence.evidence_rows(t, tables.counts(spark, sf_dir), witnesses, tables.players(spark, sf_dir))
    overlaps = intervals.record_overlaps(t.withColumn("record", F.concat_ws(":", "player", F.col("start_day").cast("string"))))
    page = provenance.evidence_page(rows, overlaps)
    return page.select("a", "b", "kind_rank", "team", "text", F.coalesce(F.size("overlaps"), F.lit(0)).alias("n_overlaps"))


def content_ids(spark, sf_dir):
    return tables.table(spark, sf_dir, "nation").select("n_nationkey", provenance.content_id("n_nationkey", "n_name").alias("content_id"))


def snapshot_identity(spark, sf_dir):
    return provenance.snapshot_identity({n: tables.table(spark, sf_dir, n) for n in ("customer", "part", "orders", "nation")})


def telemetry_summary(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"), "value")
    return provenance.telemetry_summary(e).withColumn("mean_value", F.round("mean_value", 6))


def evidence_classes(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    reasons = F.when(k % 11 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", tenure.evidence_class(k % 2 == 0, k % 3 == 0, k % 5 == 0, reasons).alias("evidence_class"))


QUERIES = {
    f.__name__: f
    for f in (
        search_exact, search_alias, search_context, search_fuzzy, search_words, normalized_names, document_spans, escaped_urls, era_mentions, transaction_movements, event_classes,
        accepted_choices, valid_scores, threshold_sweep, experiment_summary, record_lookup, player_gaps, evidence_pages, content_ids, snapshot_identity, telemetry_summary,
        evidence_classes,
    )
}

_CATALOG = """c AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS id, p_name AS name, 'Alias ' || p_partkey AS alias, 1940 + p_size AS season, p_brand AS team FROM part)"""
_TENURES = """t AS (SELECT DISTINCT 'P' || lpad(o_custkey::VARCHAR, 9, '0') AS player, 'T' || lpad(l_partkey::VARCHAR, 9, '0') AS team,
  (o_orderdate::DATE - DATE '1946-01-01')::INTEGER AS start_day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _hits(where: str, kind: str, name: str, score: int, status: str, limit: int) -> str:
    return f"""WITH {_CATALOG}, h AS (SELECT id, {name} AS n FROM c WHERE {where})
      SELECT id, '{kind}' AS match_kind, n AS matched_name, {score} AS score, {status} AS status, (SELECT count(*) FROM h) AS matches_total, (SELECT count(*) FROM h) > {limit} AS has_more
      FROM h ORDER BY id LIMIT {limit}"""


_STATUS = "CASE WHEN (SELECT count(*) FROM h) > 1 THEN 'ambiguous' ELSE '{}' END"
_COLUMNS = {
    "customer": "c_acctbal c_custkey c_mktsegment c_name c_nationkey", "nation": "n_name n_nationkey n_regionkey",
    "orders": "o_custkey o_orderdate o_orderkey o_orderpriority o_orderstatus o_totalprice", "part": "p_brand p_name p_partkey p_retailprice p_size p_type",
}


def _identity_sql(name: str) -> str:
    text = " || chr(31) || ".join(f"{c}::VARCHAR" for c in _COLUMNS[name].split())
    return f"SELECT '{name}' AS \"table\", count(*) AS rows, sha256(sum(('0x' || md5({text})[1:15])::BIGINT)::VARCHAR) AS digest FROM {name}"


SQL = {
    "search_exact": _hits("name = (SELECT min(p_name) FROM part)", "exact_name", "name", 1000, _STATUS.format("exact_match"), 50),
    "search_alias": _hits("alias = 'Alias 17'", "alias", "alias", 950, _STATUS.format("candidates"), 20),
    "search_context": _hits("season >= 1950 AND season < 1960", "context", "name", 0, _STATUS.format("candidates"), 50),
    "search_fuzzy": f"""WITH {_CATALOG}, n AS (SELECT id, unnest([name, alias]) AS n FROM c), w AS (SELECT id, n, unnest([lower(n)]) AS form, unnest(string_split(lower(n), ' ')) AS word FROM n),
      s AS (SELECT id, n, CASE WHEN word = 'smlal' THEN 850 WHEN starts_with(form, 'smlal') THEN 800 WHEN starts_with(word, 'smlal') THEN 750
          WHEN damerau_levenshtein(form, 'smlal') <= 1 THEN 600 - 20 * damerau_levenshtein(form, 'smlal') WHEN damerau_levenshtein(word, 'smlal') <= 1 THEN 550 - 20 * damerau_levenshtein(word, 'smlal') END AS score FROM w),
      h AS (SELECT id, max(score)::INTEGER AS score, arg_max(n, score) AS n FROM s WHERE score IS NOT NULL GROUP BY id), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM h)
      SELECT id, CASE WHEN score >= 850 THEN 'token' WHEN score >= 750 THEN 'prefix' ELSE 'typo' END AS match_kind, n AS matched_name, score,
        CASE WHEN (SELECT count(*) FROM o WHERE place <= 2) = 2 AND (SELECT min(score) = max(score) FROM o WHERE place <= 2) THEN 'ambiguous' ELSE 'candidates' END AS status,
        (SELECT count(*) FROM o) AS matches_total, (SELECT count(*) FROM o) > 50 AS has_more FROM o WHERE place <= 50 ORDER BY place""",
    "search_words": f"""WITH {_CATALOG}, h AS (SELECT id, name AS n, CASE WHEN list_contains(string_split(lower(name), ' '), 're') THEN 850 ELSE 800 END::INTEGER AS score FROM c
        WHERE list_contains(string_split(lower(name), ' '), 're') OR starts_with(lower(name), 're')), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM h)
      SELECT id, CASE score WHEN 850 THEN 'token' ELSE 'prefix' END AS match_kind, n AS matched_name, score,
        CASE WHEN (SELECT count(*) FROM o WHERE place <= 2) = 2 AND (SELECT min(score) = max(score) FROM o WHERE place <= 2) THEN 'ambiguous' ELSE 'candidates' END AS status,
        (SELECT count(*) FROM o) AS matches_total, (SELECT count(*) FROM o) > 50 AS has_more FROM o WHERE place <= 50 ORDER BY place""",
    "normalized_names": "SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS normalized, lower(replace(c_name, '#', ' ')) AS canonical FROM customer",
    "document_spans": """SELECT p_partkey, array_to_string(list_filter([w[1], p_name, w[2]], lambda x, i: x IS NOT NULL AND (i < 3 OR x <> w[1])), '|') AS spans
      FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)""",
    "escaped_urls": """SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
      (CASE WHEN strlen(html) > 4096 THEN length('{"truncated":true,"bytes":' || strlen(html) || '}') ELSE strlen(html) END)::INTEGER AS bounded_bytes FROM pages""",
    "era_mentions": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 1990 ELSE year(o_orderdate)::INTEGER END AS first,
      CASE o_orderkey % 3 WHEN 0 THEN 2010 WHEN 1 THEN year(o_orderdate)::INTEGER ELSE 1999 END AS last FROM orders""",
    "transaction_movements": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus = 'O' AS sign FROM orders)
      SELECT k AS page_id, 'c' || c AS slug, 'Player & ' || c AS name, CASE WHEN NOT sign THEN 'T' || (k % 30) END AS depart,
        CASE WHEN sign THEN 'T' || (k % 30) ELSE 'T' || ((k + 1) % 30) END AS arrive, 'nba-roster' AS scope, CASE WHEN sign THEN 'sign' ELSE 'trade' END AS action FROM o
      UNION ALL SELECT k, 'c' || (c + 1), 'Player & ' || (c + 1), 'T' || ((k + 1) % 30), 'T' || (k % 30), 'nba-roster', 'trade' FROM o WHERE NOT sign""",
    "event_classes": f"""SELECT o_orderkey, [{", ".join(f"'{c}'" for _, c, _ in _SAID)}][o_orderkey % {len(_SAID)} + 1] AS event_class,
      [{", ".join(f"'{s}'" for _, _, s in _SAID)}][o_orderkey % {len(_SAID)} + 1] AS event_scope FROM orders""",
    "evidence_pages": f"""WITH {EVIDENCE}, n AS (SELECT x.player AS a, y.player AS b, team, count(*)::INTEGER AS n FROM tenures x JOIN tenures y USING (team)
        WHERE x.player < y.player AND x.start_day < y.end_day AND y.start_day < x.end_day GROUP BY ALL)
      SELECT e.a, e.b, e.kind_rank, e.team, CASE e.kind_rank WHEN 0 THEN 'Memberships overlap by ' || e.overlap_days || ' overlapping days'
          WHEN 1 THEN c.a_games || ' and ' || c.b_games || ' of ' || c.team_games || ' games: ' || c.minimum_shared_games || ' shared at least' ELSE 'Both took part in game ' || e.game_id || ' on ' || w.date END AS text,
        CASE WHEN e.kind_rank = 0 THEN n.n ELSE 0 END AS n_overlaps
      FROM ev e LEFT JOIN n ON n.a = e.a AND n.b = e.b AND n.team = e.team LEFT JOIN counted c ON e.kind_rank = 1 AND c.a = e.a AND c.b = e.b AND c.team = e.team AND c.season = e.season
        LEFT JOIN witness w ON e.kind_rank = 2 AND w.a = e.a AND w.b = e.b AND w.team = e.team AND w.season = e.season""",
    "accepted_choices": """WITH e AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS p, (event_id % 7) / 6.0::DOUBLE AS c FROM events),
      s AS (SELECT event_id, c, event_id % 13 <> 0 AS sums, CASE WHEN event_id % 3 = 0 THEN 1 - p ELSE p END AS own FROM e)
      SELECT event_id, CASE WHEN sums AND own >= 0.95::DOUBLE AND c >= 0.95::DOUBLE AND own - (1 - own) >= 0.25::DOUBLE THEN CASE WHEN event_id % 3 = 0 THEN 'o001' ELSE 'o000' END END AS chosen FROM s""",
    "valid_scores": "SELECT event_id, event_id % 4 <> 0 AND event_id % 9 <> 0 AS valid FROM events",
    "threshold_sweep": """WITH e AS (SELECT (event_id % 97) / 96.0::DOUBLE AS c, event_id % 5 <> 0 AS ok FROM events), t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS threshold)
      SELECT threshold, count(*) FILTER (NOT ok) AS wrong, count(*) FILTER (ok) AS correct FROM t LEFT JOIN e ON c >= threshold GROUP BY threshold""",
    "experiment_summary": """WITH r AS (SELECT event_id AS k, CASE WHEN event_id % 2 = 0 THEN 'held-out' ELSE 'tuning' END AS split, event_type AS component, (event_id % 3)::VARCHAR AS variant FROM events)
      SELECT split, component, variant, count(*) AS n, count(*) FILTER (k % 5 <> 0) AS correct, count(*) FILTER (k % 7 <> 0 AND k % 5 = 0) AS false_automatic,
        count(*) FILTER (k % 7 = 0) AS abstained, CASE WHEN variant <> '0' THEN sum(k)::BIGINT END AS tokens, (sum(k) * 2)::BIGINT AS cost,
        median((k % 100)::DOUBLE) AS median_latency, max((k % 100)::DOUBLE) AS max_latency FROM r GROUP BY split, component, variant""",
    "record_lookup": f"""WITH {_TENURES}, r AS (SELECT *, player || ':' || team || ':' || start_day AS record, CASE WHEN start_day % 2 = 0 THEN 0 WHEN start_day % 3 = 0 THEN 1 END AS rank FROM t),
      w AS (SELECT player, team FROM t UNION SELECT player, 'T000000000' FROM t),
      b AS (SELECT player, team, min((rank, record)) AS r FROM r WHERE rank IS NOT NULL GROUP BY player, team)
      SELECT player, team, CASE r[1] WHEN 0 THEN 'certified' WHEN 1 THEN 'gap' ELSE 'not_found' END AS found, r[2] AS record FROM w LEFT JOIN b USING (player, team)""",
    "player_gaps": f"""WITH {_TENURES}, r AS (SELECT player, team || ':' || start_day AS record FROM t)
      SELECT player, record, (row_number() OVER (PARTITION BY player ORDER BY record))::INTEGER AS place, count(*) OVER (PARTITION BY player) AS total FROM r
      QUALIFY row_number() OVER (PARTITION BY player ORDER BY record) <= 10""",
    "content_ids": """SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}')[1:16] AS content_id FROM nation""",
    "snapshot_identity": " UNION ALL ".join(_identity_sql(n) for n in ("customer", "nation", "orders", "part")),
    "telemetry_summary": "SELECT event_type AS kind, count(*) AS n, min(ts) AS first, max(ts) AS last, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
    "evidence_classes": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unresolved' WHEN o_orderkey % 6 = 0 THEN 'directly-evidenced'
      WHEN (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderkey % 5 = 0 THEN 'cross-checked' ELSE 'inferred' END AS evidence_class FROM orders""",
}


def _nodes(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    return c.select(tables.player_id(F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 10 != 0, (1950 + F.col("c_custkey") % 60).cast("int")).alias("debut"))


def era_lane_layout(spark, sf_dir):
    return layout.era_lanes(_nodes(spark, sf_dir)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def concentric_layout(spark, sf_dir):
    """Around a player by all three proofs."""
    weighted = materialise(backbone.edge_weights(evidence_of(spark, sf_dir, START)).withColumn("weight", F.round("weight", 6)), "weighted")
    links = groups(spark, sf_dir)
    found = layout.concentric(_nodes(spark, sf_dir), weighted, links, neighbourhood.focus_hops(links, START), START)
    return found.select("id", "ring", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def path_ring_layout(spark, sf_dir):
    found = layout.path_rings(_nodes(spark, sf_dir), "P000000002", ["P000000001", "P000000002"])
    return found.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def nearest_nodes(spark, sf_dir):
    points = layout.era_lanes(_nodes(spark, sf_dir))
    clicks = points.select(F.col("id").alias("click"), (F.col("x") + 30).alias("x"), (F.col("y") - 20).alias("y"))
    return layout.nearest_node(points, clicks).select("click", "id", F.round("distance", 6).alias("distance"))


def zoom_tiers(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    scale = (F.col("o_orderkey") % 100) / F.lit(100.0)
    tier = layout.zoom_tier(scale)
    radius = layout.node_radius(tier, F.col("o_custkey"), F.col("o_orderkey") % 2 == 0)
    return o.select("o_orderkey", tier.alias("tier"), F.round(radius, 6).alias("radius"), F.round(layout.zoom_blend(scale, 0.25), 6).alias("blend"))


QUERIES |= {f.__name__: f for f in (era_lane_layout, concentric_layout, path_ring_layout, nearest_nodes, zoom_tiers)}

_LANES = """b AS (SELECT 'P' || lpad(c_custkey::VARCHAR, 9, '0') AS id, CASE WHEN c_custkey % 10 <> 0 THEN 1950 + c_custkey % 60 ELSE 1980 END AS year FROM customer),
  h AS (SELECT id, year, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, 11), lambda i: ord(id[i])::BIGINT)), lambda x, y: (xor(x, y) * 16777619) % 4294967296) AS h FROM b),
  p AS (SELECT id, (year - 1947) * 110.0::DOUBLE + (h % 1000) / 1000.0::DOUBLE * 105.0::DOUBLE AS x, (((h // 1000) % 10000) / 10000.0::DOUBLE - 0.5::DOUBLE) * 5200.0::DOUBLE AS y FROM h)"""
SQL |= {
    "era_lane_layout": f"WITH {_LANES} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM p",
    "concentric_layout": f"""WITH RECURSIVE {WEIGHED}, wadj AS (SELECT a AS node, b AS other FROM weighed UNION SELECT b, a FROM weighed),
      own AS (SELECT CASE WHEN a = '{START}' THEN b ELSE a END AS id, weight, primary_team AS team FROM weighed WHERE a = '{START}' OR b = '{START}'),
      hop AS (SELECT '{START}' AS id, 0 AS ring UNION ALL SELECT id, 1 FROM own UNION ALL
        SELECT DISTINCT other, 2 FROM own JOIN wadj ON node = id WHERE other <> '{START}' AND other NOT IN (SELECT id FROM own)),
      via AS (SELECT h.id, arg_min(own.team, own.id) AS team FROM hop h JOIN wadj ON wadj.node = h.id JOIN own ON own.id = wadj.other WHERE h.ring = 2 GROUP BY h.id),
      n AS (SELECT 'P' || lpad(c_custkey::VARCHAR, 9, '0') AS id, CASE WHEN c_custkey % 10 <> 0 THEN 1950 + c_custkey % 60 END AS debut FROM customer),
      p AS (SELECT n.id, debut, coalesce(ring, 3)::INTEGER AS ring, coalesce(CASE WHEN ring = 1 THEN own.team END, via.team, '~') AS team
        FROM n LEFT JOIN hop ON hop.id = n.id LEFT JOIN own ON own.id = n.id LEFT JOIN via ON via.id = n.id),
      k AS (SELECT *, row_number() OVER (PARTITION BY ring, team ORDER BY debut NULLS LAST, id) - 1 AS k, count(*) OVER (PARTITION BY ring, team) AS members,
        row_number() OVER (PARTITION BY ring ORDER BY team, debut NULLS LAST, id) - 1 AS turn, count(*) OVER (PARTITION BY ring) AS size FROM p),
      r AS (SELECT own.id, (row_number() OVER (ORDER BY weight DESC, debut NULLS FIRST, own.id) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1) AS rank FROM own LEFT JOIN n ON n.id = own.id),
      c AS (SELECT coalesce(team, '') AS team, count(*)::DOUBLE AS links FROM own GROUP BY 1), c2 AS (SELECT *, count(*) OVER () AS n, least(0.055::DOUBLE, 1.0::DOUBLE / count(*) OVER ()) AS gap FROM c),
      c3 AS (SELECT *, 2 * pi() - gap * n AS room, least(0.18::DOUBLE, (2 * pi() - gap * n) / (2.0::DOUBLE * n)) AS least FROM c2),
      c4 AS (SELECT *, least + (room - least * n) * links / sum(links) OVER () AS width FROM c3),
      s AS (SELECT team, width, coalesce(sum(width + gap) OVER (ORDER BY team = '', team ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - pi() / 2 AS start FROM c4),
      g AS (SELECT k.*, s.start, s.width, r.rank, k * 0.618033988749895::DOUBLE - floor(k * 0.618033988749895::DOUBLE) AS spiral,
        CASE ring WHEN 1 THEN 220.0::DOUBLE WHEN 2 THEN 620 ELSE 1300 END AS inside, CASE ring WHEN 1 THEN 460.0::DOUBLE WHEN 2 THEN 1020 ELSE 1900 END AS outside FROM k LEFT JOIN s USING (team) LEFT JOIN r USING (id)),
      f AS (SELECT *, CASE WHEN ring = 1 THEN inside + coalesce(rank, 0) * (outside - inside) ELSE sqrt(inside * inside + spiral * (outside * outside - inside * inside)) END AS radius,
        CASE WHEN ring <= 2 AND start IS NOT NULL THEN start + width * (k + 0.5::DOUBLE) / members ELSE 2 * pi() * turn / size END AS angle FROM g)
      SELECT id, ring, CASE WHEN ring = 0 THEN 0 ELSE round(radius * cos(angle), 4) END AS x, CASE WHEN ring = 0 THEN 0 ELSE round(radius * sin(angle), 4) END AS y FROM f""",
    "path_ring_layout": """WITH n AS (SELECT 'P' || lpad(c_custkey::VARCHAR, 9, '0') AS id FROM customer),
      r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM n WHERE id NOT IN ('P000000001', 'P000000002')),
      a AS (SELECT id, 150.0::DOUBLE + (k // 12) * 100.0::DOUBLE AS radius, 2 * pi() * (k % 12) / least(n - (k // 12) * 12, 12) - pi() / 2 AS angle FROM r)
      SELECT id, CASE id WHEN 'P000000001' THEN 0.0::DOUBLE ELSE 170.0::DOUBLE END AS x, 0.0::DOUBLE AS y FROM n WHERE id IN ('P000000001', 'P000000002')
      UNION ALL SELECT id, round(170 + radius * cos(angle), 6), round(radius * sin(angle), 6) FROM a""",
    "nearest_nodes": f"""WITH {_LANES}, m AS (SELECT c.id AS click, p.id, sqrt((c.x + 30 - p.x) ** 2 + (c.y - 20 - p.y) ** 2) AS d FROM p c JOIN p ON abs(c.x + 30 - p.x) <= 80 AND abs(c.y - 20 - p.y) <= 80)
      SELECT click, id, round(d, 6) AS distance FROM m WHERE d <= 80 QUALIFY row_number() OVER (PARTITION BY click ORDER BY d, id) = 1""",
    "zoom_tiers": """WITH s AS (SELECT o_orderkey, o_custkey, (o_orderkey % 100) / 100.0::DOUBLE AS s FROM orders),
      t AS (SELECT *, CASE WHEN s < 0.25 THEN 'macro' WHEN s < 0.75 THEN 'meso' ELSE 'micro' END AS tier, least(greatest((s - 0.25::DOUBLE) / 0.08::DOUBLE, 0), 1) AS u FROM s)
      SELECT o_orderkey, tier, round(least(greatest(CASE tier WHEN 'macro' THEN 1.1 WHEN 'meso' THEN 1.8 ELSE 2.3 END::DOUBLE
        + log2(1.0::DOUBLE + o_custkey) * CASE tier WHEN 'macro' THEN 0.13 WHEN 'meso' THEN 0.4 ELSE 0.5 END::DOUBLE + CASE WHEN o_orderkey % 2 = 0 THEN 1.4 ELSE 0 END::DOUBLE, 1.1::DOUBLE), 9.0::DOUBLE), 6) AS radius,
        round(u * u * (3 - 2 * u), 6) AS blend FROM t""",
}
