"""The graph held against its proofs, its adjacency and pairs that are known to be linked or not; pointers held against rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ADMITTED, _FORWARD, _BACKWARD, _PROVEN, _LINKED, _APART = (1 << k for k in range(6))


def audit_links(edges: DataFrame, adjacency: DataFrame, proofs: list[DataFrame], linked: DataFrame, apart: DataFrame, players: DataFrame) -> DataFrame:
    """(a, b, fault) for each fault of a pair, none if the graph is sound.

    ``edges`` (a, b) are the admitted links, ``adjacency`` (node, other) what searches use, each of ``proofs`` (a, b) what one
    kind of evidence proves, ``linked`` and ``apart`` (a, b) known pairs in either order, ``players`` (id). Everything meets in one
    aggregation by pair, so nothing is joined with anything: ``unsupported`` has no proof, ``missing-proved`` no edge, ``one-way``
    isn't in the adjacency both ways, ``stray-link`` is in it without an edge, ``missing-known`` and ``forbidden`` contradict the
    known pairs, ``self-link`` and ``disordered`` are no pairs, ``unknown-player`` names someone else.
    """
    low, high = (lambda x, y: F.least(x, y)), (lambda x, y: F.greatest(x, y))
    tagged = lambda df, x, y, tag: df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(low(F.col(x), F.col(y)).alias("a"), high(F.col(x), F.col(y)).alias("b"), tag.alias("tag"))
    mark = lambda bit: F.lit(bit).cast("long")
    way = F.when(F.col("node") <= F.col("other"), mark(_FORWARD)).otherwise(mark(_BACKWARD))
    parts = [tagged(edges, "a", "b", mark(_ADMITTED)), tagged(adjacency, "node", "other", way), tagged(linked, "a", "b", mark(_LINKED)), tagged(apart, "a", "b", mark(_APART))]
    parts += [tagged(p, "a", "b", mark(_PROVEN)) for p in proofs]
    pairs = reduce(DataFrame.union, parts).groupBy("a", "b").agg(F.bit_or("tag").alias("tags"))
    known = players.select(F.col("id").alias("known")).filter("known is not null").distinct()
    pairs = pairs.join(known.withColumn("has_a", F.lit(True)), F.col("a") == F.col("known"), "left").drop("known")
    pairs = pairs.join(known.withColumn("has_b", F.lit(True)), F.col("b") == F.col("known"), "left").drop("known")
    found = _faults(pairs, F.col("has_a").isNull() | F.col("has_b").isNull())
    wrong = edges.filter("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("disordered").alias("fault"))
    return found.union(wrong).distinct()


def tags(admitted: Column, forward: Column, backward: Column, proven: Column, linked: Column, apart: Column) -> Column:
    """What is known of a pair a < b, for ``audit_pairs``: an edge, in the adjacency from a to b and from b to a, proven, known to be linked, to be not."""
    bit = lambda said, mask: F.when(said, F.lit(mask)).otherwise(F.lit(0)).cast("long")
    said = ((admitted, _ADMITTED), (forward, _FORWARD), (backward, _BACKWARD), (proven, _PROVEN), (linked, _LINKED), (apart, _APART))
    return reduce(lambda x, y: x.bitwiseOR(y), [bit(*s) for s in said])


def audit_pairs(pairs: DataFrame, strangers: DataFrame) -> DataFrame:
    """The faults of ``audit_links`` for pairs that are there once each, (a, b, tags) with a < b; no pair meets another.

    ``strangers`` (id) are those among the pairs' players who aren't known, few if any.
    """
    who = strangers.select("id").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(who.select(F.col("id").alias(f"stranger_{end}")), F.col(end) == F.col(f"stranger_{end}"), "left")
    return _faults(pairs, F.col("stranger_a").isNotNull() | F.col("stranger_b").isNotNull())


def _faults(pairs: DataFrame, unknown: Column) -> DataFrame:
    has = lambda bit: F.col("tags").bitwiseAND(F.lit(bit)) != 0
    both = has(_FORWARD) & has(_BACKWARD)
    faults: list[tuple[str, Column]] = [
        ("unsupported", has(_ADMITTED) & ~has(_PROVEN)), ("missing-proved", has(_PROVEN) & ~has(_ADMITTED)), ("one-way", has(_ADMITTED) & ~both & (F.col("a") != F.col("b"))),
        ("stray-link", (has(_FORWARD) | has(_BACKWARD)) & ~has(_ADMITTED)), ("missing-known", has(_LINKED) & ~has(_ADMITTED)), ("forbidden", has(_APART) & has(_ADMITTED)),
        ("self-link", F.col("a") == F.col("b")), ("unknown-player", unknown),
    ]
    named = F.filter(F.array(*[F.when(c, name) for name, c in faults]), lambda f: f.isNotNull())
    return pairs.select("a", "b", F.explode(named).alias("fault"))


def audit_summary(edges: DataFrame, kinds: dict[str, DataFrame], faults: DataFrame, players: DataFrame) -> DataFrame:
    """One row: edges, pairs that each kind proves, isolated players, and unsupported and missing links."""
    one = F.lit(1).alias("k")
    counts = [edges.select("a", "b").distinct().agg(F.count("*").alias("total_edges"))]
    counts += [df.select("a", "b").distinct().agg(F.count("*").alias(f"{name}_pairs")) for name, df in kinds.items()]
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b"))
    counts.append(players.select("id").distinct().join(ends, "id", "left_anti").agg(F.count("*").alias("isolates")))
    counts.append(faults.agg(F.count_if(F.col("fault") == "unsupported").alias("unsupported_edges"), F.count_if(F.col("fault") == "missing-proved").alias("missing_proved_edges")))
    return reduce(lambda x, y: x.join(y, "k"), [c.select("*", one) for c in counts]).drop("k")


def resolve_pointers(facts: DataFrame, pointer: str, table: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """``facts`` with the fields of the row that ``pointer`` (``path:line``) names, as ``source_<field>``, and ``resolved``.

    ``table`` has ``record_no``, the line as the reports count it. A pointer to another path, to no row, or that is none, isn't resolved.
    """
    line = F.when(F.regexp_extract(pointer, r"^(.*):[0-9]+$", 1) == path, F.expr(f"try_cast(regexp_extract(`{pointer}`, ':([0-9]+)$', 1) as long)"))
    rows = table.select(F.col("record_no").alias("_line"), *[F.col(f).alias(f"source_{f}") for f in fields], F.lit(True).alias("_found"))
    met = facts.withColumn("_at", line).join(rows, F.col("_at") == F.col("_line"), "left")
    return met.withColumn("resolved", F.coalesce("_found", F.lit(False))).drop("_at", "_line", "_found")
