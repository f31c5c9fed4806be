"""The links that an edge's rank can depend on, without a row for each pair: enough for the spanning forest and each node's best.

Of parallel links the heaviest counts, so each kind of proof is thinned by itself. Who met in a game all weigh the same: its
forest is the star of its first player, and a player's best are the first others. Count rows of tiles of players meet as
matrices of shared games, of which a tile pair keeps its own forest and each player's best: what isn't in a part's forest isn't in the
whole's. Players with equal counts are one class: its first few stand for it, the others take the best links of the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.backbone import DAYS_SCALE, GAMES_SCALE, TOP_LINKS, WITNESS_WEIGHT, measure, spanning_forest, top_links
from linkloom.operators.components import connected_components
from linkloom.operators.evidence import admissible_counts, agreed_counts
from linkloom.operators.intervals import overlap_pairs
from linkloom.operators.order import positions
from linkloom.scratch import materialise

TILE = 2048


def _ends(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def counted_links(counts: DataFrame, top: int = TOP_LINKS, tile: int = TILE) -> DataFrame:
    """(a, b, games): of the pairs by count, their maximum spanning forest and each player's ``top``; games from ``GAMES_SCALE`` on are that many.

    ``counts`` is (player, team, season, games, team_games), admissible rows.
    """
    rows = agreed_counts(counts.select("player", "team", "season", "games", "team_games"))
    own = F.sort_array(F.collect_list(F.struct("team", "season", "games", "team_games"))).alias("own")
    vectors = materialise(rows.groupBy("player").agg(own), "vectors")
    first = vectors.groupBy("own").agg(F.min("player").alias("first"))
    classed = materialise(vectors.join(first, "own"), "classes")
    place = F.row_number().over(Window.partitionBy("first").orderBy("player"))
    kept = classed.select("first", "player", "own").withColumn("at", place).filter(F.col("at") <= top + 1)
    numbered = positions(kept, ["player"], "number", keep=["player", "first", "own"])
    last = (max(numbered.count(), 1) - 1) // tile
    held = numbered.select("number", F.explode("own").alias("o")).select("number", "o.*")
    cells = materialise(held.select("team", "season").distinct().withColumn("cell", F.monotonically_increasing_id()), "cells")
    held = held.join(cells, ["team", "season"]).select("number", "cell", F.col("games").cast("int").alias("games"), F.col("team_games").cast("int").alias("team_games"))
    mine = F.floor(F.col("number") / tile)
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    dealt = dealt.withColumns({"low": F.least(mine, "other"), "high": F.greatest(mine, "other")}).drop("other")
    # a link of a number with itself tells what the others of its class have with it
    found = dealt.groupBy("low", "high").applyInPandas(lambda key, x: _tile_links(int(key[0]), int(key[1]), tile, top, x), "x long, y long, games int, best boolean")
    found = materialise(found, "tile_links")
    named = lambda n, c: numbered.select(F.col("number").alias(n), F.col("player").alias(c))
    between = found.filter("x <> y").join(named("x", "px"), "x").join(named("y", "py"), "y")
    order = Window.partitionBy("x").orderBy(F.desc("games"), "y")
    best = found.filter("best").select("x", "y", "games").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= top)
    heads = numbered.filter("player = first").select(F.col("number").alias("x"), "first")
    lists = best.join(heads, "x").join(named("y", "py"), "y").select("first", "py", "games")
    rest = classed.select("first", "player").join(kept.select("player"), "player", "left_anti").join(lists, "first")
    return between.select(*_ends("px", "py"), "games").union(rest.select(*_ends("player", "py"), "games")).distinct()


def _tile_links(low: int, high: int, tile: int, top: int, rows: pd.DataFrame) -> pd.DataFrame:
    """(x, y, games, best): the forest between two tiles, and each of their players' best there, itself included in its own tile."""
    number = rows["number"].to_numpy(np.int64)
    in_low, in_high = number // tile == low, number // tile == high
    left, right = np.unique(number[in_low]), np.unique(number[in_high])
    shared = np.zeros((len(left), len(right)), np.int32)
    by_cell = {name: dict(list(rows[mask].groupby("cell"))) for name, mask in (("low", in_low), ("high", in_high))}
    for cell, x in by_cell["low"].items():
        y = by_cell["high"].get(cell)
        if y is not None:
            i, j = np.searchsorted(left, x["number"].to_numpy()), np.searchsorted(right, y["number"].to_numpy())
            over = x["games"].to_numpy(np.int32)[:, None] + (y["games"] - y["team_games"]).to_numpy(np.int32)[None, :]
            shared[np.ix_(i, j)] += np.maximum(over, 0)
    games = np.minimum(shared, GAMES_SCALE).astype(np.uint8)
    out = []
    for a, b, matrix in ((left, right, games), (right, left, np.ascontiguousarray(games.T)))[: 1 if low == high else 2]:
        matrix = matrix.copy()
        for _ in range(top + 1 if low == high else top):
            at = matrix.argmax(axis=1)
            value = matrix[np.arange(len(a)), at]
            some = np.flatnonzero(value)
            out.append((a[some], b[at[some]], value[some], np.ones(len(some), bool)))
            matrix[some, at[some]] = 0
    x, y, value = _forest(left, right, games)
    out.append((x, y, value, np.zeros(len(x), bool)))
    x, y, value, best = (np.concatenate(c) for c in zip(*out, strict=True))
    return pd.DataFrame({"x": x, "y": y, "games": value.astype(np.int32), "best": best})


def _forest(left: np.ndarray, right: np.ndarray, games: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximum spanning forest of the links between ``left`` and ``right``, by falling games, then smaller and larger end; grown node by node."""
    same = len(left) == len(right) and np.array_equal(left, right)
    nodes = left if same else np.concatenate([left, right])
    n, m = len(nodes), len(left)
    reach = games if same else None
    turned = games if same else np.ascontiguousarray(games.T)
    span = int(nodes.max()) + 1 if n else 1
    base = int(nodes.min()) if n else 0
    local, span = nodes - base, span - base
    best, via, done = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    out_x, out_y, out_v = [], [], []
    todo = 0
    for _ in range(n):
        v = int(best.argmax())
        if best[v] < 0:
            while done[todo]:
                todo += 1
            v = todo
        else:
            u = via[v]
            out_x.append(nodes[u]), out_y.append(nodes[v]), out_v.append(best[v] // (span * span))
        done[v], best[v] = True, -1
        if same:
            near, at = reach[v], slice(0, n)
        elif v < m:
            near, at = games[v], slice(m, n)
        else:
            near, at = turned[v - m], slice(0, m)
        ends = local[at]
        a, b = np.minimum(ends, local[v]), np.maximum(ends, local[v])
        # games first, then the smaller a and b
        rank = near.astype(np.int64) * (span * span) + (span * span - 1 - (a * span + b))
        better = (near > 0) & (rank > best[at]) & ~done[at]
        best[at] = np.where(better, rank, best[at])
        via[at] = np.where(better, v, via[at])
    return np.array(out_x, np.int64), np.array(out_y, np.int64), np.array(out_v, np.int64)


def seen_links(appearances: DataFrame, players: DataFrame, top: int = TOP_LINKS) -> tuple[DataFrame, DataFrame]:
    """Of pairs who met in a game: (a, b) that join whom all do, the first in order, and (a, b) of each player's ``top`` first others."""
    game = ["team", "season", "date", "game_id"]
    rows = appearances.select("player", *game).dropna().join(players.select(F.col("id").alias("player")), "player", "left_semi").distinct()
    rows = materialise(rows, "seen")
    place = F.row_number().over(Window.partitionBy(*game).orderBy("player"))
    first = rows.withColumn("at", place).filter(F.col("at") <= top + 1).select(*game, F.col("player").alias("other"), "at")
    met = rows.join(first, game).filter("player <> other")
    star = met.filter("at = 1").select(*_ends("player", "other")).distinct()
    others = met.groupBy("player").agg(F.slice(F.sort_array(F.collect_set("other")), 1, top).alias("others"))
    return star, others.select("player", F.explode("others").alias("other")).select(*_ends("player", "other")).distinct()


def candidates(tenures: DataFrame, counts: DataFrame, appearances: DataFrame, players: DataFrame, top: int = TOP_LINKS, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, weight) that hold the spanning forest, and those that hold each node's ``top`` links, of the weights of ``edge_weights``.

    ``digits`` rounds the weights before they are compared.
    """
    exact = lambda w: w if digits is None else F.round(w, digits)
    dated = overlap_pairs(tenures).groupBy("a", "b").agg(F.sum("days").alias("days")).select("a", "b", exact(measure(F.col("days"), DAYS_SCALE)).alias("weight"))
    counted = counted_links(admissible_counts(counts, players), top).select("a", "b", exact(measure(F.col("games"), GAMES_SCALE)).alias("weight"))
    strong = materialise(dated.union(counted).groupBy("a", "b").agg(F.max("weight").alias("weight")), "strong")
    star, others = seen_links(appearances, players, top)
    weighed = lambda df: df.withColumn("weight", F.lit(WITNESS_WEIGHT))
    # whom heavier links join needs no lighter one
    joined = connected_components(strong.filter(F.col("weight") > WITNESS_WEIGHT), "a", "b")
    name = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    across = star.join(name("a"), "a", "left").join(name("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    most = lambda df: df.groupBy("a", "b").agg(F.max("weight").alias("weight"))
    return most(strong.union(weighed(across))), most(strong.union(weighed(others)))


def backbone(tenures: DataFrame, counts: DataFrame, appearances: DataFrame, players: DataFrame, top: int = TOP_LINKS) -> DataFrame:
    """(a, b) of ``backbone.backbone`` over the facts' edge weights."""
    forest, best = candidates(tenures, counts, appearances, players, top)
    return spanning_forest(forest).union(top_links(best, top)).distinct()
