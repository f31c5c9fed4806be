"""The prefix trie of conversations, from their sorted order.

Conversations are sorted by their turns, so those with a common prefix stand side by side, and the trie is the Cartesian
tree of the array of longest common prefixes (LCP) of neighbours. For each entry the nearest smaller entries to its
left and right bound the interval of its node: they are found inside blocks, then among the blocks' minima, and so on
up. Equal entries with equal bounds are one node; a node stands for all depths down from its parent's, which are then
written out. Members, leaves and saved tokens follow from positions, running sums and minima over intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.order import before, before_all, positions
from linkloom.scratch import materialise

SEGMENT = 256
BLOCK = 4096
FAN_IN = 64
CHUNK = 512
RUN = 512
LEAD = 6
GROUP = 100
_DIGEST = 32
_EXPLODED = 1 << 16


def rebuilt_turns(conversations: DataFrame, lead: int = LEAD, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) of the rebuilt conversations, and their turns (conv_id, d from 1, digest, chars).

    Conversation c takes the first h = crc32(c) % ``lead`` turns of conversation c - c % ``group``, then its own after
    the first h. Turns go by turn (null first), then role and text; repeated rows are turns each. Null roles and texts are
    empty; rows without a conv_id take no part.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.substring(F.sha2(whole, 256), 1, _DIGEST)
    by_turn = ["conv_id", F.col("turn").asc_nulls_first()]
    placed = positions(rows, by_turn, "place", ["role", "text"], ["conv_id", digest.alias("digest"), F.length("text").cast("long").alias("chars")])
    lengths = materialise(placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n")), "lengths")
    own = placed.join(lengths, "conv_id").select("conv_id", (F.col("place") - F.col("first")).alias("p"), "digest", "chars")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % lead
    plan = lengths.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
    plan = materialise(plan.join(bases, "base", "left").select("conv_id", "base", "h", taken, (F.least("h", F.coalesce("base_n", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "plan")
    first = own.filter(F.col("p") < lead - 1).withColumnRenamed("conv_id", "base")
    led = plan.filter("taken > 0").join(first, "base").filter("p < taken").select("conv_id", (F.col("p") + 1).alias("d"), "digest", "chars")
    rest = own.join(plan, "conv_id").filter("p >= h").select("conv_id", (F.col("taken") + F.col("p") - F.col("h") + 1).alias("d"), "digest", "chars")
    return plan.select("conv_id", "n_turns"), materialise(led.union(rest), "turns")


def sorted_conversations(lengths: DataFrame, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(i, conv_id, n_turns, v): conversations in the order of their turns, copies by id, with the LCP to the one before (-1 at the first).

    Every ``segment`` turns of a conversation are named by the place of their digests among all such; a conversation is a row
    of eight bytes a segment, so a long one stays small.
    """
    cut = turns.groupBy("conv_id", F.floor((F.col("d") - 1) / segment).alias("s")).agg(F.array_sort(F.collect_list(F.struct("d", "digest"))).alias("own"))
    cut = materialise(cut.select("conv_id", "s", F.array_join(F.transform("own", lambda x: x["digest"]), "").alias("key")), "segments")
    names = positions(cut.select("key").distinct(), ["key"], "name")
    named = cut.join(names, "key").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", "name"))).alias("own"))
    spelt = lengths.join(named.select("conv_id", F.transform("own", lambda x: x["name"]).alias("names")), "conv_id", "left")
    spelt = spelt.withColumn("names", F.coalesce("names", F.array().cast("array<long>")))
    placed = positions(spelt, ["names", "conv_id"], "i")
    prior = placed.select((F.col("i") + 1).alias("i"), F.col("names").alias("prior"))
    apart = F.array_position(F.zip_with("names", "prior", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    met = placed.join(prior, "i", "left").withColumn("s", apart - 1)
    ends = met.select("i", "conv_id", "n_turns", "s", F.get("names", F.col("s").cast("int")).alias("a"), F.get("prior", F.col("s").cast("int")).alias("b"))
    key = lambda name: names.select(F.col("name").alias(name), F.col("key").alias(f"{name}_key"))

    @F.pandas_udf("long")
    def common(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_common(a, b) for a, b in zip(left, right, strict=True)], dtype=np.int64)

    differ = ends.filter("s >= 0").join(key("a"), "a", "left").join(key("b"), "b", "left")
    differ = differ.select("i", "conv_id", "n_turns", (F.col("s") * segment + common("a_key", "b_key")).alias("v"))
    same = ends.filter("s is null or s < 0").select("i", "conv_id", "n_turns", F.when(F.col("i") == 0, -1).otherwise(F.col("n_turns")).cast("long").alias("v"))
    return materialise(differ.union(same), "sorted")


def _common(a: str | None, b: str | None) -> int:
    """How many digests two keys have in common at their beginning."""
    n = min(len(a or ""), len(b or "")) // _DIGEST
    for k in range(n):
        if a[k * _DIGEST : (k + 1) * _DIGEST] != b[k * _DIGEST : (k + 1) * _DIGEST]:
            return k
    return n


_NEAR = "block long, i long, v long, left long, left_v long, right long, right_v long, first boolean, last boolean"


def _inside(rows: pd.DataFrame) -> pd.DataFrame:
    """Nearest smaller values inside a block, null where they lie outside; ``first`` and ``last`` mark one row of each value that has them outside."""
    rows = rows.sort_values("i", ignore_index=True)
    at, v = rows["i"].tolist(), rows["v"].tolist()
    left, right = [-1] * len(v), [-1] * len(v)
    open_: list[int] = []
    for j, x in enumerate(v):
        while open_ and v[open_[-1]] > x:
            right[open_.pop()] = j
        left[j] = open_[-1] if open_ else -1
        if open_ and v[open_[-1]] == x:
            left[j] = left[open_[-1]]
        open_.append(j)
    first, last, seen = [False] * len(v), [False] * len(v), set()
    for j in range(len(v)):
        if left[j] < 0 and v[j] not in seen:
            seen.add(v[j])
            first[j] = True
    seen.clear()
    for j in reversed(range(len(v))):
        if right[j] < 0 and v[j] not in seen:
            seen.add(v[j])
            last[j] = True
    pick = lambda ends, of: pd.array([of[e] if e >= 0 else None for e in ends], dtype="Int64")
    return pd.DataFrame(
        {"block": rows["block"], "i": at, "v": v, "left": pick(left, at), "left_v": pick(left, v), "right": pick(right, at), "right_v": pick(right, v), "first": first, "last": last}
    )


def nearest_smaller(values: DataFrame, n: int, span: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """(i, v, left, left_v, right, right_v) for each (i, v): the nearest places of smaller values and these, null where there are none.

    What a block can't tell, its first and last row of each value ask for it among such rows of ``fan_in`` blocks, and so on
    up to one block; there are at most two for each distinct minimum of a block.
    """
    local = values.select("i", "v", F.floor(F.col("i") / span).alias("block")).groupBy("block").applyInPandas(_inside, _NEAR)
    if span >= n:
        return local.drop("block", "first", "last")
    local = materialise(local, "near")
    asking = local.filter("first or last")
    upper = nearest_smaller(asking.select("i", "v"), n, span * fan_in, fan_in).drop("v")
    upper = materialise(asking.select("i", "block", "v", "first", "last").join(upper, "i"), "asked")
    side = lambda mark, end: upper.filter(mark).select("block", "v", F.col(end).alias("far"), F.col(f"{end}_v").alias("far_v"))
    found = local
    for mark, end in (("first", "left"), ("last", "right")):
        met = found.join(side(mark, end), ["block", "v"], "left")
        found = met.withColumns({end: F.coalesce(end, "far"), f"{end}_v": F.coalesce(f"{end}_v", "far_v")}).drop("far", "far_v")
    return found.select("i", "v", "left", "left_v", "right", "right_v")


def interval_minima(values: DataFrame, intervals: DataFrame, n: int, span: int = BLOCK) -> DataFrame:
    """(l, r, least) for each distinct interval (l, r), the least x of ``values`` (i, x) at l <= i < r.

    An interval asks its first and its last block, and the minima of the blocks between by the same means.
    """
    first, last = F.floor(F.col("l") / span), F.floor((F.col("r") - 1) / span)
    cut = intervals.select("l", "r", first.alias("a"), last.alias("b"))
    ask = cut.filter("a = b").select("l", "r", F.col("a").alias("block"), F.col("l").alias("x"), F.col("r").alias("y"))
    wide = cut.filter("a < b")
    ask = ask.union(wide.select("l", "r", "a", "l", (F.col("a") + 1) * span)).union(wide.select("l", "r", "b", F.col("b") * span, "r"))
    own = values.select(F.floor(F.col("i") / span).alias("block"), "i", "x")

    def least(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        x = np.append(rows["x"].to_numpy(np.int64), np.iinfo(np.int64).max)
        ends = asked[["x", "y"]].to_numpy(np.int64) - (int(rows["i"].iloc[0]) if len(rows) else 0)
        return pd.DataFrame({"l": asked["l"], "r": asked["r"], "least": np.minimum.reduceat(x, np.minimum(ends, len(rows)).ravel())[::2] if len(asked) else []})

    found = own.groupBy("block").cogroup(ask.groupBy("block")).applyInPandas(least, "l long, r long, least long")
    if n > span:
        inner = wide.filter("b > a + 1").select(F.col("l").alias("own_l"), F.col("r").alias("own_r"), (F.col("a") + 1).alias("l"), F.col("b").alias("r"))
        blocks = own.groupBy("block").agg(F.min("x").alias("x")).withColumnRenamed("block", "i")
        between = interval_minima(blocks, inner.select("l", "r").distinct(), -(-n // span), span)
        found = found.union(inner.join(between, ["l", "r"]).select("own_l", "own_r", "least"))
    return found.groupBy("l", "r").agg(F.min("least").alias("least"))


def _end_digests(ends: DataFrame, chunk: int) -> DataFrame:
    """(l, depth, ends_sha256) of the nodes at which conversations end. A node's ids go through one task, a chunk at a time."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, depth, h = None, 0, None
        for batch in batches:
            done = []
            for l, d, text in zip(batch["l"], batch["depth"], batch["ids"], strict=True):
                if l != own:
                    if h is not None:
                        done.append((own, depth, h.hexdigest()))
                    own, depth, h = l, d, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            yield pd.DataFrame(done, columns=["l", "depth", "ends_sha256"])
        if h is not None:
            yield pd.DataFrame([(own, depth, h.hexdigest())], columns=["l", "depth", "ends_sha256"])

    cut = ends.groupBy("l", "depth", F.floor(F.col("i") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("i", "conv_id"))).alias("own"))
    text = cut.select("l", "depth", "chunk", F.array_join(F.transform("own", lambda x: x["conv_id"].cast("string")), ",").alias("ids"))
    return text.repartition("l").sortWithinPartitions("l", "chunk").mapInPandas(digest, "l long, depth long, ends_sha256 string")


def trie_nodes(lengths: DataFrame, turns: DataFrame, segment: int = SEGMENT, block: int = BLOCK, fan_in: int = FAN_IN, chunk: int = CHUNK) -> DataFrame:
    """A row for each distinct sequence of first turns, the empty one included.

    (conv_id, the smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves; saved_tokens; ends_sha256). A conversation
    without turns ends at the root. Without conversations there are no nodes.
    """
    rows = sorted_conversations(lengths, turns, segment)
    n = rows.count()
    ahead = rows.select((F.col("i") - 1).alias("i"), F.col("v").alias("next_v"))
    rows = rows.join(ahead, "i", "left").withColumn("next_v", F.coalesce("next_v", F.lit(-1).cast("long")))
    read = materialise(before(turns, ["conv_id"], "d", "chars", "upto", levels=1).select("conv_id", "d", (F.coalesce("upto", F.lit(0)) + F.col("chars")).alias("upto")), "read")
    common = rows.join(read.select("conv_id", F.col("d").alias("v"), F.col("upto").alias("shared")), ["conv_id", "v"], "left")
    common = common.withColumns({"shared": F.coalesce("shared", F.lit(0).cast("long")), "leaf": (F.col("next_v") < F.col("n_turns")).cast("long"), "start": F.when(F.col("v") < F.col("n_turns"), F.col("i"))})
    common = materialise(common, "common")
    summed = before_all(common, [], "i", {"leaves": ("leaf", "sum"), "shares": ("shared", "sum"), "prior": ("start", "last")}, RUN)
    zero = F.lit(0).cast("long")
    rows = materialise(
        summed.select(
            "i", "conv_id", "n_turns", "v", "next_v", F.coalesce("start", "prior").alias("start"), F.coalesce("leaves", zero).alias("leaves"),
            (F.coalesce("leaves", zero) + F.col("leaf")).alias("leaves_upto"), (F.coalesce("shares", zero) + F.col("shared")).alias("shares_upto"),
        ),
        "rows",
    )
    near = materialise(nearest_smaller(rows.select("i", "v"), n, block, fan_in), "nearest")
    bounds = near.filter("v >= 0").select(
        F.col("left").alias("l"), F.coalesce("right", F.lit(n)).cast("long").alias("r"), "v", F.greatest("left_v", F.coalesce("right_v", F.lit(-1))).alias("above")
    )
    inner = materialise(bounds.distinct(), "inner")
    least = interval_minima(rows.select("i", F.col("conv_id").alias("x")), inner.select("l", "r").distinct(), n, block)
    alone = rows.select(F.col("i").alias("l"), (F.col("i") + 1).alias("r"), F.col("n_turns").alias("v"), F.greatest("v", "next_v").alias("above"), F.col("conv_id").alias("least"))
    every = inner.join(least, ["l", "r"]).select("l", "r", "v", "above", "least").union(alone.filter("v > above"))
    from_ = rows.select(F.col("i").alias("l"), F.col("conv_id").alias("at"), F.col("v").alias("at_v"), "leaves", F.col("shares_upto").alias("shares"))
    to = rows.select((F.col("i") + 1).alias("r"), "leaves_upto", "shares_upto")
    held = every.join(from_, "l").join(to, "r").select(
        "l", "r", "v", "above", "least", "at", "at_v", (F.col("leaves_upto") - F.col("leaves")).alias("n_leaves"), (F.col("shares_upto") - F.col("shares")).alias("shared")
    )
    held = held.join(near.select(F.col("i").alias("l"), F.col("left").alias("up")), "l")
    low = F.explode(F.sequence(F.col("above") + 1, F.col("v"), F.lit(_EXPLODED).cast("long")))
    spread = held.withColumn("low", low).withColumn("depth", F.explode(F.sequence("low", F.least(F.col("low") + _EXPLODED - 1, F.col("v")))))
    told = read.select(F.col("conv_id").alias("at"), (F.col("d") + 1).alias("depth"), F.col("upto").alias("above_chars"))
    nodes = spread.join(told, ["at", "depth"], "left").select(
        "l", "depth", F.col("least").alias("conv_id"), (F.col("r") - F.col("l")).alias("n_convs"), "n_leaves",
        (F.col("shared") - (F.col("r") - F.col("l") - 1) * F.coalesce("above_chars", zero)).alias("saved_tokens"),
        F.when(F.col("depth") == 0, None).otherwise(F.when(F.col("depth") - 1 > F.col("at_v"), F.col("l")).otherwise(F.col("up"))).alias("parent_l"),
    )
    nodes = materialise(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_l").alias("l"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = _end_digests(rows.select(F.col("start").alias("l"), F.col("n_turns").alias("depth"), "i", "conv_id"), chunk)
    told = materialise(nodes.join(children, ["l", "depth"], "left").join(ends, ["l", "depth"], "left"), "told")
    parents = nodes.select(F.col("l").alias("parent_l"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return told.join(parents, ["parent_l", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``trie_nodes`` of the rebuilt conversations of a table with conv_id, turn, role and text; further columns aren't read.

    Rows without a conv_id take no part, null roles and texts are empty, repeated rows are turns each, and turns of one number
    go by role, then text. A text is read once, for its digest and length, however long it is. An empty table gives no rows.
    """
    return trie_nodes(*rebuilt_turns(conversations))
