"""Chat formatting by prefix-target expansion.

A conversation's turns are formatted one by one and laid end to end. Every assistant turn is an example
of its own: its text is the trainable target and all that stands before it is its context. An example is
written with its whole context, its own part and the span of its target, and the loss is read back from what is written.

The template: ``<s>`` begins a conversation; ``[SYS] text [/SYS]``, ``[INST] text [/INST]`` and `` text</s>``
are the turns of system, user and assistant, ``[TURN role] text [/TURN]`` those of any other role. In
texts a backslash is doubled, then one is put behind the first character of each control string, so no
text can look like a mark, and taking them out again gives the text back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.scratch import materialise

#: Conversation -7, which every run of the query adds.
PROBE = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))
_CONTROL = r"([<\[])(?=/?s>|/?(?:INST|SYS|TURN)\]|TURN )"
_CLOSE = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """Each backslash pair becomes one, each single backslash goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _segment(role: Column, text: Column) -> tuple[Column, Column]:
    """What opens a turn of this role, and what closes it."""
    named = F.regexp_replace(role, r"([\\\[\]<> ])", r"\\$1")
    opening, closing = F.concat(F.lit("[TURN "), named, F.lit("] ")), F.lit(" [/TURN]")
    for name, (a, b) in _CLOSE.items():
        opening, closing = F.when(role == name, F.lit(a)).otherwise(opening), F.when(role == name, F.lit(b)).otherwise(closing)
    return opening, closing


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, segment, start, chars, target_start, target_end) for each turn.

    ``place`` grows with the order of turns within a conversation: by turn, then role and text, nulls
    first. Repeated rows are turns each; very long texts stay whole; an empty table gives no rows. ``start`` counts the code points of the conversation's text before the segment; the target
    span, null but for assistant turns, lies in the conversation's text. Null roles and texts are empty.
    Other columns aren't read.

    Turns are sorted over all tasks by conversation and turn, so that one conversation of any length
    lies in many; offsets are sums within a task plus what the tasks before it hold of the conversation.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    # ranges go by conversation and turn alone, so no texts are sampled; rows of one turn lie in one task
    ranged = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)
    placed = ranged.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place"))
    opening, closing = _segment(F.col("role"), F.col("text"))
    placed = materialise(
        placed.select("conv_id", "place", "task", "role", opening.alias("opening"), escape(F.col("text")).alias("body"), closing.alias("closing")), "turns"
    )
    body, edges = F.char_length("body"), F.char_length(F.concat("opening", "closing"))
    held = placed.groupBy("conv_id", "task").agg(F.sum(body + edges).alias("chars"), F.min("place").alias("first"))
    by_task = Window.partitionBy("conv_id").orderBy("task")
    before = F.sum("chars").over(by_task.rowsBetween(Window.unboundedPreceding, -1))
    carried = held.select(
        F.col("conv_id").alias("_conv"), F.col("task").alias("_task"), (F.coalesce(before, F.lit(0)) + F.when(before.isNotNull(), 3).otherwise(0)).alias("carried"),
        F.when(before.isNull(), F.col("first")).alias("begins"),
    )
    joined = placed.join(carried, placed["conv_id"].eqNullSafe(carried["_conv"]) & (placed["task"] == carried["_task"])).drop("_conv", "_task")
    segment = F.concat(F.when(F.col("place") == F.col("begins"), F.lit("<s>")).otherwise(F.lit("")), "opening", "body", "closing")
    joined = joined.select("conv_id", "place", "task", "role", "opening", "body", "closing", "carried", segment.alias("segment"))
    joined = joined.withColumn("chars", F.char_length("segment").cast("long"))
    within = Window.partitionBy("conv_id", "task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    started = joined.withColumn("start", (F.col("carried") + F.coalesce(F.sum("chars").over(within), F.lit(0))).cast("long"))
    assistant = F.col("role") == "assistant"
    target_end = F.col("start") + F.col("chars") - F.char_length("closing")
    return started.select(
        "conv_id", "place", "segment", "start", "chars",
        F.when(assistant, target_end - F.char_length("body")).alias("target_start"), F.when(assistant, target_end).alias("target_end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, place, context, own, context_end, target_start, target_end, end), a row for each assistant turn.

    The example's text is ``context``, the whole text of the conversation before the turn, and ``own``, the turn's part with the target:
    the conversation's text up to ``end``, of which only target_start to target_end is trained. So a conversation's text is written as often
    as turns of the assistant follow it, by one task, which holds the conversation's text once and streams its examples. Only the columns of
    ``format_turns`` are read, so others can't clash; an empty table gives no rows.
    """
    earlier = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = formatted.select("conv_id", "place", "segment", "start", "chars", "target_start", "target_end").withColumn("context", F.collect_list("segment").over(earlier))
    return turns.filter("target_start is not null").select(
        "conv_id", "place", F.concat_ws("", "context").alias("context"), F.col("segment").alias("own"), F.col("start").alias("context_end"),
        "target_start", "target_end", (F.col("start") + F.col("chars")).alias("end"),
    )


def read_targets(made: DataFrame) -> DataFrame:
    """The rows of ``examples`` with ``target``, the text under the loss mask, and ``example_chars``, both read back from the example's text."""
    text = F.concat("context", "own")
    span = F.substring(text, (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int"))
    return made.withColumns({"target": unescape(span), "example_chars": F.char_length(text).cast("long")})


def read_turns(formatted: DataFrame) -> DataFrame:
    """``formatted`` with role and text read back from the segments by places, so roles and texts may be of any length. An empty table gives no rows."""
    bare = F.regexp_replace("segment", "^<s>", "")
    size, named_end = F.char_length(bare), F.instr(bare, "] ")
    between = lambda opens, closes: F.substring(bare, opens + 1, size - opens - closes)
    named = bare.startswith("[TURN ")
    # a role's own brackets and spaces stand behind backslashes, so the first "] " ends it
    role = (
        F.when(bare.startswith("[SYS] "), "system").when(bare.startswith("[INST] "), "user")
        .when(named, F.regexp_replace(F.substring(bare, F.lit(7), named_end - 7), r"(?s)\\(.)", "$1")).otherwise("assistant")
    )
    text = F.when(named, between(named_end + 1, F.lit(len(" [/TURN]")))).otherwise(between(F.lit(len(_CLOSE["assistant"][0])), F.lit(len(_CLOSE["assistant"][1]))))
    for name in ("system", "user"):
        text = F.when(bare.startswith(_CLOSE[name][0]), between(F.lit(len(_CLOSE[name][0])), F.lit(len(_CLOSE[name][1])))).otherwise(text)
    return formatted.select("*", role.alias("role"), unescape(text).alias("text"))


def conversation_digests(formatted: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, example_chars).

    The loss and example columns are read from the rows of ``made``, those of ``examples``, and the others
    from the turns. A digest needs a conversation's turns in order, so each conversation streams through one task, in
    batches: memory doesn't grow with it. All else is done before, turn by turn, in all tasks. Further columns of either aren't read;
    empty tables give no rows, and a null conv_id is a conversation like any other.
    """
    none = lambda kind: F.lit(None).cast(kind)
    turns = read_turns(formatted).select("conv_id", "place", "role", "text", none("string").alias("target"), "chars")
    targets = read_targets(examples(formatted) if made is None else made)
    turns = turns.union(targets.select("conv_id", "place", none("string"), none("string"), "target", "example_chars"))
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]
        key, state, done = None, None, []

        def close() -> None:
            if state is not None:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        for batch in batches:
            for conv, role, text, target, chars in zip(
                batch["conv_id"].astype(object), batch["role"], batch["text"], batch["target"], batch["chars"], strict=True
            ):
                conv = None if pd.isna(conv) else conv
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                if target is not None:
                    state[2] += len(target)
                    state[3].update(target.encode())
                    state[5] += 1
                    state[6] += chars
                else:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[4] += chars
            yield pd.DataFrame(done, columns=names)
            done = []
        close()
        yield pd.DataFrame(done, columns=names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInPandas(
        digest,
        f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) and conversation -7, whose texts are all control strings."""
    own = conversations.select("conv_id", "turn", "role", "text")
    return own.union(own.sparkSession.createDataFrame(list(PROBE), "conv_id long, turn long, role string, text string"))
