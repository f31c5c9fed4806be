"""The last records of each kind of a stream, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.scratch import fresh_path

#: How many records each kind of buffer holds.
EVENTS, QUESTIONS = 128, 64


def _latest(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of each kind the ``most`` latest rows, by time, then id."""
    return rows.sort_values(["at", "id"]).groupby("kind", sort=False).tail(most)


def rings(records: DataFrame, most: int = EVENTS, idle: str | None = None) -> DataFrame:
    """(kind, step, ids): after each batch the ids of the ``most`` latest records of every kind it brought some of.

    ``records`` is a stream of (kind, at, id), ``at`` a timestamp. Each task first reduces what it reads to ``most`` a kind, so that a hot kind's
    rows don't all meet; the state of a kind holds ``most`` records. ``idle`` (like "1 hour") forgets a kind when no record came for
    so long, by the records' time: its next record then begins anew. Rows with nulls take no part.
    """
    named = records.select("kind", "at", F.col("id").cast("long").alias("id")).filter("kind is not null and at is not null and id is not null")
    named = named.withWatermark("at", idle) if idle else named

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = _latest(batch if held is None else pd.concat([held, batch]), most)
        if held is not None:
            yield held

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, ids, step = state.get if state.exists else ([], [], 0)
        held = pd.DataFrame({"kind": key[0], "at": pd.to_datetime(pd.Series(at, dtype="int64"), unit="us"), "id": pd.Series(ids, dtype="int64")})
        for batch in batches:
            held = _latest(pd.concat([held, batch[["kind", "at", "id"]]]), most)
        state.update((held["at"].astype("datetime64[us]").astype("int64").tolist(), held["id"].tolist(), step + 1))
        if idle:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(held["at"].max().timestamp() * 1000) + 1))
        yield pd.DataFrame({"kind": [key[0]], "step": [step + 1], "ids": [held["id"].tolist()]})

    few = named if idle else named.mapInPandas(reduce, named.schema)
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return few.groupBy("kind").applyInPandasWithState(
        fold, "kind string, step long, ids array<long>", "at array<long>, ids array<long>, step long", "update", timeout
    )


def replay(found: DataFrame, name: str = "rings") -> DataFrame:
    """What a stream of ``rings`` comes to when all that is there now has been read: the last row of each kind."""
    spark = found.sparkSession
    path, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("kind string, step long, ids array<long>, batch long").parquet(path)
    return rows.groupBy("kind").agg(F.max_by("ids", F.struct("batch", "step")).alias("ids"))
