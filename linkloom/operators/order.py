"""Places and running values along a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.scratch import write_table

_LOCAL_BITS = 33
SPAN = 4096
PART_ROWS = 1 << 18


def parts_for(rows: int, spark: SparkSession, part_rows: int = PART_ROWS) -> int:
    """Into how many parts so many rows are dealt, that a part stays small however many there are; never fewer than Spark's own number."""
    return max(-(-rows // part_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))


def positions(
    df: DataFrame, order: list[str | Column], column: str = "position", ties: list[str | Column] = (), keep: list[str | Column] | None = None,
) -> DataFrame:
    """The rows of ``df`` with their place 0, 1, ... in the order, a table in the shared folder.

    Rows are dealt out by ranges of ``order``, so equal keys share a task; ``ties`` order rows within that task. A
    task counts its own rows, and what meets on the driver is a count for each task. ``keep`` names what is left of a row.
    Rows equal in all keys stand in no certain order. An empty table gives an empty one; ``column`` must be a new name.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order, *ties).select(*(keep or ["*"]), F.monotonically_increasing_id().alias(column))
    rows, _ = write_table(dealt, "placed")
    task = F.shiftrightunsigned(column, _LOCAL_BITS)
    counts = sorted(rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for own, n in counts:
        starts.append((own, before))
        before += n
    first = F.broadcast(spark.createDataFrame(starts, "_task long, _first long"))
    place = F.col("_first") + F.col(column).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return rows.join(first, task == F.col("_task")).withColumn(column, place).drop("_task", "_first")


_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "last": F.max}


def before(df: DataFrame, group: list[str], place: str, value: str, column: str, how: str = "sum", span: int = SPAN, levels: int = 2) -> DataFrame:
    """``before_all`` of one value."""
    return before_all(df, group, place, {column: (value, how)}, span, levels)


def before_all(df: DataFrame, group: list[str], place: str, values: dict[str, tuple[str, str]], span: int = SPAN, levels: int = 2) -> DataFrame:
    """``df`` with, for each column -> (value, how) of ``values``, the aggregate of the value over the rows of the group at smaller places; null at the first.

    Within ``span`` places rows are summed up by a window, further back by the totals of whole spans, and so on up
    ``levels``; so a window holds ``span`` rows, but for the top one, which has a row for each span^levels places.
    All values go through the same windows and joins.
    ``how`` is sum, or max of values that rise with the place ("last"). Places are whole numbers, also
    negative, so that -place looks ahead. Nulls count for nothing; groups are compared null-safely only where they hold no null.
    """
    own = f"_span{levels}"
    window = Window.partitionBy(*group, *([own] if levels else [])).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        return df.withColumns({column: _AGGREGATES[how](value).over(window) for column, (value, how) in values.items()})
    cut = df.withColumn(own, F.floor(F.col(place) / span))
    inner = cut.withColumns({f"_inner{k}": _AGGREGATES[how](value).over(window) for k, (value, how) in enumerate(values.values())})
    totals = cut.groupBy(*group, own).agg(*[_AGGREGATES[how](value).alias(f"_total{k}") for k, (value, how) in enumerate(values.values())])
    above = {f"_carried{k}": (f"_total{k}", how) for k, (_, how) in enumerate(values.values())}
    carried = before_all(totals, group, own, above, span, levels - 1).select(*group, own, *above)
    out = {}
    for k, (column, (_, how)) in enumerate(values.items()):
        near, far = f"_inner{k}", f"_carried{k}"
        out[column] = F.coalesce(F.col(near) + F.col(far), near, far) if how == "sum" else F.coalesce(near, far)
    return inner.join(carried, [*group, own]).withColumns(out).select(*df.columns, *values)
