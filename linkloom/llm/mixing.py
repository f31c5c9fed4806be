"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents. The whole
copies are sure. For the rest, documents meet two at a time: one passes probability to the other until
one of the two is 0 or 1, and the undecided one goes on. Buckets of a source work side by side in order
of size, so that those who meet are alike; each leaves one undecided document at most, and these meet in
the same way, level by level, until a source has none left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.scratch import materialise

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
BUCKET_ROWS = 5000
FAN_IN = 256
_EDGE = 1e-9


def word_count(text: Column) -> Column:
    """The number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_COPIES) -> list[float]:
    """Targets of sources in their order: by weight, none above ``most`` times its size, the excess shared again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total_share * sum(sizes)
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = [i for i in sorted(open_) if unit * w[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * w[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
            open_.discard(i)
    return target


def pivot(prob: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Let rows meet in their order; returns what each has then: 0, 1, or for one row at most something between."""
    out = prob.astype(float).tolist()
    holder = -1
    for i, u in enumerate(draw.tolist()):
        b = out[i]
        if b <= _EDGE or b >= 1 - _EDGE:
            out[i] = float(round(b))
            continue
        if holder < 0:
            holder = i
            continue
        a = out[holder]
        s = a + b
        if s < 1:
            a, b = (s, 0.0) if u * s < a else (0.0, s)
        else:
            a, b = (1.0, s - 1) if u * (2 - s) < 1 - b else (s - 1, 1.0)
        out[holder], out[i] = a, b
        undecided = [k for k in (holder, i) if _EDGE < out[k] < 1 - _EDGE]
        for k in (holder, i):
            if k not in undecided:
                out[k] = float(round(out[k]))
        holder = undecided[0] if undecided else -1
    return np.array(out)


_STATE = "doc_id {id}, source_no int, size long, base int, prob double, draw double, bucket int, occurrence int"


def _meet(rows: DataFrame, last: bool, schema: str) -> DataFrame:
    """One level: the rows of each (source, bucket) meet; in the last, what is left is drawn for."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "draw", "doc_id", "occurrence"], ascending=[False, True, True, True], kind="stable")
        got = pivot(pdf["prob"].to_numpy(), pdf["draw"].to_numpy())
        if last:
            got = np.where((got > _EDGE) & (got < 1 - _EDGE), (1 - pdf["draw"].to_numpy() < got).astype(float), got)
        return pdf.assign(prob=got)

    return rows.groupBy("source_no", "bucket").applyInPandas(group, schema)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(doc_id, source, size, occurrence, source_size, target, copies) for each row of ``docs``.

    Sources take the weights in order of code point, null last. ``copies`` is 0, 1 or 2; a row of size 0
    has 0. Draws come from hashes of doc_id, so runs agree. Repeated rows are told apart by
    ``occurrence`` (from 1 within doc_id, source and size); rows with a null doc_id share one draw. The
    totals of the sources, a row each, meet on the driver; documents never do. Only doc_id, text and
    source are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = materialise(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("rows")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    targets = shares([r["size"] for r in totals], weights, total_share)
    plan = [
        (r["source"], i, r["size"], t, int(t // r["size"]), t / r["size"] - t // r["size"], -(-r["rows"] // bucket_rows))
        if r["size"]
        else (r["source"], i, 0, 0.0, 0, 0.0, 1)
        for i, (r, t) in enumerate(zip(totals, targets, strict=True))
    ]
    sources = spark.createDataFrame(plan, "source string, source_no int, source_size long, target double, base int, prob double, buckets int")
    each = rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("occurrence"))
    joined = each.join(sources, each["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "occurrence", F.lit("mix")), 11) / float(1 << 53)
    state = joined.select(
        "doc_id", "source_no", "size", "base", "prob", draw.alias("draw"),
        F.pmod(F.xxhash64("doc_id", "occurrence", F.lit("bucket")), F.col("buckets")).cast("int").alias("bucket"), "occurrence",
    )
    schema = _STATE.format(id=docs.schema["doc_id"].dataType.simpleString())
    open_ = (F.col("prob") > _EDGE) & (F.col("prob") < 1 - _EDGE) & (F.col("size") > 0)
    settled = [state.filter(~open_)]
    rest, most = state.filter(open_), max([r[-1] for r in plan], default=1)
    while True:
        met = materialise(_meet(rest, most <= 1, schema), "mix")
        undecided = (F.col("prob") > _EDGE) & (F.col("prob") < 1 - _EDGE)
        settled.append(met.filter(~undecided))
        if most <= 1:
            break
        rest, most = met.filter(undecided).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int")), -(-most // FAN_IN)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + F.round("prob").cast("int"))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    named = sources.select("source_no", "source", "source_size", "target")
    return out.join(named, "source_no").select("doc_id", "source", "size", "occurrence", "source_size", "target", copies.alias("copies"))


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words the mix takes of each row, repeats counted."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns kept, whatever their names.

    Null and empty texts have size 0 and are never taken; very long texts count whole. Rows of one id, source and size are
    numbered by a hash of the whole row, so reruns take the same ones. An empty table gives no rows.
    """
    columns = docs.columns
    taken = mix(docs).filter("copies > 0").select(
        F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size"), F.col("occurrence").alias("k_occurrence"), "copies"
    )
    names = [f"c{i}" for i in range(len(columns))]
    rows = docs.select([F.col(f"`{c}`").alias(n) for n, c in zip(names, columns, strict=True)])
    at = dict(zip(columns, names, strict=True))
    rows = rows.withColumns({"r_id": F.col(at["doc_id"]), "r_source": F.col(at["source"]).cast("string"), "r_size": word_count(F.col(at["text"]))})
    order = F.xxhash64(F.to_json(F.struct(*names)))
    rows = rows.withColumn("r_occurrence", F.row_number().over(Window.partitionBy("r_id", "r_source", "r_size").orderBy(order)))
    on = F.lit(True)
    for k in ("id", "source", "size", "occurrence"):
        on = on & F.col(f"r_{k}").eqNullSafe(F.col(f"k_{k}"))
    many = rows.join(taken, on).select(*names, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return many.select([F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])
