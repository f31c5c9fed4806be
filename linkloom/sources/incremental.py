"""Pages parsed again only where they changed, and logs that a repeated run doesn't double.

A store is a table of parsed rows in buckets of pages, beside a manifest (page_id, digest, bucket) in the same buckets. A run compares
digests, parses what is new or changed, and writes the buckets that hold such pages or have lost one; Spark replaces them when the whole
write is done, and no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.scratch import materialise

BUCKETS = 64


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _replace(df: DataFrame, path: str) -> None:
    """Writes the buckets that ``df`` has; other buckets stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def update(pages: DataFrame, store: str, parse: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> dict[str, int]:
    """Brings ``store`` up to date with ``pages`` (page_id, html); says how many pages were parsed, kept and removed.

    ``parse`` makes rows with ``page_id`` out of pages; a page may give none. Pages whose digest is the manifest's aren't parsed. Of rows of one
    page_id the one of smallest digest counts; pages without an id don't. Every bucket's row set is written whole, so a run that
    broke off is mended by the next.
    """
    spark = pages.sparkSession
    digest = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("digest")
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int").alias("bucket")
    now = pages.filter("page_id is not null").select("page_id", digest).groupBy("page_id").agg(F.min("digest").alias("digest")).withColumn("bucket", bucket)
    manifest, rows_path = f"{store}/manifest", f"{store}/rows"
    was = spark.read.parquet(manifest) if _there(spark, manifest) else now.limit(0)
    old = was.select(F.col("page_id").alias("old_id"), F.col("digest").alias("old_digest"), F.col("bucket").alias("old_bucket")).filter("old_id is not null")
    met = now.join(old, F.col("page_id") == F.col("old_id"), "full")
    state = (
        F.when(F.col("page_id").isNull(), "removed").when(F.coalesce(F.col("digest") == F.col("old_digest"), F.lit(False)), "kept").otherwise("parsed")
    )
    compared = materialise(met.select(F.coalesce("page_id", "old_id").alias("page_id"), F.coalesce("bucket", "old_bucket").alias("bucket"), "digest", state.alias("state")), "compared")
    counts = {r["state"]: r["n"] for r in compared.groupBy("state").agg(F.count("*").alias("n")).collect()}
    counts = {k: counts.get(k, 0) for k in ("parsed", "kept", "removed")}
    if counts["parsed"] or counts["removed"] or not _there(spark, manifest):
        touched = compared.filter("state <> 'kept'").select("bucket").distinct()
        # both dealt by page alone, so that the page's rows are told apart where they meet
        fresh = compared.filter("state = 'parsed'").select("page_id", "digest").repartition("page_id")
        changed = pages.withColumn("digest", digest).repartition("page_id").join(fresh, ["page_id", "digest"], "left_semi").dropDuplicates(["page_id"]).drop("digest")
        parsed = parse(changed)
        rows = parsed.withColumn("bucket", bucket)
        if _there(spark, rows_path):
            # whole buckets are written: of the pages that stay, the rows that stand
            stays = compared.filter("state = 'kept'").select("page_id")
            kept = spark.read.schema(rows.schema).parquet(rows_path).join(touched, "bucket", "left_semi").join(stays, "page_id", "left_semi")
            rows = rows.unionByName(kept.select(rows.columns))
        # a bucket that comes out empty is kept in being by a row without a page
        none = touched.select("bucket")
        bare = none.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "bucket" else F.col("bucket") for f in rows.schema])
        _replace(materialise(rows.unionByName(bare), "store_rows"), rows_path)
        listed = compared.filter("state <> 'removed'").join(touched, "bucket", "left_semi").select("page_id", "digest", "bucket")
        empty = none.select(F.lit(None).cast(listed.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("binary").alias("digest"), "bucket")
        _replace(materialise(listed.unionByName(empty), "store_manifest"), manifest)
    return counts


def read(spark: SparkSession, store: str) -> DataFrame:
    """The parsed rows of a store."""
    return spark.read.parquet(f"{store}/rows").filter("page_id is not null").drop("bucket")


def append_log(records: DataFrame, path: str, run: str) -> None:
    """One JSON object a line, with its ``kind``, under the run's name; the same run again replaces its own lines and no others."""
    if "kind" not in records.columns:
        raise ValueError("log records need a kind")
    records.write.mode("overwrite").json(f"{path}/run={run}")


def read_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """All lines of a log, with the run they came from; lines that are no such objects have nulls."""
    return spark.read.schema(f"{ddl}, run string").json(path)
