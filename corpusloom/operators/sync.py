"""Tables that follow their sources: only what has changed is worked on, and a run that is repeated changes nothing.

A table lies in folders by bucket. A run rewrites the buckets that something changes in, by dynamic partition overwrite, and
leaves the others alone. A run that was stopped between two buckets is made good by the next one, which compares again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.readers import read_if_there
from corpusloom.sources.tables import few, materialize

#: Buckets of a synced table; one is a file, so a table of t bytes has files of t / BUCKETS bytes.
BUCKETS = 256
#: Steps of a bucket of a log.
LOG_STEPS = 1_000
_SYNCED = "file_name string, source_digest string, text string, bucket int"


def _put(rows: DataFrame, path: str) -> None:
    """Rewrites the buckets that the rows (a written table) have, each as one file."""
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def sync(sources: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """file_name, action (added, changed, removed, same) of every source that is or was there, after the table at path follows sources.

    sources: file_name (not null, unique), text. process makes the texts to keep, file_name and text, of the sources that are
    new or changed; it sees no others, so it has to work document by document. What it leaves out is remembered, not tried
    again until it changes. Sources that have vanished go from the table. The number of buckets is that of the first run.
    """
    spark = sources.sparkSession
    there = read_if_there(spark, path, _SYNCED).where("file_name is not null")
    new = sources.select("file_name", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    bucket = F.pmod(F.xxhash64("file_name"), F.lit(buckets)).cast("int")
    compared = new.select("file_name", "digest").join(there.select("file_name", "source_digest"), "file_name", "full")
    action = F.when(F.col("source_digest").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("source_digest"), "changed").otherwise("same")
    actions = materialize(compared.select("file_name", action.alias("action"), bucket.alias("bucket")), "actions")
    touched = materialize(actions.where("action <> 'same'").select("bucket").distinct(), "touched")
    if touched.isEmpty():
        return actions.select("file_name", "action")
    work = materialize(new.join(few(materialize(actions.where("action in ('added', 'changed')").select("file_name"), "work")), "file_name", "left_semi"), "changed")
    kept = process(work.select("file_name", "text")).select("file_name", F.col("text").alias("kept"))
    fresh = work.join(kept, "file_name", "left").select("file_name", F.col("digest").alias("source_digest"), F.col("kept").alias("text"), bucket.alias("bucket"))
    # at most one row for each bucket
    stay = there.join(F.broadcast(touched), "bucket", "left_semi").join(actions.where("action = 'same'").select("file_name"), "file_name", "left_semi")
    rows = materialize(fresh.unionByName(stay.select(*fresh.columns)), "rows")
    # a bucket that nothing is left in gets a row without a name, so that it is rewritten too
    empty = touched.join(rows.select("bucket").distinct(), "bucket", "left_anti")
    none = F.lit(None).cast("string")
    _put(rows.unionByName(empty.select(none.alias("file_name"), none.alias("source_digest"), none.alias("text"), "bucket")), path)
    return actions.select("file_name", "action")


def synced_texts(spark, path: str) -> DataFrame:
    """file_name, text: what a synced table keeps."""
    return read_if_there(spark, path, _SYNCED).where("file_name is not null and text is not null").select("file_name", "text")


def merge_log(rows: DataFrame, path: str, keys: tuple[str, ...] = ("step",)) -> None:
    """Puts log records into the table at path, one for each key; of a key that is there already the new record counts.

    rows: the keys (step among them) and other columns; of several records of a key in one batch the greatest counts. Records are in
    buckets of LOG_STEPS steps, so a batch rewrites the buckets of its own steps, however long the log is, and a batch that
    comes again changes nothing. loss and eval_loss, where there are both, must not both be null.
    """
    spark = rows.sparkSession
    if {"loss", "eval_loss"} <= set(rows.columns):
        rows = rows.where("loss is not null or eval_loss is not null")
    new = materialize(rows.withColumn("bucket", F.floor(F.col("step") / LOG_STEPS).cast("int")), "batch")
    if new.isEmpty():
        return
    there = read_if_there(spark, path, new.schema).join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")
    both = new.withColumn("_new", F.lit(1)).unionByName(there.withColumn("_new", F.lit(0)))
    rest = [c for c in new.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max(F.struct("_new", *rest)).alias("_record")).select(*keys, *[F.col(f"_record.{c}").alias(c) for c in rest])
    _put(materialize(newest, "merged"), path)
