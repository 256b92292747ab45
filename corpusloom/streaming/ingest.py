"""A Structured Streaming front end: new document files are cleaned and appended as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as X
from corpusloom.operators.sync import merge_log

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stream_documents(spark: SparkSession, folder: str, schema: str = DOCUMENTS, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def clean_stream(docs: DataFrame, min_words: int = 100) -> DataFrame:
    """Line rules, length filter and digest: stateless, so the stream needs no watermark."""
    cleaned = docs.withColumn("text", X.clean_text(F.col("text"))).withColumn("word_count", X.word_count(F.col("text")))
    return cleaned.where(F.col("word_count") >= min_words).withColumn("digest", X.normalized_digest(F.col("text")))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, min_words: int = 100) -> StreamingQuery:
    """Everything that is there now, then stop; a batch that is tried again overwrites its own folder, so rows land once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = clean_stream(stream_documents(spark, folder), min_words)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_log(spark: SparkSession, folder: str, path: str, checkpoint: str, schema: str = "step bigint, loss double, eval_loss double") -> StreamingQuery:
    """Loss records from files as they arrive, merged by step into the log at path: a batch that comes again changes nothing."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(lambda batch, number: merge_log(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_losses(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, event_type, n, mean_value of an event stream (ts, event_type, value), late rows up to the delay counted."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
