"""Tables in the cluster's shared folder, which cut lineage and outlive executors; scans dealt out over all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of up to so many rows of ids are joined by broadcast (some 80 bytes each), larger ones by a shuffle.
BROADCAST_ROWS = 200_000

#: For texts of any length: bytes of an Arrow batch between the JVM and a worker (or one row), rows of a batch of a Parquet scan.
BATCH_BYTES, SCAN_ROWS = 4 << 20, 256


def long_texts(spark: SparkSession) -> None:
    """From now on the session's batches are small enough for texts that take tens of kilobytes each, a task in 128 MB of heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it names none, a local master gets a temporary one, set for the session;
    on a cluster that is an error, since executors would not see each other's files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that nothing before it is computed again.

    What a session has written goes when its JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def end_shuffles(spark: SparkSession) -> None:
    """Shuffle files that no table needs any more go when the driver's JVM collects its garbage, which it is told to do here:
    after large tables are written, so that the files of one step are not on disk beside those of the next."""
    spark.sparkContext._jvm.System.gc()


def drop(table: DataFrame) -> None:
    """Delete the folder of a written table that nothing reads any more."""
    spark = table.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table, marked for broadcast if it has at most so many rows."""
    return df.hint("broadcast") if df.count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt out to all of them; a scan of a large table stays as it is.

    A file of one row group is one task however many splits are planned, which at small sizes leaves the cores idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
