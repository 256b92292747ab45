"""Sources: manifests, text folders, JSONL, Parquet, JSON objects, PDF-like page extraction, and what is yet to be fetched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("file_name", "category", "publisher", "title", "url")])
LOSS_LOG = T.StructType([T.StructField("step", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in ("epoch", "loss", "eval_loss", "learning_rate", "grad_norm")])
SPLIT_ROWS = "document_id string, source string, sha256 string, words bigint, text string, part string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and quoted commas, all columns text."""
    return spark.read.csv(path, header=True, schema=MANIFEST, multiLine=True, escape='"')


def read_loss_log(spark: SparkSession, path: str) -> DataFrame:
    """CSV of a training log; an empty cell is null."""
    return spark.read.csv(path, header=True, schema=LOSS_LOG)


def read_texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """doc_id (file name without its ending), text (the whole file), of the files that match; none is an error."""
    rows = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    found = rows.select(F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.[^./]*$", 1).alias("doc_id"), F.col("value").alias("text"))
    if found.isEmpty():
        raise ValueError(f"no {glob} in {folder}")
    return found


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = SPLIT_ROWS) -> DataFrame:
    """A row for each line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """One row from a file that holds one nested object."""
    return spark.read.option("multiLine", True).json(path)


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Some columns of a Parquet table; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """A table, or an empty one of the schema if the path does not exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).format(kind).load(path)
    return spark.createDataFrame([], schema)


def read_binary(spark: SparkSession, folder: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, modificationTime, length, content of the files that match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def read_page_marked(spark: SparkSession, folder: str, glob: str = "*.txt", name: Column | None = None) -> DataFrame:
    """file_name, page_no, text, error of the page-marked text files of a folder; none is an error. name: from path and the
    folder's partition columns, if the file name is not the path's last part.

    Files are found, dealt out to tasks and read by Spark, whatever store they lie in, and cut where they are read. Pages come
    without white space at their ends and may be empty; a file without marks is one page, one without a byte has none (Spark's
    readers pass over it). A file that is not UTF-8 gives one row
    with the error, the other files' rows stay.
    """
    files = read_binary(spark, folder, glob)
    if files.select("path").isEmpty():
        raise ValueError(f"no {glob} in {folder}")
    name = F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"([^/]+)$", 1) if name is None else name
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    read = files.select(name.alias("file_name"), valid.alias("valid"), F.when(valid, F.col("content").cast("string")).alias("whole"))
    mark = r"(?m)^--- PAGE (\d+) ---$"
    numbers = F.regexp_extract_all("whole", F.lit(mark), F.lit(1))
    parts = F.split("whole", mark)
    # what stands before the first mark is no page, unless there are no marks
    marked = F.zip_with(numbers, F.slice(parts, F.lit(2), F.size(numbers)), lambda n, t: F.struct(n.cast("int").alias("page_no"), t.alias("text")))
    pages = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit(1).alias("page_no"), F.col("whole").alias("text")))).otherwise(marked)
    bad = F.array(F.struct(F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("text")))
    rows = read.select("file_name", "valid", F.explode(F.when(F.col("valid"), pages).otherwise(bad)).alias("p"))
    error = F.when(~F.col("valid"), F.lit("not UTF-8"))
    return rows.select("file_name", "p.page_no", F.regexp_replace("p.text", r"^\s+|\s+$", "").alias("text"), error.alias("error"))


def form_feed_pages(content: bytes) -> list[str]:
    """An extractor for plain text: pages end at form feeds, as command-line converters write them."""
    pages = content.decode("utf-8").split("\f")
    return pages[:-1] if len(pages) > 1 and not pages[-1].strip() else pages


def pdf_pages(content: bytes) -> list[str | None]:
    """An extractor for PDF files, by pypdf where that is installed; a missing package is every file's error."""
    import io

    import pypdf

    return [page.extract_text() for page in pypdf.PdfReader(io.BytesIO(content)).pages]


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str | None]]) -> DataFrame:
    """doc_id, page_no (from 1), text, error: each file's pages by an extractor; a file that it fails on gives one row with the error.

    files: path, content. The extractor is any function from bytes to page texts; it runs in Arrow batches, file by file.
    """
    schema = "doc_id string, page_no int, text string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = (path or "").rsplit("/", 1)[-1]
                try:
                    rows += [(name, i, t or "", None) for i, t in enumerate(extractor(content), 1)]
                except Exception as e:  # an unreadable file is a result
                    rows.append((name, None, None, f"{type(e).__name__}: {str(e)[:80]}"))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["doc_id", "page_no", "text", "error"])

    return files.select("path", "content").mapInArrow(run, schema)


def missing_files(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """The manifest's rows whose file is not there yet, or is empty: an anti join. existing: file_name, length."""
    return manifest.join(existing.where("length > 0").select("file_name"), "file_name", "left_anti")


def download_status(content: Column, error: Column, already: Column) -> Column:
    """already_present, failed: ..., not_a_pdf or downloaded."""
    magic = F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))
    return F.when(already, "already_present").when(error.isNotNull(), F.concat(F.lit("failed: "), F.substring(error, 1, 80))).when(~magic, "not_a_pdf").otherwise("downloaded")


def download_report(manifest: DataFrame, fetched: DataFrame, existing: DataFrame) -> DataFrame:
    """The manifest with status and bytes, joined to what was fetched (file_name, content, error) and what was there."""
    there = existing.where("length > 0").select("file_name", F.col("length").alias("_length"))
    rows = manifest.join(there, "file_name", "left").join(fetched, "file_name", "left")
    return rows.select(*manifest.columns, download_status(F.col("content"), F.col("error"), F.col("_length").isNotNull()).alias("status"), F.coalesce("_length", F.length("content").cast("long"), F.lit(0).cast("long")).alias("bytes"))


def quoted_url(url: Column) -> Column:
    """A URL whose path may be sent: letters, digits and `_.-~/%` stay, every other byte of its UTF-8 is percent-encoded. Query and
    fragment stay as they are."""
    cut = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$"
    path = F.url_encode(F.regexp_extract(url, f"(?s){cut}", 2))
    for encoded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%25", "%")):
        path = F.replace(path, F.lit(encoded), F.lit(plain))
    return F.when(url.isNotNull(), F.concat(F.regexp_extract(url, f"(?s){cut}", 1), path, F.regexp_extract(url, f"(?s){cut}", 3)))


#: Errors after which asking again does not help: the server has answered, or its certificate is not accepted.
FINAL_ERROR = r"(?i)^HTTP|\bSSL|certificate"


def files_to_retry(attempts: DataFrame, retries: int = 1) -> DataFrame:
    """file_name, attempts of the files whose last attempt failed for a passing reason and that were tried at most `retries` times.

    attempts: file_name, attempt (1, 2, ...), error (null: fetched). A file that was fetched once is done, and so is one that
    failed for good once.
    """
    error = F.col("error")
    by = attempts.groupBy("file_name").agg(F.max("attempt").cast("long").alias("attempts"), F.max(error.isNull() | error.rlike(FINAL_ERROR)).alias("settled"))
    return by.where(~F.col("settled") & (F.col("attempts") <= retries)).select("file_name", "attempts")


def status_counts(report: DataFrame) -> DataFrame:
    """status (before a colon), n."""
    return report.groupBy(F.split("status", ":")[0].alias("status")).agg(F.count("*").alias("n"))
