"""Sinks: each writes a whole table anew, so that nothing stale stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import numbered


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes in a text are doubled, and blanks at its ends stay, so that read_manifest gives the same texts."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def write_nested_report(row: DataFrame, path: str) -> None:
    """A one-row table as one nested JSON object in one file."""
    row.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(split: DataFrame, path: str, order: str = "document_id") -> None:
    """JSONL in a folder for each split, with an id from 0 within it, of which none is gathered in one task."""
    numbered(split, "split", [order]).write.mode("overwrite").partitionBy("split").json(path)


def write_blocks(blocks: DataFrame, path: str, split: str = "split", lengths: DataFrame | None = None) -> None:
    """A folder of Parquet for each split; with `lengths` (split, document_id, tokens) a CSV of these beside them, in <path>_doc_tokens."""
    blocks.select(split, "block", "input_ids").write.mode("overwrite").partitionBy(split).parquet(path)
    if lengths is not None:
        lengths.write.mode("overwrite").partitionBy(split).csv(f"{path}_doc_tokens", header=True)


def write_texts(kept: DataFrame, path: str) -> None:
    """doc_id and text as Parquet; documents that no longer survive go with the overwrite."""
    kept.select("doc_id", F.concat("text", F.lit("\n")).alias("text")).write.mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends loss records; one without any loss is left out."""
    rows.where("loss is not null or eval_loss is not null").write.mode("append").parquet(path)


def stale_outputs(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Outputs whose source has gone: an anti join on doc_id."""
    return outputs.join(sources.select("doc_id"), "doc_id", "left_anti")
