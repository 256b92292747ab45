"""The training-data pipeline over `documents`: language, near duplicates, repeated passages, benchmark items, packing.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir); all but the last return the columns of their input. A
stage works on every row that the one before it kept, and its result is written as Parquet and read again for the next.
Rows whose doc_id is null pass every filter that decides by id; repeated rows with one id stay or go together; extra columns
are carried along with their values, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize
from corpusloom.llm.decontamination import contaminated
from corpusloom.llm.language_id import identify, train
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.suffix_dedup import PASSAGE, clean

#: Ids that go are joined by broadcast up to this number (8 bytes each), by a shuffle beyond it.
BROADCAST_IDS = 500_000
#: Near duplicates: hundredths of five-word shingles in common.
NEAR_PERCENT = 80


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among the ids that go."""
    gone = materialize(gone.select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")


def _plain(docs: DataFrame) -> DataFrame:
    """docs with text as `text` and the other columns under generated names, so that none clashes with those of an operator."""
    return docs.toDF(*["text" if c == "text" else f"given_{i}" for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter in the text, or no text) go; labels in `lang` teach."""
    plain = _plain(docs)
    found = identify(plain, train(docs.select("doc_id", "text", "lang")), out=("found_lang", "found_score"))
    return found.where("found_lang <> 'und'").select(*plain.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return _without(docs, near_duplicates(docs.select("doc_id", "text"), NEAR_PERCENT).where("not kept")).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice are cut out if they have 400 bytes, or more than 50 words; a document of which nothing is left goes.

    n_chars, where there is one, follows the text.
    """
    plain = _plain(docs)
    had = F.length(F.coalesce(F.col("text"), F.lit(""))) > 0
    found = clean(plain.withColumn("had_text", had), shortest=PASSAGE).where("not had_text or text <> ''").select(*plain.columns).toDF(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else found


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers and names, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _without(docs, contaminated(docs.select("doc_id", "text"), benchmark)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 4,096 tokens."""
    return pack(docs.select("doc_id", "text")).drop("ids")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no counterpart of automata, transforms and tokenizers; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
