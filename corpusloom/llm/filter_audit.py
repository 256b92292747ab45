"""Interaction of filters: what each of them removes in every order in which they may be applied.

A document is a mask of the filters that it fails. With k filters there are k * 2 ** (k - 1) edges of the subset lattice: a set
of filters already applied, and the filter that is applied next. Documents are counted by part and mask, and these counts
by edge; an order of the filters is a path from the empty set to the whole one, so its steps are looked up among the edges.
Texts are read once, however many orders there are.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import let, materialize, spread, words
from corpusloom.operators.dedup import exact_duplicates

#: Filters by letter, as conditions under which a document fails, over the columns of `measured`.
FILTERS: dict[str, str] = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}
#: Symbols of one filter; capital letters.
SYMBOLS, CAPITALS = "[#$%&*|]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Orders are listed one by one, so there may not be many filters (7 have 5,040).
MOST_FILTERS = 7
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, part, n_words, n_distinct, n_capitals, n_chars, has_symbol, is_copy of df(doc_id, source and a text).

    is_copy: a smaller doc_id of the table has the same text. A null text is the empty text and equal to it, a null source
    the empty part. A null doc_id is not smaller than any and has no smaller one; rows that share an id are rows of their
    own and no copies of each other. The result is a written table; texts are compared by SHA-256.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    rows = df.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole.alias("whole"), counted.alias("counted")).select(
        "doc_id",
        "part",
        F.col("counted.n").alias("n_words"),
        F.col("counted.distinct").alias("n_distinct"),
        (F.length("whole") - F.length(F.translate("whole", CAPITALS, ""))).alias("n_capitals"),
        F.length("whole").alias("n_chars"),
        F.col("whole").rlike(SYMBOLS).alias("has_symbol"),
        F.sha2("whole", 256).alias("digest"),
    )
    copy = F.coalesce(F.col("doc_id") > F.col("first_of"), F.lit(False))
    return exact_duplicates(materialize(rows, "measured")).withColumn("is_copy", copy).drop("first_of", "digest")


def masked(rows: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """rows with mask: one bit for each filter that fails, in the order of `filters`. A condition that is null does not fail."""
    mask = F.lit(0)
    for i, condition in enumerate(filters.values()):
        mask = mask + F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0))
    return rows.withColumn("mask", mask)


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic of rows(doc_id, part, mask); labels: doc_id, quality, toxic.

    A document is good (toxic) if any of its labels' rows has quality (toxic) 1; one without labels is neither. Rows are
    added up by document before they meet its labels, so an id may have any number of rows in both tables.
    """
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    each = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(name) for c, name in (("good", "n_good"), ("bad", "n_toxic"))])


def lattice_edges(counts: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, filter, before (mask of the filters already applied), and COUNTS: all edges of every part of mask_counts."""
    letters = list(filters)
    edges = [(letter, before, 1 << i) for i, letter in enumerate(letters) for before in range(1 << len(letters)) if not before >> i & 1]
    listed = F.explode(F.array(*[F.struct(F.lit(letter).alias("filter"), F.lit(before).alias("before"), F.lit(bit).alias("bit")) for letter, before, bit in edges]))
    rows = counts.select("*", listed.alias("e")).select("part", "mask", "n", "n_good", "n_toxic", "e.*")
    passed, fails = F.col("mask").bitwiseAND(F.col("before")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(value: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(F.lit(0)))

    return rows.groupBy("part", "filter", "before").agg(
        total("n", passed & ~fails).alias("kept"),
        total("n", passed & fails).alias("removed"),
        total("n", ~passed & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("n_good", passed & fails).alias("good_lost"),
        total("n_toxic", passed & fails).alias("toxic_lost"),
    )


def order_steps(spark: SparkSession, filters: dict[str, str] = FILTERS) -> DataFrame:
    """filter_order, step, filter, before of all orders: k * k! rows, whatever the data."""
    bit = {letter: 1 << i for i, letter in enumerate(filters)}
    if len(bit) > MOST_FILTERS:
        raise ValueError(f"{len(bit)} filters have {math.factorial(len(bit))} orders; up to {MOST_FILTERS} filters are listed")
    rows = [("".join(order), i + 1, letter, sum(bit[x] for x in order[:i])) for order in itertools.permutations(filters) for i, letter in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int")


def audit(edges: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, filter_order, step, COUNTS, shapley: every order as a path through the edges.

    shapley: what the step's filter removes, summed over all orders: an edge after s of k filters lies on s! * (k - 1 - s)! of them.
    """
    k = len(filters)
    done = F.bit_count("before")
    orders = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(k - 1 - s)) for s in range(k)]), done + 1)
    summed = edges.withColumn("shapley", F.sum(F.col("removed") * orders).over(W.partitionBy("part", "filter")))
    return summed.join(F.broadcast(order_steps(edges.sparkSession, filters)), ["filter", "before"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by source; an empty table has no parts and gives no rows."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    counts = materialize(mask_counts(masked(measured(docs)), labels), "masks")
    return audit(lattice_edges(counts))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (
  SELECT doc_id, part, len(words) < 50 AS "A", 100 * len(list_distinct(words)) < 65 * len(words) AS "B",
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS "C", regexp_matches(text, '[#$%&*|]') AS "D",
    coalesce(doc_id > first, false) AS "E" FROM w),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, (CASE WHEN "A" THEN 1 ELSE 0 END + CASE WHEN "B" THEN 2 ELSE 0 END + CASE WHEN "C" THEN 4 ELSE 0 END
      + CASE WHEN "D" THEN 8 ELSE 0 END + CASE WHEN "E" THEN 16 ELSE 0 END) AS mask,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM f LEFT JOIN marks USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.l, b.l, c.l, d.l, e.l] AS ls, [a.b, b.b, c.b, d.b, e.b] AS bs
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, i::INTEGER AS step, ls[i] AS filter, bs[i] AS bit, coalesce(list_sum(bs[1:i - 1]), 0)::INTEGER AS before
  FROM orders, range(1, 6) t(i)),
counted AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""
