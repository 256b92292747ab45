"""Prefix sums over a whole table without gathering it in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.tables import few, materialize


def prefix_sums(df: DataFrame, order: list[str | Column], value: str | Column, name: str, partitions: int | None = None) -> DataFrame:
    """df with `name`: the sum of `value` over all rows before this one, in `order`.

    Rows are dealt by ranges of the order; each range sums within itself, and the ranges' totals (one row each) give the
    offsets. Rows that tie in the order stand in one range and are summed in the order that `order` leaves open, so an order
    without ties is wanted.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = df.withColumns({f"_o{i}": k for i, k in enumerate(keys)})
    ordered = materialize(named.repartitionByRange(n, *[f"_o{i}" for i in range(len(keys))]).withColumn("_range", F.spark_partition_id()), "ranges")
    amount = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0)).cast("long")
    totals = ordered.groupBy("_range").agg(F.sum(amount).alias("_total"))
    # one row for each range, so at most `partitions` rows meet here
    base = totals.withColumn("_base", F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_range", "_base")
    within = W.partitionBy("_range").orderBy(*[f"_o{i}" for i in range(len(keys))]).rowsBetween(W.unboundedPreceding, -1)
    summed = ordered.join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return summed.drop("_range", "_base", *[f"_o{i}" for i in range(len(keys))])


def numbered(df: DataFrame, by: str, order: list[str | Column], name: str = "id") -> DataFrame:
    """df with `name`: the row's number, from 0, among the rows with its value of `by`, in `order`.

    Numbers come from prefix sums over the whole table, less the first of each value, so a value may have any number of rows.
    `by` is meant to have few values (splits, types): one row for each is joined.
    """
    placed = materialize(prefix_sums(df, [by, *order], F.lit(1), "_place"), "placed")
    first = few(materialize(placed.groupBy(by).agg(F.min("_place").alias("_first")), "first"))
    return placed.join(first, by).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")
