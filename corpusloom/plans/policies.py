"""Policy-like texts made from `part` and `supplier`, for the operators that need headings, clauses and split words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part numbers that the policies of all brands share out among them.
PARTS = 500


def policy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: one policy for each brand and PARTS part numbers, a numbered section for each part of it; so the number of
    policies grows with the table, not their length."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    size, price = F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string")
    section = F.concat_ws(
        "\n",
        F.concat(F.lit("2."), (F.col("p_partkey") % 90 + 1).cast("string"), F.lit(" "), F.initcap(F.regexp_replace("p_type", "[^A-Za-z ]", " ")), F.lit(" Storage")),
        F.concat(F.lit("(a) Every keeper of "), F.lower("p_type"), F.lit(" must count the stock within "), size, F.lit(" days of its arrival at the store.")),
        F.concat(F.lit("(b) The price of an item is entered only once, and a change of more than "), price, F.lit(" per unit is signed by the head of")),
        F.lit("the office before it takes effect."),
        F.lit("(c) The following are kept apart:"),
        F.lit("- open boxes"),
        F.lit("- returned goods;"),
        F.concat(F.lit("(d) Stock that is not eli gible for sale after "), size, F.lit(" weeks is reported to the board, and eligible stock is listed with it.")),
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", section.alias("s")))), lambda x: x["s"]), "\n")
    doc_id = F.concat_ws("_", F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "_"), F.floor(F.col("p_partkey") / PARTS).cast("string"))
    return part.groupBy(doc_id.alias("doc_id")).agg(body.alias("b")).select("doc_id", F.concat(F.lit("Stock Policy of "), F.upper(F.replace("doc_id", F.lit("_"), F.lit(" "))), F.lit("\nThis text binds all stores.\n"), F.col("b"), F.lit("\nANNEXURE FORMS\nSign here on line 1.")).alias("text"))
