"""Connected components of links, by pointer jumping on forests and by alternating large and small stars.

Links and labels stay in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has a link; links has columns u and v.

    Null ends and links of a node to itself are ignored; an empty table gives an empty one. Each round is written to the
    shared folder. The rounds end when a round changes nothing, after about the logarithm of the longest chain.
    """
    stars = materialize(links.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        stars = materialize(_small_star(_large_star(stars)), "stars")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state


def forest_roots(links: DataFrame) -> DataFrame:
    """node, component of a forest: links (u, v) with v smaller than u and one link for each u at most.

    Each round replaces a node's ancestor by that ancestor's own, so the rounds grow with the logarithm of the depth, and
    the rows of a round are the nodes.
    """
    state = materialize(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "forest")
    while True:
        above = state.select(F.col("node").alias("component"), F.col("component").alias("above"))
        if state.join(above, "component", "left_semi").isEmpty():
            return state.unionByName(state.select(F.col("component").alias("node"), "component").distinct())
        state = materialize(state.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component")), "forest")


def merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, component) after more links (u, v): only the components that these touch are joined anew."""
    ends = links
    for end in ("u", "v"):
        of = label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(of, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    joined = components(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    fresh = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct().join(label, "node", "left_anti")
    every = label.unionByName(fresh.withColumn("component", F.col("node")))
    above = joined.select(F.col("node").alias("component"), F.col("component").alias("above"))
    return materialize(every.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component")), "labels")
