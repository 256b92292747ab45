"""Near-duplicates by b-bit MinHash.

A document's shingle set gives 128 minima. Bands of minima make candidates; of each minimum the low four bits are kept,
packed into longs, and the similarity is estimated from the bit counts of their exclusive or, corrected for chance
collisions. Candidates that the estimate allows are confirmed on the full sets.

Documents of equal sets are one class from the start. The smallest class of a bucket is its pivot. Every class is compared
with the smallest of its pivots first, then with those of its pivots that are in another component still. So a large group
of copies costs one comparison for each copy.

What is left are links between classes that share a pivot, of which one is not in the pivot's component. Their sets' shingles
that the pivot lacks tell them apart: if x and y share none of these, then what they share lies within the pivot, so it is at
most the smaller of their parts in common with it, and their sizes must fit that bound; if they share some, they share one of
the rarest such shingles of each (a prefix filter in the order of frequency among the pivot's group). Only pairs that meet
under such a shingle or size are candidates; each such key is a bucket again, whose members meet its smallest first. So a group
whose members are all alike, but mostly not alike enough, does not make its square of pairs, and no link between different
components is missed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import arrow_map, materialize, mix, slices, spread, text_bytes, word_hashes
from corpusloom.llm.components import components, forest_roots, merge

SHINGLE, MINIMA, BITS = 5, 128, 4
#: Greatest chance that a pair of just the threshold shares no band; deviations that the estimate may be too low by.
MISS, DEVIATIONS = 1e-4, 5.0
#: Ids up to this number are joined by broadcast (8 bytes each), more by a shuffle.
BROADCAST_IDS = 500_000
#: Pairs that share one end are joined to its set in parts of so many; sizes up to FINE are told apart exactly, larger ones by
#: steps of 1 / 64 of a doubling.
SPREAD, FINE = 256, 256
#: Estimated similarity from which a pivot is taken to be another version of an earlier one.
KIN = 0.5
_RNG = np.random.default_rng(128)
_FACTORS = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64)
_PLACES = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_rows(threshold: float) -> int:
    """Minima of a band: as many as still miss a pair of the threshold with no more than the chance MISS."""
    return max(r for r in range(1, 33) if r == 1 or (1 - threshold**r) ** (MINIMA // r) <= MISS)


def most_mismatches(threshold: float) -> int:
    """Minima whose low bits may differ in a pair whose similarity is the threshold."""
    chance = 1 / (1 << BITS)
    match = chance + (1 - chance) * threshold
    return math.ceil(MINIMA * (1 - match + DEVIATIONS * math.sqrt(match * (1 - match) / MINIMA)))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text, sorted; n + 1 bounds). A text of fewer words has one shingle, one without words none."""
    hashes, counts, _, _ = word_hashes(raw, offsets)
    n = len(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(n), many)
    start = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    left = first[text + 1] - start
    out = np.zeros(len(text), np.uint64)
    for k in range(size):
        there = left > k
        word = hashes[np.minimum(start + k, max(len(hashes) - 1, 0))] if len(hashes) else out
        out += np.where(there, mix(word + _PLACES[k]) * _PLACES[k], np.uint64(0))
    out = mix(out ^ np.minimum(left, size).astype(np.uint64))
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[new], text[new]
    return out, np.searchsorted(text, np.arange(n + 1))


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MINIMA by texts (those that have shingles)."""
    out = np.empty((MINIMA, len(bounds)), np.uint64)
    for k in range(MINIMA):
        h = values * _FACTORS[k] + _SHIFTS[k]
        h ^= h >> np.uint64(32)
        out[k] = np.minimum.reduceat(h, bounds)
    return out


def sketches(df: DataFrame, threshold: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), signature array<long>, bands array<long>."""
    rows = band_rows(threshold)
    schema = df.select(F.col(id_col).alias("doc_id")).schema.add("n_shingles", "long").add("digest", "binary")
    schema = schema.add("signature", T.ArrayType(T.LongType())).add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            values, bounds = shingle_sets(*text_bytes(batch.column(1)))
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            digests: list[bytes | None] = [None] * len(sizes)
            signature: list = [None] * len(sizes)
            bands: list = [None] * len(sizes)
            if len(some):
                least = minima(values, bounds[some])
                low = least & np.uint64((1 << BITS) - 1)
                per = 64 // BITS
                packed = np.zeros((MINIMA // per, len(some)), np.uint64)
                for k in range(MINIMA):
                    packed[k // per] |= low[k] << np.uint64(BITS * (k % per))
                keys = np.zeros((MINIMA // rows, len(some)), np.uint64)
                for b in range(len(keys)):
                    for k in range(b * rows, (b + 1) * rows):
                        keys[b] = mix(keys[b] * np.uint64(0x9E3779B97F4A7C15) + least[k])
                packed, keys = packed.T.astype(np.int64, casting="unsafe"), keys.T.astype(np.int64, casting="unsafe")
                for j, i in enumerate(some.tolist()):
                    digests[i] = hashlib.blake2b(values[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest()
                    signature[i], bands[i] = packed[j], keys[j]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signature, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "signature", "bands"],
            )

    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, schema)


def full_sets(df: DataFrame) -> DataFrame:
    """node, n, shingles array<long> of a table of node and text."""
    schema = df.select("node").schema.add("n", "long").add("shingles", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            values, bounds = shingle_sets(*text_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), lists], names=["node", "n", "shingles"])

    return arrow_map(df.select("node", "text"), run, schema)


def mismatches(a: Column, b: Column) -> Column:
    """Minima whose kept bits differ, by the bit counts of the packed signatures."""
    ones = F.lit(0x1111111111111111)

    def of(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones))

    total = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        total = total + of(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two signatures, corrected for low bits that agree by chance."""
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), ((MINIMA - mismatches(a, b)) / MINIMA - chance) / (1 - chance))


def _few(df: DataFrame) -> DataFrame:
    """df, a written table of ids, marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def with_sets(pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """pairs with n_<end> and s_<end>, the set of that end. The set of an end with very many pairs is dealt out in copies, each
    for a part of them, so that no task gets them all. pairs: a written table, or one that costs little to make twice."""
    hot = materialize(pairs.groupBy(end).agg(F.ceil(F.count("*") / SPREAD).alias("parts")).where("parts > 1"), "hot")
    hot, parts = _few(hot), F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, end, "left").withColumn("part", F.pmod(F.xxhash64(other), parts)).drop("parts")
    copies = sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("shingles").alias(f"s_{end}")).join(hot, end, "left")
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return dealt.join(copies, [end, "part"]).drop("part")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union, written. sets: node, n, shingles."""
    both = with_sets(pairs, sets, "v", "u").join(sets.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("shingles").alias("s_u")), "u")
    near = F.size(F.array_intersect("s_u", "s_v"))
    sizes = (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & (100 * near >= percent * (F.col("n_u") + F.col("n_v") - near))
    return materialize(both.where(sizes).select("u", "v").distinct(), "confirmed")


def _labelled(rows: DataFrame, label: DataFrame, of: str, name: str) -> DataFrame:
    """rows with `name`: the component of the node in column `of`, itself if it has no link."""
    return rows.join(label.select(F.col("node").alias(of), F.col("component").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))


def _around_roots(group: DataFrame) -> DataFrame:
    """node, pivot of groups (node, pivot, kin) put together: a pivot that is itself like an earlier one hands its group over.

    So copies of one text that miss each other's buckets are told apart by what they have beyond that text, and not by what
    one copy lacks. Nodes that shared a group still do.
    """
    pivots = _few(materialize(group.select(F.col("pivot").alias("node")).distinct(), "pivots"))
    above = group.where("kin").join(pivots, "node", "left_semi").groupBy(F.col("node").alias("u")).agg(F.min("pivot").alias("v"))
    roots = materialize(forest_roots(above), "roots")
    return _labelled(group.select("node", "pivot"), roots, "pivot", "root").where("node <> root").select("node", F.col("root").alias("pivot")).distinct()


def _size_class(n: Column) -> Column:
    return F.when(n <= FINE, n).otherwise(FINE + 1 + F.floor(F.log2(n / FINE) * 64)).cast("long")


def _keys(found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(probes, targets): pivot, kind, key, node, n, common, c. found: pivot, node, n, c, pc, extra (shingles that the pivot lacks).

    Two nodes of a pivot that are linked, the first outside its component, meet as probe and target under a key of kind 0
    (a shingle of both prefixes) or of kind 1 (a size). See the module's text.
    """
    needed = F.expr(f"({percent} * n + 99) div 100")  # shingles that a partner must share
    rows = found.select("pivot", "node", "n", "c", "pc", F.size("extra").cast("long").alias("e"), "extra").withColumn("common", F.col("n") - F.col("e"))
    columns = ["pivot", "kind", "key", "node", "n", "common", "c", "pc"]
    each = rows.select(*[c for c in rows.columns if c != "extra"], F.explode("extra").alias("key"))
    shared = each.groupBy("pivot", "key").agg(F.count("*").alias("f")).where("f > 1")
    own = W.partitionBy("pivot", "node")
    place = F.row_number().over(own.orderBy("f", "key")) + F.col("e") - F.count("*").over(own)  # those of no other node come first
    prefix = each.join(shared, ["pivot", "key"]).withColumn("place", place).where(F.col("place") <= F.col("n") - needed + 1)
    prefix = prefix.withColumn("kind", F.lit(0)).select(*columns)
    fits = rows.where(100 * F.col("common") >= percent * F.col("n"))
    sized = fits.withColumns({"kind": F.lit(1), "key": _size_class(F.col("n"))}).select(*columns)
    most = F.expr(f"({100 + percent} * common - {percent} * n) div {percent}")
    reach = fits.where((F.col("c") != F.col("pc")) & (most >= needed))
    reach = reach.withColumns({"kind": F.lit(1), "key": F.explode(F.sequence(_size_class(needed), _size_class(most)))}).select(*columns)
    return materialize(prefix.where("c <> pc").unionByName(reach).drop("pc"), "probes"), materialize(prefix.unionByName(sized).drop("pc"), "targets")


def _inner_links(group: DataFrame, classes: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """label after the links between nodes that share a pivot and are not all in its component. group: node, pivot."""
    member = materialize(_labelled(_labelled(group, label, "node", "c"), label, "pivot", "pc"), "members")
    several = materialize(member.groupBy("pivot").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("pivot"), "several")
    member = materialize(member.join(_few(several), "pivot", "left_semi"), "open")
    if member.isEmpty():
        return label
    own = sets.select("node", "n", "shingles")
    found = with_sets(member, sets, "pivot", "node").join(own, "node").select("pivot", "node", "n", "c", "pc", F.array_except("shingles", "s_pivot").alias("extra"))
    probes, targets = _keys(materialize(found, "extras"), percent)
    sketch = classes.select("node", "signature")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.distinct(), "candidates")
        for end in ("u", "v"):
            pairs = pairs.join(sketch.select(F.col("node").alias(end), F.col("signature").alias(f"sig_{end}")), end)
        allowed = most_mismatches(percent / 100)
        return confirm(materialize(pairs.where(mismatches(F.col("sig_u"), F.col("sig_v")) <= allowed).select("u", "v").distinct(), "gated"), sets, percent)

    at = ["pivot", "kind", "key"]
    least = targets.groupBy(*at).agg(F.min(F.struct("node", "n", "c")).alias("q"), F.count("*").alias("size")).where("size > 1")
    fit = (F.col("c") != F.col("q.c")) & (F.col("node") != F.col("q.node")) & (100 * F.least("n", "q.n") >= percent * F.greatest("n", "q.n"))
    star = confirmed(targets.join(least, at).where(fit).select(F.col("node").alias("u"), F.col("q.node").alias("v")))
    if not star.isEmpty():
        label = merge(label, star)
    x = _labelled(probes.drop("c"), label, "node", "c").select(*at, *[F.col(k).alias(f"x_{k}") for k in ("node", "n", "common", "c")])
    y = _labelled(targets.drop("c"), label, "node", "c")
    within = F.least("common", "x_common")
    fit = (F.col("c") != F.col("x_c")) & (F.col("node") != F.col("x_node")) & (100 * F.least("n", "x_n") >= percent * F.greatest("n", "x_n")) & ((F.col("kind") == 0) | ((100 + percent) * within >= percent * (F.col("n") + F.col("x_n"))))
    inner = confirmed(x.join(y, at).where(fit).select(F.greatest("node", "x_node").alias("u"), F.least("node", "x_node").alias("v")))
    return label if inner.isEmpty() else merge(label, inner)


def _once(texts: DataFrame, every: DataFrame) -> DataFrame:
    """texts(node, text) with one row for rows of an id that have equal texts: sets are joined by id, and m equal ones would make m * m rows.

    Only ids with several rows are put together, by two hashes of the text, before the shuffle and after it.
    """
    several = materialize(every.where("doc_id is not null").groupBy(F.col("doc_id").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node"), "several")
    if several.isEmpty():
        return texts
    several = _few(several)
    again = texts.join(several, "node", "left_semi").groupBy("node", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).agg(F.first("text").alias("text"))
    return texts.join(several, "node", "left_anti").unionByName(again.select("node", "text"))


def near_duplicates(df: DataFrame, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A null or empty text, or one without words, has no shingle and is linked with nothing; rows of equal sets are linked; a
    null id is never linked and has a null component. Rows that share an id are one document: a link of one of them is a link
    of all. An empty table gives an empty one.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    every = materialize(sketches(docs, percent / 100), "sketches")
    classes = materialize(
        every.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")),
        "classes",
    )
    rest = classes.select("node", "n", "signature", F.posexplode("bands").alias("band", "key"))
    pivots = rest.groupBy("band", "key").agg(F.min(F.struct("node", "n", "signature")).alias("p"), F.count("*").alias("size")).where("size > 1").drop("size")
    near = (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")) & (mismatches(F.col("signature"), F.col("p.signature")) <= most_mismatches(percent / 100))
    kin = estimate(F.col("signature"), F.col("p.signature")) >= KIN
    mates = rest.join(pivots, ["band", "key"]).where(F.col("node") != F.col("p.node"))
    group = materialize(mates.select("node", F.col("p.node").alias("pivot"), near.alias("near"), kin.alias("kin")).distinct(), "groups")
    nodes = materialize(group.select("node").unionByName(group.select(F.col("pivot").alias("node"))).distinct(), "nodes")
    sets = materialize(full_sets(_once(docs.select(F.col("doc_id").alias("node"), "text"), every).join(_few(nodes), "node", "left_semi")), "sets")
    # first the smallest of a class's pivots, then those pivots that this has not put into its component
    pairs = group.where("near").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    first = materialize(pairs.groupBy("u").agg(F.min("v").alias("v")), "first")
    label = materialize(forest_roots(confirm(first, sets, percent)), "labels")
    apart = materialize(_labelled(_labelled(pairs, label, "u", "cu"), label, "v", "cv").where("cu <> cv").select("u", "v"), "apart")
    if not apart.isEmpty():
        label = merge(label, confirm(apart, sets, percent))
    label = _inner_links(_around_roots(group), classes, sets, label, percent)
    of_class = classes.select("digest", "node").join(label, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    rows = every.select("doc_id", "n_shingles", "digest")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    none = rows.where("digest is null").withColumn("component", F.lit(None).cast(dict(rows.dtypes)["doc_id"]))
    found = materialize(rows.where("digest is not null").join(of_class, "digest", "left").unionByName(none).select("doc_id", "n_shingles", own.alias("component")), "found")
    # rows that share an id
    torn = found.groupBy("doc_id").agg(F.min("component").alias("v"), F.max("component").alias("hi")).where("v <> hi").select("doc_id", "v")
    torn = materialize(found.join(torn, "doc_id").where("component <> v").select(F.col("component").alias("u"), "v").distinct(), "torn")
    if not torn.isEmpty():
        joined = components(torn).select(F.col("node").alias("component"), F.col("component").alias("above"))
        found = found.join(joined, "component", "left").withColumn("component", F.coalesce("above", "component"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, linked at 85 hundredths of their five-word shingles."""
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), 85)


#: Every pair with a shingle in common is compared, and what each document reaches is walked.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT v, c FROM reached JOIN ways ON u = reached.doc_id),
least AS (SELECT doc_id, min(c) AS c FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least USING (doc_id)
"""
