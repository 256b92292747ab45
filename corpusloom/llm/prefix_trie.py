"""Prefix trie of conversations, built as a Patricia tree.

A turn is a code of 16 bytes, a conversation the chain of its turns' codes, so the order of the chains is the order in which
a walk through the trie meets them. Conversations are sorted by ranges; in each range, prefixes that neighbours have in
common give the points of the tree: ends of conversations, branches, leaves. Each point is made once, with an edge to the
point above it that stands for all nodes between; counts are added up from point to point, and the nodes of an edge
get theirs from sums along it. What a range shares with the one before or after it are beginnings of its first or last
conversation: the nodes of these are counted in each range that has them, each of which knows whether it saw them first, and then
added up by their key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, materialize, release, spread, words
from corpusloom.sources.tables import few

#: Bytes of a turn's code (MD5 of role and text).
CODE = 16
#: Conversations, and bytes of their chains, of a range, about.
RANGE_CONVS, RANGE_BYTES = 20_000, 16 << 20
#: Fixed values of the sharing rule: conversations of a group begin with turns of its first one, less than so many.
GROUP, SHARED = 20, 4

_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary, range int, ends string"
_NOBODY = hashlib.sha256(b"").hexdigest()


def chains(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, codes array<string> (one for each turn, in hex), sizes array<int> (words of its text).

    Turns are ordered by turn, null first, rows of one turn by code; a null role or text is empty; repeated rows are turns of
    their own; rows without a conversation's id belong to none and are left out; other columns are ignored. A
    conversation is one row of some 40 bytes a turn.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    code = F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said))
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("t"), code.alias("code"), F.size(words(said[1])).alias("size"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "code", "size"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: t["code"]).alias("codes"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def share_beginnings(made: DataFrame) -> DataFrame:
    """Every conversation c of `chains` (a written table) begins with the first h turns of conversation c - c % GROUP, h = crc32(c) % SHARED,
    as far as that one has them; its own turns after its first h follow. % is that of SQL, with the sign of c."""
    first = made.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first"), F.slice("codes", 1, SHARED - 1).alias("head"), F.slice("sizes", 1, SHARED - 1).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    both = made.withColumns({"first": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h}).join(first, "first", "left")

    def joined(head: str, own: str) -> Column:
        taken = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.slice(own, F.lit(1), F.lit(0)))
        return F.concat(taken, F.slice(own, F.col("h") + 1, F.size(own)))

    return both.select("conv_id", joined("head", "codes").alias("codes"), joined("head_sizes", "sizes").alias("sizes"))


def _common(a: bytes, b: bytes) -> int:
    """Codes that two chains have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // CODE
    at = 0
    while at < n and n - at <= 64 * CODE:  # short chains, code by code
        if a[at : at + CODE] != b[at : at + CODE]:
            return at // CODE
        at += CODE
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // CODE


def _keys(chain: bytes, upto: int) -> list[bytes]:
    """Keys of the nodes on a chain, from the root to a depth: digests of the beginnings, each from the one before."""
    running, out = hashlib.blake2b(digest_size=CODE), []
    for d in range(upto + 1):
        out.append(running.copy().digest())
        running.update(chain[d * CODE : (d + 1) * CODE])
    return out


class _Point:
    """A point of the tree: its depth, the row that made it, and what the conversations through it add up to."""

    __slots__ = ("depth", "row", "n", "smallest", "leaves", "children", "saved", "ends", "below")

    def __init__(self, depth: int, row: int):
        self.depth, self.row, self.n, self.smallest, self.leaves, self.children, self.saved = depth, row, 0, None, 0, 0, 0
        self.ends: list[int] = []
        self.below: list[int] = []  # output places of its children

    def take(self, n: int, smallest: int, leaves: int, child: int, saved: int, place: int) -> None:
        self.n += n
        self.smallest = smallest if self.smallest is None else min(self.smallest, smallest)
        self.leaves += leaves
        self.children += child
        self.saved += saved
        self.below.append(place)


class _Tree:
    """The nodes of a range of sorted conversations; before, after: the chains next to the range, None at the ends."""

    def __init__(self, ids: list[int], paths: list[bytes], sizes: list, before: bytes | None, after: bytes | None):
        self.sizes = sizes
        self.seen = -1 if before is None else _common(before, paths[0])  # nodes of the first chain that were seen before
        self.stays = -1 if after is None else _common(paths[-1], after)  # nodes of the last chain that go on
        self.first_keys, self.last_keys = _keys(paths[0], self.seen), _keys(paths[-1], self.stays)
        self.rows: list[tuple] = []
        self.parents: list[int] = []
        self.points = [_Point(0, 0)]
        for i, (conv, path) in enumerate(zip(ids, paths)):
            if i:
                self.close(_common(paths[i - 1], path))
            if len(path) // CODE > self.points[-1].depth:
                self.points.append(_Point(len(path) // CODE, i))
            end = self.points[-1]
            end.n += 1
            end.smallest = conv if end.smallest is None else min(end.smallest, conv)
            end.ends.append(conv)
        self.close(self.stays)
        while self.points:  # what is left goes on in the next range
            self.up(self.points.pop(), self.points[-1].depth if self.points else -1, True)

    def close(self, depth: int) -> None:
        """The next chain has `depth` turns in common with the last one: points below that are complete."""
        if self.points[-1].depth > depth:
            self.points[-1].leaves += 1  # nothing goes on from the last end
        while self.points and self.points[-1].depth > depth:
            point = self.points.pop()
            above = self.points[-1].depth if self.points else -1
            if above < depth:  # the chains part within the edge
                self.points.append(_Point(depth, point.row))
            self.up(point, max(above, depth), False)

    def up(self, point: _Point, above: int, stays: bool) -> None:
        """Writes the nodes of a point's edge, the point first, and adds it to the point above."""
        children, saved, below = point.children, point.saved, point.below
        sizes = self.sizes[point.row]
        for d in range(point.depth, above, -1):
            old = point.row == 0 and d <= self.seen
            if d:
                saved += (point.n - (not old)) * int(sizes[d - 1])
            key = self.first_keys[d] if old else self.last_keys[d] if stays else None
            ends = ",".join(map(str, point.ends)) if d == point.depth and point.ends else None
            digest = None if key is not None else hashlib.sha256(ends.encode()).hexdigest() if ends else _NOBODY
            place = len(self.rows)
            self.rows.append((point.smallest, d, point.n, children, point.leaves, saved, digest, key, ends if key is not None else None))
            self.parents.append(-1)
            for child in below:
                self.parents[child] = place
            children, below = int(not old), [place]
        if self.points:
            self.points[-1].take(point.n, point.smallest, point.leaves, children, saved, below[0])

    def table(self, number: int) -> pa.Table:
        smallest, depth, n, children, leaves, saved, digest, key, ends = zip(*self.rows)
        above = [None if p < 0 or key[p] is not None else smallest[p] for p in self.parents]
        above_key = [None if p < 0 else key[p] for p in self.parents]
        values = [smallest, depth, above, n, children, leaves, saved, digest, key, above_key, [number] * len(key), ends]
        types = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in _NODES.split(", ")]
        return pa.table([pa.array(v, t) for v, t in zip(values, types)], names)


_EMPTY = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in _NODES.split(", ")])


def _nodes_of_range(rows: pa.Table, bounds: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return _EMPTY.empty_table()
    rows = rows.combine_chunks().sort_by([("path", "ascending"), ("conv_id", "ascending")])
    end = bounds.to_pylist()[0]
    out = _Tree(rows["conv_id"].to_pylist(), rows["path"].to_pylist(), rows["sizes"].to_pylist(), end["before"], end["after"]).table(end["range"])
    release()
    return out


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists of ids, sorted by node and range: the digest of each node's whole list, one piece in memory at a time."""
    node, running = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([running.hexdigest()], pa.string())})

    for batch in batches:
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != node:
                if running is not None:
                    yield done()
                node, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
    if running is not None:
        yield done()


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of conversations(conv_id, codes, sizes): conv_id (its smallest member), depth, parent_conv_id (that of its parent;
    the root has none), n_convs, n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, members
    but one times the words of the node's turn), ends_sha256 (of the members that end in it).

    Ids are meant to be unique. Conversations without turns end in the root. Without conversations there is no node.
    Equal chains, however many, are dealt to several ranges; the ids that end in one node of several ranges are hashed in pieces.
    """
    flat = conversations.select("conv_id", F.unhex(F.array_join("codes", "")).alias("path"), "sizes")
    flat = materialize(flat, "chains")
    n, total = flat.agg(F.count("*"), F.sum(F.length("path"))).first()
    ranges = max(1, -(-n // RANGE_CONVS), -(-(total or 0) // RANGE_BYTES))
    placed = flat.withColumn("range", F.lit(0)) if ranges == 1 else flat.repartitionByRange(ranges, "path", "conv_id").withColumn("range", F.spark_partition_id())
    placed = materialize(placed, "ranges") if ranges > 1 else placed
    ends = placed.groupBy("range").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = W.orderBy("range")  # one row for each range
    bounds = ends.select("range", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    nodes = materialize(placed.groupBy("range").cogroup(bounds.groupBy("range")).applyInArrow(_nodes_of_range, _NODES), "nodes")
    columns = ("conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256")
    if ranges == 1:
        return nodes.select(*columns)
    met = nodes.where("node is not null")
    added = met.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), *[F.sum(c).alias(c) for c in _COUNTS])
    pieces = met.where("ends is not null").select("node", "range", "ends").repartition("node").sortWithinPartitions("node", "range").select("node", "ends")
    digests = arrow_map(pieces, _digest_ends, "node binary, ends_sha256 string")
    joint = materialize(added.join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOBODY))), "joint")
    # nodes that ranges share: as many as ranges have turns in common with the next, joined by broadcast up to a number
    above = few(joint.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    own = nodes.where("node is null").select(*columns, "parent").unionByName(joint.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns, "parent"))
    return own.join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, after those of a group share beginnings."""
    rows = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return trie(share_beginnings(materialize(chains(rows), "conversations")))


OP13_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
    len(list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'code': code, 'size': size} ORDER BY turn NULLS FIRST, code) AS turns FROM rows GROUP BY conv_id),
crc AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM own),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
members AS (
  SELECT conv_id, d, list_transform(turns[1:d], lambda t: t.code) AS path, len(turns) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE turns[d].size END AS size
  FROM built, range(0, len(turns) + 1) t(d)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, d),
children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
below AS (
  SELECT path[1:d] AS path, sum((n - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM counted, range(0, depth + 1) t(d) GROUP BY ALL)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
  below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below USING (path) LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]
"""
