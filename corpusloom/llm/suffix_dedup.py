"""Removal of long repeated passages, exact to the byte, by interval expansion on Burrows-Wheeler transforms.

Every string of the length holds an anchor: of its substrings of half the length the one with the smallest hash, leftmost of
equals. Equal strings have equal anchors, so they meet under the anchor's key, wherever they stand. An anchor's context is
the run of strings that it anchors in its text; contexts of equal bytes are one, with their number as weight. Keys with one
occurrence are done, and so are keys with one context. The others' contexts are put into bins of bounded size, and in each
bin the transform's intervals that reach the length give the repeated strings. Keys with more contexts than a bin should
hold are dealt anew: by the bytes that a few neighbouring strings have in common, then by the strings themselves.

Strings are judged on the input, per row; what they cover goes from every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.bwt import repeated
from corpusloom.llm.common import HASH_CODES, INVERSE_BASE, arrow_map, materialize, mix, power_table, release, slices, spread, text_bytes

#: Bytes of payload in a bin, contexts of a key that are still put into one bin, strings of a finer context.
BIN_BYTES, BIN_CONTEXTS, FINE = 1 << 19, 1_000, 25
#: Tables of up to so many rows are joined by broadcast (keys of 8 bytes, merged spans of some 30 bytes), larger by a shuffle.
BROADCAST_KEYS, BROADCAST_SPANS = 2_000_000, 1_000_000
#: A passage has more than so many words; strings of so many bytes bring passages together (51 words of four letters).
WORDS, PASSAGE = 50, 250
_RUN = T.StructType().add("key", T.LongType()).add("context", T.LongType()).add("tid", T.LongType()).add("place", T.LongType()).add("weight", T.LongType()).add("open", T.BooleanType())


class Hashes:
    """Hashes of any substring of a batch's bytes."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(HASH_CODES[raw] * power_table(n), out=self.sums[1:])
        self.scale = power_table(n + 1, INVERSE_BASE)

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.scale[start] + np.asarray(salt, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, length: int, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """(text, first string, last string, anchor): maximal runs of string starts that share an anchor."""
    n, k = len(raw), length // 2
    w = length - k + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    places = np.arange(n - k + 1)
    value = hashes.of(places, places + k) >> np.uint64(32) << np.uint64(32) | places.astype(np.uint64)
    padded = np.full(-(-len(value) // w) * w, np.uint64((1 << 64) - 1))
    padded[: len(value)] = value
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    anchor = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[:count]) > 0)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 4
    of_valid = anchor[valid]
    text = np.searchsorted(offsets, valid, side="right") - 1
    new = np.ones(len(valid), bool)
    new[1:] = (of_valid[1:] != of_valid[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return text[first], valid[first], valid[last], of_valid[first]


def _pack(start: np.ndarray, before: np.ndarray, run: np.ndarray) -> np.ndarray:
    """First string's start, bytes from it to the anchor, strings after the first."""
    return start << 32 | before << 16 | run


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF


def runs(docs: DataFrame, length: int) -> DataFrame:
    """key, context, tid, place, weight, open of every run of docs(tid, text, open); a text that a batch has more than once weighs more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            _, one, copies = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
            batch = batch.take(pa.array(one))
            raw, offsets = text_bytes(batch.column(1))
            hashes = Hashes(raw)
            text, first, last, anchor = anchor_runs(raw, offsets, length, hashes)
            tid = batch.column(0).to_numpy(zero_copy_only=False)[text] if len(text) else np.zeros(0, np.int64)
            key = hashes.of(anchor, anchor + length // 2).astype(np.int64)
            context = hashes.of(first, last + length, (anchor - first) << 16 | last - first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(context), pa.array(tid, pa.int64()), pa.array(_pack(first - offsets[text], anchor - first, last - first), pa.int64()), pa.array(copies[text], pa.int64()), batch.column(2).take(pa.array(text))], names=_RUN.names)

    return arrow_map(docs.select("tid", "text", "open"), run, _RUN)


def _finer(texts: DataFrame, length: int, width: int) -> DataFrame:
    """Runs of at most `width` strings, keyed by the bytes that the strings of their part of the alignment have in common.

    texts: tid, text, runs array<struct<key, context, place, weight, open>>.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            raw, offsets = text_bytes(batch.column(1))
            hashes = Hashes(raw)
            tids, lists = batch.column(0).to_pylist(), batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            place = flat.field("place").to_numpy(zero_copy_only=False)
            weight = flat.field("weight").to_numpy(zero_copy_only=False)
            opened = flat.field("open").to_numpy(zero_copy_only=False).astype(bool)
            parent = flat.field("key").to_numpy(zero_copy_only=False).astype(np.uint64)
            whose = np.repeat(np.arange(len(tids)), np.diff(bounds))
            start, before, more = _unpack(place)
            start = start + offsets[whose]
            # strings by their distance to the anchor, which falls by one from each to the next
            count = more + 1
            of = np.repeat(np.arange(len(start)), count)
            step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            part = (before[of] - step) // width
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(of)) - 1
            of, part, lo, hi = of[a], part[a], step[a], step[z]
            anchor = start[of] + before[of]
            # every string of this part holds the bytes from its nearest possible start to its farthest possible end
            key = hashes.of(anchor - part * width, anchor - part * width - (width - 1) + length, part) ^ mix(parent[of] + part.astype(np.uint64))
            context = hashes.of(start[of] + lo, start[of] + hi + length, (before[of] - lo) << 16 | hi - lo)
            tid = np.array(tids, np.int64)[whose[of]] if len(of) else np.zeros(0, np.int64)
            packed = _pack(start[of] + lo - offsets[whose[of]], before[of] - lo, hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(context.astype(np.int64)), pa.array(tid), pa.array(packed, pa.int64()), pa.array(weight[of], pa.int64()), pa.array(opened[of], pa.bool_())], names=_RUN.names)

    return arrow_map(texts.select("tid", "text", "runs"), run, _RUN)


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; df is a table in the shared folder."""
    return F.broadcast(df) if df.count() <= most else df


def _grouped(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the runs under keys that occur twice or more, in an open text too, each text's once; their contexts: key, context,
    weight, tid and place of one occurrence, contexts of the key)."""
    keys = materialize(found.groupBy("key").agg(F.sum("weight").alias("n"), F.max("open").alias("open")).where("n > 1 and open").select("key"), "keys")
    rows = found.join(_few(keys, BROADCAST_KEYS), "key", "left_semi").groupBy("key", "context", "tid", "place", "open").agg(F.sum("weight").alias("weight"))
    rows = materialize(rows, "repeated")
    contexts = materialize(rows.groupBy("key", "context").agg(F.sum("weight").alias("weight"), F.min(F.struct("tid", "place")).alias("one")).select("key", "context", "weight", "one.tid", "one.place"), "contexts")
    return rows, contexts.join(contexts.groupBy("key").agg(F.count("*").alias("contexts")), "key")


def _with_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """tid, text, runs: the texts that runs are wanted of, with these (bounded by a text's length).

    docs may hold a text more than once; then the same runs come from each.
    """
    wanted = materialize(wanted, "wanted")
    tids = materialize(wanted.select("tid").distinct(), "tids")
    lists = wanted.groupBy("tid").agg(F.collect_list(F.struct(*[c for c in ("key", "context", "place", "weight", "open") if c in wanted.columns])).alias("runs"))
    return docs.join(_few(tids, BROADCAST_KEYS), "tid", "left_semi").dropDuplicates(["tid"]).join(lists, "tid")


def _merged(spans: DataFrame) -> DataFrame:
    """tid, spans array<long>: of tid, span (start in the upper 32 bits, end in the lower) the union, as few spans as can be."""
    schema = T.StructType().add("tid", T.LongType()).add("spans", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bounds, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            out = []
            for a, z in zip(bounds, bounds[1:], strict=False):
                packed = np.sort(flat[a - bounds[0] : z - bounds[0]])
                start, reach = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
                new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                out.append(start[new] << 32 | reach[np.append(new[1:] - 1, len(packed) - 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], names=schema.names)

    return arrow_map(spans.groupBy("tid").agg(F.collect_set("span").alias("spans")), run, schema)


def _payloads(texts: DataFrame, length: int) -> DataFrame:
    schema = T.StructType().add("key", T.LongType()).add("context", T.LongType()).add("weight", T.LongType()).add("payload", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            raw, offsets = text_bytes(batch.column(1))
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            start, _, more = _unpack(flat.field("place").to_numpy(zero_copy_only=False))
            begin = offsets[np.repeat(np.arange(batch.num_rows), np.diff(bounds))] + start
            whole = raw.tobytes()
            cut = [whole[b:e] for b, e in zip(begin.tolist(), (begin + more + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("context"), flat.field("weight"), pa.array(cut, pa.binary())], names=schema.names)

    return arrow_map(texts.select("tid", "text", "runs"), run, schema)


def _expanded(payloads: DataFrame, length: int) -> DataFrame:
    """key, context, ranges (of strings found repeated, counted from the run's first), bin by bin. payloads: bin, key, context, payload, weight."""
    schema = T.StructType().add("key", T.LongType()).add("context", T.LongType()).add("ranges", T.ArrayType(T.LongType()))

    def run(table: pa.Table) -> pa.Table:
        keys, contexts = table.column("key").to_pylist(), table.column("context").to_pylist()
        found = repeated(table.column("payload").to_pylist(), table.column("weight").to_numpy().astype(float), length)
        rows = []
        for key, context, starts in zip(keys, contexts, found, strict=True):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1) + 1
                firsts, lasts = starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)]
                rows.append((key, context, (firsts << 32 | lasts).tolist()))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        release()
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], names=schema.names)

    return payloads.groupBy("bin").applyInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """tid, spans array<long>: starts (upper 32 bits) and ends of bytes covered by repeated strings, of open texts.

    docs: tid, text, open, a row for each row of the input; equal texts have one tid and are open or not together. Texts that
    are not open count as places where a string occurs.
    """
    rows, known = _grouped(materialize(runs(docs, length), "runs"))
    known = materialize(known, "known")
    whole = F.array(F.col("place").bitwiseAND(0xFFFF))  # from the run's first string to its last
    ranges = known.where("contexts = 1 or weight > 1").select("key", "context", whole.alias("ranges"))
    mixed = known.where(f"contexts > 1 and contexts <= {BIN_CONTEXTS}").select("key", "context", "weight", "tid", "place")
    each = mixed.agg(F.sum(F.col("place").bitwiseAND(0xFFFF) + length + 1)).first()[0] or 0
    if each:
        bins = max(1, -(-each // BIN_BYTES))
        cut = _payloads(_with_texts(mixed, docs), length)
        ranges = ranges.unionByName(_expanded(cut.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins))), length))
    start = F.shiftright(F.col("place"), 32)
    found = rows.where("open").select("key", "context", "tid", "place").join(ranges, ["key", "context"]).select("tid", F.explode("ranges").alias("r"), start.alias("s"))
    spans = found.select("tid", F.shiftleft(F.col("s") + F.shiftright("r", 32), 32).bitwiseOR(F.col("s") + F.col("r").bitwiseAND(0xFFFFFFFF) + length).alias("span"))
    hot = rows.join(known.where(f"contexts > {BIN_CONTEXTS}").select("key", "context"), ["key", "context"], "left_semi")
    for width in (FINE, 1):
        hot = materialize(hot, "hot")
        if hot.isEmpty():
            break
        rows, known = _grouped(materialize(_finer(_with_texts(hot, docs), length, width), "fine"))
        known = materialize(known, "known")
        here = rows.where("open").join(known.where("contexts = 1 or weight > 1").select("key", "context"), ["key", "context"], "left_semi")
        spans = spans.unionByName(here.select("tid", F.shiftleft(F.shiftright("place", 32), 32).bitwiseOR(F.shiftright("place", 32) + F.col("place").bitwiseAND(0xFFFF) + length).alias("span")))
        hot = rows.join(known.where("contexts > 1").select("key", "context"), ["key", "context"], "left_semi")
    return _merged(spans)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words of a text that stand wholly between two places."""
    inside = list(_WORD.finditer(text, start, end))
    if inside and inside[0].start() == start and start and _WORD.match(text[start - 1 : start]):
        inside = inside[1:]
    if inside and inside[-1].end() == end and end < len(text) and _WORD.match(text[end : end + 1]):
        inside = inside[:-1]
    return len(inside)


def _unpacked(packed: list[int] | None) -> list[tuple[int, int]]:
    return sorted((p >> 32, p & 0xFFFFFFFF) for p in packed or ())


def _judged(df: DataFrame, text: str, schema: T.StructType, lengths: list[int], columns: Callable) -> DataFrame:
    """Rows of `schema`: what `columns` makes of a batch of df, of its texts as bytes and of each text's spans by length.

    Spans of the first length are of all texts, of a further one of those texts that have none of a length before it. df's
    columns are told apart by place, so that no name of its own clashes with the operator's.
    """
    at, names = df.columns.index(text), [f"c{i}" for i in range(len(df.columns))]
    whole = F.coalesce(F.col(names[at]), F.lit(""))
    rows = df.toDF(*names).withColumn("tid", F.xxhash64(whole, F.length(whole)))
    docs, found = rows.select("tid", whole.alias("text")), [f"spans_{i}" for i in range(len(lengths))]
    done = None
    for name, length in zip(found, lengths, strict=True):
        some = docs.withColumn("open", F.lit(True)) if done is None else docs.join(_few(done.withColumn("done", F.lit(True)), BROADCAST_KEYS), "tid", "left").select("tid", "text", F.col("done").isNull().alias("open"))
        spans = materialize(repeated_spans(some, length), name).withColumnRenamed("spans", name)
        few = (spans.agg(F.sum(F.size(name) + 1)).first()[0] or 0) <= BROADCAST_SPANS
        rows = rows.join(F.broadcast(spans) if few else spans, "tid", "left")
        if name != found[-1]:
            done = materialize(spans.select("tid") if done is None else done.unionByName(spans.select("tid")), "done")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[at], 1 << 20):
            raw, offsets = text_bytes(batch.column(at))
            texts = [raw[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            spans = [[_unpacked(p) for p in batch.column(len(names) + i).to_pylist()] for i in range(len(found))]
            yield pa.RecordBatch.from_arrays(columns(batch.columns[: len(names)], texts, *spans), names=schema.names)

    return arrow_map(rows.select(*names, *found), run, schema)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, what is left) of a text without its spans."""
    left, removed, number, last = [], 0, 0, 0
    for s, e in spans:
        if s > last or not number:
            left.append(text[last:s])
            number += 1
            last = s
        if e > last:
            removed += e - last
            last = e
    left.append(text[last:])
    return removed, number, b"".join(left)


def remove_repeats(df: DataFrame, length: int = 400, text: str = "text", shortest: int | None = None, words: int = WORDS) -> DataFrame:
    """df with n_bytes, n_removed, n_spans and kept_bytes (binary), and its own columns; with `shortest` n_passages as well.

    A null text counts as empty; texts shorter than `length` lose nothing; equal texts of that length lose everything; rows
    may repeat, and an empty table stays empty. What is left need not be whole characters: see `clean`. Columns of these
    names are replaced; all others, whatever their names, are carried along.

    n_passages reports repeats that are too short to be removed: the removed runs, or where there are none, the runs of
    repeated strings of `shortest` bytes that hold more than `words` whole words.
    """
    given = ["n_bytes", "n_removed", "n_spans", "kept_bytes", *(["n_passages"] if shortest else [])]
    df = df.drop(*given)
    schema = df.select("*").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_bytes", "binary")
    schema = schema.add("n_passages", "long") if shortest else schema

    def columns(own: list[pa.Array], texts: list[bytes], spans: list, short: list | None = None) -> list[pa.Array]:
        found = [cut(t, s) for t, s in zip(texts, spans, strict=True)]
        out = [pa.array([len(t) for t in texts], pa.int64()), *[pa.array([f[i] for f in found], pa.int64()) for i in range(2)], pa.array([f[2] for f in found], pa.binary())]
        if short is not None:
            out.append(pa.array([f[1] or sum(whole_words(t, a, b) > words for a, b in s) for f, t, s in zip(found, texts, short, strict=True)], pa.int64()))
        return [*own, *out]

    return _judged(df, text, schema, [length, *([shortest] if shortest else [])], columns)


def clean(df: DataFrame, length: int = 400, text: str = "text", shortest: int | None = None, words: int = WORDS) -> DataFrame:
    """df with its texts rid of repeats; a character that a removed run cuts goes as a whole, a null text stays null.

    With `shortest`, runs of repeated strings of that many bytes go too if they hold more than `words` whole words.
    """
    at = df.columns.index(text)

    def columns(own: list[pa.Array], texts: list[bytes], spans: list) -> list[pa.Array]:
        long = [[(a, b) for a, b in s if b - a >= length or whole_words(t, a, b) > words] for t, s in zip(texts, spans, strict=True)]
        kept = [old if not s else cut(t, s)[2].decode("utf-8", "ignore") for old, t, s in zip(own[at].to_pylist(), texts, long, strict=True)]
        return [pa.array(kept, pa.string()) if i == at else c for i, c in enumerate(own)]

    return _judged(df, text, df.schema, [shortest or length], columns)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, rid of every byte in a 400-byte string that starts twice or more in them.

    n_passages also counts the passages of over 50 words that stand twice or more and are shorter than that.
    """
    found = remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), shortest=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), "n_passages")


#: Bytes as hexadecimal digits. Windows are told apart by MD5, runs are islands of windows that touch.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
long AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)) QUALIFY count(*) OVER (PARTITION BY k) > 1),
long_runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM long)) GROUP BY doc_id, run),
short AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 500)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 249)) AS i FROM d WHERE n >= 250)) QUALIFY count(*) OVER (PARTITION BY k) > 1),
short_runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 250 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 250 THEN 0 ELSE 1 END AS opens FROM short ANTI JOIN long_runs USING (doc_id))) GROUP BY doc_id, run),
bytes AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) IN ('20', '09', '0A', '0B', '0C', '0D') AS space FROM (SELECT doc_id, h, unnest(range(0, n)) AS i FROM d SEMI JOIN short_runs USING (doc_id))),
words AS (
  SELECT doc_id, min(i) AS s, max(i) + 1 AS e FROM (SELECT doc_id, i, space, sum(space::INT) OVER (PARTITION BY doc_id ORDER BY i) AS word FROM bytes) WHERE NOT space GROUP BY doc_id, word),
passages AS (
  SELECT doc_id, count(*) AS n_passages FROM (SELECT doc_id, a FROM short_runs JOIN words USING (doc_id) WHERE s >= a AND e <= b GROUP BY doc_id, a HAVING count(*) > 50) GROUP BY doc_id),
gaps AS (
  SELECT doc_id, a AS upto, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM long_runs
  UNION ALL SELECT doc_id, n, coalesce(last, 0) FROM d LEFT JOIN (SELECT doc_id, max(b) AS last FROM long_runs GROUP BY doc_id) USING (doc_id)),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM long_runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256, coalesce(n_spans, n_passages, 0) AS n_passages
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN passages USING (doc_id)
"""
