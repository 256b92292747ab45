"""Language-model scores by deleted interpolation of word bigrams.

A token's probability mixes the bigram and unigram maximum-likelihood estimates and a uniform one. The weights depend on how
often the context was seen (buckets by powers of two) and are learnt by expectation-maximisation on held-out counts: on the
training documents of one remainder, each token with its own occurrence deleted from the counts.

Counting: documents are dealt into blocks of some megabytes. A block sends its distinct n-grams, with their training counts,
as one sorted, delta-coded array per hash bucket; buckets add up the counts and send them back in the same order. So what
moves is a few bytes for each distinct n-gram of a block, a frequent word costs a block no more than a rare one, and no table
of all n-grams is held in one place.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import materialize, mix, share, spread, text_bytes, word_hashes
from corpusloom.llm.language_id import fold

#: Bytes of a block's texts, blocks at least, shares of training documents for the weights.
BLOCK_BYTES, LEAST_BLOCKS, EM_SHARE = 7 << 20, 12, 10
#: Rows with equal id and text beyond which they are one row with a weight, so that no block gets them all.
REPEATS = 100
#: Context buckets, steps of the estimates' natural logarithms in the weights' histogram, rounds of expectation-maximisation.
BUCKETS, STEP, ROUNDS = 24, 0.1, 60
END, START = np.uint64(0x1D872B41A3C5E6F7), np.uint64(0x7E57AB1E0DDBA115)
UNIGRAM, BIGRAM, TOTALS = 0, 1, 2


class Grams:
    """Tokens of a block's texts, each with its document, and the distinct unigrams and bigrams in order of their hashes."""

    def __init__(self, texts: pa.ChunkedArray):
        hashes, counts, _, _ = word_hashes(*text_bytes(texts))
        n = len(counts)
        self.sizes = counts + 1
        ends = np.cumsum(self.sizes)
        tokens = np.empty(int(ends[-1]) if n else 0, np.uint64)
        last = np.zeros(len(tokens), bool)
        last[ends - 1] = True
        tokens[last], tokens[~last] = END, hashes
        before = np.empty(len(tokens), np.uint64)
        before[1:] = tokens[:-1]
        before[ends - self.sizes] = START
        self.starts = np.zeros(len(tokens), bool)
        self.starts[ends - self.sizes] = True
        self.document = np.repeat(np.arange(n), self.sizes)
        self.distinct, self.of = {}, {}
        pairs = mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(tokens)) & ~np.uint64(0xFFFF)  # 48 bits tell bigrams apart
        for kind, values in ((UNIGRAM, tokens), (BIGRAM, pairs)):
            self.distinct[kind], self.of[kind] = np.unique(values, return_inverse=True)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as a first key and steps of 32 bits where they fit, else as they are."""
    if not len(keys):
        return b"\x00"
    low = 16 if not (keys & np.uint64(0xFFFF)).any() else 0
    steps = np.diff(keys >> np.uint64(low))
    if len(steps) and int(steps.max()) >= 1 << 32:
        return b"\x01" + keys.tobytes()
    return bytes([2 + low]) + keys[:1].tobytes() + steps.astype(np.uint32).tobytes()


def _unpack_keys(packed: bytes) -> np.ndarray:
    if packed[0] == 0:
        return np.zeros(0, np.uint64)
    if packed[0] == 1:
        return np.frombuffer(packed, np.uint64, offset=1)
    first, steps = np.frombuffer(packed, np.uint64, 1, 1), np.frombuffer(packed, np.uint32, offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([first, steps << np.uint64(packed[0] - 2)]), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, then the counts of 255 and more."""
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpack_counts(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    out = np.frombuffer(packed, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(packed, np.int64, offset=8 + n)
    return out


_REQUEST = T.StructType().add("bucket", T.LongType()).add("block", T.LongType()).add("kind", T.IntegerType()).add("keys", T.BinaryType()).add("counts", T.BinaryType())
_ANSWER = T.StructType().add("block", T.LongType()).add("bucket", T.LongType()).add("kind", T.IntegerType()).add("counts", T.BinaryType()).add("n", T.LongType()).add("distinct", T.LongType())


def ngram_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """Training counts of every block's n-grams, by block, bucket and kind; and each bucket's totals (block -1).

    blocks: block, text, trains, rows (that a row stands for). The bucket of an n-gram is the first `bits` bits of its hash.
    """

    def ask(table: pa.Table) -> pa.Table:
        grams, block = Grams(table.column("text")), table.column("block")[0].as_py()
        weight = np.where(table.column("trains").to_numpy(zero_copy_only=False), table.column("rows").to_numpy(), 0)[grams.document]
        rows = []
        for kind, keys in grams.distinct.items():
            counts = np.bincount(grams.of[kind], weight, len(keys)).astype(np.int64)
            cuts = np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows += [(b, block, kind, _pack_keys(keys[x:y]), _pack_counts(counts[x:y])) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())], names=_REQUEST.names)

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = []
        kinds = table.column("kind").to_numpy()
        for kind in (UNIGRAM, BIGRAM):
            part = table.filter(pa.array(kinds == kind))
            if not part.num_rows:
                continue
            keys = [_unpack_keys(x) for x in part.column("keys").to_pylist()]
            counts = np.concatenate([_unpack_counts(x) for x in part.column("counts").to_pylist()])
            cuts = np.cumsum([0, *map(len, keys)])
            distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, of, counts)
            back = total[of]
            rows += [(b, bucket, kind, _pack_counts(back[x:y]), None, None) for b, x, y in zip(part.column("block").to_pylist(), cuts, cuts[1:], strict=False)]
            if kind == UNIGRAM:
                rows.append((-1, bucket, TOTALS, None, int(total.sum()), int((total > 0).sum())))
        columns = list(zip(*rows, strict=True))
        kinds_of = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names=_ANSWER.names)

    asked = blocks.select("block", "text", "trains", "rows").groupBy("block").applyInArrow(ask, _REQUEST)
    return materialize(asked.groupBy("bucket").applyInArrow(answer, _ANSWER), "counts")


def context_bucket(seen: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 and the power of two of how often it was."""
    return np.where(seen > 0, np.minimum(1 + np.log2(np.maximum(seen, 1)).astype(np.int64), BUCKETS - 1), 0)


def _token_counts(docs: pa.Table, answers: pa.Table) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, their counts, their contexts' counts, their bigrams' counts); a document's first context counts -1."""
    grams = Grams(docs.column("text"))
    of = {}
    kinds, buckets, counts = (answers.column(c).to_pylist() for c in ("kind", "bucket", "counts"))
    for kind in (UNIGRAM, BIGRAM):
        mine = sorted((b, c) for k, b, c in zip(kinds, buckets, counts, strict=True) if k == kind)
        of[kind] = np.concatenate([_unpack_counts(c) for _, c in mine])[grams.of[kind]]
    context = np.empty(len(grams.starts), np.int64)
    context[1:] = of[UNIGRAM][:-1]
    context[grams.starts] = -1
    return grams, of[UNIGRAM], context, of[BIGRAM]


def learn_weights(cells: list[tuple[int, float]], uniform: float) -> np.ndarray:
    """BUCKETS by 3 weights (bigram, unigram, uniform) from a histogram of context buckets and estimates, by EM."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    if cells:
        code, n = np.array([c for c, _ in cells], np.int64), np.array([w for _, w in cells], float)
        bucket, two, one = code >> 24, code >> 12 & 0xFFF, code & 0xFFF
        p = np.stack([np.where(two > 0, np.exp(-(two - 1) * STEP), 0), np.where(one > 0, np.exp(-(one - 1) * STEP), 0), np.full(len(code), uniform)], axis=1)
        for _ in range(ROUNDS):
            part = weights[bucket] * p
            part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
            total = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], axis=1) + np.array([1e-3, 1e-3, 1e-3])
            weights = total / total.sum(axis=1, keepdims=True)
    weights[0, 1:] /= weights[0, 1:].sum()
    weights[0, 0] = 0.0  # a context never seen has no bigram estimate
    return weights


def weigh_repeats(docs: DataFrame) -> tuple[DataFrame, int]:
    """(docs with rows: how many rows a row stands for; bytes of all their texts). docs: doc_id, text, trains.

    Rows of an id and text that occur more than REPEATS times become one; all others stay as they are, without a shuffle of texts.
    """
    key = F.xxhash64("doc_id", "text", "trains")
    counted = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    most, volume = counted.agg(F.max("n"), F.sum(F.when(F.col("n") > REPEATS, F.col("bytes") / F.col("n")).otherwise(F.col("bytes")))).first()
    if (most or 0) <= REPEATS:
        return docs.withColumn("rows", F.lit(1).cast("long")), int(volume or 0)
    hot = materialize(counted.where(F.col("n") > REPEATS).select("key"), "repeats")
    keyed = docs.withColumn("key", key)
    one = keyed.join(hot, "key", "left_semi").groupBy("doc_id", "text", "trains").agg(F.count("*").alias("rows"))
    rest = keyed.join(hot, "key", "left_anti").select("doc_id", "text", "trains", F.lit(1).cast("long").alias("rows"))
    return rest.unionByName(materialize(one, "weighed")), int(volume)


def score(df: DataFrame, trains: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, trains, n_tokens, n_known, train_tokens, base_score, score of every row; base and score are log10.

    A null text counts as empty: it has its end token alone. Rows are counted one by one, so repeated rows add to the counts
    if they train; many repeats of one row are counted as one with a weight. Without a training row every token is unknown. An empty table gives an empty one.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    docs, volume = weigh_repeats(docs)
    blocks = max(LEAST_BLOCKS, -(-volume // BLOCK_BYTES))
    bits = max(3, math.ceil(math.log2(blocks)))
    dealt = F.xxhash64(F.col("doc_id"), F.col("text"))
    weighs = F.col("trains") & (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("weights")), F.lit(EM_SHARE)) == 0)
    # training documents that the weights are learnt on have blocks of their own, numbered from `blocks` on
    block = F.when(weighs, blocks + F.pmod(dealt, F.lit(-(-blocks // EM_SHARE)))).otherwise(F.pmod(dealt, F.lit(blocks)))
    docs = docs.withColumn("block", block)
    answers = ngram_counts(docs, bits)
    totals = answers.where(F.col("kind") == TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, known = int(totals[0]), int(totals[1])
    texts = docs.where("trains").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    uniform = 1 / (known + 1)
    back = answers.where(F.col("kind") != TOTALS).select("block", "bucket", "kind", "counts")

    def tally(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Cells of context bucket and estimates, each token's own occurrence deleted."""
        if not docs.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["cell", "n"])
        grams, one, context, two = _token_counts(docs, answers)
        context = np.where(context < 0, texts, context) - 1
        p2 = np.where(context > 0, (two - 1) / np.maximum(context, 1), 0.0)
        p1 = (one - 1) / max(tokens - 1, 1)
        quantum = [np.where(p > 0, np.minimum(1 + np.rint(-np.log(np.maximum(p, 1e-300)) / STEP), 4095), 0).astype(np.int64) for p in (p2, p1)]
        cell, of = np.unique(context_bucket(context) << 24 | quantum[0] << 12 | quantum[1], return_inverse=True)
        n = np.bincount(of, docs.column("rows").to_numpy()[grams.document], len(cell)).astype(np.int64)
        return pa.table([pa.array(cell), pa.array(n)], names=["cell", "n"])

    learners = docs.where(F.col("block") >= blocks).select("block", "text", "rows")
    cells = learners.groupBy("block").cogroup(back.where(F.col("block") >= blocks).groupBy("block")).applyInArrow(tally, "cell long, n long")
    weights = learn_weights([(r["cell"], r["n"]) for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()], uniform)
    shared = share(df.sparkSession, weights)
    schema = docs.select("doc_id", "trains", "rows").schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")

    def apply(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([docs.column("doc_id"), docs.column("trains"), docs.column("rows"), *[pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names=schema.names)
        mixture = pickle.loads(shared.value)
        grams, one, context, two = _token_counts(docs, answers)
        context = np.where(context < 0, texts, context)
        w = mixture[context_bucket(context)]
        p = w[:, 0] * (two / np.maximum(context, 1)) + w[:, 1] * (one / max(tokens, 1)) + w[:, 2] * uniform
        base = np.log10((one + 0.1) / (tokens + 0.1 * (known + 1)))
        n = docs.num_rows
        sums = [np.bincount(grams.document, x, n) for x in (one > 0, base, np.log10(p))]
        return pa.table(
            [docs.column("doc_id"), docs.column("trains"), docs.column("rows"), pa.array(grams.sizes, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(np.full(n, tokens), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
            names=schema.names,
        )

    found = docs.select("block", "doc_id", "trains", "rows", "text").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(apply, schema)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return found.withColumn("again", again).drop("again", "rows")


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents' scores, learnt from those outside remainder 0 of 10."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = score(docs, fold("doc_id", 10) != 0)
    return found.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
