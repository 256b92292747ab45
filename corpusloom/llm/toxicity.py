"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the first four bytes of its words, hashed. The machine adds a weight per term and, for every
pair of terms, the product of their factors; it is fitted on a bounded sample of labelled rows, weighted to the rows they
stand for, and applied to all whole texts in batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import HASH_CODES, INVERSE_BASE, LOWER_BYTES, arrow_map, materialize, mix, power_table, share, slices, spread, text_bytes
from corpusloom.llm.language_id import fold

#: The bounded sample: rows with label 1 and label 0; and terms that are kept, by the size of their association.
MAX_POSITIVE, MAX_NEGATIVE, MAX_TERMS = 4_000, 8_000, 4_096
#: The sample's terms in bytes (4 each); frequent terms that are tried in pairs, and the z-value that a pair must reach.
MAX_BYTES, PAIRED, PAIR_Z = 64 << 20, 1_024, 6.0
FACTORS, EPOCHS, THRESHOLD = 6, 40, 0.3
PREFIX = 4
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) without repeats: words of ASCII letters, digits and all other than ASCII, and their beginnings."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    solid = _WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(HASH_CODES[LOWER_BYTES[raw]] * power_table(n), out=sums[1:])
    scale = power_table(n, INVERSE_BASE)[starts]
    of_word = mix((sums[ends] - sums[starts]) * scale)
    of_start = mix((sums[np.minimum(ends, starts + PREFIX)] - sums[starts]) * scale + np.uint64(1))
    text = np.searchsorted(offsets, starts, side="right") - 1
    both = np.concatenate([of_word, of_start]) >> np.uint64(32)
    pairs = np.unique((np.concatenate([text, text]).astype(np.uint64) << np.uint64(32)) | both)
    return (pairs >> np.uint64(32)).astype(np.int64), pairs.astype(np.uint32)


class Machine:
    """Weights and factors of the kept terms (sorted), and a bias."""

    def __init__(self, kept: np.ndarray, seed: int = 7):
        self.kept = kept
        self.weight, self.bias = np.zeros(len(kept)), 0.0
        self.factor = np.random.default_rng(seed).normal(0, 0.05, (len(kept), FACTORS))
        self.near = np.zeros(1 << 16, bool)
        self.near[kept & np.uint32(0xFFFF)] = True

    def keep(self, text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, place among the kept terms) of the terms that the machine knows."""
        maybe = self.near[term & np.uint32(0xFFFF)]
        text, term = text[maybe], term[maybe]
        place = np.minimum(np.searchsorted(self.kept, term), max(len(self.kept) - 1, 0))
        known = self.kept[place] == term if len(self.kept) else np.zeros(len(term), bool)
        return text[known], place[known]

    def margin(self, text: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.factor[place]
        total = np.stack([np.bincount(text, v[:, f], n) for f in range(FACTORS)], axis=1) if n else np.zeros((0, FACTORS))
        squares = np.bincount(text, (v * v).sum(axis=1), n) if n else np.zeros(0)
        return self.bias + np.bincount(text, self.weight[place], n) + 0.5 * ((total * total).sum(axis=1) - squares), total

    def score(self, text: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(text, place, n)[0], -30, 30)))


def pairs_that_tell(rows: list[np.ndarray], labels: np.ndarray, names: np.ndarray, total: np.ndarray, screened: np.ndarray) -> np.ndarray:
    """Places (in names) of terms that tell nothing alone but do in pairs: of the PAIRED most frequent terms that the screening
    left out, those in a pair whose rows have label 1 more or less often than all rows, by a z-value of PAIR_Z."""
    rest = np.setdiff1d(np.flatnonzero((total >= 3) & (total <= 0.9 * max(len(rows), 1))), screened)
    rest = np.sort(rest[np.argsort(-total[rest], kind="stable")[:PAIRED]])
    if len(rest) < 2 or not 0 < labels.sum() < len(labels):
        return rest[:0]
    there = np.zeros((len(rows), len(rest)), np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(names[rest], r)
        at = at[(at < len(rest)) & (names[rest][np.minimum(at, len(rest) - 1)] == r)]
        there[i, at] = 1
    ones, share = there[labels > 0], float((labels > 0).mean())
    hits, both = ones.T @ ones, there.T @ there
    z = np.abs(hits - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1))
    np.fill_diagonal(z, 0)
    return rest[(z >= PAIR_Z).any(axis=0)]


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Machine:
    """Terms are screened by the z-value of their log odds, alone and in pairs, then weights and factors are learnt by Adam on
    the logistic loss."""
    lengths = np.array([len(r) for r in rows], np.int64)
    every = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    label_of = np.repeat(labels, lengths)
    names, where = np.unique(every, return_inverse=True)
    total = np.bincount(where, minlength=len(names))
    hits = np.bincount(where, label_of, minlength=len(names))
    n1, n0 = labels.sum() + 1, (1 - labels).sum() + 1
    odds = np.log((hits + 0.5) / n1) - np.log((total - hits + 0.5) / n0)
    z = np.abs(odds) / np.sqrt(1 / (hits + 0.5) + 1 / (total - hits + 0.5))
    good = np.flatnonzero((total >= 3) & (z > 2.5))
    good = good[np.argsort(-z[good], kind="stable")[:MAX_TERMS]]
    kept = np.sort(names[np.concatenate([good, pairs_that_tell(rows, labels, names, total, good)])])
    machine = Machine(kept, seed)
    base = float((weights * labels).sum() + 0.5) / float(weights.sum() + 1)
    machine.bias = float(np.log(base / (1 - base)))
    if not len(kept):
        return machine
    place_of = [np.searchsorted(kept, r[np.isin(r, kept)]) for r in rows]
    step, rng = 0, np.random.default_rng(seed)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (machine.weight, machine.factor)]
    bias_m = [0.0, 0.0]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            place = np.concatenate([place_of[i] for i in part])
            text = np.repeat(np.arange(len(part)), [len(place_of[i]) for i in part])
            margin, sums = machine.margin(text, place, len(part))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) * weights[part] / weights.mean() / len(part)
            grad_w = np.bincount(place, error[text], len(kept)) + 1e-5 * machine.weight
            each = error[text, None] * (sums[text] - machine.factor[place])
            grad_v = np.stack([np.bincount(place, each[:, f], len(kept)) for f in range(FACTORS)], axis=1) + 1e-4 * machine.factor
            step += 1
            rate = 0.05 * (1 - epoch / EPOCHS)
            for x, g, (m, s) in zip((machine.weight, machine.factor), (grad_w, grad_v), moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) * (1 if x.ndim == 1 else 0.2)
            g = float(error.sum())
            bias_m = [bias_m[0] + 0.1 * (g - bias_m[0]), bias_m[1] + 0.001 * (g * g - bias_m[1])]
            machine.bias -= rate * (bias_m[0] / (1 - 0.9**step)) / (np.sqrt(bias_m[1] / (1 - 0.999**step)) + 1e-8)
    return machine


def hashed_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with terms (binary, unsigned 32 bits each)."""
    names = df.columns
    rest = [c for c in names if c != text]
    schema = df.select(*rest).schema.add("terms", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            number, term = terms(*text_bytes(batch.column(names.index(text))))
            cuts = np.searchsorted(number, np.arange(batch.num_rows + 1))
            found = [term[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in rest], pa.array(found, pa.binary())], names=[*rest, "terms"])

    return arrow_map(df, run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text") -> Machine:
    """A machine from at most MAX_POSITIVE and MAX_NEGATIVE labelled rows, those with the smallest hashes; of fewer where their
    terms take more than MAX_BYTES.

    A label that is null teaches nothing; of several labels of one document the largest counts. The sample's ids are joined
    by broadcast: they are bounded by these parameters.
    """
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col(label) != 0).cast("int")).alias("y"))
    n = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    most = {1: MAX_POSITIVE, 0: MAX_NEGATIVE}
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity sample")), F.lit(1 << 30))
    limit = F.when(F.col("y") == 1, F.lit(-(-(most[1] << 30) // max(n.get(1, 1), 1)))).otherwise(F.lit(-(-(most[0] << 30) // max(n.get(0, 1), 1))))
    sample = marked.where(rank < limit)
    rows = hashed_terms(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("y", "doc_id", "text"))
    rows = materialize(rows.withColumn("part", rank / limit), "sample")
    size = rows.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    rows = rows.where(F.col("part") < MAX_BYTES / size) if size > MAX_BYTES else rows
    found = sorted((r["doc_id"], r["y"], bytes(r["terms"])) for r in rows.collect())
    y = np.array([r[1] for r in found], float)
    share_of = {k: max(1.0, n.get(k, 0) / max(1, int((y == k).sum()))) for k in (0, 1)}
    return fit([np.frombuffer(r[2], np.uint32) for r in found], y, np.array([share_of[int(v)] for v in y]))


def classify(df: DataFrame, machine: Machine, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """df without its text, with score (0 to 1) and predicted. A null or empty text has the score of no terms; rows are
    scored one by one; columns named score and predicted are replaced."""
    df = df.drop("score", "predicted")
    names = df.columns
    rest = [c for c in names if c != text]
    schema = df.select(*rest).schema.add("score", "double").add("predicted", "integer")
    shared = share(df.sparkSession, machine)  # bounded by MAX_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in slices(batches, text, 2 << 20):
            score = model.score(*model.keep(*terms(*text_bytes(batch.column(names.index(text))))), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in rest], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*rest, "score", "predicted"])

    return arrow_map(df, run, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labelled rows outside remainder 2 of 4."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    machine = train(docs, labels.where(~held_out))
    return classify(docs.select("doc_id", held_out.alias("held_out"), "text"), machine)
