"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed greedily into the longest phrases that occur in
a language's text; phrases times log2 of that text's length, over the characters parsed, estimates the cross entropy. The
language that needs fewest normalised phrases wins. The automata's transitions stand in sparse tables over every letter of
the samples, and all texts of a batch walk through them at once, a character at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, share, slices, spread

#: The bounded labelled sample of each language: characters, documents, characters from one document (at a hashed place).
SAMPLE_CHARS, SAMPLE_DOCS, DOC_CHARS = 40_000, 200, 1_000
#: Languages that texts are parsed against at once; a parse begins anew every SEGMENT characters, so that a long text is
#: as many short parses.
AT_ONCE, SEGMENT = 64, 2_048


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """For each state, the state after one more character. State 0 is the root."""
    jump: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(jump)
        jump.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in jump[p]:
            jump[p][c] = new
            p = link[p]
        if p >= 0:
            q = jump[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(jump)
                jump.append(dict(jump[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and jump[p].get(c) == q:
                    jump[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return jump


def packed(jump: list[dict[int, int]], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base of each state, owner and target of each place): the transition of a state by c stands at base + c, if it owns that.

    Rows are laid over each other in the gaps, longest first; a search begins where the last row of its length came to stand.
    """
    base, taken, begin = np.zeros(len(jump), np.int32), bytearray(2 * classes + 4 * len(jump)), {}
    owner, target = [], []
    for state in sorted(range(len(jump)), key=lambda i: -len(jump[i])):
        letters = sorted(jump[state])
        if not letters:
            break
        first = letters[0]
        at = begin.get(len(letters), classes)
        while True:
            at = taken.find(0, at)
            if at < 0 or at + classes >= len(taken):
                at = len(taken) if at < 0 else at
                taken.extend(bytes(len(taken)))
            if not any(taken[at - first + c] for c in letters):
                break
            at += 1
        begin[len(letters)] = at
        base[state] = at - first
        for c in letters:
            taken[at - first + c] = 1
            owner.append((at - first + c, state))
            target.append(jump[state][c])
    places = np.array(owner, np.int64).reshape(-1, 2)
    size = max(int(base.max()), int(places[:, 0].max(initial=0))) + classes + 1
    owners, targets = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    owners[places[:, 0]], targets[places[:, 0]] = places[:, 1], target
    return base, owners, targets


_LETTER: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code points of all texts, n + 1 offsets)."""
    lowered = [t.lower() for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=offsets[1:])
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


class CrossParser:
    """Phrase counts of texts against each language's automaton."""

    def __init__(self, samples: dict[str, str]):
        """samples: labelled text by language; each is normalised like any text: runs of other than letters are one gap."""
        self.languages = sorted(samples)
        codes, _ = code_points(["".join(samples[k] for k in self.languages)])
        self.alphabet = np.unique(codes[is_letter()[codes]])
        self.classes = len(self.alphabet) + 2  # 0 stands between words, the last for letters no sample holds
        self.class_of: np.ndarray | None = None
        self.sizes, self.starts, bases, owners, targets, states, places = [], [], [], [], [], 0, 0
        for k in self.languages:
            letters, _, _ = self.normalise([samples[k]])
            base, owner, target = packed(suffix_automaton(letters), self.classes)
            self.sizes.append(max(2, len(letters)))
            self.starts.append(states)
            bases.append(base + places)
            owners.append(np.where(owner >= 0, owner + states, -1))
            targets.append(np.where(target >= 0, target + states, -1))
            states, places = states + len(base), places + len(owner)
        self.base, self.owner, self.target = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (bases, owners, targets))

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states after one more character, or -1."""
        at = self.base[states] + classes
        return np.where(self.owner[at] == states, self.target[at], -1).astype(np.int64)

    def normalise(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(classes of all kept characters, n + 1 offsets, letters of each text)."""
        if self.class_of is None:
            self.class_of = np.where(is_letter(), self.classes - 1, 0).astype(np.int32)
            self.class_of[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        points, offsets = code_points(texts)
        classes = self.class_of[points]
        gap = classes == 0
        keep = ~gap
        keep[1:] |= keep[:-1]  # the first of a run of gaps stays
        first = offsets[:-1][offsets[:-1] < len(points)]
        keep[first] &= ~gap[first]
        kept = np.concatenate([[0], np.cumsum(keep)])
        letters = np.concatenate([[0], np.cumsum(~gap)])
        return classes[keep], kept[offsets], np.diff(letters[offsets])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases of each text by language, characters parsed, letters)."""
        classes, offsets, letters = self.normalise(texts)
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        text_of = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[text_of] + within * SEGMENT
        length = np.minimum(SEGMENT, sizes[text_of] - within * SEGMENT)
        order = np.argsort(-length, kind="stable")
        begin, length, text_of = begin[order], length[order], text_of[order]
        n = len(order)
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        for at in range(0, len(self.languages), AT_ONCE):
            roots = np.array(self.starts[at : at + AT_ONCE], np.int64)[:, None]
            state, count = np.repeat(roots, n, axis=1), np.ones((len(roots), n), np.int64)
            live = n
            for t in range(int(length[0]) if n else 0):
                live = int(np.searchsorted(-length, -t, side="left"))
                c = classes[begin[:live] + t]
                old = state[:, :live]
                new = self.step(old, c)
                missed, fresh = new < 0, old == roots
                if t:
                    count[:, :live] += fresh  # behind a letter that the language lacks, which is a phrase of its own
                if missed.any():
                    count[:, :live] += missed & ~fresh
                    again = self.step(np.broadcast_to(roots, old.shape), c)
                    lost = missed & (again < 0)
                    new = np.where(missed, np.where(lost, roots, again), new)
                state[:, :live] = new
            for i, row in enumerate(count):
                out[at + i] = np.bincount(text_of, row, len(texts)).astype(np.int64)
        return out.T, sizes, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language or `und`, score): the score is 1 for a certain choice and 1 / languages for an open one."""
        if not self.languages or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        counts, _, letters = self.phrases(texts)
        cost = counts * np.log2(self.sizes)[None, :]
        best = cost.argmin(axis=1)
        least = np.maximum(cost[np.arange(len(best)), best], 1e-9)
        weights = np.exp2(np.maximum(least[:, None] - cost, -60.0))
        score = np.where(letters > 0, 1 / weights.sum(axis=1), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)], score


def train(df: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id") -> CrossParser:
    """Automata from labelled rows: of each language the documents with the smallest hashes, so the sample is the same every time.

    Rows with a null label or text teach nothing. The label counts choose the hash threshold, so what reaches the driver is
    bounded by SAMPLE_DOCS and DOC_CHARS for each label; every label is learnt.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 30))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return CrossParser({})
    limits = [(k, min(1 << 30, -(-(2 * SAMPLE_DOCS << 30) // n))) for k, n in sorted(counts.items())]
    limit = F.broadcast(df.sparkSession.createDataFrame(limits, "lang string, most long"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("place")), F.greatest(F.length("text") - DOC_CHARS + 1, F.lit(1)).cast("long"))
    found = rows.join(limit, "lang").where(rank < F.col("most")).select("lang", rank.alias("r"), F.substr(F.col("text"), (place + 1).cast("int"), F.lit(DOC_CHARS)).alias("text"))
    samples: dict[str, list] = {}
    for r in found.collect():
        samples.setdefault(r["lang"], []).append((r["r"], r["text"]))
    return CrossParser({k: " ".join(t for _, t in sorted(v)[:SAMPLE_DOCS])[:SAMPLE_CHARS] for k, v in samples.items()})


def identify(df: DataFrame, parser: CrossParser, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with the columns of `out`: the language and its score. A null text, an empty one or one without letters is `und` with score 0.

    Rows are judged one by one, so repeated rows get equal results; columns of these two names are replaced.
    """
    df = df.drop(*out)
    names = df.columns
    shared = share(df.sparkSession, parser)  # bounded by the sample's parameters
    schema = df.select("*").schema.add(out[0], "string").add(out[1], "double")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in slices(batches, text, 2 << 20):
            found, score = model.predict([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*names, *out])

    return arrow_map(df, run, schema)


def fold(id_col: str, of: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the labelled documents outside fold 0 of 5."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    parser = train(docs.where(~held_out))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), parser)
    return found.select("doc_id", "held_out", "lang_pred", "score")
