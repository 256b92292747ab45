"""Concatenate and cut: documents' token ids in one stream, cut into windows of fixed length.

First pass: each task tokenises its documents, keeps the running number of tokens before each, and writes ids and counts
to the shared folder. The tasks' totals, one number each, give the tasks' global offsets by a prefix sum. Second pass: each
document knows its global place and is cut at the windows' ends; every piece is a boundary record. Nothing is shuffled.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, forget, in_worker, materialize, release, slices, spread

#: Words no longer than this are remembered from task to task in each worker, in two generations of so many (some 200 bytes
#: a word, so about 40 MB at most): when the young one is full it becomes the old one, and words still in use move back.
REMEMBERED_BYTES, GENERATION = 64, 100_000
#: Totals of up to so many tasks are joined by broadcast (16 bytes each); more by a shuffle join.
BROADCAST_TASKS = 100_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes: 0 white space, 1 lower-case ASCII letters and digits, 2 ASCII signs, 3 the rest.
_KIND = np.full(256, 3, np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2


def split_words(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """(the words of all texts in turn, words up to the end of each text). Words are parted by ASCII white space and in lower case,
    and a run of ASCII signs that ends a word and stands behind an ASCII letter or digit is a word of its own: the tokenizer's
    split parts it anyway. A text with a special token's name keeps its case and its signs."""
    special = np.array([b"<|" in t for t in texts], bool)
    raw = np.frombuffer(b"\n".join(t if s else t.lower() for t, s in zip(texts, special.tolist(), strict=True)) + b"\n", np.uint8)
    closes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # the line feed behind each text
    kind = _KIND[raw]
    solid, sign = kind != 0, kind == 2
    turns = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    turns = np.concatenate([np.zeros(int(solid[0]), np.int64), turns])
    starts, ends = turns[::2], turns[1::2]
    signs = np.flatnonzero(sign[1:] & ~sign[:-1]) + 1  # where runs of signs begin, but for the first byte
    last = np.flatnonzero(sign[ends - 1])
    cut = np.append(signs, 0)[np.searchsorted(signs, ends[last] - 1, side="right") - 1]
    cut = cut[(cut > starts[last]) & (kind[cut - 1] == 1) & ~special[np.searchsorted(closes, cut)]]
    ends = np.sort(np.concatenate([ends, cut]))
    # white space taken out, the words lie one behind the other
    offsets = np.concatenate([[0], np.cumsum(solid)[ends - 1]]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid])])
    return words, np.searchsorted(ends, closes, side="right")


class WordEncoder:
    """ids of a text as bytes (little-endian, 2 or 4 each), by way of its words, which are remembered.

    Right for tokenizers that lower-case, split letters from signs, and never join what ASCII white space separates: their
    ids are the words' ids in turn.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def one_by_one(self, words: list[bytes], strings: list[str], into: dict[bytes, bytes]) -> None:
        found = self.tokenizer.encode_batch(strings, add_special_tokens=False)
        into.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(words, found, strict=True))

    def learn(self, new: list[bytes], into: dict[bytes, bytes]) -> None:
        """Words of letters alone are one piece each, so many are encoded as one text and told apart by the pieces' ends."""
        letters, rest, strings = [], [], []
        for w in new:
            if w.isalpha():  # ASCII alone
                letters.append(w)
                continue
            s = w.decode("utf-8", "replace")
            if s.isalpha() and s.lower().isalpha() and unicodedata.is_normalized("NFC", s):
                letters.append(w)
            else:
                rest.append(w)
                strings.append(s)
        for at in range(0, len(rest), 20_000):
            self.one_by_one(rest[at : at + 20_000], strings[at : at + 20_000], into)
        width = int(self.kind[-1])
        for at in range(0, len(letters), 50_000):
            words = letters[at : at + 50_000]
            joined = [b" ".join(words[k : k + 200]).decode() for k in range(0, len(words), 200)]
            ids = np.concatenate([np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(cuts) == len(words):
                whole = ids.tobytes()
                into.update(zip(words, (whole[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:
                self.one_by_one(words, [w.decode() for w in words], into)

    def ids_of(self, every: list[bytes]) -> list[bytes]:
        """The ids of different words; short ones are remembered."""
        if len(self.known) > GENERATION:
            self.old, self.known = self.known, {}
        known, old, new = self.known, self.old, []
        for w in every:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    new.append(w)
        once: dict[bytes, bytes] = {}
        self.learn([w for w in new if len(w) <= REMEMBERED_BYTES], known)
        self.learn([w for w in new if len(w) > REMEMBERED_BYTES], once)
        return [known[w] if w in known else once[w] for w in every] if once else [known[w] for w in every]

    def encode(self, texts: list[bytes], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, ids up to the end of each text), with `end` behind each text.

        Each different word of the texts is looked up once; ids are copied by word number.
        """
        width = int(self.kind[-1])
        words, upto = split_words(texts)
        coded = words.dictionary_encode()
        found = [*self.ids_of(coded.dictionary.to_pylist()), end]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // width
        number = np.insert(coded.indices.to_numpy(zero_copy_only=False), upto, len(found) - 1)
        upto = upto + np.arange(1, len(texts) + 1)
        starts, whole = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(found), self.kind)
        n = lengths[number]
        sums = np.cumsum(n)
        out = whole[np.repeat((starts[number] - (sums - n)).astype(np.int32), n) + np.arange(sums[-1] if len(sums) else 0, dtype=np.int32)]
        return out, np.concatenate([[0], sums])[upto]


def encode_documents(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, task, before (tokens before it in its task), n_tokens, ids (binary), written to the shared folder."""
    schema = df.select(F.col(id_col).alias("doc_id")).schema.add("task", "integer").add("before", "long").add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, before, encoder = TaskContext.get().partitionId(), 0, in_worker(f"words {path}", lambda: WordEncoder(path))
        end, width = np.array([end_id], encoder.kind).tobytes(), int(encoder.kind[-1])
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            ids, upto = encoder.encode(texts, end)
            upto = np.concatenate([[0], upto])
            packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((upto * width).astype(np.int32)), pa.py_buffer(ids)])
            columns = [batch.column(0), pa.array(np.full(len(texts), task, np.int32)), pa.array(before + upto[:-1]), pa.array(np.diff(upto)), packed]
            before += int(upto[-1])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "task", "before", "n_tokens", "ids"])

    return materialize(arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, schema), "tokens")


def pack(df: DataFrame, path: str | None = None, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (array<int>), doc_tokens, sequence_id, offset.

    Sequence s holds the stream's tokens from s * length on; only the last can be short. A null or empty text has its end
    token alone. Rows with equal or null ids are packed as separate documents. An empty table gives no piece.
    """
    path = path or tokenizer_path()
    tokens = encode_documents(df, path, end_id, id_col, text)
    totals = tokens.groupBy("task").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total")).orderBy("task").collect()
    bases = list(accumulate((r["total"] for r in totals), initial=0))
    base = df.sparkSession.createDataFrame([(r["task"], b) for r, b in zip(totals, bases, strict=False)], "task int, base long")
    placed = tokens.join(F.broadcast(base) if len(totals) <= BROADCAST_TASKS else base, "task")
    schema = tokens.select("doc_id").schema.add("start", "long").add("length", "long").add("ids", "binary").add("ids_crc32", "long").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    kind = WordEncoder(path).kind

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(f"words {path}")  # the first pass is over
        release()
        for batch in slices(batches, "ids", 1 << 20):
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            rows, out = [], []
            for k, (at, n, ids) in enumerate(zip(column["at"].to_pylist(), column["n_tokens"].to_pylist(), column["ids"].to_pylist(), strict=True)):
                whole, start = np.frombuffer(ids, kind).astype("<u4"), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    piece = whole[start : start + size].tobytes()
                    rows.append(k)
                    out.append((start, size, piece, zlib.crc32(piece), n, sequence, offset))
                    start += size
            names = ["start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([column["doc_id"].take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", *names])

    return arrow_map(placed.select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n_tokens", "ids"), cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary, little-endian unsigned 32 bits), boundaries array<struct<offset, doc_id, start>>.

    A sequence has at most its fixed length of tokens, so a group is bounded.
    """
    whole = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    return pieces.groupBy("sequence_id").agg(whole.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"))).alias("boundaries"),
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens: the pieces and their ids' checksums."""
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).drop("ids")
