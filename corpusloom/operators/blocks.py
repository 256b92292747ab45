"""Tokens and fixed-size blocks of training splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.prefix import prefix_sums
from corpusloom.sources.tables import few, materialize

#: Ids of the start and end tokens, and the number of ids that the built-in tokenizer hashes words to, from 3 on.
BOS, EOS, HASHED = 1, 2, 30_000


def hash_tokens(text: Column) -> Column:
    """array<int>: an id for each word by white space, from the first seven hex digits of its MD5. The built-in tokenizer."""
    return F.transform(X.word_list(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % HASHED + 3))


def encode(df: DataFrame, tokenizer: Callable[[Column], Column] = hash_tokens, bos: int = BOS, eos: int = EOS, text: str = "text") -> DataFrame:
    """df with ids: the start token, the text's ids, the end token. A tokenizer is any column function, a pandas UDF too."""
    return df.withColumn("ids", F.concat(F.array(F.lit(bos)), tokenizer(F.col(text)), F.array(F.lit(eos))))


def pack_blocks(encoded: DataFrame, size: int = 2048, split: str = "split", order: str = "document_id", keep_remainder: Column | None = None) -> DataFrame:
    """split, block, input_ids: each split's documents as one stream, cut at `size`.

    The last, short block is kept where keep_remainder holds and it has more than one token (by default in every split but
    `train`). Offsets come from prefix sums over the documents; tokens move once, dealt by block.
    """
    keep = (F.col(split) != "train") if keep_remainder is None else keep_remainder
    counted = materialize(encoded.select(split, order, "ids", F.size("ids").cast("long").alias("_n")), "encoded")
    placed = prefix_sums(counted, [split, order], "_n", "_before")
    first = few(materialize(counted.groupBy(split).agg(F.sum("_n").alias("_all")), "totals"))  # a row for each split
    base = first.alias("a").join(first.alias("b"), F.col(f"b.{split}") < F.col(f"a.{split}"), "left").groupBy(F.col(f"a.{split}").alias(split)).agg(F.coalesce(F.sum("b._all"), F.lit(0)).alias("_base"))
    at = F.col("_before") - F.col("_base")
    rows = placed.join(few(materialize(base, "bases")), split).select(split, "ids", at.alias("_at"), F.size("ids").alias("_n"))

    def piece(block: Column) -> Column:
        start = F.greatest(block * size - F.col("_at"), F.lit(0)).cast("int")
        end = F.least((block + 1) * size - F.col("_at"), F.col("_n")).cast("int")
        return F.struct(block.alias("block"), (F.col("_at") + start).alias("g"), F.slice("ids", start + 1, end - start).alias("part"))

    # a document gives one slice for each block it touches; the slices are cut before rows are made, so ids are copied once
    cut = rows.where("_n > 0").select(split, F.explode(F.transform(F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("_n") - 1) / size)), piece)).alias("c")).select(split, "c.*")
    blocks = cut.groupBy(split, "block").agg(F.sort_array(F.collect_list(F.struct("g", "part"))).alias("p")).select(split, "block", F.flatten("p.part").alias("input_ids"))
    return blocks.where((F.size("input_ids") == size) | keep & (F.size("input_ids") > 1))


def token_statistics(encoded: DataFrame, blocks: DataFrame, split: str = "split") -> DataFrame:
    """split, documents, tokens, mean_tokens (one place), min_tokens, max_tokens, blocks, dropped_tokens."""
    n = F.size("ids")
    by_doc = encoded.groupBy(split).agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"), F.round(F.avg(n), 1).alias("mean_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"))
    by_block = blocks.groupBy(split).agg(F.count("*").alias("blocks"), F.sum(F.size("input_ids")).alias("kept"))
    zero = F.lit(0).cast("long")
    return by_doc.join(by_block, split, "left").select(split, "documents", "tokens", "mean_tokens", "min_tokens", "max_tokens", F.coalesce("blocks", zero).alias("blocks"), (F.col("tokens") - F.coalesce("kept", zero)).alias("dropped_tokens"))


def special_counts(blocks: DataFrame, bos: int = BOS, eos: int = EOS, split: str = "split") -> DataFrame:
    """split, bos_tokens, eos_tokens in the kept blocks."""
    count = lambda token: F.sum(F.size(F.filter("input_ids", lambda x: x == token))).cast("long")
    return blocks.groupBy(split).agg(count(bos).alias("bos_tokens"), count(eos).alias("eos_tokens"))


def uneven_blocks(blocks: DataFrame, size: int, split: str = "split") -> DataFrame:
    """uneven: train blocks of another size than `size`; 0 if the packing is right."""
    return blocks.where(F.col(split) == "train").agg(F.count_if(F.size("input_ids") != size).alias("uneven"))


def build_packed(documents: DataFrame, size: int = 2048, tokenizer: Callable[[Column], Column] = hash_tokens, optional: tuple[str, ...] = ("eval_unseen",), splits: tuple[str, ...] = ("train", "eval", "eval_unseen"), bos: int = BOS, eos: int = EOS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, document lengths, statistics) of documents (split, document_id, text); see pack_blocks and token_statistics.

    A split that gives no block raises ValueError, an optional one without documents is left out. Train blocks of another
    size than `size` raise as well.
    """
    encoded = materialize(encode(documents.select("split", "document_id", "text"), tokenizer, bos, eos).select("split", "document_id", "ids"), "tokens")
    blocks = materialize(pack_blocks(encoded, size), "blocks")
    stats = materialize(token_statistics(encoded, blocks), "statistics")
    found = {r["split"]: r for r in stats.where(F.col("split").isin(*splits)).collect()}  # a row for each split
    for name in splits:
        if name not in found and name in optional:
            continue
        if name not in found or not found[name]["blocks"]:
            raise ValueError(f"{name}: only {found[name]['tokens'] if name in found else 0} tokens, fewer than one block of {size}; add documents or make blocks smaller")
    if uneven_blocks(blocks, size).first()["uneven"]:
        raise ValueError(f"a train block does not have {size} tokens")
    return blocks, encoded.select("split", "document_id", F.size("ids").cast("long").alias("tokens")), stats


def training_examples(blocks: DataFrame) -> DataFrame:
    """input_ids, attention_mask (all ones), labels (the ids)."""
    return blocks.select("input_ids", F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"), F.col("input_ids").alias("labels"))


def first_special_context(blocks: DataFrame, token: int = EOS, before: int = 4, after: int = 4, split: str = "split") -> DataFrame:
    """split, block, position (from 1), context of the first such token of each block that has one."""
    at = F.array_position("input_ids", token)
    start = F.greatest(at - before, F.lit(1)).cast("int")
    return blocks.where(at > 0).select(split, "block", at.alias("position"), F.slice("input_ids", start, (at + after - start + 1).cast("int")).alias("context"))
