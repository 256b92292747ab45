"""Corpus split without leakage: whole unseen documents, and a held-out tail of every other document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions import text as X
from corpusloom.functions.columns import let, seeded
from corpusloom.operators.prefix import prefix_sums


def validate(docs: DataFrame, fraction: float) -> None:
    """Raises ValueError for a fraction outside (0, 1), fewer than two documents, an empty text or a repeated one."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    seen = docs.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty")).first()
    if seen["n"] < 2:
        raise ValueError("at least two documents are needed")
    if seen["empty"]:
        raise ValueError(f"{seen['empty']} documents are empty")
    if not docs.groupBy(F.sha2("text", 256)).count().where("count > 1").isEmpty():
        raise ValueError("a text occurs twice; deduplicate first")


def unseen_documents(docs: DataFrame, settings: Settings = Settings(), pinned: list[str] | None = None, words: str = "words") -> DataFrame:
    """doc_id, words, rank of the documents held out whole.

    In seeded order, documents are taken until their words reach the target; one that would exceed 1.5 targets is skipped.
    docs: doc_id, words. A document of at most half a target is never skipped before the target is reached, so prefix sums
    decide it. Only larger ones need a fold; there are no more than two divided by the target's fraction of them.
    """
    total = docs.agg(F.sum(words)).first()[0] or 0
    target = settings.unseen_fraction * total
    rows = docs if not pinned else docs.where(~F.lower(F.col("doc_id").cast("string")).isin([p.lower() for p in pinned]))
    rows = rows.select("doc_id", F.col(words).cast("long").alias("words"), seeded(settings.seed, "doc_id").alias("rank")).where("words > 0")
    large = F.col("words") > 0.5 * target
    placed = prefix_sums(rows, ["rank", "doc_id"], F.when(large, 0).otherwise(F.col("words")), "before").where(F.col("before") < target)
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<rank:string,id:string,words:bigint,before:bigint>>").alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        there = x["before"] + acc["sum"]
        return F.when((there < target) & (there + x["words"] <= 1.5 * target), F.struct((acc["sum"] + x["words"]).alias("sum"), F.array_append(acc["taken"], x).alias("taken"))).otherwise(acc)

    listed = placed.where(large).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"), "words", "before"))).alias("all"))
    taken = listed.select(F.aggregate("all", empty, take, lambda acc: acc["taken"]).alias("taken"))
    both = placed.join(F.broadcast(taken))  # one row
    ahead = F.aggregate(F.filter("taken", lambda t: t["rank"] < F.col("rank")), F.lit(0).cast("long"), lambda n, t: n + t["words"])
    chosen = F.when(large, F.exists("taken", lambda t: t["id"] == F.col("doc_id").cast("string"))).otherwise(F.col("before") + ahead < target)
    return both.where(chosen).select("doc_id", "words", "rank")


def tail_split(text: Column, fraction: float) -> Column:
    """struct<head, tail, how>: the last `fraction` of a text's words, cut at a blank line, else a line end, else a word.

    A separator's cut is taken if it lies within 5 hundredths of the words from the target; of several the nearest, first
    of equals, never before or after everything. A null or empty text gives two empty parts.
    """

    def by(pieces: Column, total: Column) -> Column:
        """struct<gap, cut> of the best cut between pieces, the first of equals, its gap null if there is none. One fold."""
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("words"), F.lit(None).cast("double").alias("gap"), F.lit(0).alias("cut"))

        def step(acc: Column, n: Column) -> Column:
            words = acc["words"] + n
            gap = F.abs(words - (1 - fraction) * total)
            better = (words > 0) & (words < total) & (acc["i"] + 1 < F.size(pieces)) & (acc["gap"].isNull() | (gap < acc["gap"]))
            return F.struct((acc["i"] + 1).alias("i"), words.alias("words"), F.when(better, gap).otherwise(acc["gap"]).alias("gap"), F.when(better, acc["i"] + 1).otherwise(acc["cut"]).alias("cut"))

        return F.aggregate(F.transform(pieces, X.word_count), start, step, lambda acc: F.struct(acc["gap"].alias("gap"), acc["cut"].alias("cut")))

    def at(separator: str, name: str, pieces: Column, total: Column, otherwise: Column) -> Column:
        def chosen(b: Column) -> Column:
            parts = F.struct(
                F.trim(F.array_join(F.slice(pieces, F.lit(1), b["cut"]), separator)).alias("head"),
                F.trim(F.array_join(F.slice(pieces, b["cut"] + 1, F.size(pieces)), separator)).alias("tail"),
                F.lit(name).alias("how"),
            )
            return F.when(b["gap"] <= 0.05 * total, parts).otherwise(otherwise)

        return let(by(pieces, total), chosen)

    def of(t: Column) -> Column:
        words = t["words"]
        total = F.size(words)
        cut = F.bround((1 - fraction) * total).cast("int")
        by_word = F.struct(F.array_join(F.slice(words, F.lit(1), cut), " ").alias("head"), F.array_join(F.slice(words, cut + 1, F.greatest(total, F.lit(1))), " ").alias("tail"), F.lit("words").alias("how"))
        return at("\n\n", "paragraph", t["paragraphs"], total, at("\n", "line", t["lines"], total, by_word))

    whole = F.coalesce(text, F.lit(""))
    return let(F.struct(X.word_list(whole).alias("words"), F.split(whole, "\n\n").alias("paragraphs"), F.split(whole, "\n").alias("lines")), of)


def split_corpus(docs: DataFrame, settings: Settings = Settings(), pinned: list[str] | None = None, check: bool = False) -> DataFrame:
    """document_id, split (train, eval, eval_unseen), part (head, tail or null), words, sha256 (of the whole text), text.

    Documents chosen as unseen go whole to eval_unseen; every other one gives its head to train and its tail to eval. With
    `check`, the input must pass `validate` first.
    """
    if check:
        validate(docs, settings.eval_fraction)
    counted = docs.select("doc_id", "text", X.word_count(F.col("text")).cast("long").alias("words"))
    unseen = unseen_documents(counted.select("doc_id", "words"), settings, pinned).select("doc_id")
    whole = counted.join(unseen, "doc_id", "left_semi").select("doc_id", "text", F.lit("eval_unseen").alias("split"), F.lit(None).cast("string").alias("part"), F.col("text").alias("piece"))
    cut = counted.join(unseen, "doc_id", "left_anti").withColumn("s", tail_split(F.col("text"), settings.eval_fraction))
    parts = F.explode(F.array(F.struct(F.lit("train").alias("split"), F.lit("head").alias("part"), F.col("s.head").alias("piece")), F.struct(F.lit("eval").alias("split"), F.lit("tail").alias("part"), F.col("s.tail").alias("piece"))))
    pieces = cut.select("doc_id", "text", parts.alias("p")).select("doc_id", "text", "p.split", "p.part", "p.piece").unionByName(whole)
    return pieces.select(F.col("doc_id").alias("document_id"), "split", "part", X.word_count(F.col("piece")).cast("long").alias("words"), F.sha2("text", 256).alias("sha256"), F.col("piece").alias("text"))


def split_manifest(split: DataFrame) -> DataFrame:
    """split, documents, words, fraction (of all words, four places)."""
    by = split.groupBy("split").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))
    total = by.agg(F.sum("words").alias("total"))
    return by.join(F.broadcast(total)).select("split", "documents", "words", F.round(F.col("words") / F.col("total"), 4).alias("fraction"))


def manifest_report(docs: DataFrame, split: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: seed, split_unit, requested_eval_fraction, document counts by split, word and document fractions, note.

    docs: doc_id, text (the input of split_corpus); split: its result. The documents of each split are the rows of `split`
    itself, so they are written as a table and not gathered in one row.
    """
    by = split.agg(
        *[F.count_if(F.col("split") == s).alias(f"documents_{s}") for s in ("train", "eval", "eval_unseen")],
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("words"))), F.lit(0)).alias(f"words_{s}") for s in ("eval", "eval_unseen")],
    )
    every = docs.agg(F.count("*").alias("documents_total"), F.sum(X.word_count(F.col("text"))).cast("long").alias("words_total"))
    share = lambda s: F.col(f"words_{s}") / F.col("words_total")
    percent = lambda x: F.format_string("%.1f%%", x * 100)
    note = F.concat(
        F.lit(f"eval = last {settings.eval_fraction:.0%} of each of "), F.col("documents_eval").cast("string"), F.lit(" documents ("), percent(share("eval")),
        F.lit(" of words); eval_unseen = "), F.col("documents_eval_unseen").cast("string"), F.lit(" whole documents never used in CPT ("), percent(share("eval_unseen")),
        F.lit(" of words); probe documents kept out of eval_unseen."),
    )
    return every.join(F.broadcast(by)).select(
        F.lit(settings.seed).alias("seed"), F.lit("eval: per-document tail (paragraph boundary); eval_unseen: whole documents").alias("split_unit"), F.lit(settings.eval_fraction).alias("requested_eval_fraction"),
        "documents_total", "documents_train", "documents_eval", "documents_eval_unseen",
        F.round(share("eval_unseen"), 4).alias("actual_eval_unseen_word_fraction"), F.round(F.col("documents_eval") / F.col("documents_total"), 4).alias("actual_eval_document_fraction"),
        F.round(share("eval"), 4).alias("actual_eval_word_fraction"), note.alias("note"),
    )


def grouped_split(rows: DataFrame, group: str, train_fraction: float = 0.8, seed: int = 42, pinned: Column | None = None) -> DataFrame:
    """rows with split: whole groups, pinned ones first and then in seeded order, go to train until it has its share.

    A group goes to train if the rows before it are fewer than the target, so the last may exceed it.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"), F.max(F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(False)).alias("_pinned"))
    target = train_fraction * rows.count()
    placed = prefix_sums(sizes, [(~F.col("_pinned")).cast("int"), seeded(seed, group), group], "_n", "_before")
    return rows.join(placed.select(group, F.when(F.col("_before") < target, "train").otherwise("eval").alias("split")), group)
