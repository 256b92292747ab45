"""Benchmark decontamination by templates, with DataFrame expressions only.

Words of documents and benchmark items are canonicalised: numbers, names (capitalised words inside a sentence) and units after
a number become typed placeholders, of which a run counts once. Windows of five canonical words are joined by hash. Windows
that lie alike in a document and an item (within a few words, or within the 64 that may stand between its parts) make up one alignment, which counts if it covers enough of the item
and its slots are consistent: each value in the item stands for one value in the document, and the other way round. So a
question with other numbers or names is found, and one with other relations between them is not. Where an item repeats a
template inside itself, windows also match a clause further; chains of matches in one order tell the alignments apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import let, spread

#: Words of a window, least share of an item's words that an alignment covers.
WINDOW, COVERED = 5, 0.8
#: Words by which an alignment may shift: few, or as many as may be put in between the parts of an item.
SHIFTS = (8, 64)
#: Benchmark windows up to this number are broadcast (some 60 bytes each), more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Units that are placeholders after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg lb lbs pound pounds oz ounce ounces ton tons ml cl l liter liters litre "
    "litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent "
    "cents percent degree degrees c f k w kw kwh v volt volts watt watts j joule joules n pa kpa mph kmh kb mb gb tb"
).split()
_NAME, _NUMBER, _UNIT = "\x01", "\x02", "\x03"
#: A capitalised word that no sentence or line begins with.
_IN_SENTENCE = r"\p{Lu}(?<=[^.!?:;\s\p{Pi}\"(] \p{Lu})(?=\p{Ll})"
_BETWEEN = "[^\\p{L}\\p{M}\\p{N}\x01]+"


def canonical(text: Column) -> Column:
    """array<struct<c, v>>: canonical word and the text it stands for; runs of one placeholder are one."""
    marked = F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03", "   "), _IN_SENTENCE, _NAME + "$0"))
    tokens = F.filter(F.split(marked, _BETWEEN), lambda t: t != "")

    def typed(words: Column) -> Column:
        def kind(t: Column, i: Column) -> Column:
            head = F.substring(t, 1, 1)
            unit = t.isin(*UNITS) & (i > 0) & F.substring(F.get(words, i - 1), 1, 1).between("0", "9")
            return F.when(head == _NAME, F.struct(F.lit(_NAME).alias("c"), t.alias("v"))).when(head.between("0", "9"), F.struct(F.lit(_NUMBER).alias("c"), t.alias("v"))).when(unit, F.struct(F.lit(_UNIT).alias("c"), t.alias("v"))).otherwise(F.struct(t.alias("c"), F.lit("").alias("v")))

        return F.transform(words, kind)

    return let(let(tokens, typed), lambda a: F.filter(a, lambda x, i: (x["v"] == "") | (i == 0) | (F.get(a, i - 1)["c"] != x["c"])))


def windows(words: Column, sizes: list[int]) -> Column:
    """array<struct<pos, size, hash, slots>> of canonical words; slots holds the placeholders' values, parted by \\x1f."""

    def of(a: Column) -> Column:
        codes = F.transform(a, lambda x: F.xxhash64(x["c"]))
        values = F.transform(a, lambda x: x["v"])
        typed = F.exists(a, lambda x: x["v"] != "")

        def all_of(both: Column) -> Column:
            def one(size: int) -> Column:
                return F.when(
                    F.size(both["codes"]) >= size,
                    F.transform(
                        F.sequence(F.lit(0), F.size(both["codes"]) - size),
                        lambda i: F.struct(
                            i.alias("pos"),
                            F.lit(size).alias("size"),
                            F.xxhash64(F.slice(both["codes"], i + 1, size)).alias("hash"),
                            F.when(both["typed"], F.array_join(F.slice(both["values"], i + 1, size), "\x1f")).otherwise(F.lit("")).alias("slots"),
                        ),
                    ),
                ).otherwise(F.expr("cast(array() as array<struct<pos:int,size:int,hash:bigint,slots:string>>)"))

            found = [one(s) for s in sizes]
            return F.concat(*found) if len(found) > 1 else found[0]

        return let(F.struct(codes.alias("codes"), values.alias("values"), typed.alias("typed")), all_of)

    return let(words, of)


def coverage(matches: Column) -> Column:
    """Share of the item's words (n_words) in windows (of `size` words) of the matches."""
    places = F.flatten(F.transform(matches, lambda m: F.sequence(m["at"], m["at"] + F.col("size") - 1)))
    return F.size(F.array_distinct(places)) / F.col("n_words")


def slot_pairs(matches: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(matches, lambda m: m["pairs"])))


def one_to_one(pairs: Column) -> Column:
    return (F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"]))) == F.size(pairs)) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))) == F.size(pairs))


def chain(matches: Column, shift: Column) -> Column:
    """The matches of one shift, then those of others, nearest first, that stand in the same order in item and document.

    So an item's window has one window of the document and the other way round, and clauses that repeat a template inside an
    item do not contradict each other. A match that fits in order is taken even if its slots do not agree.
    """
    others = F.array_sort(F.transform(F.filter(matches, lambda m: m["shift"] != shift), lambda m: F.struct(F.abs(m["shift"] - shift).alias("far"), m["at"].alias("at"), m.alias("m"))))

    def fits(kept: Column, m: Column) -> Column:
        return F.forall(kept, lambda k: (k["at"] - m["at"]) * (k["at"] + k["shift"] - m["at"] - m["shift"]) > 0)

    return F.aggregate(others, F.filter(matches, lambda m: m["shift"] == shift), lambda kept, o: F.when(fits(kept, o["m"]), F.concat(kept, F.array(o["m"]))).otherwise(kept))


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, coverage (best alignment), n_windows, exact.

    exact: the best alignment's slots have the item's own values. An item under five words is one window of its own; an item
    or document without words, or null, matches nothing. Repeated documents and items each give their rows; rows whose id
    is null are kept apart from none: they share one null id. An empty table on either side gives an empty result.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), canonical(F.col(item_text)).alias("w")).withColumn("n_words", F.size("w")).where("n_words > 0")
    sizes = sorted({min(r["n_words"], WINDOW) for r in items.select(F.least("n_words", F.lit(WINDOW)).alias("n_words")).distinct().collect()})  # five at most
    spark = docs.sparkSession
    if not sizes:
        return spark.createDataFrame([], docs.select(F.col(id_col).alias("doc_id")).schema).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", dict(benchmark.dtypes)[item_col]), ("coverage", "double"), ("n_windows", "long"), ("exact", "boolean"))])
    own = [items.where(F.least("n_words", F.lit(WINDOW)) == s).select("item_id", "n_words", F.explode(windows(F.col("w"), [s])).alias("i")) for s in sizes]
    item_windows = own[0]
    for more in own[1:]:
        item_windows = item_windows.unionByName(more)
    item_windows = item_windows.select("item_id", "n_words", F.col("i.hash").alias("hash"), F.col("i.size").alias("size"), F.col("i.pos").alias("item_pos"), F.col("i.slots").alias("item_slots"))
    if item_windows.count() <= BROADCAST_WINDOWS:
        item_windows = F.broadcast(item_windows)
    doc_windows = docs.select(F.col(id_col).alias("doc_id"), F.explode(windows(canonical(F.col(text)), sizes)).alias("d")).select("doc_id", F.col("d.hash").alias("hash"), F.col("d.size").alias("size"), F.col("d.pos").alias("pos"), F.col("d.slots").alias("slots"))
    found = doc_windows.join(item_windows, ["hash", "size"])
    # two overlapping ranges of shifts for each of SHIFTS, so that windows up to so many words apart in shift always share one
    shift = F.col("pos") - F.col("item_pos")
    numbered = lambda most, number: F.struct(F.lit(most).alias("most"), number.alias("number"))
    ranges = F.explode(F.array(*[numbered(s, n) for s in SHIFTS for n in (F.floor(shift / (2 * s)) * 2, F.floor((shift + s) / (2 * s)) * 2 + 1)]))
    pairs = F.filter(
        F.zip_with(F.split("item_slots", "\x1f"), F.split("slots", "\x1f"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: (F.coalesce(p["a"], F.lit("")) != "") | (F.coalesce(p["b"], F.lit("")) != ""),
    )
    matched = found.select("doc_id", "item_id", "n_words", "size", ranges.alias("range"), F.struct(shift.alias("shift"), F.col("item_pos").alias("at"), pairs.alias("pairs")).alias("match"))
    aligned = matched.groupBy("doc_id", "item_id", "n_words", "size", "range").agg(F.collect_set("match").alias("matches"), F.count("*").alias("n_windows"))
    enough = aligned.where(coverage(F.col("matches")) >= covered)
    whole = F.array(F.struct("n_windows", F.col("matches").alias("matches")))
    chains = F.transform(F.array_distinct(F.transform("matches", lambda m: m["shift"])), lambda s: let(chain(F.col("matches"), s), lambda c: F.struct(F.size(c).cast("long").alias("n_windows"), c.alias("matches"))))
    chosen = enough.select("doc_id", "item_id", "n_words", "size", F.explode(F.when(one_to_one(slot_pairs(F.col("matches"))), whole).otherwise(chains)).alias("c")).select("doc_id", "item_id", "n_words", "size", "c.n_windows", "c.matches")
    told = chosen.withColumns({"coverage": coverage(F.col("matches")), "pairs": slot_pairs(F.col("matches"))})
    exact = F.forall("pairs", lambda p: p["a"].eqNullSafe(p["b"]))
    best = told.where(one_to_one(F.col("pairs")) & (F.col("coverage") >= covered)).groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_windows", exact.alias("exact"))).alias("b"))
    return best.select("doc_id", "item_id", "b.coverage", "b.n_windows", "b.exact")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return contaminated(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
