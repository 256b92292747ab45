"""Quality rules as a bitmask ledger, with DataFrame expressions only.

Every rule is evaluated once; a row of the ledger holds the measurements and one bit per failed rule. A policy is a
versioned mask: a document is kept if no bit of the mask is set. Ablations count, from the ledger's bits alone, what each
rule of a policy removes, and what only it removes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import let, spread, words

#: Characters that count as symbols, words in a window.
SYMBOLS, WINDOW = "#*$%&|<>", 8

#: Rules by bit, as conditions over the measurements under which a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: Policies by version: the rules that decide.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "word_length"),
    "strict": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _repeat_words(tokens: Column) -> Column:
    """Words that stand in a window found twice or more: windows by hash, sorted with their places, neighbours compared."""

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)))

    def covered(placed: Column) -> Column:
        last = F.size(placed) - 1
        twins = F.filter(F.zip_with(F.slice(placed, 1, last), F.slice(placed, 2, last), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull())
        starts = F.sort_array(F.array_distinct(F.flatten(twins)))
        return let(starts, lambda s: F.aggregate(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda n, x: n + x))

    return F.when(F.size(tokens) < WINDOW, F.lit(0)).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), of))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all bigint; 0 where text is null or empty).

    Repeated rows are measured one by one; columns of these names are replaced; an empty table stays empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    solid = F.length(F.translate(whole, " \t\n\x0b\x0c\r", ""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    n_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    counted = let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("again")))
    of_words, of_lines = (f"{name}_{uuid.uuid4().hex}" for name in ("words", "lines"))  # no column of df has these names
    return (
        df.withColumns({of_words: counted, of_lines: n_lines, "word_chars": solid.cast("long"), "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")})
        .withColumns({"n_words": F.col(f"{of_words}.n"), "n_repeat_words": F.col(f"{of_words}.again"), "n_lines": F.col(f"{of_lines}.n"), "n_dup_lines": F.col(f"{of_lines}.dup")})
        .drop(of_words, of_lines)
    )


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The measurements and failed_bits, one bit per rule of RULES."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return measure(df, text).withColumn("failed_bits", bits)


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with `kept` under a policy."""
    return led.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, removed, removed_alone: from counts by bits, of which there are at most 2 ** rules."""
    by_bits = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).alias("bit")) for n in POLICIES[policy]]))
    return (
        by_bits.select("bits", "n", names.alias("r"))
        .groupBy("r.rule")
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("removed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("removed_alone"),
        )
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v1."""
    led = apply_policy(ledger(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))), "v1")
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "failed_bits")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
grams AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
steps AS (
  SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS n FROM twice),
again AS (SELECT rid, sum(n)::BIGINT AS n FROM steps GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN again USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
  failed_bits & 23 = 0 AS kept, n_lines, failed_bits FROM b
"""
