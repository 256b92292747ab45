"""Scalar scores of generated text: keyword verdicts, ROUGE-L, relative change."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyword_verdict(text: Column, keywords: Column) -> Column:
    """Whether any keyword occurs; one that ends in a digit must not be followed by a digit or comma. Null text: false."""
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("°"), F.lit(" "))

    def found(k: Column) -> Column:
        after = F.when(k.rlike("[0-9]$"), F.lit("(?![0-9,])")).otherwise(F.lit(""))
        return F.rlike(plain, F.concat(F.lit("\\Q"), F.lower(k), F.lit("\\E"), after))

    return F.exists(keywords, found)


def strict_prefix(text: Column, fact: Column) -> Column:
    """Whether a text begins with a fact, after nothing but other than word characters."""
    return F.rlike(F.lower(text), F.concat(F.lit("^\\W*\\Q"), F.lower(fact), F.lit("\\E")))


def forgetting_verdict(base: Column, new: Column) -> Column:
    return F.when(new, F.lit("Retained")).when(base, F.lit("Degraded")).otherwise(F.lit("Retained (base also wrong)"))


def relative_change(before: Column, after: Column, digits: int = 2) -> Column:
    """100 * (1 - after / before), rounded; null if before is 0."""
    return F.round(F.when(before != 0, 100 * (1 - after / before)), digits)


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two word lists, by rows of bits; a fold in the JVM would copy a row for each word."""

    def length(x, y) -> int:
        places: dict[str, int] = {}
        for i, w in enumerate(y):
            places[w] = places.get(w, 0) | 1 << i
        every = (1 << len(y)) - 1
        row = every
        for w in x:
            met = row & places.get(w, 0)
            row = (row + met | row - met) & every
        return len(y) - row.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of lower-cased words; 0 if a side has none."""

    def words(text: Column) -> Column:
        return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")

    p, r = words(prediction), words(reference)
    return 2.0 * common_subsequence(p, r) / F.greatest(F.size(p) + F.size(r), F.lit(1))
