"""Scalar text functions: page and line rules, normalisation, words, digests, shingles. All Column to Column.

A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.columns import let

#: Patterns of page marks, page numbers, document-control labels and contents lines.
PAGE_MARK = r"--- PAGE \d+ ---"
PAGE_NUMBER = r"(?i)^(?:(?:Page\s*)?\d+\s*(?:of|/)\s*\d+|Page\s*\d+|-\s*\d{1,3}\s*-)$"
EDGE_NUMBER = r"(?i)^\s*[-–]?\s*(?:\d{1,4}|[ivxlc]{1,6})\s*[-–]?\s*$"
CONTROL_LABEL = (
    r"(?i)^(?:ref\.? no|reference no|version(?: no)?|date of issue|issue date|effective date|document owner|approved by|reviewed by|"
    r"prepared by|document type|subcategory|policy owner|revision date|next review date)\s*[:.-]"
)
DOT_LEADER = r"(?:\.\s?){5,}|…{2,}|_{5,}"
#: White space as Unicode has it, other than line ends: what (?U)[^\S\r\n] matches, in many times its speed.
BLANKS = r"[\t\x0B\f \x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
INLINE_PAGE = r"(?i)\bPage\s+\d+\s+(?:of|/)\s+\d+\b"


@functools.cache
def nfkc_safe() -> str:
    """A class of code points that NFKC leaves as they are and that combine with none before them, as far as texts mostly use them.

    By rule: ASCII; runs of at least five below U+0500 (Latin, Greek, Cyrillic) and in U+2000 to U+2030; runs of at least 2,000
    anywhere (ideographs, Hangul syllables).
    """
    runs, start = [], None
    for point in range(0x80, 0x30000):
        c = chr(point)
        safe = not 0xD800 <= point <= 0xDFFF and unicodedata.category(c)[0] not in "MC" and not 0x1100 <= point <= 0x11FF and unicodedata.is_normalized("NFKC", c)
        if safe and start is None:
            start = point
        elif not safe and start is not None:
            runs.append((start, point - 1))
            start = None
    used = [(a, b) for a, b in runs if b - a >= (4 if b < 0x500 or 0x2000 <= a <= 0x2030 else 1_999)]
    return r"\x00-\x7F" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in used)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Spark has no built-in, so texts that it may change go to Python, in Arrow batches; the others, found by a
    class of code points, stay in the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(f"[^{nfkc_safe()}]"), text)), text)


def strip_control(text: Column) -> Column:
    """Without code points of the categories C*, but for line end and tab."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def dehyphenate(text: Column) -> Column:
    """Word halves that a hyphen and a line end part are joined."""
    return F.when(text.contains("-\n"), F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")).otherwise(text)


def collapse(text: Column) -> Column:
    """Runs of white space other than line ends become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANKS}+", " "))


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")


def word_list(text: Column) -> Column:
    """Words by Unicode white space; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"(?:{BLANKS}|[\r\n])+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def is_dropped_line(line: Column) -> Column:
    """Page marks and numbers, document-control labels on short lines, lines of a table of contents."""
    label = line.rlike(CONTROL_LABEL) & (word_count(line) <= 12)
    return line.rlike(f"^{PAGE_MARK}$") | line.rlike(PAGE_NUMBER) | label | line.rlike(DOT_LEADER)


def clean_line(line: Column) -> Column:
    """A kept line without page numbers inside it, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, INLINE_PAGE, ""), " {2,}", " "))


def clean_text(text: Column, boilerplate: Column | None = None) -> Column:
    """The line rules over a text: control characters, hyphens, white space, dropped lines, one blank line at most.

    boilerplate: an array of lines to drop, collapsed as here. NFKC, where wanted, goes first.
    """
    lines = F.transform(split_lines(dehyphenate(strip_control(text))), collapse)
    kept = F.filter(lines, lambda x: ~is_dropped_line(x) & (F.lit(True) if boilerplate is None else ~F.array_contains(F.coalesce(boilerplate, F.array().cast("array<string>")), x)))
    joined = F.array_join(F.transform(kept, clean_line), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_edge_numbers(page: Column) -> Column:
    """A page whose first and last lines that are not blank are emptied if they hold a page number and nothing else."""

    def of(lines: Column) -> Column:
        filled = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"(?U)\S"), i)), lambda i: i.isNotNull())
        ends = lambda f: F.transform(lines, lambda x, i: F.when(((i == F.array_min(f)) | (i == F.array_max(f))) & x.rlike(EDGE_NUMBER), F.lit("")).otherwise(x))
        return F.array_join(let(filled, ends), "\n")

    return let(F.split(F.coalesce(page, F.lit("")), "\n"), of)


def strip_all_edge_numbers(text: Column) -> Column:
    """The same for every page of a page-marked text, whose marks stay as they are."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?={PAGE_MARK})|(?<=--- PAGE \d{{1,9}} ---)")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(rf"^\s*{PAGE_MARK}\s*$"), x).otherwise(strip_edge_numbers(x))), "")


def normalized_digest(text: Column) -> Column:
    """SHA-256 of the lower-cased words, one space between; null counts as empty."""
    return F.sha2(F.lower(F.array_join(word_list(text), " ")), 256)


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(text: Column, size: int = 5) -> Column:
    """The distinct word shingles; a text of fewer words has one, of no words the empty one."""

    def of(words: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - size)), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])))

    return let(alnum_words(text), of)


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """array<bigint>: 64-bit hashes of the distinct word shingles, made of the words' own hashes, so that no shingle is put together."""

    def of(codes: Column) -> Column:
        # element by element: a slice would copy the whole array for each shingle
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(codes) - size)), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(size)])))

    return let(F.transform(alnum_words(text), lambda w: F.xxhash64(w)), of)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def truncate_words(text: Column, limit: int) -> Column:
    """Up to `limit` words; a longer text ends at the last sentence or clause past half of the cut, else with an ellipsis."""

    def cut(words: Column) -> Column:
        def ended(x: Column) -> Column:
            back = F.reverse(x)
            found = [F.when(F.locate(mark, back) > 0, F.length(x) - F.locate(mark, back)).otherwise(F.lit(0)) for mark in (" .", " ;")]
            last = F.greatest(*found)  # code points up to and with the stop
            return F.when(last - 1 > F.floor(F.length(x) / 2), F.substr(x, F.lit(1), last)).otherwise(F.concat(x, F.lit(" ...")))

        return F.when(F.size(words) <= limit, text).otherwise(let(F.array_join(F.slice(words, 1, limit), " "), ended))

    return let(word_list(text), cut)


def first_sentences(text: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(text, r"(?<=[.])\s+(?=[A-Z])"), 1, n), " ")


def word_chunks(text: Column, size: int = 600) -> Column:
    """array<string> of consecutive runs of `size` words; none for a text without words."""

    def of(words: Column) -> Column:
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size)), lambda i: F.array_join(F.slice(words, (i * size + 1).cast("int"), size), " ")))

    return let(word_list(text), of)
