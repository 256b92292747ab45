"""License scan: phrases in places, and templates found by an exact set-similarity join, with DataFrame expressions only.

A text's words are cut into blocks that overlap by half: a block has twice the words of the longest template of its class,
so any run as long as a template lies whole in one block. A template is found in a block that holds at least a share of its
distinct words. The join is exact: words that no template has are left out of the blocks' sets, which changes no
intersection; the words left are ordered by the number of blocks that have them, rarest first; a block and a template that
share enough words share one among the first of each (prefix filter), at places behind which enough words are left
(positional filter), and a block with fewer words than a template needs takes no part (length filter). What these filters
leave is confirmed on the whole sets.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import let, materialize, spread

#: What stands between words, in lower-cased texts; phrases by their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of public licenses, with their labels. None holds all words of another: containment finds both then.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
)
#: Hundredths of a template's distinct words that a block must hold.
PERCENT = 90
#: Words of the longest template of a class; a template belongs to the first class that takes it.
CLASSES = (8, 64, 256)
#: Documents with a found template that are joined by broadcast, at most (some 100 bytes each).
BROADCAST_FOUND = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_sets(templates: tuple[tuple[str, str], ...], percent: int) -> list[dict]:
    """label, words (distinct), need (how many a block must hold), half (words of its class) of each template."""
    out = []
    for label, text in templates:
        found = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(str.maketrans(_UPPER, _LOWER)))
        if not found or len(found) > CLASSES[-1]:
            raise ValueError(f"a template of {len(found)} words: 1 to {CLASSES[-1]} are taken")
        distinct = sorted(set(found))
        out.append({"label": label, "words": distinct, "need": max(1, -(-percent * len(distinct) // 100)), "half": next(h for h in CLASSES if len(found) <= h)})
    return out


def license_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased (null: none)."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN), lambda w: w != "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _phrase_places(words: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    """array<struct<at, label>> of all places where a phrase's words stand one after the other, found from their last word."""
    split = [(phrase.split(" "), label) for phrase, label in phrases]
    last = sorted({p[-1] for p, _ in split})
    ends = F.filter(F.transform(words, lambda w, i: F.when(w.isin(last), i)), lambda i: i.isNotNull())

    def at(i: Column, phrase: list[str]) -> Column:
        n = len(phrase)
        return reduce(lambda a, b: a & b, [F.get(words, i - (n - 1 - k)) == phrase[k] for k in range(n)])

    def places(phrase: list[str], label: str) -> Column:
        hits = F.filter(ends, lambda i: F.coalesce((i >= len(phrase) - 1) & at(i, phrase), F.lit(False)))
        return F.transform(hits, lambda i: F.struct((i - (len(phrase) - 1)).alias("at"), F.lit(label).alias("label")))

    return F.concat(*[places(p, label) for p, label in split])


def _blocks(words: Column, templates: list[dict]) -> Column:
    """array<struct<half, words>>: the blocks that hold enough words of a class's templates for the least of them (length filter).

    A text is cut into halves by one walk over it, and each half's set is made once; a block is two neighbours.
    """
    none = F.array().cast("array<string>")
    joined = F.array_join(words, " ")

    def of_class(half: int) -> Column:
        own = [t for t in templates if t["half"] == half]
        vocabulary, least = _strings(sorted({w for t in own for w in t["words"]})), min(t["need"] for t in own)
        halves = F.transform(F.regexp_extract_all(joined, F.lit(rf"(?:[^ ]+ ?){{1,{half}}}"), F.lit(0)), lambda h: F.array_intersect(vocabulary, F.split(h, " ")))

        def pairs(sets: Column) -> Column:
            both = lambda i: F.array_intersect(vocabulary, F.concat(F.get(sets, i), F.coalesce(F.get(sets, i + 1), none)))
            cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sets) - 2, F.lit(0))), lambda i: F.struct(F.lit(half).alias("half"), both(i).alias("words")))
            return F.filter(cut, lambda b: F.size(b["words"]) >= least)

        # a text that lacks the words as a whole has no such block
        enough = F.size(F.array_intersect(vocabulary, words)) >= least
        return F.when(enough, let(halves, pairs)).otherwise(F.array().cast("array<struct<half:int,words:array<string>>>"))

    return F.concat(*[of_class(h) for h in CLASSES if any(t["half"] == h for t in templates)])


def _ordered(blocks: DataFrame, templates: list[dict]) -> dict[int, list[str]]:
    """For each class the templates' words, rarest first. As many rows reach the driver as the templates have words."""
    seen = {(r["half"], r["w"]): r["n"] for r in blocks.select("half", F.explode("words").alias("w")).groupBy("half", "w").agg(F.count("*").alias("n")).collect()}
    return {h: sorted({w for t in templates if t["half"] == h for w in t["words"]}, key=lambda w: (seen.get((h, w), 0), w)) for h in {t["half"] for t in templates}}


def _prefixes(spark: SparkSession, templates: list[dict], order: dict[int, list[str]]) -> DataFrame:
    """half, w, i (its place, from 0), label, need, all (words in order): the first words of each template, one of which a block must have."""
    rows = []
    for t in templates:
        place = {w: i for i, w in enumerate(order[t["half"]])}
        words = sorted(t["words"], key=place.__getitem__)
        rows += [(t["half"], words[i], i, t["label"], t["need"], words) for i in range(len(words) - t["need"] + 1)]
    return spark.createDataFrame(rows, "half int, w string, i int, label string, need int, all array<string>")


def join_templates(blocks: DataFrame, templates: list[dict]) -> DataFrame:
    """blocks(half, words and others; a written table) with label and containment, for each template that a block holds."""
    order = _ordered(blocks, templates)
    least = {h: min(t["need"] for t in templates if t["half"] == h) for h in order}
    by_class = F.array()
    needed = F.lit(0)
    for h, words in order.items():
        by_class = F.when(F.col("half") == h, F.array_intersect(_strings(words), F.col("words"))).otherwise(by_class)
        needed = F.when(F.col("half") == h, F.lit(least[h])).otherwise(needed)
    others = [c for c in blocks.columns if c != "words"]
    sets = blocks.select(*others, by_class.alias("ordered"), needed.alias("least"))
    probes = sets.select(*others, "ordered", F.posexplode(F.slice("ordered", F.lit(1), F.size("ordered") - F.col("least") + 1)).alias("j", "w"))
    prefixes = _prefixes(blocks.sparkSession, templates, order)  # as many rows as the templates have words, at most
    left_of_block, left_of_template = F.size("ordered") - F.col("j"), F.size("all") - F.col("i")
    candidates = probes.join(F.broadcast(prefixes), ["half", "w"]).where((left_of_block >= F.col("need")) & (left_of_template >= F.col("need")))
    shared = F.size(F.array_intersect("ordered", "all"))
    return candidates.select(*others, "label", "need", shared.alias("shared"), F.size("all").alias("n")).where("shared >= need").select(*others, "label", (F.col("shared") / F.col("n")).alias("containment"))


def scan_licenses(df: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row for each row of df(doc_id, text).

    n_base counts the places of all phrases; first_word and last_word are their smallest and largest start, words counted
    from 0, null without one. labels are those of the phrases and of the templates found. score is 1 with a phrase, else
    the largest share of a template that a block holds, 0 below the threshold. A null or empty text has no words, rows
    that share an id (or have none) are scanned one by one, other columns are ignored, an empty table stays empty. Long texts are more blocks,
    none of them larger.
    """
    sets = template_sets(templates, percent)
    found = let(license_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _phrase_places(w, phrases).alias("places"), _blocks(w, sets).alias("blocks")))
    read = df.select("doc_id", found.alias("f"))
    scanned = materialize(
        read.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.col("f.n").alias("n_words"),
            F.size("f.places").cast("long").alias("n_base"),
            F.array_min(F.transform("f.places", lambda p: p["at"])).cast("long").alias("first_word"),
            F.array_max(F.transform("f.places", lambda p: p["at"])).cast("long").alias("last_word"),
            F.sort_array(F.array_distinct(F.transform("f.places", lambda p: p["label"]))).alias("phrases"),
            F.col("f.blocks").alias("blocks"),
        ),
        "scanned",
    )
    blocks = materialize(scanned.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.half", "b.words"), "blocks")
    matched = materialize(join_templates(blocks, sets).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment")), "matched")
    rows = scanned.drop("blocks").join(F.broadcast(matched) if matched.count() <= BROADCAST_FOUND else matched, "row", "left")
    labels = F.sort_array(F.array_union("phrases", F.coalesce("found", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("phrases", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents, with the phrases and templates above."""
    return scan_licenses(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _sql() -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({quoted(t['label'])}, [{', '.join(quoted(w) for w in t['words'])}], {t['need']}, {t['half']})" for t in template_sets(TEMPLATES, PERCENT))
    phrases = "\n  UNION ALL ".join(
        f"SELECT rid, i - 1 AS place, {quoted(label)} AS label FROM w, range(1, len(words) + 1) t(i) WHERE words[i:i + {phrase.count(' ')}] = [{', '.join(quoted(p) for p in phrase.split(' '))}]" for phrase, label in PHRASES
    )
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS words FROM documents),
templates(label, words, need, half) AS (VALUES
  {rows}),
places AS (
  {phrases}),
based AS (
  SELECT rid, count(*) AS n, min(place) AS first, max(place) AS last, list(DISTINCT label) AS labels FROM places GROUP BY rid),
blocks AS (
  SELECT rid, half, list_distinct(words[k * half + 1:(k + 2) * half]) AS words
  FROM w, (SELECT DISTINCT half FROM templates), range(0, greatest(ceil(len(words) / half)::BIGINT - 1, 1)) t(k)),
held AS (
  SELECT b.rid, t.label, len(list_intersect(t.words, b.words)) / len(t.words) AS containment
  FROM blocks b JOIN templates t USING (half) WHERE len(list_intersect(t.words, b.words)) >= t.need),
found AS (
  SELECT rid, list(DISTINCT label) AS labels, max(containment) AS containment FROM held GROUP BY rid)
SELECT doc_id, len(w.words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first::BIGINT AS first_word, b.last::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(f.containment, 0) END::DOUBLE AS score
FROM w LEFT JOIN based b USING (rid) LEFT JOIN found f USING (rid)
"""


OP12_SQL = _sql()
