"""The language detector against a plain version, on held-out documents, and in the cleaning chain."""

import collections
import os
import re
import unicodedata

import pytest

from corpusloom.config import Settings
from corpusloom.functions import text as X
from corpusloom.operators import cleaning, language
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LABELLED = [
    ("the house stands on the hill and the door is open to the wind", "en"), ("she said that they would come in the morning with the others", "en"),
    ("das haus steht auf dem hügel und die tür ist offen für den wind", "de"), ("sie sagte dass sie am morgen mit den anderen kommen würden", "de"),
    ("дом стоит на холме и дверь открыта ветру", "ru"), ("ohne marke", None), (None, "en"), ("123", "de"),
]


def grams(text):
    return [f" {w} "[i : i + 3] for w in re.split(r"[\W\d_]+", (text or "").lower()) if w for i in range(len(w))]


def plain(labelled, text, size):
    counts = collections.defaultdict(collections.Counter)
    for t, lang in labelled:
        if lang is not None:
            counts[lang].update(grams(t))
    profiles = {lang: {g: size - i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])} for lang, c in counts.items()}
    worth = {lang: sum(p.get(g, 0) for g in grams(text)) for lang, p in profiles.items()}
    best = min(worth, key=lambda lang: (-worth[lang], lang))
    return best if worth[best] else None


@pytest.mark.parametrize("size", [400, 12])
def test_equals_a_plain_version(spark, size):
    labelled = spark.createDataFrame(LABELLED, "text string, lang string")
    texts = [None, "", "42 !?", "字 字", "the wind and the door", "der wind und die tür", "ветер и дверь", "Das Haus", "en", "X", "wind wind wind", "the\nhouse2und"] + [t for t, _ in LABELLED]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["language"] for r in language.detect(df, language.learn_profiles(labelled, size=size)).collect()}
    assert got == {i: plain(LABELLED, t, size) for i, t in enumerate(texts) if plain(LABELLED, t, size)}


def test_no_labels_no_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.learn_profiles(none).count() == 0
    df = spark.createDataFrame([(1, "the house")], "doc_id long, text string")
    assert language.detect(df, language.learn_profiles(none)).count() == 0
    assert language.detect(none, language.learn_profiles(spark.createDataFrame(LABELLED, "text string, lang string"))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").withColumn("held", F.col("doc_id") % 5 == 0)
    found = language.detect(docs.where("held"), language.learn_profiles(docs.where("not held")))
    rows = docs.where("held").join(found, "doc_id", "left").where(F.size(language.letter_words(F.col("text"))) > 0).select("lang", "language").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["language"] for r in rows) >= 0.99 * len(rows)


def test_the_chain_detects_and_tells_failures(spark):
    profiles = language.learn_profiles(spark.createDataFrame(LABELLED, "text string, lang string"))
    files = [("a.txt", "the house and the door and the hill in the wind"), ("b.txt", "das haus und die tür auf dem hügel"), ("c.txt", "1 2 3 4 5 6"), ("d.txt", "short")]
    records, kept = cleaning.clean_corpus(spark.createDataFrame(files, "file_name string, text string"), Settings(min_words=3), profiles=profiles)
    found = {r["file_name"]: (r["reason"], r["language"]) for r in records.collect()}
    assert found == {"a.txt": ("passes_filters", "en"), "b.txt": ("non_english", "de"), "c.txt": ("language_detection_failed", "unknown"), "d.txt": ("below_min_words", "not_checked")}
    assert [r["file_name"] for r in kept.collect()] == ["a.txt"]


def test_nfkc_goes_to_python_only_where_it_may_change_a_text(spark):
    texts = [None, "", "plain", "é — “quoted”", "漢字", "한국", "e\u0301", "ﬁles", "％", "½", "a\u00a0b", "\u1112\u1161\u11ab", "ｱ", "Ǆ", "\u0344", "x\u0323\u0307", "…"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: (r["n"], r["goes"]) for r in df.select("i", X.nfkc(F.col("text")).alias("n"), F.col("text").rlike(f"[^{X.nfkc_safe()}]").alias("goes")).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    assert [texts[i] for i in got if got[i][1] is False] == ["", "plain", "é — “quoted”", "漢字", "한국"]


def test_safe_code_points_stay_as_they_are_side_by_side():
    safe = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", X.nfkc_safe())
    inside = re.compile(f"[{safe}]")
    points = [c for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) <= 0xDFFF and inside.match(c)]
    assert len(points) > 30_000
    for text in ("".join(points), "".join(reversed(points)), "e".join(points)):
        assert unicodedata.is_normalized("NFKC", text)
