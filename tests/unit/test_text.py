"""Line, page and word rules, one trap each."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scoring
from corpusloom.functions import text as X
from corpusloom.operators import pages, vocabulary
from corpusloom.sources import tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("exam-\nple é-\nb", "example éb"),
        ("a-\nb-\nc", "ab-\nc"),
        ("foo- \nbar", "foo-\nbar"),
        ("so­ft z​w ﻿b\x0cf", "soft zw bf"),
        ("Page 3 of 9\n12/25\n- 7 -\nkept", "kept"),
        ("Ref No: 5 and eleven more words a b c d e f g", "Ref No: 5 and eleven more words a b c d e f g"),
        ("Version 2: one\nx", "Version 2: one\nx"),
        ("Effective Date: 1 May\nx", "x"),
        ("Leave Rules ........ 12\nTotal ______\nx", "x"),
        ("see Page 1 of 2 here", "see here"),
        ("a\n\n\n\nb\n", "a\n\nb"),
        ("a\n--- PAGE 2 ---\n\nb", "a\n\nb"),
        ("x y", "x\ny"),
        ("", ""),
    ],
)
def test_line_rules(spark, raw, clean):
    assert one(spark, X.clean_text(F.col("t")), t=raw) == clean


def test_nfkc_and_null(spark):
    assert one(spark, X.nfkc(F.col("t")), t="ﬁ ２") == "fi 2"
    assert one(spark, X.clean_text(F.col("t")), t=None) is None
    assert one(spark, X.word_count(F.col("t")), t=None) == 0


def test_page_edges(spark):
    df = spark.createDataFrame([("d", 1, "67\ntable\n12\nrow\niv"), ("d", 2, "Civil\nx"), ("d", 3, "- 4 -"), ("d", 4, None)], "doc_id string, page_no int, text string")
    found = {r["page_no"]: r["text"] for r in pages.strip_edge_numbers(df).collect()}
    assert found == {1: "\ntable\n12\nrow\n", 2: "\n", 3: "", 4: ""}


def test_repeated_lines_need_three_pages_and_short_lines(spark):
    long = "h" * 120
    rows = [(d, p, f"Header  x\n{long}\nline {p}") for d, n in (("two", 2), ("three", 3), ("eight", 8)) for p in range(1, n + 1)]
    rows += [("eight", p + 8, "Rare" if p < 4 else "none") for p in range(1, 5)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    found = {(r["doc_id"], r["line"]): r["n_pages"] for r in pages.repeated_lines(df).collect()}
    assert found == {("three", "Header x"): 3, ("eight", "Header x"): 8}


def test_pages_cut_and_joined(spark):
    df = spark.createDataFrame([("d", "intro\n--- PAGE 1 ---\none\n\n--- PAGE 2 ---\ntwo"), ("e", "--- PAGE 1 ---\n")], "doc_id string, text string")
    found = pages.split_pages(df)
    assert sorted((r["doc_id"], r["page_no"], r["text"].strip()) for r in found.collect()) == [("d", 0, "intro"), ("d", 1, "one"), ("d", 2, "two"), ("e", 1, "")]
    assert {r["doc_id"]: r["text"] for r in pages.join_pages(found.where("page_no > 0")).collect()}["d"] == "--- PAGE 1 ---\none\n\n--- PAGE 2 ---\ntwo"


def test_split_words_are_joined_from_left_to_right(spark):
    text = "exc eeding the limit. exceeding dis rupt, disrupt b ut x.\nwith out Rep eat repeat"
    df = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in vocabulary.repair_split_words(df).collect()}
    assert found[1] == "exceeding the limit. exceeding disrupt, disrupt b ut x.\nwith out Repeat repeat" and found[2] == "nothing here" and found[3] is None
    few = spark.createDataFrame([(1, "x exc eeding")], "doc_id long, text string")
    words = spark.createDataFrame([("exceeding", 1), ("exc", 9), ("eeding", 3)], "word string, n long")
    assert vocabulary.repair_split_words(few, words).first()["text"] == "x exc eeding"  # both parts are too common


def test_counts_of_words_are_not_broadcast_and_batches_have_few_bytes(spark):
    df = spark.createDataFrame([(i, f"exc eeding {'ab' * i} exceeding") for i in range(1, 20)], "doc_id long, text string")
    assert "BroadcastHashJoin" not in vocabulary.joinable(df)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert {r["text"].split()[0] for r in vocabulary.repair_split_words(df).collect()} == {"exceeding"}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == tables.BATCH_BYTES


def test_keywords_and_prefixes(spark):
    words = F.array(F.lit("Rs. 10"), F.lit("a+b"))
    got = [one(spark, scoring.keyword_verdict(F.col("t"), words), t=t) for t in ("rs. 10 only", "rs. 1000", "rs. 10,000", "", None, "A+B")]
    assert got == [True, False, False, False, False, True]
    assert one(spark, scoring.keyword_verdict(F.col("t"), F.array(F.lit("100"))), t="at 100°c")
    assert one(spark, scoring.strict_prefix(F.col("t"), F.col("f")), t="- Paris, of course", f="paris")


def plain_rouge(a, b):
    import re

    p, r = re.findall(r"\w+", (a or "").lower()), re.findall(r"\w+", (b or "").lower())
    row = [0] * (len(r) + 1)
    for x in p:
        new = [0]
        for j, y in enumerate(r):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 2 * row[-1] / (len(p) + len(r)) if row[-1] else 0.0


@pytest.mark.parametrize(("a", "b"), [("a b c d", "a c e d"), ("", "x"), (None, None), ("same words", "same words"), ("x y", "p q"), ("the cat the dog", "dog the cat the")])
def test_rouge(spark, a, b):
    assert abs(one(spark, scoring.rouge_l(F.col("a"), F.col("b")), a=a, b=b) - plain_rouge(a, b)) < 1e-12


def test_truncation(spark):
    assert one(spark, X.truncate_words(F.col("t"), 3), t="a b c") == "a b c"
    assert one(spark, X.truncate_words(F.col("t"), 5), t="one two three. four five six") == "one two three."
    assert one(spark, X.truncate_words(F.col("t"), 4), t="aa. bbbbbbbbb cccccccc dddddd eeee") == "aa. bbbbbbbbb cccccccc dddddd ..."
    assert one(spark, X.first_sentences(F.col("t")), t="One. Two. three. Four.") == "One. Two. three."
