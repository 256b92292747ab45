"""Clauses of sections by runs of rows, against the fold over arrays and a plain version."""

import random
import re

import pytest

from corpusloom.operators import instructions
from pyspark.sql import functions as F


def plain(lines):
    items, current = [], ""
    for line in lines:
        if re.match(instructions.ITEM, line) and current:
            items.append(current)
            current = line
        else:
            current = f"{current} {line}".strip()
    clauses = []
    for item in items + [current]:
        text = re.sub(instructions.ITEM, "", item, count=1).strip()
        parts = re.split(r"(?<=[.;])\s+(?=[A-Z])", text) if len(text.split()) > 80 else [text]
        clauses += [(p.strip(), bool(re.match(instructions.BULLET, item))) for p in parts if p.strip()]
    out, i = [], 0
    fits = [(b or len(t.split()) <= 6) and len(t.split()) <= 25 for t, b in clauses]
    while i < len(clauses):
        text, end = clauses[i][0], i + 1
        if text.endswith(":"):
            while end < len(clauses) and fits[end] and end - i <= 8:
                end += 1
        tail = [re.sub("[ ;,.]+$", "", t) for t, _ in clauses[i + 1 : end]]
        out.append(f"{text} {'; '.join(tail)}." if tail else text)
        i = end
    return out


def made(spark, sections):
    df = spark.createDataFrame([("d", i, lines) for i, lines in enumerate(sections)], "doc_id string, section int, lines array<string>").repartition(3)
    return {r["section"]: r["clauses"] for r in instructions.section_clauses(df).collect()}


def random_lines(rng):
    line = lambda: rng.choice(["- ", "(a) ", "", "", "b) ", "ii. ", "• "]) + " ".join(rng.choice("Staff must be told. of leave; Days count 12 within".split()) for _ in range(rng.choice([1, 3, 5, 8, 30]))) + rng.choice(["", "", ".", ";", ":", ":"])
    return [line() for _ in range(rng.randint(1, 60))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_plain_version(spark, seed):
    rng = random.Random(seed)
    sections = [random_lines(rng) for _ in range(40)]
    sections += [["These are kept:"] + [f"- item {i}:" for i in range(30)], ["- a:", "- b:"], ["Only this"], ["x:"] + ["- y."] * 20 + ["A longer clause that is no item of any list at all, so it stands alone."]]
    got = made(spark, sections)
    assert got == {i: plain(lines) for i, lines in enumerate(sections)}
    folded = spark.createDataFrame(list(enumerate(sections)), "i int, lines array<string>").select("i", instructions.split_items(F.col("lines")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in folded} == got


def test_a_section_of_fifty_thousand_lines(spark):
    lines = ["The following are kept:"] + [f"- item {i}" + (":" if i % 5 == 0 else ";") for i in range(50_000)]
    assert made(spark, [lines, ["short"]]) == {0: plain(lines), 1: ["short"]}


def test_no_sections(spark):
    assert made(spark, []) == {}
