"""The audit of filter orders against applying every order document by document."""

import itertools
import math
import random
import re

import pytest

from corpusloom.llm import filter_audit

DOCS = "doc_id long, text string, source string, mask int, n_words string, first_of string"


def fails(doc_id, text, rows):
    text = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    return "".join(
        letter
        for letter, failed in (
            ("A", len(words) < 50),
            ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)),
            ("D", any(c in "#$%&*|" for c in text)),
            ("E", doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)),
        )
        if failed
    )


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, removed = {}, {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, fails(i, t, rows)) for i, t, s in rows if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                failing = [x for x in own if letter in x[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == letter for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                removed[part, letter] = removed.get((part, letter), 0) + len(gone)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = filter_audit.mask_counts(filter_audit.masked(filter_audit.measured(df)), marks)
    found = filter_audit.audit(filter_audit.lattice_edges(counts)).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in found}


def test_equals_applying_every_order(spark):
    """Nulls in every column, empty and long texts, repeated rows, ids that repeat in both tables, columns of clashing names."""
    rng = random.Random(11)
    long_text = " ".join(f"w{i}" for i in range(30_000))
    texts = ["", None, "one two", "ABC DEF", "a # b", " ".join(["same"] * 60), " ".join(f"x{i}" for i in range(60)), "É " * 55, long_text, "Q" * 200, " ".join(f"y{i}" for i in range(55)) + " $"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(80)]
    rows += [(7, "one two", "a")] * 3
    labels = [(rng.choice([None, *range(45)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    got, want = audited(spark, rows, labels), plain(rows, labels)
    assert len(got) == len({s or "" for _, _, s in rows}) * math.factorial(5) * 5
    assert got == want


def test_a_table_without_rows_has_no_parts(spark):
    assert audited(spark, [], []) == {}


def test_hot_text_is_joined_in_parts(spark, monkeypatch):
    """Beyond what is broadcast, copies are dealt out; the result is the same."""
    from corpusloom.operators import dedup

    rows = [(i, "same text" if i % 3 else f"own {i}", f"s{i % 2}") for i in range(60)]
    want = audited(spark, rows, [(1, 1, 0), (2, 0, 1)])
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dedup, "SPREAD", 7)
    assert audited(spark, rows, [(1, 1, 0), (2, 0, 1)]) == want == plain(rows, [(1, 1, 0), (2, 0, 1)])


def test_orders_of_many_filters_are_refused(spark):
    with pytest.raises(ValueError):
        filter_audit.order_steps(spark, {c: "true" for c in "ABCDEFGH"})


def test_every_step_of_every_order_is_an_edge(spark):
    steps = filter_audit.order_steps(spark).collect()
    assert len(steps) == 600 and len({(r["filter"], r["before"]) for r in steps}) == 80
