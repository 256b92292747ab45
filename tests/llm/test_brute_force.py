"""Operators against slow, plain versions of what they compute, and against hostile or planted input."""

import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import decontamination, html_extract, language_id, lm_scoring, queries, toxicity

SF = "/root/testdata/sf0.001"
WORDS = "river stone garden window paper yellow silver winter summer market bridge engine candle forest island mirror pocket ribbon saddle tunnel".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "ly"]) for _ in range(n))


# ---- op 2: planted items ------------------------------------------------------------------------------------------


def question(rng, values):
    body = text(rng, 6)
    return f"the {body} carries {values[0]} boxes and {values[1]} crates over {values[2]} km while the {text(rng, 4)} stays near {values[3]} and counts {values[0]} lamps"


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_finds_what_was_planted_and_nothing_else(spark, seed):
    rng, items, docs, want = random.Random(seed), [], [], set()
    names = ["Anna", "Bert", "Cleo", "Dora", "Emil", "Fritz"]
    for item in range(12):
        values = [*(str(v) for v in rng.sample(range(10, 90), 3)), rng.choice(names)]
        own = rng.getrandbits(32)
        whole = question(random.Random(own), values)
        items.append((item, whole))
        others = [*(str(v) for v in rng.sample(range(100, 900), 3)), rng.choice([n for n in names if n != values[3]])]
        changed = question(random.Random(own), others)
        broken = changed[::-1].replace(others[0][::-1], "777"[::-1], 1)[::-1]  # one value of the item stands for two
        for kind, passage in (("copy", whole), ("changed", changed), ("broken", broken), ("none", text(rng, 30)), ("half", " ".join(whole.split()[:9]))):
            doc = len(docs)
            docs.append((doc, f"{text(rng, rng.randint(0, 40))} {passage} {text(rng, rng.randint(0, 40))}".strip()))
            if kind in ("copy", "changed"):
                want.add((doc, item, kind == "copy"))
    docs += [(docs[0][0], docs[0][1]), (None, items[3][1]), (len(docs) + 5, None), (len(docs) + 6, "")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, w int")
    found = {(r["doc_id"], r["item_id"], r["exact"]) for r in decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == want | {(None, 3, True)}


# ---- op 3: the query's choice -------------------------------------------------------------------------------------


def test_language_is_that_of_fewest_phrases(spark):
    rng = random.Random(8)
    letters = {"aa": "abcdef ", "bb": "bcdefg ", "cc": "ghijka "}
    make = lambda k, n: "".join(rng.choice(letters[k]) for _ in range(n))
    rows = [(i, make(k, rng.randint(30, 200)), k) for i in range(60) for k in letters]
    rows = [(i, t, k) for i, (_, t, k) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = language_id.train(df)
    tests = [(i, make(rng.choice(list(letters)), rng.randint(1, 300))) for i in range(60)] + [(90, None), (91, "12 !"), (92, "")]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(tests, "doc_id long, text string"), parser).collect()}
    counts, _, _ = parser.phrases([t or "" for _, t in tests])
    for (i, t), row in zip(tests, counts):
        cost = [n * math.log2(size) for n, size in zip(row, parser.sizes)]
        if re.search("[a-z]", t or ""):
            assert found[i][0] == parser.languages[min(range(3), key=lambda k: (cost[k], k))]
            assert abs(found[i][1] - 1 / sum(2 ** (min(cost) - c) for c in cost)) < 1e-9
        else:
            assert found[i] == ("und", 0.0)


# ---- op 8: the interpolated score ---------------------------------------------------------------------------------


@pytest.mark.parametrize("repeats", [1, 100])
def test_scores_equal_counting_by_hand(spark, monkeypatch, repeats):
    monkeypatch.setattr(lm_scoring, "REPEATS", repeats)
    mixture = np.random.default_rng(1).dirichlet([2, 2, 1], lm_scoring.BUCKETS)
    mixture[0] = [0, 0.7, 0.3]
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda cells, uniform: mixture)
    rng = random.Random(2)
    rows = [(i, text(rng, rng.randint(0, 30)).title(), i % 4 != 0) for i in range(80)] + [(90, None, True), (91, "", False), (92, "never seen words", False)]
    rows += [rows[1], (None, "river stone", True), rows[8], rows[8], (None, "river stone", True)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, trains boolean, n_tokens string").repartition(3)
    from pyspark.sql import functions as F

    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in lm_scoring.score(df, F.col("trains")).collect()), key=repr)
    one, two, n = Counter(), Counter(), 0
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    for _, t, trains in rows:
        if trains:
            s = tokens(t)
            one.update(s)
            two.update(zip([0, *s], s))
            n += 1
    total, known = sum(one.values()), len(one)
    want = []
    for i, t, _ in rows:
        s, score, base = tokens(t), 0.0, 0.0
        for before, w in zip([0, *s], s):
            context = n if before == 0 else one[before]
            weights = mixture[0 if not context else min(1 + int(math.log2(context)), lm_scoring.BUCKETS - 1)]
            score += math.log10(weights[0] * two[before, w] / max(context, 1) + weights[1] * one[w] / total + weights[2] / (known + 1))
            base += math.log10((one[w] + 0.1) / (total + 0.1 * (known + 1)))
        want.append((i, len(s), sum(one[w] > 0 for w in s), round(base, 8), round(score, 8)))
    assert found == sorted(want, key=repr)


def test_weights_make_held_out_counts_likelier():
    rng = np.random.default_rng(3)
    cells = [(int(b) << 24 | int(t) << 12 | int(o), int(n)) for b, t, o, n in zip(rng.integers(0, 6, 300), rng.integers(0, 60, 300), rng.integers(1, 90, 300), rng.integers(1, 50, 300))]
    learnt = lm_scoring.learn_weights(cells, 1e-4)

    def likelihood(weights):
        out = 0.0
        for code, n in cells:
            b, t, o = code >> 24, code >> 12 & 0xFFF, code & 0xFFF
            out += n * math.log(weights[b][0] * (math.exp(-(t - 1) * lm_scoring.STEP) if t else 0) + weights[b][1] * math.exp(-(o - 1) * lm_scoring.STEP) + weights[b][2] * 1e-4)
        return out

    assert np.allclose(learnt.sum(axis=1), 1)
    for _ in range(30):
        other = learnt + rng.uniform(0, 0.05, learnt.shape)
        other[0, 0] = 0
        assert likelihood(learnt) >= likelihood(other / other.sum(axis=1, keepdims=True)) - 1e-6


# ---- op 9: pages that say nothing about their article, and hostile ones --------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_scoring_finds_the_article_where_no_tag_or_class_does(seed):
    rng = random.Random(seed)
    sentence = lambda n: text(rng, n).capitalize() + rng.choice([".", ", " + text(rng, 6) + "."])
    links = lambda n: "<div class='c%d'>%s</div>" % (rng.randint(0, 9), "".join(f"<a href='/{i}'>{text(rng, 2)}</a> " for i in range(n)))
    blocks = [("p", " ".join(sentence(rng.randint(8, 20)) for _ in range(rng.randint(2, 4)))) for _ in range(rng.randint(3, 9))]
    for at in sorted(rng.sample(range(1, len(blocks)), 1)):
        blocks.insert(at, ("h2", text(rng, 3)))
    body = "".join(f"<{tag}>{t}</{tag}>\n" for tag, t in blocks)
    for _ in range(rng.randint(0, 3)):
        body = f"<div class='w{rng.randint(0, 9)}'>{body}</div>"
    page = f"<html><head><title>x</title></head><body>{links(8)}<div class='k1'><div class='k2'>{body}</div>{links(rng.randint(4, 12))}</div>{links(6)}</body></html>"
    assert html_extract.main_text(page) == "\n\n".join(t for _, t in blocks)


@pytest.mark.parametrize(
    "page",
    ["<b>" * 30_000 + "</i>" * 30_000 + "x", "<span>" * 20_000 + "<div>" * 20_000 + "x", "<div>a" * 20_000, "<a '\">" * 60_000, "<li>" * 30_000 + "x", "<table>" * 20_000 + "<tr><td>x", "<!--" * 50_000, "<p>" * 50_000 + "</p>" * 50_000, "<" * 200_000, "<script>" * 30_000, "&" * 200_000, "<i>a</b>" * 40_000],
    ids=range(12),
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 8


# ---- op 10: pairs of terms ----------------------------------------------------------------------------------------


def test_the_factor_form_is_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    machine = toxicity.Machine(np.sort(rng.choice(1 << 32, 50, replace=False).astype(np.uint32)))
    machine.weight, machine.factor, machine.bias = rng.normal(size=50), rng.normal(size=(50, toxicity.FACTORS)), 0.3
    for _ in range(20):
        place = np.sort(rng.choice(50, rng.integers(0, 12), replace=False))
        plain = machine.bias + machine.weight[place].sum() + sum(float(machine.factor[a] @ machine.factor[b]) for i, a in enumerate(place) for b in place[:i])
        assert abs(machine.margin(np.zeros(len(place), np.int64), place, 1)[0][0] - plain) < 1e-9


def test_pairs_are_learnt_whose_terms_say_nothing_alone():
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for _ in range(4_000):
        there = rng.random(40) < 0.5
        rows.append(np.flatnonzero(there).astype(np.uint32) * np.uint32(99_991))
        labels.append(float(there[3] != there[17]))
    labels = np.array(labels)
    rows = [np.sort(r) for r in rows]
    machine = toxicity.fit(rows[:3_000], labels[:3_000], np.ones(3_000))
    assert {3 * 99_991, 17 * 99_991} <= set(machine.kept.tolist())
    score = np.array([machine.score(*machine.keep(np.zeros(len(r), np.int64), r), 1)[0] for r in rows[3_000:]])
    assert ((score > 0.5) == (labels[3_000:] > 0)).mean() > 0.95


# ---- queries with SQL ---------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "conversations"):
        c.sql(f"create view {table} as from '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist()), key=repr) == sorted(map(tuple, want[columns].values.tolist()), key=repr)
