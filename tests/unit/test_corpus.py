"""Folds against sequential versions: near duplicates, pair dedup, splits, packing, sections, curves."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.operators import blocks, dedup, funnel, instructions, metrics, split
from corpusloom.operators.prefix import prefix_sums


@pytest.mark.parametrize("seed", range(3))
def test_survivors_equal_a_sequential_pass(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.06}
    passes = [rng.random() < 0.8 for _ in range(n)]
    kept, want = set(), {}
    for i in range(n):
        if any((i, k) in edges for k in kept):
            want[i] = "near"
        else:
            want[i] = "kept" if passes[i] else "blocked_language"
            if passes[i]:
                kept.add(i)
    nodes = spark.createDataFrame(list(enumerate(passes)), "doc_id long, passes boolean")
    found = dedup.survivors(nodes, spark.createDataFrame(sorted(edges), "later long, earlier long"))
    assert {r["doc_id"]: r["fate"] for r in found.collect()} == want


def test_pair_dedup_equals_a_sequential_pass(spark):
    rng = random.Random(4)
    rows = [(i, f"Q {rng.randint(0, 12)}?", f"a {rng.randint(0, 12)}") for i in range(60)]
    seen, want = set(), []
    for i, q, a in rows:
        if q not in seen and a not in seen:
            want.append(i)
            seen |= {q, a}
    df = spark.createDataFrame(rows, "id long, instruction string, response string")
    assert sorted(r["id"] for r in instructions.dedup_pairs(df).collect()) == want


def test_records_have_one_reason_each(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randint(0, 900)}" for _ in range(150))
    rows = [(1, text, "en"), (2, text.upper(), "en"), (3, text + " tail", "en"), (4, text[: len(text) // 3], "en"), (5, " ".join(f"v{i}" for i in range(120)), "fr"), (6, " ".join(f"v{i}" for i in range(120)), "en"), (7, " ".join(f"u{i}" for i in range(120)), None), (8, None, "en")]
    df = spark.createDataFrame([(i, t, t, k) for i, t, k in rows], "doc_id long, raw string, text string, lang string")
    found = {r["doc_id"]: (r["reason"], r["duplicate_of"], r["language"]) for r in dedup.cleaning_records(df).collect()}
    assert found == {
        1: ("passes_filters", None, "en"), 2: ("exact_duplicate", 1, "not_checked"), 3: ("near_duplicate", 1, "not_checked"), 4: ("below_min_words", None, "not_checked"),
        5: ("non_english", None, "fr"), 6: ("exact_duplicate", 5, "not_checked"), 7: ("language_detection_failed", None, "unknown"), 8: ("below_min_words", None, "not_checked"),
    }


def test_records_tell_the_similarity_below_the_threshold(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [base, base[:100] + [f"x{i}" for i in range(50)], [f"z{i}" for i in range(60)] + base[60:], [f"q{i}" for i in range(120)], base[:149] + ["y"], base[:40] + [f"r{rng.randint(0, 9)}" for _ in range(80)]]
    langs = ["en", "fr", "en", "en", "en", "en"]
    df = spark.createDataFrame([(i, " ".join(w), " ".join(w), k) for i, (w, k) in enumerate(zip(texts, langs, strict=True))], "doc_id long, raw string, text string, lang string")
    kept, want = {}, {}
    for i, (w, k) in enumerate(zip(texts, langs, strict=True)):
        mine = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        want[i] = max((len(mine & s) / len(mine | s) for s in kept.values()), default=0.0)
        if want[i] < 0.8 and k == "en":
            kept[i] = mine
    found = {r["doc_id"]: r["max_similarity"] for r in dedup.cleaning_records(df).collect()}
    assert found == pytest.approx(want) and 0 < found[1] < 0.8 and found[3] == 0 and found[4] >= 0.8
    assert {r["doc_id"] for r in funnel.most_similar(dedup.cleaning_records(df)).collect()} == set(kept)


def test_similarity_of_just_the_threshold_counts(spark):
    a = [f"w{i}" for i in range(13)]  # 9 shingles
    b = a[:-1] + ["x"]  # 8 in common of 10
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "日本"), (4, "中国")], "doc_id long, text string")
    found = {(r["later"], r["earlier"]): r["similarity"] for r in dedup.similar_pairs(df).collect()}
    assert found == {(2, 1): 0.8, (4, 3): 1.0}  # texts without Latin words have the empty shingle alone


def test_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 9)) for i in range(100)]
    found = {r["i"]: r["before"] for r in prefix_sums(spark.createDataFrame(rows, "i long, n long").repartition(5), ["i"], "n", "before").collect()}
    assert found == {i: sum(n for j, n in rows if j < i) for i, _ in rows}


def test_unseen_documents_skip_what_is_too_large(spark):
    import hashlib

    rng = random.Random(7)
    rows = [(i, rng.choice([3, 5, 8, 60])) for i in range(60)]
    total = sum(n for _, n in rows)
    taken, at, target = [], 0, 0.05 * total
    for i, n in sorted(rows, key=lambda r: hashlib.sha256(f"42|{r[0]}".encode()).hexdigest()):
        if at >= target:
            break
        if at + n <= 1.5 * target:
            taken.append(i)
            at += n
    found = split.unseen_documents(spark.createDataFrame(rows, "doc_id long, words long"), Settings())
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(taken)


@pytest.mark.parametrize(
    ("text", "head", "tail", "how"),
    [
        ("a " * 90 + "\n\n" + "b " * 10, "a " * 89 + "a", "b " * 9 + "b", "paragraph"),
        ("a " * 80 + "\n\n" + "b " * 8 + "\n" + "c " * 12, ("a " * 80 + "\n\n" + "b " * 8).strip(), "c " * 11 + "c", "line"),
        ("a " * 50 + "\n" + "b " * 50, None, None, "words"),
        ("", "", "", "words"),
        (None, "", "", "words"),
    ],
)
def test_tails(spark, text, head, tail, how):
    r = spark.createDataFrame([(text,)], "t string").select(split.tail_split(F.col("t"), 0.1).alias("s")).first()["s"]
    assert r["how"] == how
    if head is not None:
        assert (r["head"].strip(), r["tail"].strip()) == (head.strip(), tail.strip())
    else:
        assert len(r["head"].split()) == 90 and len(r["tail"].split()) == 10


def test_validation(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    for rows, fraction in ((docs, 0.1), (docs.limit(1), 0.1), (docs, 1.0)):
        with pytest.raises(ValueError):
            split.validate(rows, fraction)


def test_groups_are_never_split(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, f"g{rng.randint(0, 9)}") for i in range(100)], "id long, g string")
    rows = split.grouped_split(df, "g", 0.8, 42, F.col("g") == "g3").collect()
    sides = {}
    for r in rows:
        sides.setdefault(r["g"], set()).add(r["split"])
    assert len(rows) == 100 and all(len(s) == 1 for s in sides.values()) and sides["g3"] == {"train"}
    assert sum(r["split"] == "train" for r in rows) >= 80


@pytest.mark.parametrize("sizes", [[14], [6, 6], [5, 6], [30, 1, 2], [0]])
def test_blocks_equal_one_stream(spark, sizes):
    rows = [(name, i, " ".join(f"w{i}x{k}" for k in range(n))) for name in ("train", "eval") for i, n in enumerate(sizes)]
    df = blocks.encode(spark.createDataFrame(rows, "split string, document_id int, text string"))
    found = {(r["split"], r["block"]): r["input_ids"] for r in blocks.pack_blocks(df, 8).collect()}
    for name in ("train", "eval"):
        stream = [t for r in sorted(df.where(F.col("split") == name).collect(), key=lambda r: r["document_id"]) for t in r["ids"]]
        cut = [stream[k : k + 8] for k in range(0, len(stream), 8)]
        if len(cut[-1]) < 8 and (name == "train" or len(cut[-1]) == 1):
            cut.pop()
        assert [found[k] for k in sorted(found) if k[0] == name] == cut


def test_sections_and_clauses(spark):
    text = "Intro line\n1. Purpose - why it is\nmore of it\n2.1 Scope of the\n30 days notice\nLEAVE RULES:\n(a) first item that\nis wrapped\n(b) types:\n- casual;\n- sick\nEMPTY PART\nANNEXURE A\nx"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = sorted(instructions.split_sections(df).select("section", "heading", "lines", instructions.split_items(F.col("lines")).alias("items")).collect(), key=lambda r: r["section"])
    assert [(r["section"], r["heading"], r["lines"]) for r in rows] == [
        (0, "Overview", ["Intro line"]), (1, "Purpose", ["why it is", "more of it", "2.1 Scope of the"]),
        (2, "Leave Rules", ["(a) first item that", "is wrapped", "(b) types:", "- casual;", "- sick"]), (3, "Empty Part", ["ANNEXURE A", "x"]),
    ]
    assert rows[2]["items"] == ["first item that is wrapped", "types: casual; sick."]


def test_subjects(spark):
    df = spark.createDataFrame([("The Employee",), ("HR team",), (" any staff",)], "s string")
    assert [r["x"] for r in df.select(instructions.clean_subject(F.col("s")).alias("x")).collect()] == ["employee", "HR team", "staff"]


def test_curves(spark):
    losses = [5.0, 4.0, 3.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0]
    curve = spark.createDataFrame([("r", i, x, None) for i, x in enumerate(losses)] + [("flat", 0, 1.0, 2.0), ("flat", 1, 1.0, 2.0), ("none", 0, None, 1.0)], "run string, step int, loss double, eval_loss double")
    summary = {r["run"]: r for r in metrics.curve_summary(curve).collect()}
    assert summary["r"]["last_nonzero"] == 1.0 and summary["r"]["min_step"] == 12 and "none" not in summary
    assert summary["flat"]["min_step"] == 0
    assert {r["run"]: r["plateau_step"] for r in metrics.plateau(curve, 2).collect()} == {"r": 5, "flat": None}
    assert {r["run"]: r["heldout_plateau_step"] for r in metrics.heldout_plateau(curve).collect()} == {"flat": 0, "none": None}
    sweep = spark.createDataFrame([("a", "2/3", 5.0), ("b", "3/3", 7.0), ("c", "3/3", 6.0), ("d", "3/3", 6.0)], "candidate string, general_facts_kept string, heldout_ppl double")
    assert metrics.select_candidate(sweep).first()["candidate"] == "c"


def test_most_similar_kept_orders_by_the_rounded_similarity(spark, monkeypatch):
    """As its SQL does: of two that round alike the smaller id comes first."""
    from corpusloom.plans import catalogue

    rows = spark.createDataFrame([(9, "kept", 0.5000001), (10, "kept", 0.5000002), (11, "kept", 0.4)], "doc_id long, status string, max_similarity double")
    monkeypatch.setattr(catalogue, "full_records", lambda spark, sf_dir: rows)
    assert [tuple(r) for r in catalogue.most_similar_kept(spark, "").collect()] == [(9, 0.5), (10, 0.5), (11, 0.4)]
