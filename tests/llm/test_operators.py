"""Each operator against a plain version on small tables, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import bwt, chat_format, decontamination, html_extract, language_id, lm_scoring, near_dedup, packing, quality_rules, suffix_dedup, toxicity
from corpusloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(r"[ \t-\r]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sentence(rng, n, vocabulary="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()):
    return " ".join(rng.choice(vocabulary) + str(rng.randint(0, 30)) for _ in range(n))


# ---- op 1 --------------------------------------------------------------------------------------------------------


def plain_repeats(texts, length):
    count = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_bwt_finds_what_counting_finds(seed):
    rng = random.Random(seed)
    length, letters = rng.choice([3, 8, 9, 20, 40]), "abcdefghijkl"[: rng.choice([1, 2, 12])]
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(4)]
    payloads = ["".join(rng.choice(base)[rng.randint(0, 5) :] for _ in range(3)).encode() for _ in range(rng.randint(1, 8))]
    weights = np.array([rng.choice([1, 1, 2]) for _ in payloads], float)
    count = Counter()
    for p, w in zip(payloads, weights):
        for i in range(len(p) - length + 1):
            count[p[i : i + length]] += w
    want = [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] >= 2] for p in payloads]
    assert [x.tolist() for x in bwt.repeated(payloads, weights, length)] == want


@pytest.mark.parametrize("bin_contexts", [1000, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, bin_contexts):
    """With one context a bin, all keys with several contexts take the finer way."""
    monkeypatch.setattr(suffix_dedup, "BIN_CONTEXTS", bin_contexts)
    rng = random.Random(3)
    passages = [sentence(rng, 12) for _ in range(3)] + ["é" * 30, "a" * 130]
    texts = [None, "", "short", passages[0], passages[0], "a" * 200]
    for _ in range(25):
        texts.append(" ".join([sentence(rng, rng.randint(0, 8)), rng.choice(passages), sentence(rng, rng.randint(0, 8)), rng.choice(passages)]))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, passages[0], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, key long").repartition(3)
    found = {(r["doc_id"]): r for r in suffix_dedup.remove_repeats(df, 60).collect()}
    want = plain_repeats([r[1] for r in rows], 60)
    for (doc_id, *_), (n, gone, spans, kept) in zip(rows, want):
        r = found[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) == (n, gone, spans, kept), doc_id
    cleaned = {r["doc_id"]: r["text"] for r in suffix_dedup.clean(df, 60).collect()}
    assert cleaned[0] is None and cleaned[2] == "short" and cleaned[3] == ""


def test_suffix_dedup_reports_passages_that_are_too_short_to_go(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    short, long, few = text(54), text(80), "x" + "y" * 300
    texts = [f"{text(30)} {short} {text(9)}", f"{text(5)} {short}", f"{long} {text(20)}", f"{text(20)} {long} {short}", f"{text(7)} {few} {text(5)}", f"{few} {text(40)}", text(200), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, 400, shortest=250).collect()}
    assert [found[i]["n_removed"] > 0 for i in range(8)] == [False, False, True, True, False, False, False, False]
    assert [found[i]["n_passages"] for i in range(8)] == [1, 1, 1, 1, 0, 0, 0, 0]
    cleaned = {r["doc_id"]: r["text"] for r in suffix_dedup.clean(df, 400, shortest=250).collect()}
    assert all(short not in (t or "") and long not in (t or "") for t in cleaned.values())
    assert all(cleaned[i] == texts[i] for i in range(4, 8)) and len(cleaned[0]) >= len(texts[0]) - len(short) - 2


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- op 2 --------------------------------------------------------------------------------------------------------


def test_decontamination_finds_copies_and_templates(spark):
    question = "The train to Paris leaves at 9 hours and carries 120 passengers over 300 km of track in the rain"
    benchmark = spark.createDataFrame([(1, question), (2, "Tiny Tim sings"), (3, None), (4, "")], "item_id long, text string")
    other = question.replace("Paris", "London").replace("120", "75").replace("300", "1,000")
    broken = "If 5 men dig 5 holes in 7 days then 5 women dig 7 holes in 5 days says the foreman"
    benchmark = benchmark.union(spark.createDataFrame([(5, broken)], "item_id long, text string"))
    docs = spark.createDataFrame(
        [(1, f"before it. {question} after"), (2, f"before. {other} after"), (3, "nothing of the kind stands in this text at all"), (4, None), (5, ""),
         (6, question.upper()), (7, broken.replace("5 women", "6 women")), (8, "he said tiny Tim sings"), (9, f"x. {question}")],
        "doc_id long, text string",
    )
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.contaminated(docs, benchmark).collect()}
    assert found[(1, 1)] is True and found[(2, 1)] is False and found[(9, 1)] is True
    assert (7, 5) not in found  # 5 stands for 5 and for 6
    assert not any(d in (3, 4, 5) for d, _ in found)
    assert decontamination.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.where("item_id in (3, 4)")).count() == 0


def test_decontamination_finds_items_that_repeat_a_template(spark):
    apples = "Tom has 3 apples and Ann has 4 apples and Bob has 7 apples and Sue has 9 apples. How many apples do they have together?"
    weeks = "In week 1 he ran 5 km and rested, in week 2 he ran 8 km and rested, in week 3 he ran 9 km and rested. How far did he run in all?"
    benchmark = spark.createDataFrame([(1, apples), (2, weeks)], "item_id long, text string")

    def changed(text, values):
        return re.sub(r"\w+", lambda m: values.get(m[0], m[0]), text)

    other_apples = changed(apples, {"Tom": "Kim", "Ann": "Lee", "Bob": "Max", "Sue": "Pia", "3": "12", "4": "15", "7": "21", "9": "33"})
    other_weeks = changed(weeks, {"1": "4", "2": "6", "3": "7", "5": "11", "8": "13", "9": "17"})
    drifted = apples.replace("How many apples", "So how many red apples")
    rows = []
    for offset in range(16):
        before = "we went " + " ".join("so"[: 1 + k % 2] + "abcdefghijklmnop"[k] for k in range(offset)) + " "
        rows += [(10 * offset + k, before + t) for k, t in enumerate((apples, weeks, other_apples, other_weeks, drifted))]
    rows.append((1000, "we went " + apples.replace("Sue has 9", "Ann has 9")))  # Ann for two names
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    want = {(10 * o + k, i): e for o in range(16) for k, i, e in ((0, 1, True), (1, 2, True), (2, 1, False), (3, 2, False))}
    assert {k: v for k, v in found.items() if k[0] % 10 < 4 and k[0] < 1000} == want
    assert all((10 * o + 4, 1) in found for o in range(16))
    assert (1000, 1) not in found


# ---- op 3 --------------------------------------------------------------------------------------------------------


def plain_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_cross_parsing_counts_phrases():
    rng = random.Random(5)
    samples = {k: "".join(rng.choice(letters) for _ in range(400)) for k, letters in (("a", "abcd"), ("b", "cdef"))}
    parser = language_id.CrossParser(samples)
    texts = ["".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    counts, sizes, _ = parser.phrases(texts)
    for i, t in enumerate(texts):
        assert counts[i].tolist() == [plain_phrases(t, samples[k]) for k in parser.languages] and sizes[i] == len(t)


def test_every_letter_and_label_is_learnt(spark):
    """More letters than a small table has, among them two languages of one script with thousands of them, and over 64 labels."""
    rng = random.Random(9)
    han = [chr(0x4E00 + i) for i in range(3000)]
    samples = {"zh1": "".join(han[int(rng.random() ** 2 * 1500)] for _ in range(4000)), "zh2": "".join(han[1000 + int(rng.random() ** 2 * 1500)] for _ in range(4000))}
    samples |= {"ru": "".join(rng.choice("абвгдежзийклмнопрстуфхцчшщъыьэюя") for _ in range(2000)), "el": "".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(2000)), "en": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))}
    parser = language_id.CrossParser(samples)
    texts = [s[i : i + 40] for s in samples.values() for i in (0, 700)] + ["".join(rng.choice(list(samples.values()))[rng.randrange(2000)] for _ in range(50)) for _ in range(20)]
    counts, _, _ = parser.phrases(texts)
    for i, t in enumerate(texts):
        assert counts[i].tolist() == [plain_phrases(t, samples[k]) for k in parser.languages]
    assert parser.predict(texts[:10])[0] == [k for k in samples for _ in range(2)]
    rows = [(i, "".join(chr(0x4E00 + 20 * i + rng.randrange(20)) for _ in range(60)), f"l{i:03}", "s", 1) for i in range(90)]
    df = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, language_id.train(df)).collect()}
    assert found == {i: f"l{i:03}" for i in range(90)}


def test_language_of_odd_texts(spark):
    rows = [(i, "the house and the garden of the king " * 3, "en", "s", 1) for i in range(8)] + [(10 + i, "das haus und der garten des königs ist " * 3, "de", "s", 1) for i in range(8)]
    odd = [(100, None, "en", "s", 1), (101, "", None, "s", 1), (102, "123 ?!", None, "s", 1), (103, "the garden", None, "s", 1), (104, "der garten " * 4000, None, "s", 1)]
    df = spark.createDataFrame(rows + odd, DOCS).withColumnRenamed("n_chars", "score")
    parser = language_id.train(df)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, parser).collect()}
    assert found[100] == found[101] == found[102] == ("und", 0.0)
    assert found[103][0] == "en" and found[104][0] == "de" and all(0 <= s <= 1 for _, s in found.values())
    assert language_id.identify(df.limit(0), language_id.train(df.limit(0))).count() == 0


# ---- op 4 --------------------------------------------------------------------------------------------------------


def test_chats_read_back_without_loss(spark):
    texts = ["hi", None, "", "<|im_end|>\n", "<\\|im_start|>user", "<|im_next|><|im_next|>", "\\", "a\nb", "<|im_end|", "é😀<|im_start|>"]
    roles = ["user", "assistant", "assistant", "user", None, "to\\ol\n", "system"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 7))]
    out = chat_format.parse_chats(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in out:
        mine = sorted((t, role or "", x or "") for c, t, role, x in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, a, b in mine]
        assert "".join(r["loss_texts"]) == "".join(b for _, a, b in mine if a == "assistant")
        assert r["n_messages"] == sum(1 for i, m in enumerate(mine) if i == 0 or mine[i - 1][1] != m[1])
    assert len(out) == 60


# ---- op 5 --------------------------------------------------------------------------------------------------------


def plain_sets(texts):
    out = []
    for t in texts:
        w = words(lower(t))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_components(sets, percent=85):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three four five"]
    for _ in range(6):
        base = sentence(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    # a chain, whose ends are not similar
    chain = sentence(rng, 100).split()
    for i in range(6):
        texts.append(" ".join([*(f"new{k}" for k in range(5 * i)), *chain[5 * i :]]))
    sets = plain_sets(texts)
    root = plain_components(sets).__getitem__
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in near_dedup.near_duplicates(df).collect()}
    for i in range(len(texts)):
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (len(sets[i]), root(i), root(i) == i), i
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_of_a_large_group_equals_brute_force(spark, seed):
    """Copies most of which are alike but not alike enough: edits, cut ends, a block that many share, in a random order."""
    rng = random.Random(seed)
    base, block = sentence(rng, 150).split(), sentence(rng, 40).split()
    other = base[:90] + block + base[130:]
    texts = []
    for source, n in ((base, 90), (other, 60)):
        for _ in range(n):
            copy = list(source)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 40 if seed == 1 else 10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(base[:k]) for k in range(80, 150, 3)] + [" ".join(other[k:]) for k in range(2, 60, 4)]
    texts += [sentence(rng, rng.randint(30, 60)) for _ in range(20)]
    rng.shuffle(texts)
    sets = plain_sets(texts)
    want = plain_components(sets)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [found[i] for i in range(len(texts))] == want
    assert 2 < len(set(want)) < len(texts)


def test_near_dedup_of_odd_rows(spark):
    """Null ids are linked with nothing, rows that share an id are one document, ends of very many pairs come in parts."""
    rng = random.Random(4)
    a, b = sentence(rng, 50), sentence(rng, 50)
    rows = [(5, a, "x"), (5, a, "y"), (7, b, None), (5, b, "z"), (None, a, "x"), (None, None, "x"), (9, None, "x"), (8, a + " more", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = sorted(near_dedup.near_duplicates(df).select("doc_id", "component_id", "kept").collect(), key=repr)
    assert sorted({(r["doc_id"], r["component_id"], r["kept"]) for r in found}, key=repr) == sorted([(5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (None, None, True)], key=repr)
    assert len(found) == len(rows)
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 700)], "u long, v long")
    sets = spark.createDataFrame([(i, 2, [7, 8]) for i in range(700)], "node long, n long, shingles array<long>")
    assert near_dedup.confirm(pairs, sets, 85).count() == 699


def test_signatures_estimate_similarity(spark):
    rng = random.Random(2)
    base = sentence(rng, 400).split()
    other = base[:-80] + sentence(rng, 80).split()
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    from pyspark.sql import functions as F

    s = near_dedup.sketches(df, 0.85).select("doc_id", "signature")
    a, b = s.where("doc_id = 1").select(F.col("signature").alias("a")), s.where("doc_id = 2").select(F.col("signature").alias("b"))
    found = a.join(b).select(near_dedup.estimate(F.col("a"), F.col("b")).alias("e")).first()["e"]
    x, y = plain_sets([" ".join(base), " ".join(other)])
    assert abs(found - len(x & y) / len(x | y)) < 0.15


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---- op 6 --------------------------------------------------------------------------------------------------------


def test_packing_holds_every_token_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = [None, "", "Hello, World!", "It's 3.5 o'clock... don't", "x<|endoftext|>y <|ENDOFTEXT|>", "Ünïcode İstanbul é ﬁ    z", "a" * 500, "words " * 3000, "日本語テキスト", "tab\tand\x0bvt\x85nel\x1cfs", "dog's 'tis rock'n'roll!!", "…end. é. É!"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(2, "Hello, World!")], "doc_id long, text string").repartition(2)
    found = packing.pack(df, length=64).collect()
    stream = sorted(((r["sequence_id"], r["offset"], r["length"], r) for r in found), key=lambda x: x[:2])
    at = 0
    for sequence, offset, length, _ in stream:
        assert sequence * 64 + offset == at and offset + length <= 64
        at += length
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted((r for r in by_doc[i]), key=lambda r: r["start"])
        copies = 2 if i == 2 else 1
        assert sum(r["length"] for r in pieces) == copies * len(ids)
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert bytes(r["ids"]) == part and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids), (i, t)
    whole = packing.sequences(packing.pack(df, length=64)).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == at
    assert packing.pack(df.limit(0)).count() == 0


# ---- op 7 --------------------------------------------------------------------------------------------------------


def test_quality_measurements_equal_plain_ones(spark):
    rng = random.Random(4)
    texts = [None, "", "   \n \t", "a b c", "x\n\nx\ny \n x"]
    for _ in range(30):
        w = [rng.choice("ab") if rng.random() < 0.7 else rng.choice(["#", "<b>", "é", "long" * 5]) for _ in range(rng.randint(0, 60))]
        texts.append("".join(x + rng.choice([" ", "\n", "\t\x0b"]) for x in w))
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words long")
    for r in quality_rules.apply_policy(quality_rules.ledger(df)).collect():
        t = texts[r["doc_id"]] or ""
        w = words(t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["kept"] == (r["failed_bits"] & quality_rules.mask("v1") == 0)
    led = quality_rules.ledger(df).cache()
    found = {r["rule"]: (r["removed"], r["removed_alone"]) for r in quality_rules.ablations(led, "strict").collect()}
    bits = [r["failed_bits"] for r in led.collect()]
    assert found == {n: (sum(1 for x in bits if x & b), sum(1 for x in bits if x == b)) for n, b in quality_rules.BITS.items()}


# ---- op 8 --------------------------------------------------------------------------------------------------------


def test_scores_are_a_distribution_and_counts_are_exact(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = [None, "", "Alpha ALPHA alpha"] + [sentence(rng, rng.randint(1, 40), ["p", "q"]) for _ in range(60)]
    rows = list(enumerate(texts)) + [(2, "Alpha ALPHA alpha")]
    # documents of one word each score the next-token distribution after the start
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm_scoring.score(df, F.col("doc_id") % 10 != 0).collect()
    tokens = lambda t: [*words(lower(t)), None]
    count = Counter(w for i, t in rows if i % 10 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert len(found) == len(rows)
    for r in found:
        w = tokens(dict(rows)[r["doc_id"]])
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    # all words, and one that is unknown, as first word after the start: with the end token after each
    weights = lm_scoring.learn_weights([(3 << 24 | 5 << 12 | 40, 10), (0 << 24 | 0 << 12 | 30, 4)], 1 / (v + 1))
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0
    assert lm_scoring.score(df.limit(0), F.lit(True)).count() == 0


def test_repeats_of_a_row_weigh_what_they_weigh_one_by_one(spark, monkeypatch):
    """Also for the weights that are learnt; and no block gets more rows of one id and text than the bound."""
    from pyspark.sql import functions as F

    rng = random.Random(18)
    rows = [(i, sentence(rng, rng.randint(1, 30), ["p", "q", "r"]), "x") for i in range(40)]
    df = spark.createDataFrame(rows + rows[5:15] * 30 + [(None, None, "x")] * 30, "doc_id long, text string, rows string").repartition(4)
    trains = F.col("doc_id") % 10 != 0
    results = []
    for bound in (10, 1000):
        monkeypatch.setattr(lm_scoring, "REPEATS", bound)
        results.append(sorted((str(r["doc_id"]), r["n_tokens"], r["train_tokens"], round(r["base_score"], 8), round(r["score"], 6)) for r in lm_scoring.score(df, trains).collect()))
    assert results[0] == results[1] and len(results[0]) == df.count()
    monkeypatch.setattr(lm_scoring, "REPEATS", 10)
    weighed, volume = lm_scoring.weigh_repeats(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains")))
    assert weighed.count() == 41 and volume == sum(len(t) for _, t, _ in rows)


def test_packed_keys_and_counts_come_back():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1 << 40), (1, 1 << 40), (1000, 1 << 40), (50, (1 << 63))):
        keys = np.unique(rng.integers(0, top, n, dtype=np.uint64)) << np.uint64(1)
        assert np.array_equal(lm_scoring._unpack_keys(lm_scoring._pack_keys(keys)), keys)
        assert np.array_equal(lm_scoring._unpack_keys(lm_scoring._pack_keys(keys << np.uint64(16))), keys << np.uint64(16))
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert lm_scoring._unpack_counts(lm_scoring._pack_counts(counts)).tolist() == counts.tolist()


# ---- op 9 --------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies, really, a lot of them.</div>
<article><h1>Title &amp; more</h1><p>One, two, three and a good deal of text that makes a paragraph.<br>
More\n text&nbsp;here <a href=x>link</a>.<p>Short.</p><ul><li>item</ul><form><input value="x"><label>Mail</label></form></article>
<section id="comments"><p>A reader says that this is great, really great, and goes on at some length.</p></section>
<aside class="x">Side</aside><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE) == "Title & more\n\nOne, two, three and a good deal of text that makes a paragraph. More text here link.\n\nShort.\n\nitem"


BODY = [f"Paragraph {i} of the body, which is long enough, has commas, and reads like a text of an article." for i in range(10)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BODY)


@pytest.mark.parametrize("attributes", ["class='entry-content overflow-hidden'", "class='elementor-widget-container'", "class='commentary'", "class='post-body footnote'", "id='skip'", "class='content menu'"])
@pytest.mark.parametrize("wrapper", ["div", "article", "body"])
def test_a_class_that_marks_nothing_keeps_the_body(attributes, wrapper):
    page = f"<html><nav>Home</nav><{wrapper}><div {attributes}>{PARAGRAPHS}</div></{wrapper}><div class='site-footer'>Imprint</div></html>"
    assert html_extract.main_text(page) == "\n\n".join(BODY)


def test_notes_and_formulas_stay_and_boilerplate_goes():
    rest = "<div class=byline>By A. Writer</div><p>Where <math><mi>x</mi></math> is one.</p><div class=footnote>1 A note.</div>"
    gone = "".join(f"<div class='{c}'>{PARAGRAPHS[:300]}</div>" for c in ("site-footer", "main-nav", "cookie-notice", "ad", "comment-list", "commentlist", "related-posts", "advertisement"))
    assert html_extract.main_text(f"<body><article>{PARAGRAPHS}{rest}{gone}</article></body>") == "\n\n".join([*BODY, "By A. Writer", "Where x is one.", "1 A note."])
    # readers' comments are left out even if they are longer than the article
    assert html_extract.main_text(f"<body><div><p>{BODY[0]}</p></div><div id=comments>{PARAGRAPHS}</div></body>") == BODY[0]


def test_parts_beside_the_best_container_stay():
    whole = "\n\n".join(["Title", *BODY, "Closing remark."])
    menu, links = "<ul><li><a href=/>Home page of the site</a></li></ul>", "<h2>More</h2><ul><li><a href=/x>Another article, with a long title</a></li></ul>"
    assert html_extract.main_text(f"<div><h1>Title</h1><div>{PARAGRAPHS}</div><p>Closing remark.</p></div>") == whole
    assert html_extract.main_text(f"<body>{menu}<h1>Title</h1><div>{PARAGRAPHS}</div>Closing remark.{links}</body>") == whole
    assert html_extract.main_text(f"<body><div><h1><a href=/>Title</a></h1><div><div>{PARAGRAPHS}</div></div><ul><li>Closing remark.</ul></div>{links}</body>") == whole
    parts = f"<div>{PARAGRAPHS}</div><h2>Part</h2><ul><li>one<li>two</ul><p>Short.</p><div><p>{BODY[0]}</p></div>"
    assert html_extract.main_text(f"<main><h1>Title</h1>{parts}<p>Closing remark.</p></main>") == "\n\n".join(["Title", *BODY, "Part", "one", "two", "Short.", BODY[0], "Closing remark."])


def test_main_text_of_odd_pages(spark):
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    assert html_extract.main_text("just text &lt;b&gt;") == "just text <b>"
    assert html_extract.main_text("<p>a<p>b <!-- c --> d") == "a\n\nb d"
    assert html_extract.main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(len(r["text"]) for r in html_extract.extract(df).collect()) == [0, *[len(html_extract.main_text(PAGE))] * 2]
    assert html_extract.extract(df.limit(0)).count() == 0


# ---- op 10 -------------------------------------------------------------------------------------------------------


def test_machine_learns_what_only_a_pair_shows(spark):
    """An insult, or a group's name, alone is harmless; together they are not."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        parts = sentence(rng, 12).split() + ["vermin"] * insult + ["martians"] * group
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
        labels.append((i, int(insult and group)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs.where("doc_id < 700"), marked.where("doc_id < 700"))
    found = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.classify(docs.where("doc_id >= 700"), machine).collect()}
    assert sum(found[i][1] == y for i, y in labels[700:]) >= 0.97 * 200
    odd = spark.createDataFrame([(1, None, 2.0), (2, "", 3.0), (3, "x" * 100_000, None)], "doc_id long, text string, score double")
    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(odd, machine).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    empty = toxicity.train(docs.limit(0), marked.limit(0))
    assert toxicity.classify(odd, empty).count() == 3


def test_terms_do_not_cross_texts():
    import pyarrow as pa

    from corpusloom.llm.common import text_bytes

    alone = [set(toxicity.terms(*text_bytes(pa.array([t])))[1].tolist()) for t in ("ab", "cd", "", "abcd")]
    text, term = toxicity.terms(*text_bytes(pa.array(["ab", "cd", None, "abcd"])))
    assert [set(term[text == i].tolist()) for i in range(4)] == alone


@pytest.mark.parametrize("text", ["", "\x00", "a" * 3, "x y", " é"])
def test_hash_of_a_word_is_that_of_the_word_alone(text):
    import pyarrow as pa

    from corpusloom.llm.common import text_bytes, word_hashes

    many = word_hashes(*text_bytes(pa.array(["before it", text, "after"])))
    alone = word_hashes(*text_bytes(pa.array([text])))
    assert many[1].tolist()[1] == len(words(text))
    assert np.array_equal(many[0][2 : 2 + len(words(text))], alone[0])
    assert hashlib.sha256(b"").hexdigest()[:2] == "e3"


# ---- pages inside forms, repeated rows ---------------------------------------------------------------------------

FLOOD = " ".join("The river rose, and the town, which lay low, was under water for many days." for _ in range(6))


@pytest.mark.parametrize("inside", [f"<article><p>{FLOOD}</p></article>", f"<div><p>{FLOOD}</p><p>{FLOOD}</p></div>"])
@pytest.mark.parametrize("wrapper", ['form id="aspnetForm"', "object"])
def test_a_page_inside_a_form_is_kept(inside, wrapper):
    page = f"<html><body><{wrapper}>{inside}</{wrapper.split()[0]}></body></html>"
    assert html_extract.main_text(page).split("\n\n")[0] == FLOOD


def test_forms_and_comments_beside_an_article_go_and_words_in_a_line_stay():
    line = '<p>Write <span class="hljs-comment">a note</span> or <label>a letter</label> to them, and wait for the answer.</p>'
    page = f'<body><form><p>Search this site</p></form><article><p>{FLOOD}</p>{line}<form><p>Your name, please</p></form></article><div class="comments"><p>{FLOOD}</p></div></body>'
    assert html_extract.main_text(page) == f"{FLOOD}\n\nWrite a note or a letter to them, and wait for the answer."


@pytest.mark.parametrize("head", ["<header>{}</header>", "<header class='entry-header'>{}</header>", "<div class='post-header'>{}</div>", "<div class=header>{}</div>"])
def test_the_head_of_an_article_stays_and_that_of_the_page_goes(head):
    title = "<h1>High water</h1><p>By A. Writer</p>"
    page = f"<body><header><h1>The Daily</h1></header><div class='page-header'>Top of the page</div><article>{head.format(title)}<p>{FLOOD}</p></article></body>"
    assert html_extract.main_text(page) == f"High water\n\nBy A. Writer\n\n{FLOOD}"


def test_words_that_end_names_of_an_articles_blocks_mark_nothing_by_themselves():
    own = "".join(f"<div class='{c}'>What {c} says.</div>" for c in ("market-share", "flood-notice", "letters-reply"))
    gone = "".join(f"<div class='{c}'>Not this.</div>" for c in ("share", "post-share", "social-share", "site-notice", "privacy-notice", "notice", "notice-bar", "related", "reply-form"))
    page = f"<body><article><p>{FLOOD}</p>{own}{gone}</article></body>"
    assert html_extract.main_text(page) == "\n\n".join([FLOOD, "What market-share says.", "What flood-notice says.", "What letters-reply says."])


def test_repeated_rows_of_near_copies_are_compared_once(spark, monkeypatch):
    rng = random.Random(3)
    base = sentence(rng, 120)
    rows = [(1, base), (2, base + " one more"), (3, sentence(rng, 60))]
    seen, make = [], near_dedup.full_sets

    def counted(df):
        out = make(df).cache()
        seen.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "full_sets", counted)
    df = spark.createDataFrame(rows * 300, "doc_id long, text string").repartition(4)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert found == {(1, 116, 1, True), (2, 118, 1, False), (3, 56, 3, True)}
    assert seen == [2]


@pytest.mark.parametrize("between, found", [(6, True), (20, True), (60, True), (400, False)])
def test_an_item_with_words_put_in_its_middle_is_found(spark, between, found):
    """Up to 64 words; what is further apart are two halves of an item."""
    rng = random.Random(between)
    item = [f"w{rng.randint(0, 9999)}x" for _ in range(40)]
    other = [f"o{rng.randint(0, 9999)}y" for _ in range(between + 100)]
    text = " ".join([*other[:50], *item[:20], *other[100:], *item[20:], *other[50:100]])
    docs = spark.createDataFrame([(1, text), (2, " ".join(other)), (3, " ".join(other[:30] + item[:20]))], "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["exact"]) for r in got] == ([(1, 7, True)] if found else [])


def test_packing_cuts_words_as_a_plain_version_does_and_remembers_a_bounded_number():
    import re

    from corpusloom.llm import packing

    signs = re.compile(rb"([a-z0-9])([!-/:-@\[-`{-~]+)(?=[ \t-\r]|\Z)")
    rng = random.Random(5)
    for _ in range(500):
        texts = ["".join(rng.choice(["a", "B", "9", ".", "!", "<|", " ", "\n", "\x0b", "é", "\x00"]) for _ in range(rng.randrange(9))).encode() for _ in range(rng.randrange(1, 5))]
        words, upto = packing.split_words(texts)
        plain = [(t if b"<|" in t else signs.sub(rb"\1 \2", t.lower())).split() for t in texts]
        assert words.to_pylist() == [w for p in plain for w in p]
        assert upto.tolist() == [sum(map(len, plain[: k + 1])) for k in range(len(plain))]
    encoder = packing.WordEncoder(packing.tokenizer_path())
    for k in range(30):
        encoder.encode([" ".join(f"w{k * 10_000 + i}" for i in range(10_000)).encode()])
    assert len(encoder.known) + len(encoder.old) < 250_000
