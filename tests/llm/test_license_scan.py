"""The license scan against comparing every block with every template, and planted notices."""

import random
import re

import pytest

from corpusloom.llm import license_scan

MIT = next(t for label, t in license_scan.TEMPLATES if label == "mit")
APACHE = next(t for label, t in license_scan.TEMPLATES if label == "apache")


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, templates=license_scan.TEMPLATES, percent=license_scan.PERCENT):
    w = words(text)
    starts = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    found, best = set(), 0.0
    for t in license_scan.template_sets(templates, percent):
        for at in range(0, max(1, len(w)), t["half"]):
            share = len(set(w[at : at + 2 * t["half"]]) & set(t["words"])) / len(t["words"])
            if share * 100 >= percent:
                found.add(t["label"])
                best = max(best, share)
    places, base = [i for i, _ in starts], {label for _, label in starts}
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best)


def scanned(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row int, blocks string, labels string").repartition(3)
    return {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(df, **kw).collect()}


def spoil(rng, text, n):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), min(n, len(w))):
        w[i] = f"other{i}"
    return " ".join(w)


def test_equals_comparing_all_blocks(spark):
    rng = random.Random(5)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in words(t)})
    texts = [None, "", " \n", "MIT License", "mit\x00license mit  LICENSE", "the GNU General Public License, the Apache-License", "license mit", "général public license", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0"]
    for _, t in license_scan.TEMPLATES:
        texts += [t, t.upper(), "# " + t.replace(" ", "\n# "), " ".join(reversed(t.split(" ")))]
        texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 400))) + " " + spoil(rng, t, rng.randint(0, 8)) + " tail" * rng.randint(0, 70) for _ in range(3)]
    texts += [" ".join(rng.choice(vocabulary[:60]) for _ in range(rng.randint(1, 3000))) for _ in range(10)]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain(t)) if got[i][-1] != plain(t)[-1] else got[i] == plain(t), t


def test_planted_notices_are_found_wherever_they_stand(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"word{rng.randint(0, 5000)}" for _ in range(n))
    texts = [f"{filler(n)} {t} {filler(40)}" for n in (0, 1, 63, 64, 200, 5000) for t in (MIT, APACHE, "Licensed under CC BY-SA 4.0")] + [filler(6000)]
    got = scanned(spark, texts)
    assert [got[i][5] for i in range(len(texts))] == [*["mit", "apache", "cc-by-sa"] * 6, ""]


def test_own_phrases_templates_and_threshold(spark):
    texts = ["all rights reserved by us", "one two three four five", "one two three four", "one two three"]
    kw = {"phrases": (("rights reserved", "closed"),), "templates": (("count", "one two three four five"),)}
    assert [scanned(spark, texts, **kw, percent=80)[i][5:] for i in range(4)] == [("closed", 1.0), ("count", 1.0), ("count", 0.8), ("", 0.0)]
    with pytest.raises(ValueError):
        license_scan.template_sets((("empty", " ?"),), 90)


def test_many_found_rows_are_joined_by_shuffle(spark, monkeypatch):
    texts = [MIT, "nothing", APACHE] * 3
    want = scanned(spark, texts)
    monkeypatch.setattr(license_scan, "BROADCAST_FOUND", 0)
    assert scanned(spark, texts) == want


def test_an_empty_table_and_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert license_scan.scan_licenses(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "MIT license"), (None, "none"), (4, MIT), (4, MIT), (4, "x")], schema)
    found = sorted((repr(r["doc_id"]), r["labels"]) for r in license_scan.scan_licenses(df).collect())
    assert found == [("4", ""), ("4", "mit"), ("4", "mit"), ("None", ""), ("None", "mit")]


def test_a_text_as_long_as_a_book(spark):
    text = " ".join(f"word{i % 999}" for i in range(200_000)) + " " + MIT
    assert scanned(spark, [text])[0] == (len(words(text)), 0, None, None, "", "mit", 1.0)
