"""The stages against plain versions, on a small table of documents and odd rows."""

import random

import pytest

import corpus_pipeline
from corpusloom.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_language", "spans", "tid", "_had_text", "found_lang", "had_text", "given_0", "n_removed"]

#: The values of every column beyond the documents' own, the same in each row; each stage has to carry them along.
OWN = ("own", 5, "t", 7, "f", "h", "g", "r")


def sentence(rng, n):
    return " ".join(rng.choice("the of and to in house garden river king stone water light".split()) + rng.choice(["", "s", "ing", "ed"]) + str(rng.randint(0, 50)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    base, passage, item = sentence(rng, 120), sentence(rng, 70), sentence(rng, 25)
    rows = [(0, None), (1, ""), (2, "12 ?!"), (3, base), (4, base), (5, base.replace("river", "River", 1) + " more"), (6, f"{sentence(rng, 60)} {passage} {sentence(rng, 10)}"), (7, f"{sentence(rng, 90)} {passage}"), (8, f"{sentence(rng, 80)}. {item}. {sentence(rng, 20)}")]
    rows += [(i, sentence(rng, rng.randint(20, 80))) for i in range(9, 20)]
    out = tmp_path_factory.mktemp("sf")
    data = [(i, t, "en", "s", len(t or ""), *OWN) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, _language string, spans int, tid string, _had_text int, found_lang string, had_text string, given_0 string, n_removed string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), dict(rows), passage


def test_stages_take_effect_one_after_the_other(spark, folder):
    sf_dir, texts, passage = folder
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "t")
        assert docs.columns == COLUMNS
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert all(tuple(r[c] for c in COLUMNS[5:]) == OWN for r in kept[name].values())
    assert set(texts) - set(kept["language"]) == {0, 1, 2}
    assert set(kept["language"]) - set(kept["near_dedup"]) == {4, 5}
    assert set(kept["near_dedup"]) == set(kept["suffix_dedup"])
    for i in (6, 7):
        assert passage not in kept["suffix_dedup"][i]["text"] and kept["suffix_dedup"][i]["n_chars"] == len(kept["suffix_dedup"][i]["text"])
    assert all(kept["suffix_dedup"][i]["text"] == texts[i] for i in kept["suffix_dedup"] if i not in (6, 7))
    assert set(kept["suffix_dedup"]) - set(kept["decontamination"]) == {8}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["decontamination"])
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_empty_tables_go_through(spark, folder):
    sf_dir = folder[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_odd_rows_have_a_defined_result(spark, tmp_path):
    """Null ids pass what decides by id, rows that share an id go together, every column may be null, very long texts are one row."""
    rng = random.Random(3)
    unique, again, huge = sentence(rng, 40), sentence(rng, 30), sentence(rng, 20_000)
    rows = [(None, unique), (None, None), (1, again), (1, again), (2, again + " tail"), (3, huge), (4, "x" * 60_000), (5, " \n"), (6, "12 34"), (None, sentence(rng, 20))]
    data = [(i, t, None, None, None, *OWN) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _language string, spans int, tid string, _had_text int, found_lang string, had_text string, given_0 string, n_removed string"
    docs = spark.createDataFrame(data + [(9, sentence(rng, 25), "en", "s", 7, *OWN)], schema).repartition(2)
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == COLUMNS
        seen[name] = sorted((r["doc_id"] for r in docs.collect()), key=repr)
    assert seen["language"] == sorted([None, 1, 1, 2, 3, 4, None, 9], key=repr)
    assert seen["near_dedup"] == sorted([None, 1, 1, 3, 4, None, 9], key=repr)  # 2 is like 1
    assert seen["suffix_dedup"] == seen["decontamination"]
    pieces = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(seen["decontamination"])
    by = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    assert all(a[1] + a[2] == (b[1] if a[0] == b[0] else 4096) for a, b in zip(by, by[1:]))
