"""Tables that follow their sources, logs that may come twice, and the page source."""

import os

import pytest

from corpusloom.operators import sync
from corpusloom.sources import readers
from pyspark.sql import functions as F


def files(spark, rows):
    return spark.createDataFrame(rows, "file_name string, text string")


class Worked:
    """Upper-cases texts, leaves out those that say drop, and remembers what it has been given."""

    def __init__(self):
        self.seen = []

    def __call__(self, df):
        self.seen.append(sorted(r["file_name"] for r in df.collect()))
        return df.where("text not like '%drop%' or text is null").select("file_name", F.upper("text").alias("text"))


def state(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_what_changes_is_worked_on(spark, tmp_path):
    path, work = str(tmp_path / "t"), Worked()
    run = lambda rows: {r["file_name"]: r["action"] for r in sync.sync(files(spark, rows), path, work, 8).collect()}
    texts = lambda: {r["file_name"]: r["text"] for r in sync.synced_texts(spark, path).collect()}
    rows = [(f"f{i}", f"text {i}") for i in range(30)] + [("x", "drop it"), ("n", None)]
    assert set(run(rows).values()) == {"added"} and len(work.seen[-1]) == 32
    assert texts() == {f"f{i}": f"TEXT {i}" for i in range(30)}
    before = state(path)
    assert set(run(rows).values()) == {"same"} and len(work.seen) == 1  # the one that was left out is not tried again
    assert state(path) == before
    changed = [("f1", "other")] + [r for r in rows if r[0] not in ("f1", "f2")] + [("new", "fresh")]
    assert {k: v for k, v in run(changed).items() if v != "same"} == {"f1": "changed", "f2": "removed", "new": "added"}
    assert work.seen[-1] == ["f1", "new"]
    assert texts() == {**{f"f{i}": f"TEXT {i}" for i in range(3, 30)}, "f0": "TEXT 0", "f1": "OTHER", "new": "FRESH"}
    after = state(path)
    assert 0 < len(set(before) - set(after)) <= 3  # no more buckets than changes are written anew
    assert set(run([]).values()) == {"removed"} and texts() == {}
    assert run([("f1", "again")]) == {"f1": "added"} and texts() == {"f1": "AGAIN"}


def test_a_run_that_stopped_half_way_is_made_good(spark, tmp_path):
    path, work = str(tmp_path / "t"), Worked()
    rows = [(f"f{i}", f"text {i}") for i in range(20)]
    sync.sync(files(spark, rows), path, work, 4)
    gone = sorted(d for d in os.listdir(path) if d.startswith("bucket="))[0]
    for f in os.listdir(f"{path}/{gone}"):
        os.remove(f"{path}/{gone}/{f}")
    spark.catalog.refreshByPath(path)
    actions = [r["action"] for r in sync.sync(files(spark, rows), path, work, 4).collect()]
    assert set(actions) == {"added", "same"} and sync.synced_texts(spark, path).count() == 20


def test_a_log_that_comes_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    log = lambda *rows: spark.createDataFrame(rows, "step long, loss double, eval_loss double")
    read = lambda: sorted((r["step"], r["loss"], r["eval_loss"]) for r in spark.read.parquet(path).collect())
    first = log((1, 2.0, None), (2, 1.5, None), (2500, 1.0, 0.5), (3, None, None))
    sync.merge_log(first, path)
    once = state(path)
    sync.merge_log(first, path)
    assert read() == [(1, 2.0, None), (2, 1.5, None), (2500, 1.0, 0.5)]
    other = [p for p in once if "bucket=2" in p]
    sync.merge_log(log((2, 1.25, None), (4, 1.0, None)), path)
    spark.catalog.refreshByPath(path)
    assert read() == [(1, 2.0, None), (2, 1.25, None), (4, 1.0, None), (2500, 1.0, 0.5)]
    assert len(other) == 1 and sum("bucket=2" in p for p in state(path)) == 1
    sync.merge_log(log(), path)
    assert len(read()) == 4


def test_a_stream_may_hand_a_batch_over_again(spark, tmp_path):
    from corpusloom.streaming import ingest

    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(i, float(i), None) for i in range(5)], "step long, loss double, eval_loss double").write.parquet(source)
    for checkpoint in ("a", "b"):  # a lost checkpoint gives the same files again
        ingest.ingest_log(spark, source, path, str(tmp_path / checkpoint)).awaitTermination()
    assert sorted(r["step"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_pages_of_marked_files(spark, tmp_path):
    (tmp_path / "a b+c.txt").write_text("before\n--- PAGE 1 ---\n one \n\n--- PAGE 2 ---\n\n--- PAGE 10 ---\nten --- PAGE 3 --- in a line\n", encoding="utf-8")
    (tmp_path / "plain.txt").write_text("no marks é\n", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"--- PAGE 1 ---\n\xff\xfe")
    (tmp_path / "other.md").write_text("not read")
    got = sorted(tuple(r) for r in readers.read_page_marked(spark, str(tmp_path)).collect() if r["error"] is None)
    assert got == [("a b+c.txt", 1, "one", None), ("a b+c.txt", 2, "", None), ("a b+c.txt", 10, "ten --- PAGE 3 --- in a line", None), ("plain.txt", 1, "no marks é", None)]
    assert [tuple(r) for r in readers.read_page_marked(spark, str(tmp_path)).where("error is not null").collect()] == [("bad.txt", None, None, "not UTF-8")]
    with pytest.raises(ValueError):
        readers.read_page_marked(spark, str(tmp_path), "*.none")
