"""Sources, sinks and the streaming front end."""

from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions import text as X
from corpusloom.sources import readers, sinks
from corpusloom.streaming import ingest


def test_manifest_and_texts(spark, tmp_path):
    (tmp_path / "m.csv").write_text('file_name,category,publisher,title,url\na.pdf,x,y,"One, two",http://h/a\n')
    row = readers.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert (row["file_name"], row["title"]) == ("a.pdf", "One, two")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a b.txt").write_text("one\ntwo")
    (tmp_path / "t/c.md").write_text("no")
    assert [(r["doc_id"], r["text"]) for r in readers.read_texts(spark, str(tmp_path / "t")).collect()] == [("a b", "one\ntwo")]
    assert readers.read_if_there(spark, str(tmp_path / "none"), "a int").count() == 0


def test_logs_and_splits_round_trip(spark, tmp_path):
    (tmp_path / "log.csv").write_text("step,epoch,loss,eval_loss,learning_rate,grad_norm\n1,0.1,2.5,,0.1,\n2,0.2,,1.5,,\n")
    rows = readers.read_loss_log(spark, str(tmp_path / "log.csv"))
    assert [(r["loss"], r["eval_loss"]) for r in rows.orderBy("step").collect()] == [(2.5, None), (None, 1.5)]
    sinks.append_log(rows.union(rows.select("step", "epoch", F.lit(None).cast("double"), F.lit(None).cast("double"), "learning_rate", "grad_norm")), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    split = spark.createDataFrame([("b", "train", "x"), ("a", "train", "y"), ("c", "eval", "z")], "document_id string, split string, text string")
    sinks.write_splits(split, str(tmp_path / "s"))
    sinks.write_splits(split.where("document_id <> 'b'"), str(tmp_path / "s"))
    assert sorted((r["split"], r["id"], r["document_id"]) for r in spark.read.json(str(tmp_path / "s")).collect()) == [("eval", 0, "c"), ("train", 0, "a")]


def test_pages_of_files_and_failures(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one\x0c two")
    (tmp_path / "b.PDF").write_bytes(b"broken")

    def extractor(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no pages")
        return [p.decode() for p in content[4:].split(b"\x0c")]

    rows = readers.extract_pages(readers.read_binary(spark, str(tmp_path)), extractor).collect()
    assert sorted((r["doc_id"], r["page_no"] or 0, r["text"], r["error"]) for r in rows if r["error"] is None) == [("a.pdf", 1, " one", None), ("a.pdf", 2, " two", None)]
    assert [r["error"] for r in rows if r["error"]] == ["ValueError: no pages"]


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("BLOCK_SIZE", "1024")
    assert Settings.from_env().block_size == 1024 and Settings().override(min_words=5).min_words == 5


def test_stream_cleans_each_file_once(spark, tmp_path):
    rows = [(i, "word " * (150 if i % 2 else 20), "en", "s", 1) for i in range(6)]
    spark.createDataFrame(rows[:3], ingest.DOCUMENTS).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame(rows[3:], ingest.DOCUMENTS).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3, 5]
    assert found.where(F.col("text") != X.clean_text(F.col("text"))).count() == 0


def test_paths_are_quoted_as_a_client_does(spark):
    from urllib.parse import quote, urlsplit, urlunsplit

    urls = ["https://a.org/x y/ü.pdf?q=a b#f g", "http://a.org", "https://a.org/%20ok/+*~'()!,;:@&=$[]", "/only/a path", "", "https://h/漢字/\t"]
    want = [urlunsplit(urlsplit(u)._replace(path=quote(urlsplit(u).path, safe="/%"))) for u in urls[:-1]] + ["https://h/%E6%BC%A2%E5%AD%97/%09"]
    df = spark.createDataFrame(list(enumerate([*urls, None])), "i int, url string")
    got = {r["i"]: r["u"] for r in df.select("i", readers.quoted_url(F.col("url")).alias("u")).collect()}
    assert [got[i] for i in range(len(got))] == [*(w.replace("f%20g", "f g") for w in want), None]


def test_only_passing_errors_are_tried_again(spark):
    rows = [("a", 1, None), ("b", 1, "HTTPError: 503"), ("c", 1, "timed out"), ("d", 1, "timed out"), ("d", 2, "reset"), ("e", 1, "timed out"), ("e", 2, None), ("f", 1, "[SSL: CERTIFICATE_VERIFY_FAILED]")]
    df = spark.createDataFrame(rows, "file_name string, attempt int, error string")
    assert sorted(tuple(r) for r in readers.files_to_retry(df).collect()) == [("c", 1)]
    assert sorted(tuple(r) for r in readers.files_to_retry(df, 2).collect()) == [("c", 1), ("d", 2)]
