"""Queries over what sinks have written: each writes a whole result to the shared folder, reads it back and works on that.

The other half are the small rules around training and evaluation that the catalogue's longer queries do not show by themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scoring
from corpusloom.functions import text as X
from corpusloom.operators import blocks, conversations, evaluation, metrics, split
from corpusloom.plans.catalogue import BLOCK, SETTINGS, SPLIT_SQL, TOKENS_SQL, documents, encoded_splits, packed, query, sql_words, table
from corpusloom.sources import readers, sinks
from corpusloom.sources.tables import shared_dir

#: Documents that are never held out whole.
PINNED = [str(i) for i in range(100)]
PINNED_SQL = SPLIT_SQL.replace("WHERE words > 0", f"WHERE words > 0 AND doc_id >= {len(PINNED)}")


def target(spark, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


# ---- splits and blocks -------------------------------------------------------------------------------------------


@query("written_splits", f"WITH RECURSIVE {PINNED_SQL} SELECT split, row_number() OVER (PARTITION BY split ORDER BY document_id) - 1 AS id, document_id, part, words, sha256, sha256(piece) AS piece_sha FROM split")
def written_splits(spark, sf_dir):
    """The split with pinned documents as JSONL in a folder for each split, with an id within it."""
    path = target(spark, "splits")
    sinks.write_splits(split.split_corpus(documents(spark, sf_dir), SETTINGS, PINNED), path)
    rows = readers.read_jsonl(spark, path, "split string, id bigint, document_id bigint, sha256 string, words bigint, text string, part string")
    return rows.select("split", "id", "document_id", "part", "words", "sha256", F.sha2("text", 256).alias("piece_sha"))


@query(
    "manifest_report",
    f"""WITH RECURSIVE {SPLIT_SQL},
n AS (SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'eval') AS eval, count(*) FILTER (split = 'eval_unseen') AS unseen, coalesce(sum(words) FILTER (split = 'eval'), 0) AS eval_words, coalesce(sum(words) FILTER (split = 'eval_unseen'), 0) AS unseen_words FROM split),
d AS (SELECT count(*) AS documents, sum(words) AS words FROM wc)
SELECT 42 AS seed, 'eval: per-document tail (paragraph boundary); eval_unseen: whole documents' AS split_unit, 0.1::DOUBLE AS requested_eval_fraction, documents AS documents_total, train AS documents_train, eval AS documents_eval, unseen AS documents_eval_unseen,
round(unseen_words / words, 4) AS actual_eval_unseen_word_fraction, round(eval / documents, 4) AS actual_eval_document_fraction, round(eval_words / words, 4) AS actual_eval_word_fraction,
'eval = last 10% of each of ' || eval || ' documents (' || printf('%.1f', 100 * eval_words / words) || '% of words); eval_unseen = ' || unseen || ' whole documents never used in CPT (' || printf('%.1f', 100 * unseen_words / words) || '% of words); probe documents kept out of eval_unseen.' AS note FROM n, d""",
)
def manifest_report(spark, sf_dir):
    """The split's manifest as one nested JSON object, written and read."""
    docs, path = documents(spark, sf_dir), target(spark, "manifest")
    report = split.manifest_report(docs, split.split_corpus(docs, SETTINGS), SETTINGS)
    sinks.write_nested_report(report.select(F.struct("*").alias("manifest")), path)
    return readers.read_json_object(spark, path).select("manifest.*").withColumn("seed", F.col("seed").cast("int"))


def built(spark, sf_dir) -> str:
    """Where the packed blocks of all documents and their lengths are written."""
    path = target(spark, "blocks")
    sources = encoded_splits(spark, sf_dir).select("split", "document_id", "text")
    found, lengths, _ = blocks.build_packed(sources, BLOCK, optional=("eval", "eval_unseen"))
    sinks.write_blocks(found, path, lengths=lengths)
    return path


@query("written_blocks", f"WITH {TOKENS_SQL} SELECT split, block, md5(array_to_string(input_ids, ',')) AS ids_md5 FROM blocks")
def written_blocks(spark, sf_dir):
    rows = readers.read_columns(spark, built(spark, sf_dir), "split", "block", "input_ids")
    return rows.select("split", "block", F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("ids_md5"))


@query("written_lengths", f"WITH {TOKENS_SQL} SELECT split, document_id, len(ids)::BIGINT AS tokens FROM e")
def written_lengths(spark, sf_dir):
    return spark.read.csv(f"{built(spark, sf_dir)}_doc_tokens", header=True, schema="document_id bigint, tokens bigint, split string").select("split", "document_id", "tokens")


@query("training_examples", f"WITH {TOKENS_SQL} SELECT md5(array_to_string(input_ids, ',')) AS ids_md5, len(input_ids)::BIGINT AS attended, true AS labels_are_ids FROM blocks")
def training_examples(spark, sf_dir):
    rows = blocks.training_examples(packed(spark, sf_dir))
    attended = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select(F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("ids_md5"), attended.alias("attended"), (F.col("labels") == F.col("input_ids")).alias("labels_are_ids"))


# ---- manifests, texts and logs -----------------------------------------------------------------------------------


@query("written_manifest", "SELECT page_id || '.pdf' AS file_name, 'Page \"' || page_id || '\", of ' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || chr(10) || ' with a second line ' AS title, url FROM pages")
def written_manifest(spark, sf_dir):
    """Pages as a manifest whose titles hold commas, quotes, line ends and blanks at their ends."""
    path = target(spark, "sources")
    title = F.concat(F.lit('Page "'), F.col("page_id").cast("string"), F.lit('", of '), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("\n with a second line "))
    rows = table(spark, sf_dir, "pages", "page_id", "url").select(F.concat("page_id", F.lit(".pdf")).alias("file_name"), F.lit("rules").alias("category"), F.lit(None).cast("string").alias("publisher"), title.alias("title"), "url")
    sinks.write_csv(rows, path)
    return readers.read_manifest(spark, path).where("category = 'rules' and publisher is null").select("file_name", "title", "url")


@query("stale_outputs", f"SELECT doc_id, sha256(text || chr(10)) AS sha FROM documents WHERE len({sql_words('text')}) >= 100 AND doc_id % 10 = 0")
def stale_outputs(spark, sf_dir):
    """Texts once written whose document is no longer among the sources, a tenth of which have gone."""
    path = target(spark, "texts")
    sinks.write_texts(documents(spark, sf_dir).where(X.word_count(F.col("text")) >= SETTINGS.min_words), path)
    gone = sinks.stale_outputs(readers.read_columns(spark, path, "doc_id", "text"), documents(spark, sf_dir, "doc_id").where("doc_id % 10 <> 0"))
    return gone.select("doc_id", F.sha2("text", 256).alias("sha"))


@query(
    "training_log",
    "SELECT 'train' AS kind, event_id::INTEGER AS step, round(value, 6) AS loss FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL UNION ALL SELECT 'eval', event_id::INTEGER, round(value + 2, 6) FROM events WHERE event_id % 5 = 0 AND value IS NOT NULL",
)
def training_log(spark, sf_dir):
    """Events as a CSV log with empty cells, read and told apart into training and evaluation records."""
    path = target(spark, "log")
    loss, held = F.when(F.col("event_id") % 3 != 0, F.col("value")), F.when(F.col("event_id") % 5 == 0, F.col("value") + 2)
    nothing = F.lit(None).cast("double")
    sinks.write_csv(table(spark, sf_dir, "events", "event_id", "value").select(F.col("event_id").alias("step"), (F.col("value") / 100).alias("epoch"), loss.alias("loss"), held.alias("eval_loss"), nothing.alias("learning_rate"), nothing.alias("grad_norm")), path)
    train, evaluated = evaluation.split_logs(readers.read_loss_log(spark, path))
    both = train.select(F.lit("train").alias("kind"), "step", "loss").union(evaluated.select(F.lit("eval"), "step", "eval_loss"))
    return both.withColumn("loss", F.round("loss", 6))


# ---- rules around training and evaluation ------------------------------------------------------------------------


@query("first_blocks_loss", "SELECT l_returnflag AS set, round((sum(l_discount * l_quantity) / sum(l_quantity))::DOUBLE, 6) AS loss FROM lineitem WHERE l_linenumber < 4 GROUP BY l_returnflag".replace("AS set", 'AS "set"'))
def first_blocks_loss(spark, sf_dir):
    """The weighted mean over the first blocks of a run alone; an order's lines are its blocks."""
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linenumber", "l_discount", "l_quantity")
    rows = rows.select(F.col("l_returnflag").alias("set"), F.col("l_linenumber").alias("block"), F.col("l_discount").cast("double").alias("loss"), F.col("l_quantity").cast("double").alias("tokens"))
    return metrics.weighted_loss(rows, ["set"], first=4).select("set", F.round("loss", 6).alias("loss"))


@query("chosen_parameters", "SELECT c_name AS candidate, c_nationkey AS rank, c_mktsegment AS schedule FROM customer ORDER BY c_custkey % 4 DESC, round(abs(c_acctbal), 2), c_name LIMIT 1")
def chosen_parameters(spark, sf_dir):
    """What the chosen candidate was trained with: the best one is the feature."""
    rows = table(spark, sf_dir, "customer")
    sweep = rows.select(F.col("c_name").alias("candidate"), F.concat((F.col("c_custkey") % 4).cast("string"), F.lit("/3")).alias("general_facts_kept"), F.round(F.abs("c_acctbal"), 2).alias("heldout_ppl"))
    best = metrics.select_candidate(sweep).first()["candidate"]
    return metrics.candidate_by_name(rows.select(F.col("c_name").alias("candidate"), F.col("c_nationkey").alias("rank"), F.col("c_mktsegment").alias("schedule")), best)


@query("answers_by_prefix", r"SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN text IS NOT NULL OR NULL ELSE regexp_matches(lower(text), '^\W*the') END AS begins FROM conversations")
def answers_by_prefix(spark, sf_dir):
    """Whether a turn begins with the fact that is asked for: its own first letters after a mark, or a word."""
    even = F.col("conv_id") % 2 == 0
    text = F.when(even, F.concat(F.lit("- “"), F.col("text"))).otherwise(F.col("text"))
    begins = scoring.strict_prefix(text, F.when(even, F.substring("text", 1, 5)).otherwise(F.lit("The")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", begins.alias("begins"))


@query("relative_changes", "SELECT o_custkey AS customer, round(CASE WHEN max(o_totalprice) <> 0 THEN 100 * (1 - min(o_totalprice)::DOUBLE / max(o_totalprice)::DOUBLE) END, 2) AS change_percent FROM orders GROUP BY o_custkey")
def relative_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.max("o_totalprice").cast("double").alias("before"), F.min("o_totalprice").cast("double").alias("after"))
    return rows.select("customer", scoring.relative_change(F.col("before"), F.col("after")).alias("change_percent"))


@query("statistics_by_key", "SELECT source AS name, count(*) AS documents, sum(length(coalesce(text, '')))::BIGINT AS characters FROM documents WHERE source IS NOT NULL AND source <> (SELECT min(source) FROM documents) GROUP BY source")
def statistics_by_key(spark, sf_dir):
    """A report's map of sources without one of its keys, as a row for each key. Sources are few."""
    by = documents(spark, sf_dir, "source", "text").where("source is not null").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("characters"))
    report = by.agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("documents", "characters")))).alias("sources"), F.min("source").alias("least"))
    return metrics.transpose_map(evaluation.without_key(report, "sources", F.col("least")), "sources")


@query(
    "conversation_examples",
    "WITH p AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER w AS asked, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
    "SELECT conv_id, turn, sha256('<|system|>' || chr(10) || 'Answer by the rules.</s>' || chr(10) || '<|user|>' || chr(10) || asked || '</s>' || chr(10) || '<|assistant|>' || chr(10) || text || '</s>' || chr(10)) AS sha FROM p WHERE role = 'assistant' AND before = 'user'",
)
def conversation_examples(spark, sf_dir):
    """Every answer with the question before it as a conversation of system, user and assistant, rendered."""
    w = W.partitionBy("conv_id").orderBy("turn")  # one conversation
    rows = table(spark, sf_dir, "conversations").withColumn("response", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"instruction": F.lag("response").over(w), "before": F.lag("role").over(w)}).where("role = 'assistant' and before = 'user'")
    examples = conversations.to_conversation(rows, "Answer by the rules.")
    return examples.select("conv_id", "turn", F.sha2(conversations.render(F.concat("prompt", "completion")), 256).alias("sha"))
