"""All queries of the engine's own operators, by name, and the SQL that their results must equal.

Every query runs over its whole tables. Real numbers are rounded to six places in both, since sums of doubles depend on the
order in which they are added.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions import scoring
from corpusloom.functions import text as X
from corpusloom.operators import blocks, cleaning, conversations, dedup, evaluation, funnel, instructions, language, metrics, pages, split, sync, vocabulary
from corpusloom.plans.policies import PARTS, policy_texts
from corpusloom.sources import readers
from corpusloom.sources.tables import long_texts, materialize, shared_dir, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Fixed value: the white space of Python's and Java's words, as far as these tables have any.
SPACE = r"\s+"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents, doc_id and text unless told; texts are dealt out to all cores where the scan has fewer splits."""
    columns = columns or ("doc_id", "text")
    rows = table(spark, sf_dir, "documents", *columns)
    return spread(rows) if "text" in columns else rows


# ---- lines and pages ---------------------------------------------------------------------------------------------

#: documents' texts with the line that nfkc_clean_text adds, as NFKC leaves it.
NFKC_SQL = "(coalesce(text, '') || chr(10) || 'final 20 1')"
#: documents' texts with what the line rules look for: marks, labels, contents lines, page numbers, a broken word.
DECORATED = "concat('--- PAGE 1 ---\\nRef No: HR-', doc_id, '\\n', coalesce(text, ''), '\\n\\n\\nLeave Rules ........ 12\\nsee Page 2 of 9 now\\nexam-\\nple\\n', doc_id % 50, '/50\\n- 7 -')"
DECORATED_SQL = "('--- PAGE 1 ---' || chr(10) || 'Ref No: HR-' || doc_id || chr(10) || coalesce(text, '') || repeat(chr(10), 3) || 'Leave Rules ........ 12' || chr(10) || 'see Page 2 of 9 now' || chr(10) || 'exam-' || chr(10) || 'ple' || chr(10) || doc_id % 50 || '/50' || chr(10) || '- 7 -')"


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[^\S\r\n]+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


def sql_clean(x: str, but: str = "") -> str:
    """The line rules; `but`: what else a line x must not be."""
    joined = rf"regexp_replace(regexp_replace({x}, '[^\P{{C}}\n\t]', '', 'g'), '([\p{{L}}\p{{M}}\p{{N}}_])-\n([\p{{L}}\p{{M}}\p{{N}}_])', '\1\2', 'g')"
    lines = f"list_transform(string_split({joined}, chr(10)), lambda x: {sql_collapse('x')})"
    kept = (
        f"list_filter({lines}, lambda x: NOT regexp_matches(x, '^{X.PAGE_MARK}$') AND NOT regexp_matches(x, '{X.PAGE_NUMBER}') "
        f"AND NOT (regexp_matches(x, '{X.CONTROL_LABEL}') AND len({sql_words('x')}) <= 12) AND NOT regexp_matches(x, '{X.DOT_LEADER}'){but})"
    )
    plain = f"list_transform({kept}, lambda x: trim(regexp_replace(regexp_replace(x, '{X.INLINE_PAGE}', '', 'g'), ' {{2,}}', ' ', 'g')))"
    return rf"regexp_replace(regexp_replace(array_to_string({plain}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("clean_text", f"SELECT doc_id, sha256({sql_clean(DECORATED_SQL)}) AS sha, length({sql_clean(DECORATED_SQL)})::BIGINT AS n_chars FROM documents")
def clean_text(spark, sf_dir):
    cleaned = X.clean_text(F.expr(DECORATED))
    return documents(spark, sf_dir).select("doc_id", cleaned.alias("c")).select("doc_id", F.sha2("c", 256).alias("sha"), F.length("c").cast("long").alias("n_chars"))


@query("nfkc_clean_text", f"SELECT doc_id, {sql_clean(NFKC_SQL)} AS text FROM documents")
def nfkc_clean_text(spark, sf_dir):
    """With NFKC first, on texts that it changes: ligatures and full-width digits put in; nothing else of the given texts changes."""
    strange = F.concat(F.coalesce("text", F.lit("")), F.lit("\nﬁnal ２０ ①"))
    return documents(spark, sf_dir).select("doc_id", X.clean_text(X.nfkc(strange)).alias("text"))


#: A source is a document here, its documents are pages.
def source_pages(spark, sf_dir):
    return documents(spark, sf_dir, "source", "doc_id", "text").select(F.col("source").alias("doc_id"), (F.col("doc_id") + 1).alias("page_no"), "text")


REPEATED_SQL = f"""
lines AS (SELECT DISTINCT source AS doc_id, doc_id AS page, {sql_collapse('u.line')} AS line FROM documents, unnest(string_split(text, chr(10))) AS u(line)),
counted AS (SELECT doc_id, line, count(*) AS n_pages FROM lines WHERE line <> '' GROUP BY ALL),
marked AS (SELECT source AS doc_id, count(*) AS marked FROM documents GROUP BY 1 HAVING count(*) >= 3),
repeated AS (SELECT doc_id, line, n_pages FROM counted JOIN marked USING (doc_id) WHERE n_pages >= greatest(3, floor(marked * 0.1)) AND length(line) < 120)
"""


@query("repeated_lines", f"WITH {REPEATED_SQL} SELECT doc_id, line, n_pages FROM repeated")
def repeated_lines(spark, sf_dir):
    return pages.repeated_lines(source_pages(spark, sf_dir), share=0.1)


@query(
    "boilerplate_removed",
    f"WITH {REPEATED_SQL}, every AS (SELECT source AS doc_id, doc_id AS page, {sql_collapse('u.line')} AS line FROM documents, unnest(string_split(text, chr(10))) AS u(line)) "
    "SELECT doc_id, count(*) AS n_lines FROM every ANTI JOIN repeated USING (doc_id, line) GROUP BY doc_id",
)
def boilerplate_removed(spark, sf_dir):
    rows = source_pages(spark, sf_dir)
    return pages.without_lines(pages.page_lines(rows), pages.repeated_lines(rows, share=0.1)).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(
    "edge_numbers",
    r"WITH t AS (SELECT doc_id, string_split(CASE doc_id % 4 WHEN 0 THEN '67' WHEN 1 THEN '- 4 -' WHEN 2 THEN 'iv' ELSE 'x 1' END || chr(10) || coalesce(text, '') || chr(10) || '12 ' || chr(10), chr(10)) AS l FROM documents), "
    r"f AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: trim(l[i]) <> '') AS filled FROM t) "
    r"SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN (i = filled[1] OR i = filled[-1]) AND regexp_matches(l[i], '(?i)^\s*[-–]?\s*(?:\d{1,4}|[ivxlc]{1,6})\s*[-–]?\s*$') THEN '' ELSE l[i] END), chr(10))) AS sha FROM f",
)
def edge_numbers(spark, sf_dir):
    text = F.expr("concat(CASE doc_id % 4 WHEN 0 THEN '67' WHEN 1 THEN '- 4 -' WHEN 2 THEN 'iv' ELSE 'x 1' END, '\\n', coalesce(text, ''), '\\n12 \\n')")
    return pages.strip_edge_numbers(documents(spark, sf_dir).select("doc_id", text.alias("text"))).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("page_split", "SELECT doc_id, 2::BIGINT AS n_pages, (length(coalesce(text, '')) + 6)::BIGINT AS n_chars FROM documents")
def page_split(spark, sf_dir):
    marked = F.concat(F.lit("--- PAGE 1 ---\n"), F.coalesce("text", F.lit("")), F.lit("\n--- PAGE 2 ---\nlast\n"))
    rows = pages.split_pages(documents(spark, sf_dir).select("doc_id", marked.alias("text")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(
    "extraction_report",
    "SELECT regexp_extract(url, '//([^/]+)/', 1) AS doc_id, count(*) AS total_pages, count(*) FILTER (trim(coalesce(html, '')) <> '') AS text_pages, count(*) FILTER (trim(coalesce(html, '')) = '') AS empty_pages, sum(length(coalesce(html, '')))::BIGINT AS characters_extracted FROM pages GROUP BY 1",
)
def extraction_report(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "url", "html").select(F.regexp_extract("url", "//([^/]+)/", 1).alias("doc_id"), F.col("html").alias("text"))
    return pages.extraction_report(rows)


@query(
    "largest_documents",
    "SELECT regexp_extract(url, '//([^/]+)/', 1) AS doc_id, count(*) AS total_pages, sum(length(coalesce(html, '')))::BIGINT AS characters_extracted FROM pages GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5",
)
def largest_documents(spark, sf_dir):
    """The top five are the feature."""
    return pages.largest_documents(extraction_report(spark, sf_dir)).select("doc_id", "total_pages", "characters_extracted")


# ---- words -------------------------------------------------------------------------------------------------------


@query("word_vocabulary", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_vocabulary(spark, sf_dir):
    return vocabulary.vocabulary(documents(spark, sf_dir))


@query("doc_word_counts", f"SELECT doc_id, len({sql_words('text')})::BIGINT AS word_count, sha256(lower(array_to_string({sql_words('text')}, ' '))) AS digest FROM documents")
def doc_word_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).cast("long").alias("word_count"), X.normalized_digest(F.col("text")).alias("digest"))


#: The policy texts, and the words that a space has split: joined from left to right, chr(1) at the end of what is joined.
REPAIRED_SQL = rf"""
s AS (SELECT regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') || '_' || p_partkey // {PARTS} AS doc_id, p_partkey, array_to_string([
    '2.' || (p_partkey % 90 + 1) || ' ' || array_to_string(list_transform(string_split(regexp_replace(p_type, '[^A-Za-z ]', ' ', 'g'), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || ' Storage',
    '(a) Every keeper of ' || lower(p_type) || ' must count the stock within ' || p_size || ' days of its arrival at the store.',
    '(b) The price of an item is entered only once, and a change of more than ' || floor(p_retailprice)::BIGINT || ' per unit is signed by the head of',
    'the office before it takes effect.', '(c) The following are kept apart:', '- open boxes', '- returned goods;',
    '(d) Stock that is not eli gible for sale after ' || p_size || ' weeks is reported to the board, and eligible stock is listed with it.'], chr(10)) AS section FROM part),
texts AS (SELECT doc_id, 'Stock Policy of ' || upper(replace(doc_id, '_', ' ')) || chr(10) || 'This text binds all stores.' || chr(10) || string_agg(section, chr(10) ORDER BY p_partkey) || chr(10) || 'ANNEXURE FORMS' || chr(10) || 'Sign here on line 1.' || chr(10) ||
    'Held as q' || translate(doc_id[7:], '0123456789_', 'abcdefghijx') || 'ware, but q' || translate(doc_id[7:], '0123456789_', 'abcdefghijx') || ' ware ware; is kept' AS text FROM s GROUP BY doc_id),
own AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM texts) GROUP BY ALL),
counts AS (SELECT doc_id, word, n + sum(n) OVER (PARTITION BY word) AS n FROM own),
corpus AS (SELECT word, sum(n) AS n FROM own GROUP BY word),
lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, string_split(unnest(string_split(text, chr(10))), ' ') AS t FROM texts),
neighbours AS (SELECT DISTINCT doc_id, t[u.i] AS a, t[u.i + 1] AS whole_b, regexp_replace(t[u.i + 1], '[.,;:]$', '') AS b FROM lines, unnest(range(1, len(t))) AS u(i)),
candidates AS (SELECT DISTINCT doc_id, lower(a) AS a, b FROM neighbours WHERE regexp_matches(a, '^\p{{L}}+$') AND regexp_matches(whole_b, '^[a-z]+[.,;:]?$') AND lower(a) NOT IN {('o', 'i', *vocabulary.COMMON_WORDS)} AND b NOT IN {('i', *vocabulary.COMMON_WORDS)}),
seen AS (SELECT c.*, coalesce(x.n, u.n, 0) AS n_a, coalesce(y.n, v.n, 0) AS n_b, coalesce(z.n, w.n, 0) AS n_ab FROM candidates c LEFT JOIN corpus u ON u.word = a LEFT JOIN corpus v ON v.word = b LEFT JOIN corpus w ON w.word = a || b
    LEFT JOIN counts x ON x.doc_id = c.doc_id AND x.word = a LEFT JOIN counts y ON y.doc_id = c.doc_id AND y.word = b LEFT JOIN counts z ON z.doc_id = c.doc_id AND z.word = a || b),
joined AS (SELECT doc_id, list(a || ' ' || b) AS pairs FROM seen WHERE n_ab >= CASE WHEN least(len(a), len(b)) = 1 THEN 3 ELSE 1 END AND least(n_a, n_b) <= 3 GROUP BY doc_id),
mended AS (SELECT doc_id, line, replace(array_to_string(list_reduce(list_transform(t, lambda w: [w]), lambda kept, x:
    CASE WHEN list_contains(coalesce(pairs, []), lower(kept[-1]) || ' ' || rtrim(x[1], '.,;:')) AND regexp_matches(x[1], '^\p{{Ll}}') THEN list_append(kept[:-2], kept[-1] || x[1] || chr(1)) ELSE list_concat(kept, x) END), ' '), chr(1), '') AS line_text FROM lines LEFT JOIN joined USING (doc_id))
"""


@query("repaired_words", f"WITH {REPAIRED_SQL} SELECT doc_id, string_agg(line_text, chr(10) ORDER BY line) AS text FROM mended GROUP BY doc_id")
def repaired_words(spark, sf_dir):
    """The policy texts with their split words joined. Each gets a word of its own that is once whole and once split; one
    that all policies have in two parts ("eli gible") stays, since neither part is rare."""
    code = F.concat(F.lit("q"), F.translate(F.substr("doc_id", F.lit(7)), "0123456789_", "abcdefghijx"))
    docs = policy_texts(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nHeld as "), code, F.lit("ware, but "), code, F.lit(" ware ware; is kept")))
    long_texts(spark)
    docs = materialize(docs, "policies")
    return vocabulary.repair_split_words(docs, materialize(vocabulary.vocabulary(docs), "vocabulary"))


@query("word_chunks", f"SELECT doc_id, (len({sql_words('text')}) + 599) // 600 AS n_chunks, sha256(array_to_string({sql_words('text')}[1:600], ' ')) AS first_sha FROM documents WHERE len({sql_words('text')}) > 0")
def word_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", X.word_chunks(F.col("text")).alias("c")).where(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.sha2(F.col("c")[0], 256).alias("first_sha"))


# ---- filters and deduplication -----------------------------------------------------------------------------------

SETTINGS = Settings()
CLEANED_SQL = f"c AS (SELECT doc_id, text AS raw, {sql_clean('text')} AS text, lang FROM documents)"
#: Records of c(doc_id, raw, text, lang).
OF_CLEANED_SQL = f"""
d AS MATERIALIZED (SELECT *, len({sql_words('text')}) AS wc, sha256(lower(array_to_string({sql_words('text')}, ' '))) AS digest FROM c),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY digest) AS first_of FROM d WHERE wc >= 100),
orig AS (SELECT doc_id, text, lang FROM f WHERE doc_id = first_of),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM orig),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(0, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
pairs AS MATERIALIZED (SELECT a.doc_id AS later, b.doc_id AS earlier, count(*) / (a.n + b.n - count(*)) AS similarity FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id > b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
edges AS (SELECT * FROM pairs WHERE similarity >= 0.8),
nodes AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rn FROM orig WHERE doc_id IN (SELECT later FROM edges UNION SELECT earlier FROM edges)),
steps AS (SELECT n.rn, n.doc_id, n.lang, coalesce(list(e.earlier) FILTER (e.earlier IS NOT NULL), []) AS earlier FROM nodes n LEFT JOIN edges e ON e.later = n.doc_id GROUP BY ALL),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, []::BIGINT[] AS near UNION ALL
  SELECT s.rn, CASE WHEN list_has_any(walk.kept, s.earlier) OR s.lang IS DISTINCT FROM 'en' THEN walk.kept ELSE list_append(walk.kept, s.doc_id) END,
    CASE WHEN list_has_any(walk.kept, s.earlier) THEN list_append(walk.near, s.doc_id) ELSE walk.near END
  FROM walk JOIN steps s ON s.rn = walk.i + 1),
ended AS (SELECT kept, near FROM walk ORDER BY i DESC LIMIT 1),
keepers AS (SELECT doc_id AS earlier FROM orig WHERE list_contains((SELECT kept FROM ended), doc_id) OR lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM nodes)),
best AS (SELECT later AS doc_id, max(struct_pack(similarity := similarity, earlier := earlier)) AS b FROM pairs SEMI JOIN keepers USING (earlier) GROUP BY later),
reasons AS (SELECT d.*, f.first_of, best.b, CASE WHEN d.wc < 100 THEN 'below_min_words' WHEN f.first_of <> d.doc_id THEN 'exact_duplicate'
    WHEN list_contains((SELECT near FROM ended), d.doc_id) THEN 'near_duplicate' WHEN d.lang = 'en' THEN 'passes_filters'
    WHEN d.lang IS NULL THEN 'language_detection_failed' ELSE 'non_english' END AS reason
  FROM d LEFT JOIN f USING (doc_id) LEFT JOIN best USING (doc_id)),
records AS (SELECT doc_id, wc::BIGINT AS word_count, CASE WHEN reason = 'passes_filters' THEN 'kept' ELSE 'removed' END AS status, reason,
    CASE WHEN reason = 'exact_duplicate' THEN first_of WHEN reason = 'near_duplicate' THEN b.earlier END AS duplicate_of,
    round(CASE WHEN reason = 'exact_duplicate' THEN 1.0 WHEN wc >= 100 THEN coalesce(b.similarity, 0) END, 6) AS max_similarity,
    CASE WHEN reason IN ('passes_filters', 'non_english', 'language_detection_failed') THEN coalesce(lang, 'unknown') ELSE 'not_checked' END AS language,
    length(raw)::BIGINT AS characters_before, length(text)::BIGINT AS characters_after, (length(raw) - length(text))::BIGINT AS characters_removed,
    round(CASE WHEN length(raw) > 0 THEN 100.0 * (length(raw) - length(text)) / length(raw) ELSE 0 END, 2) AS reduction_percent FROM reasons)
"""
RECORDS_SQL = f"{CLEANED_SQL}, {OF_CLEANED_SQL}"
WITH_RECORDS = f"WITH RECURSIVE {RECORDS_SQL}"


FUNNEL_SQL = """
stages AS (SELECT * FROM (VALUES (0, 'basic_cleaning'), (1, 'length_filter'), (2, 'deduplication'), (3, 'near_dedup'), (4, 'english_filter')) AS s(stage_no, stage)),
ranked AS (SELECT *, CASE reason WHEN 'below_min_words' THEN 1 WHEN 'exact_duplicate' THEN 2 WHEN 'near_duplicate' THEN 3 WHEN 'passes_filters' THEN 5 ELSE 4 END AS gone FROM records),
funnel AS (SELECT stage_no, stage, count(*) FILTER (gone >= stage_no) AS documents_before, count(*) FILTER (gone > stage_no) AS documents_after, count(*) FILTER (gone = stage_no) AS documents_removed,
  coalesce(sum(CASE WHEN stage_no = 0 THEN characters_before WHEN gone >= stage_no THEN characters_after END), 0)::BIGINT AS characters_before,
  coalesce(sum(CASE WHEN gone > stage_no THEN characters_after END), 0)::BIGINT AS characters_after FROM stages, ranked GROUP BY ALL)
"""


def cleaned_documents(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text", "lang").select("doc_id", F.col("text").alias("raw"), X.clean_text(F.col("text")).alias("text"), "lang")


def records(spark, sf_dir):
    """As RECORDS_SQL says, but for max_similarity, which is null below the threshold: no query that reads it uses this."""
    return dedup.cleaning_records(cleaned_documents(spark, sf_dir), SETTINGS, below=False)


def full_records(spark, sf_dir):
    """As RECORDS_SQL says, with the best similarity to an earlier kept document wherever it lies."""
    return dedup.cleaning_records(cleaned_documents(spark, sf_dir), SETTINGS)


def long_documents(spark, sf_dir):
    """doc_id, text, digest of the cleaned documents of enough words, written."""
    rows = cleaned_documents(spark, sf_dir).select("doc_id", "text", X.word_count(F.col("text")).alias("word_count"), X.normalized_digest(F.col("text")).alias("digest"))
    return materialize(rows, "cleaned").where(F.col("word_count") >= SETTINGS.min_words)


@query("length_filter", f"SELECT doc_id FROM documents WHERE len({sql_words('text')}) >= 100")
def length_filter(spark, sf_dir):
    return documents(spark, sf_dir).where(X.word_count(F.col("text")) >= SETTINGS.min_words).select("doc_id")


@query("exact_dedup", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(array_to_string({sql_words('text')}, ' '))) AS first_of FROM documents")
def exact_dedup(spark, sf_dir):
    return dedup.exact_duplicates(doc_word_counts(spark, sf_dir)).select("doc_id", "first_of")


@query("shingle_counts", f"WITH RECURSIVE {RECORDS_SQL} SELECT doc_id, len(s)::BIGINT AS n FROM sets")
def shingle_counts(spark, sf_dir):
    _, originals = dedup.first_documents(long_documents(spark, sf_dir))
    return originals.select("doc_id", F.size(X.shingles(F.col("text"))).cast("long").alias("n"))


@query("similar_pairs", f"{WITH_RECORDS} SELECT later, earlier, round(similarity, 6) AS similarity FROM edges")
def similar_pairs(spark, sf_dir):
    _, originals = dedup.first_documents(long_documents(spark, sf_dir))
    return dedup.similar_pairs(originals.select("doc_id", "text")).select("later", "earlier", F.round("similarity", 6).alias("similarity"))


@query("cleaning_records", f"{WITH_RECORDS} SELECT * FROM records")
def cleaning_records(spark, sf_dir):
    return full_records(spark, sf_dir).withColumn("max_similarity", F.round("max_similarity", 6))


@query("stage_funnel", f"{WITH_RECORDS}, {FUNNEL_SQL} SELECT *, characters_before - characters_after AS characters_removed FROM funnel")
def stage_funnel(spark, sf_dir):
    return funnel.stage_funnel(records(spark, sf_dir))


@query("largest_removals", f"{WITH_RECORDS}, {FUNNEL_SQL} SELECT stage, documents_removed AS removed FROM funnel WHERE documents_removed = (SELECT max(documents_removed) FROM funnel) AND documents_removed > 0")
def largest_removals(spark, sf_dir):
    return funnel.largest_removals(stage_funnel(spark, sf_dir))


@query("word_statistics", f"{WITH_RECORDS} SELECT count(*) AS documents, sum(word_count)::BIGINT AS total, min(word_count) AS minimum, max(word_count) AS maximum, round(avg(word_count), 1) AS mean, median(word_count) AS median FROM records WHERE status = 'kept'")
def word_statistics(spark, sf_dir):
    return funnel.word_statistics(records(spark, sf_dir).where("status = 'kept'"))


@query("reason_counts", f"{WITH_RECORDS} SELECT reason, count(*) AS n FROM records GROUP BY reason")
def reason_counts(spark, sf_dir):
    return funnel.counts_by(records(spark, sf_dir), "reason", "reason")


@query("corpus_reduction", f"{WITH_RECORDS} SELECT count(*) AS documents, sum(characters_before)::BIGINT AS characters_before, sum(characters_after)::BIGINT AS characters_after, round(100.0 * (sum(characters_before) - sum(characters_after)) / sum(characters_before), 2) AS character_reduction_percent, count(*) FILTER (reason = 'language_detection_failed') AS language_detection_failures FROM records")
def corpus_reduction(spark, sf_dir):
    return funnel.reduction(records(spark, sf_dir))


@query("most_similar_kept", f"{WITH_RECORDS} SELECT doc_id, max_similarity FROM records WHERE status = 'kept' AND max_similarity IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 5")
def most_similar_kept(spark, sf_dir):
    """The top five are the feature."""
    return funnel.most_similar(full_records(spark, sf_dir).withColumn("max_similarity", F.round("max_similarity", 6)))


#: A file is eight documents as pages, each with a running head and its number at the foot; a part of them is named as copies.
PAGED = "concat('Running Head ', doc_id div 8, '\\n', coalesce(text, ''), '\\n', doc_id % 8 + 1)"
FILE_NAME = "concat(CASE WHEN doc_id div 8 % 4 = 0 THEN 'a_dup_' ELSE 'b_' END, lpad(doc_id div 8, 12, '0'), '.txt')"
FILES_SQL = rf"""
p AS (SELECT doc_id // 8 AS file, doc_id % 8 + 1 AS page, lang, regexp_replace('Running Head ' || (doc_id // 8) || chr(10) || coalesce(text, '') || chr(10) || (doc_id % 8 + 1), '^\s+|\s+$', '', 'g') AS text FROM documents),
marked AS (SELECT file, count(*) AS n FROM p GROUP BY file HAVING count(*) >= 3),
heads AS (SELECT file, list(line) AS boilerplate FROM (SELECT file, line, count(*) AS k FROM (SELECT DISTINCT file, page, {sql_collapse('u.line')} AS line FROM p, unnest(string_split(text, chr(10))) AS u(line)) WHERE line <> '' GROUP BY ALL)
  JOIN marked USING (file) WHERE k >= greatest(3, n // 2) AND length(line) < 120 GROUP BY file),
cut AS (SELECT file, page, text, string_split(text, chr(10)) AS l FROM p),
seen AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '\S')) AS filled FROM cut),
edged AS MATERIALIZED (SELECT file, page, text, array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN (i = filled[1] OR i = filled[-1]) AND regexp_matches(l[i], '{X.EDGE_NUMBER}') THEN '' ELSE l[i] END), chr(10)) AS edged FROM seen),
files AS (SELECT file, string_agg('--- PAGE ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS raw, string_agg('--- PAGE ' || page || ' ---' || chr(10) || edged, chr(10) || chr(10) ORDER BY page) AS edged FROM edged GROUP BY file),
named AS (SELECT file, CASE WHEN file % 4 = 0 THEN 'a_dup_' ELSE 'b_' END || lpad(file::VARCHAR, 12, '0') || '.txt' AS file_name, raw, edged, coalesce(boilerplate, []) AS boilerplate, lang FROM files LEFT JOIN heads USING (file) JOIN (SELECT file, min(lang) AS lang FROM p GROUP BY file) USING (file)),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY contains(file_name, 'dup'), file_name) - 1 AS doc_id, file_name, raw, {sql_clean('edged', " AND NOT list_contains(boilerplate, x)")} AS text, lang FROM named)
"""


def paged_files(spark, sf_dir):
    """file_name, text, lang: eight documents each, so a file is bounded."""
    rows = documents(spark, sf_dir, "doc_id", "text", "lang").select(F.expr(FILE_NAME).alias("doc_id"), (F.col("doc_id") % 8 + 1).alias("page_no"), F.expr(PAGED).alias("text"), "lang")
    lang = rows.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    return pages.join_pages(rows).join(lang, "doc_id").withColumnRenamed("doc_id", "file_name")


@query(
    "clean_corpus",
    f"WITH RECURSIVE {FILES_SQL}, {OF_CLEANED_SQL} SELECT c.file_name, r.* EXCLUDE (doc_id, duplicate_of), k.file_name AS duplicate_of FROM records r JOIN c USING (doc_id) LEFT JOIN c k ON k.doc_id = r.duplicate_of",
)
def clean_corpus(spark, sf_dir):
    """The whole chain, but for split words, which SQL cannot mend: see repaired_corpus."""
    found, _ = cleaning.clean_corpus(paged_files(spark, sf_dir), SETTINGS, repair=False)
    return found.withColumn("max_similarity", F.round("max_similarity", 6))


@query("kept_texts", f"WITH RECURSIVE {FILES_SQL}, {OF_CLEANED_SQL} SELECT c.file_name, sha256(c.text) AS sha FROM records JOIN c USING (doc_id) WHERE status = 'kept'")
def kept_texts(spark, sf_dir):
    return cleaning.clean_corpus(paged_files(spark, sf_dir), SETTINGS, repair=False, below=False)[1].select("file_name", F.sha2("text", 256).alias("sha"))


@query("repaired_corpus")
def repaired_corpus(spark, sf_dir):
    """The whole chain with split words joined; tested against a plain version."""
    return cleaning.clean_corpus(paged_files(spark, sf_dir), SETTINGS, below=False)[1]


@query(
    "corpus_summary",
    f"{WITH_RECORDS}, {FUNNEL_SQL}, g AS (SELECT *, characters_before - characters_after AS characters_removed FROM funnel), k AS (SELECT * FROM records WHERE status = 'kept') "
    "SELECT (SELECT count(*) FROM records) AS documents_before, (SELECT count(*) FROM k) AS documents_after, (SELECT string_agg(stage || ':' || documents_after || ':' || characters_after, ' ' ORDER BY stage_no) FROM g) AS stages, "
    "(SELECT string_agg(stage, ' ' ORDER BY stage_no) FROM g WHERE documents_removed > 0 AND documents_removed = (SELECT max(documents_removed) FROM g)) AS most_documents, "
    "(SELECT string_agg(stage, ' ' ORDER BY stage_no) FROM g WHERE characters_removed > 0 AND characters_removed = (SELECT max(characters_removed) FROM g)) AS most_characters, "
    "(SELECT sum(word_count)::BIGINT FROM k) AS total, (SELECT median(word_count) FROM k) AS median, (SELECT sum(characters_after)::BIGINT FROM k) AS characters_after, "
    "(SELECT round(100.0 * (sum(characters_before) - (SELECT sum(characters_after) FROM k)) / sum(characters_before), 2) FROM records) AS character_reduction_percent",
)
def corpus_summary(spark, sf_dir):
    found = cleaning.summarize_corpus(materialize(records(spark, sf_dir), "records"))
    stages = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["stage"], s["documents_after"].cast("string"), s["characters_after"].cast("string"))), " ")
    return found.select(
        "documents_before", "documents_after", stages.alias("stages"), F.array_join("largest_document_removal_stages", " ").alias("most_documents"), F.array_join("largest_character_removal_stages", " ").alias("most_characters"),
        "retained_document_words.total", "retained_document_words.median", "characters_after", "character_reduction_percent",
    )


@query("language_filter", f"SELECT coalesce(lang, 'unknown') AS language, count(*) AS n, count(*) FILTER (lang = 'en') AS kept FROM documents GROUP BY 1")
def language_filter(spark, sf_dir):
    lang = F.coalesce("lang", F.lit("unknown"))
    return documents(spark, sf_dir, "doc_id", "lang").groupBy(lang.alias("language")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == SETTINGS.language).alias("kept"))


def sql_detect(labelled: str, rows: str) -> str:
    """CTEs: detected(doc_id, language) of rows(doc_id, text), learnt from labelled(text, lang)."""
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+'), lambda w: w <> '')"
    return f"""
labelled_words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({words}) AS word FROM {labelled} WHERE lang IS NOT NULL) GROUP BY ALL),
labelled_grams AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, n, substring(' ' || word || ' ', i, 3) AS gram FROM labelled_words, range(1, length(word) + 1) t(i)) GROUP BY ALL),
profiles AS (SELECT lang, gram, {language.PROFILE + 1} - row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS worth FROM labelled_grams QUALIFY worth > 0),
text_words AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({words}) AS word FROM {rows}) GROUP BY ALL),
text_grams AS (SELECT doc_id, substring(' ' || word || ' ', i, 3) AS gram, sum(n) AS n FROM text_words, range(1, length(word) + 1) t(i) GROUP BY ALL),
worths AS (SELECT doc_id, lang, sum(n * worth) AS worth FROM text_grams JOIN profiles USING (gram) GROUP BY ALL),
detected AS (SELECT doc_id, lang AS language FROM worths QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY worth DESC, lang) = 1)"""


def learnt_profiles(spark, sf_dir):
    return language.learn_profiles(documents(spark, sf_dir, "text", "lang"))


@query("language_profiles", f"WITH {sql_detect('documents', 'documents')} SELECT lang, gram, worth FROM profiles")
def language_profiles(spark, sf_dir):
    return learnt_profiles(spark, sf_dir)


@query("detected_languages", f"WITH {sql_detect('documents', 'documents')} SELECT d.doc_id, language FROM documents d LEFT JOIN detected USING (doc_id)")
def detected_languages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id").join(language.detect(docs, learnt_profiles(spark, sf_dir)), "doc_id", "left")


@query("detected_filter", f"WITH {sql_detect('documents', 'documents')} SELECT coalesce(language, 'unknown') AS language, count(*) AS n, count(*) FILTER (language = 'en') AS kept, count(*) FILTER (language = lang) AS as_labelled FROM documents LEFT JOIN detected USING (doc_id) GROUP BY 1")
def detected_filter(spark, sf_dir):
    """What the language filter keeps by the detector's answers, and how many of them are the label."""
    rows = documents(spark, sf_dir, "doc_id", "lang").join(detected_languages(spark, sf_dir), "doc_id")
    return rows.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"), F.count_if(F.col("language") == SETTINGS.language).alias("kept"), F.count_if(F.col("language") == F.col("lang")).alias("as_labelled"))


DETECTED_FILES_SQL = f"""{FILES_SQL.rstrip().replace("c AS MATERIALIZED", "named_rows AS MATERIALIZED")}, {sql_detect("documents", "named_rows")},
c AS MATERIALIZED (SELECT n.doc_id, file_name, raw, text, language AS lang FROM named_rows n LEFT JOIN detected USING (doc_id))"""


@query(
    "clean_corpus_detected",
    f"WITH RECURSIVE {DETECTED_FILES_SQL}, {OF_CLEANED_SQL} SELECT c.file_name, r.* EXCLUDE (doc_id, duplicate_of), k.file_name AS duplicate_of FROM records r JOIN c USING (doc_id) LEFT JOIN c k ON k.doc_id = r.duplicate_of",
)
def clean_corpus_detected(spark, sf_dir):
    """The whole chain with the language that the detector finds in the cleaned text."""
    found, _ = cleaning.clean_corpus(paged_files(spark, sf_dir).drop("lang"), SETTINGS, repair=False, profiles=learnt_profiles(spark, sf_dir))
    return found.withColumn("max_similarity", F.round("max_similarity", 6))


@query("paged_folder", "SELECT CASE WHEN doc_id // 8 % 4 = 0 THEN 'a_dup_' ELSE 'b_' END || lpad((doc_id // 8)::VARCHAR, 12, '0') || '.txt' AS file_name, (doc_id % 8 + 1)::INTEGER AS page_no, sha256(regexp_replace('Running Head ' || (doc_id // 8) || chr(10) || coalesce(text, '') || chr(10) || (doc_id % 8 + 1), '^\\s+|\\s+$', '', 'g')) AS sha, NULL::VARCHAR AS error FROM documents")
def paged_folder(spark, sf_dir):
    """The page-marked files, written to a folder and read back page by page."""
    folder = f"{shared_dir(spark)}/corpusloom/paged-{uuid.uuid4().hex}"
    paged_files(spark, sf_dir).select("text", F.col("file_name").alias("file")).repartition("file").write.partitionBy("file").text(folder)
    return readers.read_page_marked(spark, folder, name=F.col("file")).select("file_name", "page_no", F.sha2("text", 256).alias("sha"), "error")


def kept_by_rules(files: DataFrame) -> DataFrame:
    cleaned = files.select("file_name", X.clean_text(F.col("text")).alias("text"))
    return cleaned.where(X.word_count(F.col("text")) >= SETTINGS.min_words)


@query(
    "incremental_sync",
    f"""
WITH now AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN coalesce(text, '') || ' as revised' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 10 <> 0),
cleaned AS (SELECT doc_id, {sql_clean('text')} AS text FROM now),
kept AS (SELECT doc_id, sha256(text) AS sha FROM cleaned WHERE len({sql_words('text')}) >= 100)
SELECT doc_id::VARCHAR AS file_name, CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 10 = 1 THEN 'changed' WHEN doc_id % 10 = 2 THEN 'added' ELSE 'same' END AS action, sha FROM documents LEFT JOIN kept USING (doc_id)
""",
)
def incremental_sync(spark, sf_dir):
    """A table made from a first state of all documents, brought up to a second one in which a tenth each has vanished, changed
    and come: what was done to each document, and the digest of the text that the table then keeps."""
    path = f"{shared_dir(spark)}/corpusloom/synced-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file_name"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 10).alias("k"))
    sync.sync(docs.where("k <> 2").select("file_name", "text"), path, kept_by_rules)
    after = docs.where("k <> 0").select("file_name", F.when(F.col("k") == 1, F.concat("text", F.lit(" as revised"))).otherwise(F.col("text")).alias("text"))
    actions = sync.sync(after, path, kept_by_rules)
    return actions.join(sync.synced_texts(spark, path).select("file_name", F.sha2("text", 256).alias("sha")), "file_name", "left")


@query("merged_log", "SELECT event_id AS step, round(CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END, 6) AS loss FROM events WHERE value IS NOT NULL")
def merged_log(spark, sf_dir):
    """Events as a log that arrives in three batches: the first comes twice, the last corrects every fifth record."""
    path = f"{shared_dir(spark)}/corpusloom/log-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events", "event_id", "value").where("value is not null").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    first = rows.where("step % 2 = 0")
    for batch in (first, rows.where("step % 2 = 1"), first, rows.where("step % 5 = 0").select("step", (F.col("loss") + 1).alias("loss"))):
        sync.merge_log(batch, path)
    return spark.read.parquet(path).select("step", F.round("loss", 6).alias("loss"))


# ---- split, tokens, blocks ---------------------------------------------------------------------------------------

UNSEEN_SQL = f"""
wc AS (SELECT doc_id, len({sql_words('text')})::BIGINT AS words FROM documents),
target AS (SELECT 0.05 * sum(words) AS t FROM wc),
ranked AS (SELECT doc_id, words, sha256('42|' || doc_id) AS rank, row_number() OVER (ORDER BY sha256('42|' || doc_id), doc_id) AS rn FROM wc WHERE words > 0),
walk AS (SELECT 0::BIGINT AS i, 0::BIGINT AS total, []::BIGINT[] AS taken UNION ALL
  SELECT r.rn, CASE WHEN total < t AND total + r.words <= 1.5 * t THEN total + r.words ELSE total END, CASE WHEN total < t AND total + r.words <= 1.5 * t THEN list_append(taken, r.doc_id) ELSE taken END
  FROM walk JOIN ranked r ON r.rn = walk.i + 1, target WHERE total < t),
unseen AS (SELECT unnest(taken) AS doc_id FROM (SELECT taken FROM walk ORDER BY i DESC LIMIT 1))
"""


@query("unseen_documents", f"WITH RECURSIVE {UNSEEN_SQL} SELECT doc_id, words, rank FROM ranked SEMI JOIN unseen USING (doc_id)")
def unseen_documents(spark, sf_dir):
    return split.unseen_documents(documents(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("words")))


#: These tables have no blank lines, so cuts at line ends and words are all there is.
TAIL_SQL = f"""
base AS (SELECT doc_id, coalesce(text, '') AS text, {sql_words('text')} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
sums AS (SELECT doc_id, u.i AS cut, sum(len({sql_words('l[u.i]')})) OVER (PARTITION BY doc_id ORDER BY u.i) AS n, len(w) AS total FROM base, unnest(range(1, len(l))) AS u(i)),
cuts AS (SELECT doc_id, min(struct_pack(gap := round(abs(n - 0.9 * total), 6), cut := cut)) AS c FROM sums WHERE n > 0 AND n < total GROUP BY doc_id),
tails AS (SELECT doc_id, text, CASE WHEN c.gap <= 0.05 * len(w) THEN 'line' ELSE 'words' END AS how,
  CASE WHEN c.gap <= 0.05 * len(w) THEN trim(array_to_string(l[1:c.cut], chr(10)), ' ') ELSE array_to_string(w[1:round_even(0.9 * len(w), 0)::INT], ' ') END AS head,
  CASE WHEN c.gap <= 0.05 * len(w) THEN trim(array_to_string(l[c.cut + 1:], chr(10)), ' ') ELSE array_to_string(w[round_even(0.9 * len(w), 0)::INT + 1:], ' ') END AS tail
  FROM base LEFT JOIN cuts USING (doc_id))
"""


@query("tail_split", f"WITH {TAIL_SQL} SELECT doc_id, how, sha256(head) AS head_sha, sha256(tail) AS tail_sha FROM tails")
def tail_split(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", split.tail_split(F.col("text"), SETTINGS.eval_fraction).alias("s"))
    return rows.select("doc_id", "s.how", F.sha2("s.head", 256).alias("head_sha"), F.sha2("s.tail", 256).alias("tail_sha"))


SPLIT_SQL = f"""{UNSEEN_SQL}, {TAIL_SQL},
pieces AS (SELECT doc_id AS document_id, 'train' AS split, 'head' AS part, head AS piece, text FROM tails ANTI JOIN unseen USING (doc_id) UNION ALL
  SELECT doc_id, 'eval', 'tail', tail, text FROM tails ANTI JOIN unseen USING (doc_id) UNION ALL SELECT doc_id, 'eval_unseen', NULL, text, text FROM tails SEMI JOIN unseen USING (doc_id)),
split AS (SELECT document_id, split, part, len({sql_words('piece')})::BIGINT AS words, sha256(text) AS sha256, piece FROM pieces)
"""


@query("split_corpus", f"WITH RECURSIVE {SPLIT_SQL} SELECT document_id, split, part, words, sha256, sha256(piece) AS piece_sha FROM split")
def split_corpus(spark, sf_dir):
    rows = split.split_corpus(documents(spark, sf_dir), SETTINGS)
    return rows.select("document_id", "split", "part", "words", "sha256", F.sha2("text", 256).alias("piece_sha"))


@query("split_manifest", f"WITH RECURSIVE {SPLIT_SQL} SELECT split, count(*) AS documents, sum(words)::BIGINT AS words, round(sum(words) / (SELECT sum(words) FROM split), 4) AS fraction FROM split GROUP BY split")
def split_manifest(spark, sf_dir):
    return split.split_manifest(split.split_corpus(documents(spark, sf_dir), SETTINGS))


@query(
    "grouped_split",
    "WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT source, coalesce(sum(n) OVER (ORDER BY sha256('42|' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) "
    "SELECT doc_id, source, CASE WHEN before < 0.8 * (SELECT count(*) FROM documents) THEN 'train' ELSE 'eval' END AS split FROM documents JOIN p USING (source)",
)
def grouped_split(spark, sf_dir):
    return split.grouped_split(documents(spark, sf_dir, "doc_id", "source"), "source").select("doc_id", "source", "split")


def encoded_splits(spark, sf_dir):
    """Sources by a hash of their name: one in five is eval."""
    which = F.when(F.conv(F.substring(F.md5("source"), 1, 4), 16, 10).cast("int") % 5 == 0, "eval").otherwise("train")
    return blocks.encode(documents(spark, sf_dir, "doc_id", "text", "source").select(F.col("doc_id").alias("document_id"), which.alias("split"), "text"))


BLOCK = 512
TOKENS_SQL = f"""
e AS (SELECT doc_id AS document_id, CASE WHEN ('0x' || md5(source)[1:4])::INT % 5 = 0 THEN 'eval' ELSE 'train' END AS split,
  list_concat([1], list_transform({sql_words('text')}, lambda w: (('0x' || md5(w)[1:7])::INT % 30000 + 3)::INT), [2]) AS ids FROM documents),
t AS (SELECT split, document_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM e),
g AS (SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY document_id, k) - 1 AS g FROM t),
b AS (SELECT split, g // {BLOCK} AS block, list(id ORDER BY g) AS input_ids FROM g GROUP BY ALL),
blocks AS (SELECT * FROM b WHERE len(input_ids) = {BLOCK} OR split <> 'train' AND len(input_ids) > 1)
"""


def packed(spark, sf_dir):
    return blocks.pack_blocks(encoded_splits(spark, sf_dir), BLOCK)


@query("token_lengths", f"WITH {TOKENS_SQL} SELECT document_id, split, len(ids)::BIGINT AS tokens FROM e")
def token_lengths(spark, sf_dir):
    return encoded_splits(spark, sf_dir).select("document_id", "split", F.size("ids").cast("long").alias("tokens"))


@query("pack_blocks", f"WITH {TOKENS_SQL} SELECT split, block, len(input_ids)::BIGINT AS tokens, md5(array_to_string(input_ids, ',')) AS ids_md5 FROM blocks")
def pack_blocks(spark, sf_dir):
    return packed(spark, sf_dir).select("split", "block", F.size("input_ids").cast("long").alias("tokens"), F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("ids_md5"))


@query("token_statistics", f"WITH {TOKENS_SQL}, k AS (SELECT split, count(*) AS blocks, sum(len(input_ids)) AS kept FROM blocks GROUP BY split) SELECT split, count(*) AS documents, sum(len(ids))::BIGINT AS tokens, round(avg(len(ids)), 1) AS mean_tokens, min(len(ids)) AS min_tokens, max(len(ids)) AS max_tokens, coalesce(any_value(blocks), 0)::BIGINT AS blocks, (sum(len(ids)) - coalesce(any_value(kept), 0))::BIGINT AS dropped_tokens FROM e LEFT JOIN k USING (split) GROUP BY split")
def token_statistics(spark, sf_dir):
    rows = blocks.token_statistics(encoded_splits(spark, sf_dir), packed(spark, sf_dir))
    return rows.withColumns({"min_tokens": F.col("min_tokens").cast("long"), "max_tokens": F.col("max_tokens").cast("long")})


@query("special_counts", f"WITH {TOKENS_SQL} SELECT split, sum(len(list_filter(input_ids, lambda x: x = 1)))::BIGINT AS bos_tokens, sum(len(list_filter(input_ids, lambda x: x = 2)))::BIGINT AS eos_tokens FROM blocks GROUP BY split")
def special_counts(spark, sf_dir):
    return blocks.special_counts(packed(spark, sf_dir))


@query("uneven_blocks", f"WITH {TOKENS_SQL} SELECT count(*) FILTER (len(input_ids) <> {BLOCK}) AS uneven FROM blocks WHERE split = 'train'")
def uneven_blocks(spark, sf_dir):
    return blocks.uneven_blocks(packed(spark, sf_dir), BLOCK)


@query("special_context", f"WITH {TOKENS_SQL}, p AS (SELECT *, list_position(input_ids, 2) AS position FROM blocks) SELECT split, block, position::BIGINT AS position, array_to_string(input_ids[greatest(position - 4, 1):position + 4], ',') AS context FROM p WHERE position > 0")
def special_context(spark, sf_dir):
    return blocks.first_special_context(packed(spark, sf_dir)).withColumn("context", F.array_join(F.transform("context", lambda x: x.cast("string")), ","))


# ---- conversations and instructions ------------------------------------------------------------------------------


@query("chat_messages", "SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    return conversations.collect_messages(table(spark, sf_dir, "conversations")).select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join("messages.role", ",").alias("roles"))


@query("chat_render", "SELECT conv_id, sha256(string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || '</s>' || chr(10), '' ORDER BY turn)) AS sha FROM conversations GROUP BY conv_id")
def chat_render(spark, sf_dir):
    return conversations.collect_messages(table(spark, sf_dir, "conversations")).select("conv_id", F.sha2(conversations.render(F.col("messages")), 256).alias("sha"))


#: What the policy texts are made of, and what titles, sections and clauses their lines have to give.
POLICIES_SQL = rf"""
p AS (SELECT regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') || '_' || p_partkey // {PARTS} AS doc_id, p_partkey, lower(p_type) AS kind, p_size AS size, floor(p_retailprice)::BIGINT AS price,
    array_to_string(list_transform(string_split(regexp_replace(p_type, '[^A-Za-z ]', ' ', 'g'), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || ' Storage' AS heading FROM part),
named AS (SELECT DISTINCT doc_id, 'Stock Policy of ' || upper(replace(doc_id, '_', ' ')) AS first_line, CASE WHEN doc_id = 'brand_11_0' THEN 'Curated Title' ELSE 'Stock Policy of Brand' || replace(doc_id[6:], '_', ' ') END AS title FROM p),
rules AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p_partkey)::INTEGER AS section, heading,
    'Every keeper of ' || kind || ' must count the stock within ' || size || ' days of its arrival at the store.' AS a,
    'The price of an item is entered only once, and a change of more than ' || price || ' per unit is signed by the head of the office before it takes effect.' AS b,
    'Stock that is not eli gible for sale after ' || size || ' weeks is reported to the board, and eligible stock is listed with it.' AS d, kind FROM p),
sections AS (
  SELECT doc_id, 0 AS section, 'Overview' AS heading, 2 AS n_lines, [first_line || ' This text binds all stores.'] AS clauses FROM named
  UNION ALL SELECT doc_id, section, heading, 7, [a, b, 'The following are kept apart: open boxes; returned goods.', d] FROM rules
  UNION ALL SELECT doc_id, max(section) + 1, 'Annexure Forms', 1, ['Sign here on line 1.'] FROM rules GROUP BY doc_id)
"""
CURATED = [("brand_11_0", "Curated Title"), ("brand_12_0", "")]


def titled(spark, docs):
    return instructions.document_titles(docs, spark.createDataFrame(CURATED, "doc_id string, title string"))


@query("document_titles", f"WITH {POLICIES_SQL} SELECT doc_id, title FROM named")
def document_titles(spark, sf_dir):
    return titled(spark, policy_texts(spark, sf_dir))


@query("policy_sections", f"WITH {POLICIES_SQL} SELECT doc_id, section, heading, n_lines, to_json(clauses)::VARCHAR AS clauses FROM sections")
def policy_sections(spark, sf_dir):
    rows = materialize(instructions.split_sections(policy_texts(spark, sf_dir)), "sections")
    rows = rows.join(instructions.section_clauses(rows), ["doc_id", "section"], "left")
    return rows.select("doc_id", "section", "heading", F.size("lines").alias("n_lines"), F.to_json(F.coalesce("clauses", F.array().cast("array<string>"))).alias("clauses"))


#: All pairs of the policies' sections; {title} is what a document's title comes from.
PAIRS_SQL = rf"""{POLICIES_SQL},
bodies AS (SELECT r.*, {{title}} AS title, '(a) ' || a || ' (b) ' || b || ' (c) The following are kept apart: - open boxes - returned goods; (d) ' || d AS body, string_split(b, ' ') AS w FROM rules r JOIN named USING (doc_id)),
pairs AS (
  SELECT doc_id, section, heading, title, 0 AS pos, 'What does the ' || title || ' say about ' || lower(heading) || '?' AS instruction, body AS response, 'section_qa' AS type FROM bodies
  UNION ALL SELECT doc_id, section, heading, title, 1, 'Summarise the ''' || heading || ''' provisions of the ' || title || '.', body, 'section_sum' FROM bodies
  UNION ALL SELECT doc_id, section, heading, title, 2, 'What does the ' || title || ' require regarding keeper of ' || kind || '?', a, 'clause_rule' FROM bodies
  UNION ALL SELECT doc_id, section, heading, title, 3, 'Complete this rule from the ' || title || ' (section ''' || heading || '''): "' || array_to_string(w[1:greatest(5, len(w) // 2)], ' ') || ' ..."', b, 'clause_cloze' FROM bodies
  UNION ALL SELECT doc_id, section, heading, title, 4, 'What does the ' || title || ' require regarding stock that?', d, 'clause_rule' FROM bodies)
"""


@query("instruction_pairs", f"WITH {PAIRS_SQL.replace('{title}', 'named.title')} SELECT doc_id, section, pos, instruction, sha256(response) AS response, type FROM pairs")
def instruction_pairs(spark, sf_dir):
    """All pairs that the templates make, before caps and dedup; each section has 5."""
    docs = policy_texts(spark, sf_dir)
    pairs = instructions.filter_pairs(instructions.section_pairs(materialize(instructions.split_sections(docs), "sections"), titled(spark, docs)))
    return pairs.select("doc_id", "section", "pos", "instruction", F.sha2("response", 256).alias("response"), "type")


def sql_normal(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'))"


#: Capped pairs in order, each as [[question, answer, place]]; a pair is accepted if no accepted one has its question or answer.
DATASET_SQL = rf"""{PAIRS_SQL.replace('{title}', "'Stock Policy of Brand' || replace(doc_id[6:], '_', ' ')")},
ranked AS (SELECT *, doc_id || '::' || section AS "group", row_number() OVER (PARTITION BY doc_id ORDER BY sha256('42|' || doc_id || '|' || section || '|' || pos), section, pos) AS r FROM pairs),
keyed AS (SELECT *, dense_rank() OVER (ORDER BY {sql_normal('instruction')}) AS q, dense_rank() OVER (ORDER BY {sql_normal('response')}) AS a, row_number() OVER (ORDER BY doc_id, section, pos) AS place FROM ranked WHERE r <= 150),
firsts AS (SELECT q, a, min(place) AS place FROM keyed GROUP BY q, a),
walk AS (SELECT list_reduce(list_concat([[]::BIGINT[][]], list([[q, a, place]] ORDER BY place)), lambda taken, x:
  CASE WHEN list_contains(list_transform(taken, lambda t: t[1]), x[1][1]) OR list_contains(list_transform(taken, lambda t: t[2]), x[1][2]) THEN taken ELSE list_concat(taken, x) END) AS taken FROM firsts),
kept AS (SELECT keyed.* FROM keyed JOIN (SELECT unnest(taken)[3] AS place FROM walk) USING (place)),
sizes AS (SELECT "group", count(*) AS n FROM kept GROUP BY "group"),
dealt AS (SELECT "group", coalesce(sum(n) OVER (ORDER BY sha256('42|' || "group"), "group" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes),
split AS (SELECT kept.*, CASE WHEN before < 0.8 * (SELECT count(*) FROM kept) THEN 'train' ELSE 'eval' END AS split FROM kept JOIN dealt USING ("group")),
dataset AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY sha256('42|' || "group"), "group", doc_id, section, pos) - 1 AS id, instruction, response, type, "group", heading AS section, doc_id AS source, title AS document_title, 'heuristic' AS method FROM split)
"""


@query("instruction_dataset", f"WITH {DATASET_SQL} SELECT * FROM dataset")
def instruction_dataset(spark, sf_dir):
    return instructions.instruction_dataset(policy_texts(spark, sf_dir))


@query(
    "instruction_statistics",
    f"""WITH {DATASET_SQL}, types AS (SELECT type, count(*) AS n FROM dataset GROUP BY type)
SELECT count(*) AS pairs, count(*) FILTER (split = 'train') AS train_pairs, round(count(*) FILTER (split = 'train') / count(*), 3) AS train_fraction, count(DISTINCT source) AS source_documents,
(SELECT '{{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}}' FROM types) AS pairs_by_type FROM dataset""",
)
def instruction_statistics(spark, sf_dir):
    return instructions.instruction_statistics(instruction_dataset(spark, sf_dir)).withColumn("pairs_by_type", F.to_json("pairs_by_type"))


@query("parsed_replies", "SELECT doc_id, 'Q' || doc_id AS instruction, 'A' AS response FROM documents WHERE doc_id % 2 = 0")
def parsed_replies(spark, sf_dir):
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('Sure: [{"instruction": " Q'), F.col("doc_id").cast("string"), F.lit('", "response": "A "}, {"instruction": "", "response": "x"}] done'))).otherwise("no list")
    return instructions.parse_replies(documents(spark, sf_dir, "doc_id").select("doc_id", reply.alias("reply")))


#: A page is a file that was asked for once or twice; what came of it goes by its number.
ATTEMPTS = "SELECT concat(page_id, '.pdf') AS file_name, 1 AS attempt, CASE page_id % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'HTTPError: 404' WHEN 2 THEN 'SSLError: bad' ELSE 'timed out' END AS error FROM pages UNION ALL SELECT concat(page_id, '.pdf'), 2, CASE WHEN page_id % 10 = 4 THEN CAST(NULL AS STRING) ELSE 'connection reset' END FROM pages WHERE page_id % 5 = 4"


@query("files_to_retry", "SELECT page_id || '.pdf' AS file_name, CASE WHEN page_id % 5 = 4 THEN 2 ELSE 1 END::BIGINT AS attempts FROM pages WHERE page_id % 5 = 3 OR page_id % 10 = 9")
def files_to_retry(spark, sf_dir):
    """Up to two retries: what failed for a passing reason each time, and never for good."""
    attempts = spark.sql(ATTEMPTS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages", "page_id"))
    return readers.files_to_retry(attempts, retries=2)


@query("quoted_urls", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/a%20b/%C3%BC%20(x)~' || page_id || '.pdf?q=a b' AS url FROM pages".replace("(x)", "%28x%29"))
def quoted_urls(spark, sf_dir):
    """Every page's host with a path that has to be quoted, and a query that has not."""
    strange = F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.lit("/a%20b/ü (x)~"), F.col("page_id").cast("string"), F.lit(".pdf?q=a b"))
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", readers.quoted_url(strange).alias("url"))


# ---- scores and curves -------------------------------------------------------------------------------------------


@query("keyword_verdict", "SELECT conv_id, turn, regexp_matches(replace(lower(text), '°', ' '), 'tion of|the an|rs\\. 10([^0-9,]|$)') AS correct FROM conversations WHERE role = 'assistant'")
def keyword_verdict(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", scoring.keyword_verdict(F.col("text"), F.array(F.lit("tion of"), F.lit("The An"), F.lit("Rs. 10"))).alias("correct"))


@query(
    "forgetting_verdicts",
    "WITH p AS (SELECT conv_id, max(contains(lower(text), 'tion of')) FILTER (role = 'user') AS base, max(contains(lower(text), 'tion of')) FILTER (role = 'assistant') AS new FROM conversations GROUP BY conv_id) "
    "SELECT CASE WHEN new THEN 'Retained' WHEN base THEN 'Degraded' ELSE 'Retained (base also wrong)' END AS verdict, count(*) AS n FROM p GROUP BY 1",
)
def forgetting_verdicts(spark, sf_dir):
    hit = scoring.keyword_verdict(F.col("text"), F.array(F.lit("tion of")))
    both = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", hit)).alias("base"), F.max(F.when(F.col("role") == "assistant", hit)).alias("new"))
    return funnel.counts_by(both, scoring.forgetting_verdict(F.col("base"), F.col("new")), "verdict")


def sql_rouge(p: str, r: str) -> str:
    """F1 of the longest common subsequence of two lists of words, by a row of its table for each word of p."""
    rows = f"list_concat([list_transform(range(0, len({r}) + 1), lambda i: 0)], list_transform({p}, lambda w: list_concat([-1], list_transform({r}, lambda v: CASE WHEN v = w THEN 1 ELSE 0 END))))"
    cells = "list_concat([[0]], list_transform(range(2, len(old) + 1), lambda j: [j]))"
    step = "lambda row, j: list_append(row, CASE WHEN same[j[1]] = 1 THEN old[j[1] - 1] + 1 ELSE greatest(old[j[1]], row[-1]) END)"
    return f"2.0 * (list_reduce({rows}, lambda old, same: list_reduce({cells}, {step}))[-1]) / greatest(len({p}) + len({r}), 1)"


def sql_lower_words(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


@query("rouge_l", f"""
WITH asked AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations),
w AS (SELECT conv_id, turn, {sql_lower_words('text')} AS p, {sql_lower_words('asked')} AS r FROM asked WHERE role = 'assistant' AND asked IS NOT NULL)
SELECT conv_id, turn, round({sql_rouge('p', 'r')}, 6) AS rouge_l FROM w""")
def rouge_l(spark, sf_dir):
    """Each assistant turn against the user turn before it; tested against a plain table of the subsequence."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("asked", F.lag("text").over(w)).where("role = 'assistant' and asked is not null")
    return rows.select("conv_id", "turn", F.round(scoring.rouge_l(F.col("text"), F.col("asked")), 6).alias("rouge_l"))


#: A user's events are a run, in the order of their time; every fifth has an evaluation loss beside it.
def curves(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("step"), "value").select("run", "step", (F.col("value") + 1).alias("loss"), F.when(F.col("step") % 5 == 0, F.col("value") + 2).alias("eval_loss"))


CURVES_SQL = """
s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events),
curves AS (SELECT run, step, value + 1 AS loss, CASE WHEN step % 5 = 0 THEN value + 2 END AS eval_loss FROM s),
smooth AS (SELECT run, step, avg(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smooth FROM curves)
"""


@query("rolling_loss", f"WITH {CURVES_SQL} SELECT run, step, round(smooth, 6) AS smooth FROM smooth")
def rolling_loss(spark, sf_dir):
    return metrics.rolling_mean(curves(spark, sf_dir)).select("run", "step", F.round("smooth", 6).alias("smooth"))


@query("plateau_step", f"WITH {CURVES_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS i, lead(smooth, 5) OVER (PARTITION BY run ORDER BY step) AS ahead FROM smooth) SELECT run, min(step) FILTER (i >= 5 AND ahead IS NOT NULL AND (smooth - ahead) / smooth < 0.02) AS plateau_step FROM a GROUP BY run")
def plateau_step(spark, sf_dir):
    return metrics.plateau(curves(spark, sf_dir))


@query("heldout_plateau", f"WITH {CURVES_SQL}, a AS (SELECT run, step, eval_loss, min(eval_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS least FROM curves WHERE eval_loss IS NOT NULL) SELECT run, min(step) FILTER (least IS NOT NULL AND (eval_loss - least) / eval_loss < 0.01) AS heldout_plateau_step FROM a GROUP BY run")
def heldout_plateau(spark, sf_dir):
    return metrics.heldout_plateau(curves(spark, sf_dir))


@query("curve_summary", f"WITH {CURVES_SQL} SELECT run, count(*) AS n, round(arg_min(loss, step), 6) AS first_loss, round(arg_max(loss, step), 6) AS last_loss, round(min(loss), 6) AS min_loss, min(struct_pack(l := loss, s := step)).s AS min_step, round(100 * (1 - arg_max(loss, step) / arg_min(loss, step)), 2) AS drop_percent, round(arg_max(loss, step) FILTER (loss <> 0), 6) AS last_nonzero FROM curves GROUP BY run")
def curve_summary(spark, sf_dir):
    rows = metrics.curve_summary(curves(spark, sf_dir))
    return rows.select("run", "n", "min_step", "drop_percent", *[F.round(c, 6).alias(c) for c in ("first_loss", "last_loss", "min_loss", "last_nonzero")])


@query("adaptive_window", f"WITH {CURVES_SQL} SELECT run, greatest(3, count(loss) // 10)::INT AS window FROM curves GROUP BY run")
def adaptive_window(spark, sf_dir):
    return metrics.adaptive_window(curves(spark, sf_dir))


@query("head_tail_means", f"WITH {CURVES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS j FROM curves) SELECT run, round(avg(loss) FILTER (i <= 3), 6) AS head_mean, round(avg(loss) FILTER (j <= 3), 6) AS tail_mean FROM r GROUP BY run")
def head_tail_means(spark, sf_dir):
    rows = metrics.head_tail_means(curves(spark, sf_dir), 3)
    return rows.select("run", F.round("head_mean", 6).alias("head_mean"), F.round("tail_mean", 6).alias("tail_mean"))


@query(
    "loss_summary",
    f"""WITH {CURVES_SQL}, n AS (SELECT run, greatest(3, count(*) // 10) AS w FROM curves GROUP BY run),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS j FROM curves JOIN n USING (run)),
m AS (SELECT run, any_value(w)::INT AS win, avg(loss) FILTER (i <= w) AS head, avg(loss) FILTER (j <= w) AS tail, arg_max(eval_loss, step) FILTER (eval_loss IS NOT NULL) AS last_eval, arg_min(step, struct_pack(l := eval_loss, s := step)) FILTER (eval_loss IS NOT NULL) AS best_step FROM r GROUP BY run)
SELECT run, win AS "window", round(100 * (1 - tail / head), 2) AS window_mean_loss_drop_percent, round(tail - last_eval, 4) AS final_train_eval_gap, best_step AS min_eval_loss_step FROM m""",
)
def loss_summary(spark, sf_dir):
    return metrics.loss_summary(curves(spark, sf_dir)).select("run", "window", "window_mean_loss_drop_percent", "final_train_eval_gap", F.col("min_eval_loss_step").cast("long").alias("min_eval_loss_step"))


@query("epoch_means", f"WITH {CURVES_SQL} SELECT run, round(avg(loss) FILTER (step <= 5), 6) AS first_mean, round(avg(loss) FILTER (step > 5), 6) AS second_mean FROM curves GROUP BY run")
def epoch_means(spark, sf_dir):
    return metrics.epoch_means(curves(spark, sf_dir), 5).select("run", F.round("first_mean", 6).alias("first_mean"), F.round("second_mean", 6).alias("second_mean"))


@query("loss_histogram", "WITH m AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT least(29, floor((l_quantity - lo) / (hi - lo) * 30))::INT AS bin, count(*) AS n FROM lineitem, m GROUP BY 1")
def loss_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "lineitem", "l_quantity"), "l_quantity", 30)


@query("weighted_loss", "SELECT event_type, round(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 6) AS loss FROM events GROUP BY event_type")
def weighted_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("loss"), (F.col("user_id") % 7 + 1).alias("tokens"))
    return metrics.weighted_loss(rows, ["event_type"]).select("event_type", F.round("loss", 6).alias("loss"))


PERPLEXITY_SQL = """
p AS (SELECT event_type AS set, CASE WHEN user_id % 2 = 0 THEN 'base' ELSE 'cpt' END AS model, exp(sum(value / 100 * (user_id % 5 + 1)) / sum(user_id % 5 + 1)) AS perplexity FROM events GROUP BY ALL)
"""


def scored_models(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("set"), F.when(F.col("user_id") % 2 == 0, "base").otherwise("cpt").alias("model"), (F.col("value") / 100 * (F.col("user_id") % 5 + 1)).alias("nll"), (F.col("user_id") % 5 + 2).alias("length"))
    return metrics.perplexity(rows, ["set", "model"])


@query("perplexity", f'WITH {PERPLEXITY_SQL} SELECT "set", model, round(perplexity, 6) AS perplexity FROM p')
def perplexity(spark, sf_dir):
    return scored_models(spark, sf_dir).withColumn("perplexity", F.round("perplexity", 6))


@query("compare_models", f"""WITH {PERPLEXITY_SQL}, w AS (SELECT "set", max(perplexity) FILTER (model = 'base') AS base, max(perplexity) FILTER (model = 'cpt') AS new FROM p GROUP BY 1) SELECT "set", round(base, 6) AS base, round(new, 6) AS new, round(100 * (1 - new / base), 2) AS reduction_percent, 100 * (1 - new / base) BETWEEN 10 AND 40 AS in_band FROM w""")
def compare_models(spark, sf_dir):
    return metrics.compare_models(scored_models(spark, sf_dir)).withColumns({"base": F.round("base", 6), "new": F.round("new", 6)})


@query(
    "perplexity_report",
    """WITH p AS (SELECT CASE WHEN event_type = 'click' THEN 'eval' ELSE 'eval_unseen' END AS s, user_id % 2 = 0 AS base, exp(sum(value / 100 * (user_id % 5 + 1)) / sum(user_id % 5 + 1)) AS ppl, sum(user_id % 5 + 1)::BIGINT AS tokens FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
w AS (SELECT s, max(ppl) FILTER (base) AS b, max(ppl) FILTER (NOT base) AS c, max(tokens) AS tokens FROM p GROUP BY s), e AS (SELECT * FROM w WHERE s = 'eval'), u AS (SELECT * FROM w WHERE s = 'eval_unseen')
SELECT e.tokens AS eval_tokens, round(e.b, 4) AS base_ppl, round(e.c, 4) AS cpt_ppl, round(100 * (e.b - e.c) / e.b, 2) AS ppl_reduction_percent, u.tokens AS unseen_eval_tokens, round(u.b, 4) AS unseen_base_ppl, round(u.c, 4) AS unseen_cpt_ppl,
round(100 * (u.b - u.c) / u.b, 2) AS unseen_ppl_reduction_percent, round(100 * (e.b - e.c) / e.b, 2) BETWEEN 10 AND 40 AS within_expected_10_40_percent FROM e FULL JOIN u ON TRUE""",
)
def perplexity_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").select(F.when(F.col("event_type") == "click", "eval").otherwise("eval_unseen").alias("set"), F.when(F.col("user_id") % 2 == 0, "base").otherwise("cpt").alias("model"), (F.col("value") / 100 * (F.col("user_id") % 5 + 1)).alias("nll"), (F.col("user_id") % 5 + 2).alias("length"))
    tokens = rows.groupBy("set", "model").agg(F.sum(F.col("length") - 1).cast("long").alias("tokens"))
    return metrics.perplexity_report(metrics.perplexity(rows, ["set", "model"]).join(tokens, ["set", "model"]))


@query("first_rows", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn LIMIT 30")
def first_rows(spark, sf_dir):
    """The first thirty held-out rows: the limit is the feature."""
    return evaluation.first_rows(table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn"), 30, "conv_id", "turn")


@query("select_candidate", "SELECT c_name AS candidate, (c_custkey % 4) || '/3' AS general_facts_kept, round(abs(c_acctbal), 2) AS heldout_ppl FROM customer ORDER BY c_custkey % 4 DESC, abs(c_acctbal), c_name LIMIT 1")
def select_candidate(spark, sf_dir):
    """The best candidate is the feature."""
    sweep = table(spark, sf_dir, "customer").select(F.col("c_name").alias("candidate"), F.concat((F.col("c_custkey") % 4).cast("string"), F.lit("/3")).alias("general_facts_kept"), F.round(F.abs("c_acctbal"), 2).alias("heldout_ppl"))
    return metrics.select_candidate(sweep)


@query("training_steps", "SELECT source, (ceil(count(*) / 16) * 2)::BIGINT AS updates FROM documents GROUP BY source")
def training_steps(spark, sf_dir):
    return documents(spark, sf_dir, "source").groupBy("source").agg(F.count("*").alias("n")).select("source", metrics.training_steps(F.col("n"), 16, 2).alias("updates"))


@query("seeded_sample", "SELECT conv_id, turn FROM conversations ORDER BY sha256('42|' || conv_id || '|' || turn), conv_id, turn LIMIT 8")
def seeded_sample(spark, sf_dir):
    """Eight rows in seeded order: the limit is the feature."""
    from corpusloom.functions.columns import seeded

    return table(spark, sf_dir, "conversations", "conv_id", "turn").orderBy(seeded(42, "conv_id", "turn"), "conv_id", "turn").limit(8)


@query("download_status", "SELECT CASE WHEN page_id % 3 = 0 THEN 'already_present' WHEN page_id % 3 = 1 AND page_id % 2 = 0 THEN 'failed' WHEN page_id % 3 = 1 THEN 'not_a_pdf' ELSE 'downloaded' END AS status, count(*) AS n FROM pages GROUP BY 1")
def download_status(spark, sf_dir):
    """The status logic of a collection run, over pages as a manifest."""
    manifest = table(spark, sf_dir, "pages", "page_id", "url").select(F.col("page_id").cast("string").alias("file_name"), "url", "page_id")
    fetched = manifest.select("file_name", F.when(F.col("page_id") % 3 == 2, F.lit(b"%PDF-1")).otherwise(F.lit(b"<html>")).alias("content"), F.when((F.col("page_id") % 3 == 1) & (F.col("page_id") % 2 == 0), "HTTPError: 404").alias("error"))
    existing = manifest.where("page_id % 3 = 0").select("file_name", F.lit(10).alias("length"))
    return readers.status_counts(readers.download_report(manifest, fetched, existing))


@query("missing_files", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def missing_files(spark, sf_dir):
    manifest = table(spark, sf_dir, "pages", "page_id").withColumn("file_name", F.col("page_id").cast("string"))
    return readers.missing_files(manifest, manifest.where("page_id % 3 = 0").select("file_name", F.lit(1).alias("length"))).select("page_id")


# ---- model outputs -----------------------------------------------------------------------------------------------

#: A conversation is a prompt: its first user turn against the first and the last assistant turn.
OUTPUTS_SQL = """
o AS (SELECT conv_id AS prompt_id, arg_min(text, turn) FILTER (role = 'user') AS prompt, arg_min(text, turn) FILTER (role = 'assistant') AS base, arg_max(text, turn) FILTER (role = 'assistant') AS cpt FROM conversations GROUP BY conv_id),
v AS (SELECT prompt_id, coalesce(regexp_matches(lower(base), 'tion of|the an'), FALSE) AS base_correct, coalesce(regexp_matches(lower(cpt), 'tion of|the an'), FALSE) AS cpt_correct FROM o)
"""


def forgetting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "prompt_id")
    pick = lambda f, role: rows.where(F.col("role") == role).groupBy("prompt_id").agg(f("text", "turn").alias("output"))
    prompts = rows.select("prompt_id").distinct().withColumn("keywords", F.array(F.lit("tion of"), F.lit("the an"), F.lit("unused")))
    prompts = prompts.withColumn("keywords", F.slice("keywords", 1, 2))
    return evaluation.forgetting_table(evaluation.join_outputs(prompts, ("base", pick(F.min_by, "assistant")), ("cpt", pick(F.max_by, "assistant"))))


@query("forgetting_table", f"WITH {OUTPUTS_SQL} SELECT prompt_id, 'tion of / the an' AS expected_fact, base_correct, cpt_correct, CASE WHEN cpt_correct THEN 'Retained' WHEN base_correct THEN 'Degraded' ELSE 'Retained (base also wrong)' END AS verdict FROM v")
def forgetting_table(spark, sf_dir):
    return forgetting(spark, sf_dir).select("prompt_id", "expected_fact", "base_correct", "cpt_correct", "verdict")


@query("review_counts", f"WITH {OUTPUTS_SQL} SELECT CASE WHEN prompt_id % 2 = 0 THEN 'domain' ELSE 'general' END AS \"set\", count(*) AS prompts, count(*) FILTER (base_correct) AS automatic, count(*) FILTER (cpt_correct) AS manual, count(*) FILTER (base_correct AND NOT cpt_correct) AS over_counted FROM v GROUP BY 1")
def review_counts(spark, sf_dir):
    rows = forgetting(spark, sf_dir).withColumn("set", F.when(F.col("prompt_id") % 2 == 0, "domain").otherwise("general"))
    return evaluation.review_counts(rows.select("prompt_id", "set", F.col("base_correct").alias("correct")), rows.select("prompt_id", F.col("cpt_correct").alias("correct")))


@query("adapter_summary", f"""
WITH asked AS (SELECT conv_id, {sql_lower_words("arg_min(text, turn)")} AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
answers AS (SELECT conv_id, {sql_lower_words("arg_min(text, turn)")} AS f, {sql_lower_words("arg_max(text, turn)")} AS l FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
scores AS (SELECT {sql_rouge('f', 'q')} AS before, {sql_rouge('l', 'q')} AS after FROM asked JOIN answers USING (conv_id))
SELECT count(*) AS pairs, round(avg(before), 6) AS mean_before, round(avg(after), 6) AS mean_after, count(*) FILTER (after > before) AS improved FROM scores""")
def adapter_summary(spark, sf_dir):
    """ROUGE-L of first and last answers against the prompt's first user turn; tested with the scores it is made of."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("asked"))
    answers = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    scores = asked.join(answers, "conv_id").select(scoring.rouge_l(F.col("first"), F.col("asked")).alias("rougeL_cpt"), scoring.rouge_l(F.col("last"), F.col("asked")).alias("rougeL_sft"))
    found = evaluation.adapter_summary(scores)
    return found.withColumns({"mean_before": F.round("mean_before", 6), "mean_after": F.round("mean_after", 6)})


@query("extraction_totals", "SELECT count(DISTINCT regexp_extract(url, '//([^/]+)/', 1)) AS documents, count(*) AS pages, count(*) FILTER (trim(coalesce(html, '')) = '') AS empty_pages, sum(length(coalesce(html, '')))::BIGINT AS characters FROM pages")
def extraction_totals(spark, sf_dir):
    return evaluation.extraction_totals(extraction_report(spark, sf_dir))


@query("tokens_per_word", f"WITH {TOKENS_SQL} SELECT split, sum(len(ids))::BIGINT AS tokens, sum(len(ids) - 2)::BIGINT AS words, round(sum(len(ids)) / sum(len(ids) - 2), 2) AS tokens_per_word FROM e GROUP BY split")
def tokens_per_word(spark, sf_dir):
    rows = encoded_splits(spark, sf_dir).select("split", F.size("ids").alias("tokens"), X.word_count(F.col("text")).alias("words"))
    return evaluation.tokens_per_word(rows)


@query("originals_first", "SELECT source, min(doc_id) AS first_doc FROM documents WHERE doc_id % 3 <> 0 GROUP BY source")
def originals_first(spark, sf_dir):
    """Every third document is named as a copy; the first of each source in the order that puts originals first."""
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "a_dup_").otherwise("b_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    rows = documents(spark, sf_dir, "doc_id", "source").withColumn("name", name)
    w = W.partitionBy("source").orderBy(*evaluation.originals_first(F.col("name")))
    return rows.withColumn("i", F.row_number().over(w)).where("i = 1").select("source", F.col("doc_id").alias("first_doc"))
