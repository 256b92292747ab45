"""Question and answer pairs from policy texts: titles, sections, clauses, templates, filters, two-key dedup.

Documents are rows (doc_id, text); the stem of doc_id stands in for a file's name.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import Settings
from corpusloom.functions import text as X
from corpusloom.functions.columns import let, seeded
from corpusloom.operators.components import components
from corpusloom.operators.dedup import ORDERED, ROUNDS
from corpusloom.operators.prefix import numbered
from corpusloom.operators.split import grouped_split
from corpusloom.sources.tables import few, materialize

#: Items that a clause which ends with a colon takes in, at most.
MOST_ITEMS = 8
#: Tables of accepted pairs, one a round, that are put together at once.
MOST_TABLES = 30
#: Patterns of headings, list items, modal clauses, and words that steer the templates.
TITLE_WORDS = "(?i)polic|rule|manual|code|guideline|program|procedure"
HEADING = r"(?i)^(?:(?:section|rule|chapter|clause)\s+)?(\d{1,2}(?:\.\d{1,2}){0,2})[.)]?\s+([A-Z][A-Za-z0-9 ,&/()'’\-]{2,80}?)\s*(?:[.:]?\s*[—–-]{1,2}\s*(.*))?$"
CAPS_HEADING = r"^[A-Z][A-Z0-9 &/,'()\-]{3,60}:?$"
DANGLING = r"(?i)\b(?:or|and|of|the|to|for|in|with|by|on|a|an|as|at)[\s:,-]*$"
ITEM = r"(?i)^(?:\(?[a-z]\)|\(?[ivx]{1,4}\)|[ivx]{1,4}\.|\(\d{1,2}\)|[o•▪\-\*]\s)"
BULLET = r"^[o•▪\-\*]\s"
MODAL = (
    r"(?i)^([A-Z][^.;:]{2,70}?)\s+(?:shall|must|should|will be|will|is entitled|are entitled|is eligible|are eligible|can not|cannot|can|may|"
    r"is not|are not|is required|are required)\b"
)
LEADING_PREPOSITION = r"(?i)^(?:in|on|at|for|other|if|where|when|during|after|before|upon|as|such)\b"
LIMIT_WORDS = r"(?i)\d|eligible|entitle|not |only|within|maximum|minimum"
SKIPPED = (
    r"(?i)\b(?:index|contents|appendix|annexure|annex|form|format|proforma|application|declaration|undertaking|checklist|signature|approver|"
    r"prepared by|reviewed by|approved by|revision history|version history|document control|miscellany)\b"
)
CONTENTS_LIKE = r"(?:[A-Za-z)] \d{1,3} [A-Z(].*){3,}"
GENERIC = (
    "leave resource resources employee employees policy process purpose it they he she this these staff company organisation organization management he/she member members"
).split()
#: The questions' templates and the prompt for generated pairs.
SECTION_QA = "What does the {title} say about {section}?"
SECTION_SUM = "Summarise the '{section}' provisions of the {title}."
GENERIC_RULE = "Under the {title}, what is the rule for {subject} on {section}?"
CLAUSE_RULE = "What does the {title} require regarding {subject}?"
CLAUSE_CLOZE = "Complete this rule from the {title} (section '{section}'): \"{half} ...\""
PROMPT = (
    "Read the text below and generate {n} instruction-response pairs in JSON format "
    "based ONLY on this text. Each entry must have instruction and response keys.\n"
    "The instruction must be a question an employee or HR executive would realistically ask; "
    "the response must answer it using only facts stated in the text (quote numbers, limits "
    "and conditions exactly). Return a JSON list only, with no commentary.\n\n"
    "Document: {title}\n---\n{chunk}\n---"
)


def fill(template: str, **values: Column) -> Column:
    """A template with columns for its names in braces."""
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template))])


def document_titles(docs: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """doc_id, title: the curated title (doc_id, title) if there is one that is not empty; else the first line if it reads
    like a policy's title; else the id's words."""
    first = F.trim(F.coalesce(F.get(F.filter(X.split_lines(F.coalesce(F.col("text"), F.lit(""))), lambda x: F.trim(x) != ""), F.lit(0)), F.lit("")))
    fallback = F.replace(F.col("doc_id").cast("string"), F.lit("_"), F.lit(" "))
    found = F.when(first.rlike(TITLE_WORDS) & (X.word_count(first) <= 12), first).otherwise(fallback)
    plain = F.regexp_replace(F.regexp_replace(found, r"(?U)\s+", " "), "^[ :-]+|[ :-]+$", "")
    one_case = ((plain == F.upper(plain)) | (plain == F.lower(plain))) & plain.rlike(r"\p{L}")
    capped = F.array_join(F.transform(F.split(plain, " "), lambda w: F.when(w.rlike("^[^A-Za-z0-9_]*[A-Z]{4,}[^A-Za-z0-9_]*$"), F.initcap(w)).otherwise(w)), " ")
    titles = docs.select("doc_id", F.when(one_case, F.initcap(plain)).otherwise(capped).alias("derived"))
    if curated is None:
        return titles.select("doc_id", F.col("derived").alias("title"))
    return titles.join(curated.select("doc_id", "title"), "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("title") != "", F.col("title")), "derived").alias("title"))


def split_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section (index from 0 among those that have lines), heading, lines: gaps and islands over the lines.

    Lines before the first heading are the section `Overview`; a heading without lines gives none.
    """
    lines = docs.select("doc_id", F.posexplode(F.transform(X.split_lines(F.coalesce(F.col("text"), F.lit(""))), lambda x: F.trim(x))).alias("line_no", "line")).where("line <> ''")
    title = F.regexp_extract("line", HEADING, 2)
    numbered = F.col("line").rlike(HEADING) & (X.word_count(title) <= 10)
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    caps = F.col("line").rlike(CAPS_HEADING) & (X.word_count(F.col("line")) <= 8) & (letters >= 0.7 * F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))))
    is_heading = (numbered | caps) & ~F.col("line").rlike(DANGLING)
    name = F.when(numbered, F.regexp_replace(title, r"^[ .:\-]+|[ .:\-]+$", "")).otherwise(F.initcap(F.regexp_replace("line", "^:+|:+$", "")))
    body = F.when(is_heading, F.when(numbered, F.regexp_extract("line", HEADING, 3)).otherwise("")).otherwise(F.col("line"))
    w = W.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("_h", is_heading).select("doc_id", "line_no", body.alias("body"), F.when(F.col("_h"), name).alias("name"), F.sum(F.col("_h").cast("int")).over(w).alias("island"))
    sections = marked.groupBy("doc_id", "island").agg(F.coalesce(F.max("name"), F.lit("Overview")).alias("heading"), F.sort_array(F.collect_list(F.when(F.col("body") != "", F.struct("line_no", "body")))).alias("b"))
    return sections.where(F.size("b") > 0).select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("island")) - 1).alias("section"), "heading", F.col("b.body").alias("lines"))


def _fold(items: Column, start: Column, step, finish) -> Column:
    return F.aggregate(items, start, step, finish)


def split_items(lines: Column) -> Column:
    """array<string> of clauses: wrapped lines joined, list marks taken off, long paragraphs cut into sentences, and the short
    items after a clause that ends with a colon taken into it. For short lists; `section_clauses` does it for sections of any
    length."""
    strings = "array<string>"
    wrapped = _fold(
        lines,
        F.struct(F.array().cast(strings).alias("done"), F.lit("").alias("open")),
        lambda acc, x: F.when(x.rlike(ITEM) & (acc["open"] != ""), F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), x.alias("open"))).otherwise(
            F.struct(acc["done"].alias("done"), F.trim(F.concat(acc["open"], F.lit(" "), x)).alias("open"))
        ),
        lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]),
    )

    def cut(item: Column) -> Column:
        plain = F.trim(F.regexp_replace(item, ITEM, ""))
        parts = F.when(X.word_count(plain) > 80, F.split(plain, r"(?<=[.;])\s+(?=[A-Z])")).otherwise(F.array(plain))
        return F.transform(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.struct(p.alias("t"), item.rlike(BULLET).alias("bullet")))

    clauses = F.flatten(F.transform(wrapped, cut))
    kind = "struct<done:array<string>,open:string,tail:array<string>>"

    def close(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).when(F.size(acc["tail"]) == 0, F.array_append(acc["done"], acc["open"])).otherwise(F.array_append(acc["done"], F.concat(acc["open"], F.lit(" "), F.array_join(acc["tail"], "; "), F.lit("."))))

    def take(acc: Column, x: Column) -> Column:
        n = X.word_count(x["t"])
        absorbed = acc["open"].isNotNull() & (F.size(acc["tail"]) < MOST_ITEMS) & (x["bullet"] | (n <= 6)) & (n <= 25)
        none = F.array().cast(strings)
        return F.when(absorbed, F.struct(acc["done"].alias("done"), acc["open"].alias("open"), F.array_append(acc["tail"], F.regexp_replace(x["t"], "[ ;,.]+$", "")).alias("tail"))).when(
            x["t"].endswith(":"), F.struct(close(acc).alias("done"), x["t"].alias("open"), none.alias("tail"))
        ).otherwise(F.struct(F.array_append(close(acc), x["t"]).alias("done"), F.lit(None).cast("string").alias("open"), none.alias("tail")))

    return _fold(clauses, F.struct(F.array().cast(strings), F.lit(None).cast("string"), F.array().cast(strings)).cast(kind), lambda acc, x: take(acc, x).cast(kind), close)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _openers(places: pd.Series) -> pd.Series:
    """Of the places, in order, of a run's clauses that end with a colon: those that no earlier one takes in."""

    def of(run) -> list[int]:
        out: list[int] = []
        for k in run:
            if not out or k > out[-1] + MOST_ITEMS:
                out.append(int(k))
        return out

    return places.map(of)


def section_clauses(sections: DataFrame) -> DataFrame:
    """doc_id, section, clauses of sections(doc_id, section, lines): what `split_items` makes of the lines, row by row instead of by
    folds over arrays, so a section takes time in proportion to its lines. A section without clauses has no row.

    Wrapped lines are an island from one list mark to the next. Clauses that may be taken into one before them stand in runs; a
    clause that ends with a colon takes in up to MOST_ITEMS of its run, and the next one after those may open anew.
    """
    own = W.partitionBy("doc_id", "section")
    before = own.orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = sections.select("doc_id", "section", F.posexplode("lines").alias("no", "line")).withColumn("item", F.sum(F.col("line").rlike(ITEM).cast("int")).over(before))
    items = lines.groupBy("doc_id", "section", "item").agg(F.sort_array(F.collect_list(F.struct("no", "line"))).alias("l")).select("doc_id", "section", "item", F.trim(F.array_join("l.line", " ")).alias("whole"))
    plain = F.trim(F.regexp_replace("whole", ITEM, ""))
    parts = F.when(X.word_count(plain) > 80, F.split(plain, r"(?<=[.;])\s+(?=[A-Z])")).otherwise(F.array(plain))
    cut = items.select("doc_id", "section", "item", F.col("whole").rlike(BULLET).alias("bullet"), F.posexplode(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")).alias("part", "t"))
    n = X.word_count(F.col("t"))
    rows = cut.withColumn("k", F.row_number().over(own.orderBy("item", "part")).cast("long")).withColumn("fits", (F.col("bullet") | (n <= 6)) & (n <= 25))
    rows = rows.withColumn("run", F.sum((~F.col("fits")).cast("int")).over(own.orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = materialize(rows.select("doc_id", "section", "run", "k", "t"), "clauses")
    colons = rows.where(F.col("t").endswith(":")).groupBy("doc_id", "section", "run").agg(F.sort_array(F.collect_list("k")).alias("places"))
    opens = colons.select("doc_id", "section", F.explode(_openers("places")).alias("k")).withColumn("opens", F.col("k"))
    last = F.last("opens", ignorenulls=True).over(W.partitionBy("doc_id", "section", "run").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    headed = rows.join(opens, ["doc_id", "section", "k"], "left").withColumn("last", last)
    head = F.when(F.col("k") - F.col("last") <= MOST_ITEMS, F.col("last")).otherwise(F.col("k"))
    groups = headed.groupBy("doc_id", "section", head.alias("head")).agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("g"))
    tail = F.transform(F.slice("g", F.lit(2), F.size("g")), lambda x: F.regexp_replace(x["t"], "[ ;,.]+$", ""))
    first = F.col("g")[0]["t"]
    joined = groups.select("doc_id", "section", "head", F.when(F.size("g") == 1, first).otherwise(F.concat(first, F.lit(" "), F.array_join(tail, "; "), F.lit("."))).alias("clause"))
    listed = joined.groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("head", "clause"))).alias("c"))
    return listed.select("doc_id", "section", F.col("c.clause").alias("clauses"))


def clean_subject(subject: Column) -> Column:
    plain = F.regexp_replace(F.trim(subject), r"(?i)^(?:the|all|any|every|an?)\s+", "")
    return F.when(F.substring(plain, 1, 2).rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*$"), plain).otherwise(F.concat(F.lower(F.substring(plain, 1, 1)), F.expr("''"), F.substr(plain, F.lit(2))))


def section_pairs(sections: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, section, heading, title, pos, instruction, response, type: the templates over sections and their clauses."""
    rows = sections.where(~F.col("heading").rlike(SKIPPED)).join(titles, "doc_id").withColumn("body", F.trim(F.regexp_replace(F.array_join("lines", " "), r"(?U)\s+", " ")))
    rows = rows.join(section_clauses(sections), ["doc_id", "section"], "left")
    rows = rows.withColumns({"words": X.word_count(F.col("body")), "clauses": F.coalesce("clauses", F.array().cast("array<string>"))})
    lower = F.lower("heading")

    def pair(instruction: Column, response: Column, kind: str) -> Column:
        return F.struct(instruction.alias("instruction"), response.alias("response"), F.lit(kind).alias("type"))

    nothing = F.lit(None).cast("struct<instruction:string,response:string,type:string>")
    some = (F.col("words") >= 20) & (F.col("heading") != "Overview")
    qa = F.when(some, pair(fill(SECTION_QA, title=F.col("title"), section=lower), X.truncate_words(F.col("body"), 180), "section_qa")).otherwise(nothing)
    summary = F.when(some & (F.col("words") >= 60), pair(fill(SECTION_SUM, title=F.col("title"), section=F.col("heading")), X.first_sentences(F.col("body")), "section_sum")).otherwise(nothing)

    def of_clause(c: Column) -> Column:
        n = X.word_count(c)
        subject = F.regexp_replace(F.regexp_extract(c, MODAL, 1), "^[ ,]+|[ ,]+$", "")
        rule = c.rlike(MODAL) & X.word_count(subject).between(1, 7) & ~subject.rlike(r"\d") & ~subject.rlike(LEADING_PREPOSITION)

        def ask(s: Column) -> Column:
            generic = F.lower(s).isin(*GENERIC)
            return F.when(generic, fill(GENERIC_RULE, title=F.col("title"), subject=s, section=lower)).otherwise(fill(CLAUSE_RULE, title=F.col("title"), subject=s))

        half = F.array_join(F.slice(X.word_list(c), F.lit(1), F.greatest(F.lit(5), F.floor(n / 2).cast("int"))), " ")
        cloze = fill(CLAUSE_CLOZE, title=F.col("title"), section=F.col("heading"), half=half)
        return F.when(~n.between(8, 90), nothing).when(rule, pair(let(clean_subject(subject), ask), c, "clause_rule")).when(c.rlike(LIMIT_WORDS) & (n >= 12), pair(cloze, c, "clause_cloze")).otherwise(nothing)

    every = F.filter(F.concat(F.array(qa, summary), F.transform("clauses", of_clause)), lambda p: p.isNotNull())
    return rows.select("doc_id", "section", "heading", "title", F.posexplode(every).alias("pos", "p")).select("doc_id", "section", "heading", "title", "pos", "p.*")


def cap_pairs(pairs: DataFrame, most: int = 150, seed: int = 42) -> DataFrame:
    """At most `most` pairs of a document, in seeded order where there are more. The cap is the feature: long manuals must
    not dominate the mix."""
    w = W.partitionBy("doc_id").orderBy(seeded(seed, "doc_id", "section", "pos"), "section", "pos")
    return pairs.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def filter_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with 3 to 250 words of response that is no table of contents and does not end with a colon; page numbers at the end go."""
    n = X.word_count(F.col("response"))
    plain = F.trim(F.regexp_replace("response", r"(?<=[^\d\s])\s+\d{1,3}\s*$", ""))
    kept = pairs.where(n.between(3, 250)).withColumn("response", plain)
    return kept.where(~F.col("response").rlike(X.DOT_LEADER) & ~F.col("response").rlike(CONTENTS_LIKE) & ~F.col("response").endswith(":"))


def dedup_pairs(pairs: DataFrame, order: str = "id") -> DataFrame:
    """Pairs of which neither question nor answer, normalised, was accepted before, in order; a rejected pair blocks nothing.

    In a round, a pair that is the first undecided one for both of its keys is accepted, and every pair that shares a key with
    an accepted one is rejected. Keys are aggregated to their first undecided pair, so a key of any number of rows costs no
    more than its rows. After ROUNDS rounds, what hangs together through shared keys and has up to ORDERED pairs is gone through
    in order, each component in one task, so a long chain of revisions takes no round for each; larger ones go on in rounds.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))
    open_ = materialize(pairs.select(order, F.xxhash64(norm(F.col("instruction"))).alias("q"), F.xxhash64(norm(F.col("response"))).alias("a")), "pairs")
    accepted: list[DataFrame] = [open_.select(order).limit(0)]
    rounds = 0
    while not open_.isEmpty():
        if rounds == ROUNDS:
            taken, open_ = _by_component(open_, order)
            accepted.append(taken)
        rounds += 1
        q = open_.groupBy("q").agg(F.min(order).alias("q_first"))
        a = open_.groupBy("a").agg(F.min(order).alias("a_first"))
        taken = materialize(open_.join(q, "q").join(a, "a").where((F.col(order) == F.col("q_first")) & (F.col(order) == F.col("a_first"))).select(order, "q", "a"), "taken")
        accepted.append(taken.select(order))
        if len(accepted) > MOST_TABLES:
            accepted = [materialize(reduce(DataFrame.unionByName, accepted), "accepted")]
        open_ = materialize(open_.join(taken.select("q").distinct(), "q", "left_anti").join(taken.select("a").distinct(), "a", "left_anti").select(order, "q", "a"), "pairs")
    return pairs.join(reduce(DataFrame.unionByName, accepted), order, "left_semi")


def _by_component(open_: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(pairs accepted in the components of up to ORDERED pairs; the pairs of larger ones, open still)."""
    # questions and answers are the nodes, a pair is a link; an answer's node is told apart from an equal question's
    link = F.struct(F.lit(0).alias("side"), F.col("q").alias("key")).alias("u"), F.struct(F.lit(1).alias("side"), F.col("a").alias("key")).alias("v")
    label = materialize(components(open_.select(*link)).where("node.side = 0").select(F.col("node.key").alias("q"), "component"), "components")
    of = materialize(open_.join(label, "q").select(order, "q", "a", "component"), "labelled")
    large = materialize(of.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > ORDERED).select("component"), "large")

    def in_order(rows: pa.Table) -> pa.Table:
        plain = lambda v: tuple(v.values()) if isinstance(v, dict) else v
        place = [plain(v) for v in rows[order].to_pylist()]
        q, a = rows["q"].to_pylist(), rows["a"].to_pylist()
        seen_q, seen_a, kept = set(), set(), []
        for i in sorted(range(len(place)), key=place.__getitem__):
            if q[i] not in seen_q and a[i] not in seen_a:
                seen_q.add(q[i])
                seen_a.add(a[i])
                kept.append(i)
        return rows.select([order]).take(pa.array(kept, pa.int64()))

    small = of.join(few(large), "component", "left_anti")
    taken = materialize(small.groupBy("component").applyInArrow(in_order, open_.select(order).schema), "taken")
    return taken, materialize(of.join(few(large), "component", "left_semi").select(order, "q", "a"), "pairs")


def chunk_prompts(docs: DataFrame, curated: DataFrame | None = None, n: int = 10, size: int = 600) -> DataFrame:
    """doc_id, chunk (from 0), title, prompt: what a generator is asked about each `size` words of a document."""
    rows = docs.select("doc_id", F.posexplode(X.word_chunks(F.col("text"), size)).alias("chunk", "words")).join(document_titles(docs, curated), "doc_id")
    return rows.select("doc_id", "chunk", "title", fill(PROMPT, n=F.lit(str(n)), title=F.col("title"), chunk=F.col("words")).alias("prompt"))


def reply_pairs(replies: DataFrame) -> DataFrame:
    """The pairs of a generator's replies (doc_id, chunk, title, reply), as section_pairs gives them: a chunk is a section."""
    listed = parse_replies(replies.select("doc_id", "chunk", "title", "reply"))
    w = W.partitionBy("doc_id", "chunk").orderBy("instruction", "response")  # of one reply
    name = F.concat(F.lit("chunk "), F.col("chunk").cast("string"))
    return listed.select("doc_id", F.col("chunk").alias("section"), name.alias("heading"), "title", (F.row_number().over(w) - 1).alias("pos"), "instruction", "response", F.lit("llm_synthetic").alias("type"))


def instruction_dataset(docs: DataFrame, curated: DataFrame | None = None, settings: Settings = Settings(), pinned: list[str] | None = None, least: int = 0, replies: DataFrame | None = None) -> DataFrame:
    """split, id (from 0 in each split), instruction, response, type, group, section, source, document_title, method.

    Fewer pairs than `least` raise ValueError. With `replies` (of a generator to chunk_prompts) the pairs come from these.
    """
    if replies is None:
        sections = materialize(split_sections(docs), "sections")
        pairs = filter_pairs(cap_pairs(section_pairs(sections, document_titles(docs, curated)), settings.max_pairs_per_doc, settings.seed))
    else:
        pairs = filter_pairs(reply_pairs(replies))
    key = F.struct(F.col("doc_id").cast("string").alias("d"), "section", "pos")
    kept = dedup_pairs(materialize(pairs.withColumn("key", key), "instructions"), "key")
    if least and kept.limit(least).count() < least:
        raise ValueError(f"fewer than {least} pairs")
    named = kept.withColumn("group", F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.col("section").cast("string")))
    pin = F.lower(F.col("doc_id").cast("string")).isin(*[p.lower() for p in pinned]) if pinned else None
    split = grouped_split(named, "group", settings.instruction_train_fraction, settings.seed, pin)
    return numbered(split, "split", [seeded(settings.seed, "group"), "group", "key"]).select("split", "id", "instruction", "response", "type", "group", F.col("heading").alias("section"), F.col("doc_id").cast("string").alias("source"), F.col("title").alias("document_title"), F.lit("heuristic" if replies is None else "llm").alias("method"))


def instruction_statistics(data: DataFrame) -> DataFrame:
    """pairs, train_pairs, train_fraction (three places), source_documents, pairs_by_type."""
    by = data.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("pairs_by_type"))
    total = data.agg(F.count("*").alias("pairs"), F.count_if(F.col("split") == "train").alias("train_pairs"), F.countDistinct("source").alias("source_documents"))
    return total.join(F.broadcast(by)).select("pairs", "train_pairs", F.round(F.col("train_pairs") / F.col("pairs"), 3).alias("train_fraction"), "source_documents", "pairs_by_type")


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies' own columns, instruction, response: the pairs in the first bracket to the last of a generated reply that is JSON."""
    listed = F.from_json(F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"(?s)(\[.*\])", 1), "array<struct<instruction:string,response:string>>")
    rows = replies.select(*[c for c in replies.columns if c != reply], F.explode(listed).alias("p"))
    both = (F.coalesce(F.col("p.instruction"), F.lit("")) != "") & (F.coalesce(F.col("p.response"), F.lit("")) != "")
    return rows.where(both).select("*", F.trim("p.instruction").alias("instruction"), F.trim("p.response").alias("response")).drop("p")
