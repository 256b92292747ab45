"""Chat formatting with DataFrame expressions only.

A conversation's rows are collected as structs and sorted by turn; runs of one role become one message, whose turns stay
apart by a mark; messages are concatenated. Control strings that occur in a text or a role get one more backslash inside,
which is taken away again on reading, so the output can be read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import let

#: The template's control strings.
OPEN, NEXT, CLOSE = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
_CONTROL = r"<(\\*)(\|im_(?:start|next|end)\|>)"
_ESCAPED = r"<\\(\\*)(\|im_(?:start|next|end)\|>)"


def escape(text: Column) -> Column:
    """`<`, any backslashes, then the rest of a control string: one backslash more. Null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1$2")


def escape_role(role: Column) -> Column:
    """A role stands on a line of its own: its line ends are written as backslash n, its backslashes doubled; NUL goes."""
    plain = F.replace(F.coalesce(role, F.lit("")), F.lit("\x00"), F.lit(""))
    return escape(F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.replace(unescape(role), F.lit("\\\\"), F.lit("\x00"))
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))


def format_chats(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_messages, loss_spans (code points, end exclusive).

    Ties of a turn are ordered by role, then text; a null turn comes first; a null role or text counts as empty; a null
    conversation id is one conversation; an empty table gives an empty one. Other columns are ignored.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_r"), escape(F.col(text)).alias("_x"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_t", "_r", "_x"))).alias("_turns"))
    n = F.size("_turns")
    # one piece of output per turn: what stands before the text, the text, what stands after it
    opens = F.transform("_turns", lambda x, i: (i == 0) | (x["_r"] != F.get("_turns", i - 1)["_r"]))
    chats = chats.withColumn("_opens", opens)
    pieces = F.transform(
        "_turns",
        lambda x, i: F.struct(
            F.when(F.get("_opens", i), F.concat(F.lit(OPEN), escape_role(x["_r"]), F.lit("\n"))).otherwise(F.lit(NEXT)).alias("head"),
            x["_x"].alias("text"),
            F.when((i == n - 1) | F.get("_opens", i + 1), F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"),
            x["_r"].isin(*loss_roles).alias("loss"),
        ),
    )
    chats = chats.withColumn("_pieces", pieces).withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), ""))
    # prefix sums of the pieces' lengths give the loss spans: a fold that keeps only the running offset and the spans
    spans = F.aggregate(
        "_pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans")),
        lambda acc, p: let(
            acc["at"] + F.length(p["head"]),
            lambda start: F.struct(
                (start + F.length(p["text"]) + F.length(p["tail"])).alias("at"),
                F.when(p["loss"], F.array_append(acc["spans"], F.struct(start.alias("start"), (start + F.length(p["text"])).alias("end")))).otherwise(acc["spans"]).alias("spans"),
            ),
        ),
        lambda acc: acc["spans"],
    )
    return chats.select("conv_id", "formatted", F.size(F.filter("_opens", lambda o: o)).cast("long").alias("n_messages"), spans.alias("loss_spans"))


def parse_chats(df: DataFrame) -> DataFrame:
    """The turns that `formatted` holds, unescaped: conv_id, turns array<struct<role, text>>, loss_texts array<string>."""
    messages = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda m: m != "")
    turns = F.flatten(
        F.transform(
            messages,
            lambda m: let(
                F.struct(F.substring_index(F.substr(m, F.lit(len(OPEN) + 1)), "\n", 1).alias("role"), m.alias("whole")),
                lambda s: F.transform(
                    F.split(F.substr(s["whole"], F.lit(len(OPEN) + 2) + F.length(s["role"])), r"<\|im_next\|>"),
                    lambda t: F.struct(unescape_role(s["role"]).alias("role"), unescape(t).alias("text")),
                ),
            ),
        )
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return df.select("*", turns.alias("turns"), loss.alias("loss_texts"))


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the output."""
    says = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {says}), (-1L, 1L, 'assistant', {says}) AS t(conv_id, turn, role, text)")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = parse_chats(format_chats(rows))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The template's own characters are counted from the rows: 12 + role + 1 and 11 per message, 11 between turns of one message.
OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS opens
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + CASE WHEN opens = 1 THEN 24 + length(role) ELSE 11 END
      + len(regexp_extract_all(text, '<\\*\|im_(?:start|next|end)\|>')))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
