"""Conversations as arrays of messages, and their rendering with role marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_messages(rows: DataFrame) -> DataFrame:
    """conv_id, messages array<struct<role, content>> by turn; a null text counts as empty."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    return rows.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def to_conversation(pairs: DataFrame, system: str) -> DataFrame:
    """prompt (system and user message) and completion (assistant message) of instruction pairs."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return pairs.select("*", F.array(message("system", F.lit(system)), message("user", F.col("instruction"))).alias("prompt"), F.array(message("assistant", F.col("response"))).alias("completion"))


def render(messages: Column, eos: str = "</s>", add_generation_prompt: bool = False) -> Column:
    """`<|role|>`, line end, content, end mark and line end for each message; the assistant's mark last if asked for."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit(f"{eos}\n")))
    whole = F.array_join(parts, "")
    return F.concat(whole, F.lit("<|assistant|>")) if add_generation_prompt else whole
