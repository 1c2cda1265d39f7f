"""Conversation history, token-budget packing and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ASSISTANT_LABEL, CONTEXT_TITLE, HISTORY_TITLE, NO_CONTEXT, QUESTION_TITLE, SOURCE_LABEL, STRICT_PROMPT, SYSTEM_PROMPT, USER_LABEL, Budget
from ..functions.text import estimate_tokens, is_blank, strip

BLOCK = "struct<kind: string, parent_id: string, text: string, tokens: int, source: string, heading: string, score: double, score_kind: string>"


def turns(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, question, answer``: each user message with the assistant message right after it, if there is one."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = messages.filter(F.col("role") != "system").withColumn("_role", F.lead("role").over(order)).withColumn("_text", F.lead("text").over(order))
    return said.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("_role") == "assistant", F.col("_text")).otherwise("").alias("answer"))


def render_turn(question: Column, answer: Column) -> Column:
    said = lambda label, c: F.when(~is_blank(c), F.concat(F.lit(label), strip(c)))
    return F.concat_ws("\n", said(USER_LABEL, question), said(ASSISTANT_LABEL, answer))


def trim_history(rows: DataFrame, budget: Budget | None = None) -> DataFrame:
    """The longest run of latest turns whose rendering costs at most the budget.

    A suffix's cost grows with every turn, so a running sum from the end decides.
    """
    b = budget or Budget()
    text = rows.withColumn("_line", render_turn(F.col("question"), F.col("answer")))
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.length("_line") > 0, F.length("_line") + 1).otherwise(0)
    text = text.withColumn("_chars", F.sum(said).over(back) - 1)
    cost = F.when(F.col("_chars") > 0, F.greatest(F.lit(1), (F.col("_chars") / F.lit(b.chars_per_token)).cast("int"))).otherwise(0)
    return text.withColumn("suffix_tokens", cost).filter(F.col("suffix_tokens") <= b.history).drop("_line", "_chars")


def history_text(rows: DataFrame) -> DataFrame:
    """``conv_id, history, history_tokens`` of (trimmed) turns."""
    line = render_turn(F.col("question"), F.col("answer"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    text = F.array_join(F.filter(lines, lambda x: F.length(x) > 0), "\n")
    got = rows.groupBy("conv_id").agg(text.alias("history"))
    return got.withColumn("history_tokens", F.when(F.length("history") > 0, estimate_tokens(F.col("history"))).otherwise(0))


def resolve_history_tokens(text: Column, given: Column) -> Column:
    """The text's own cost, if there is a text; else the number given."""
    return F.when(~is_blank(text), estimate_tokens(text)).otherwise(F.coalesce(given, F.lit(0)))


def pack(hits: DataFrame, parents: DataFrame, queries: DataFrame, budget: Budget | None = None, history_tokens: Column | None = None) -> DataFrame:
    """One row per query: ``blocks`` (numbered from 1), ``dropped``, ``used_tokens``, ``budget``, ``utilization``.

    Hits are taken in rank order: the whole parent if it still fits, else the child's text, else neither; a
    later, smaller one may still fit.  A query without hits has no blocks.
    """
    b = budget or Budget()
    held = hits.join(parents.select("parent_id", "parent_text", "heading"), "parent_id")
    row = F.struct("rank", "parent_id", "parent_text", "child_text", "source", "heading", "score", "score_kind")
    grouped = held.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("_hits"))
    asked = queries.select("qid", "question", (history_tokens if history_tokens is not None else F.lit(0)).alias("_history")).join(grouped, "qid", "left")
    fixed = F.lit(b.system) + F.col("_history") + estimate_tokens(F.col("question"), b.chars_per_token)
    cost = lambda c: estimate_tokens(c, b.chars_per_token)

    def step(acc: Column, h: Column) -> Column:
        whole, part = cost(h["parent_text"]), cost(h["child_text"])
        takes_whole = whole <= acc["left"]
        takes_part = ~takes_whole & ~is_blank(h["child_text"]) & (part <= acc["left"])
        block = lambda kind, text, n: F.struct(F.lit(kind).alias("kind"), h["parent_id"].alias("parent_id"), text.alias("text"), n.cast("int").alias("tokens"), h["source"].alias("source"), h["heading"].alias("heading"), h["score"].alias("score"), h["score_kind"].alias("score_kind")).cast(BLOCK)
        return (
            F.when(takes_whole, F.struct((acc["left"] - whole).alias("left"), F.concat(acc["out"], F.array(block("parent", h["parent_text"], whole))).alias("out"), acc["dropped"].alias("dropped")))
            .when(takes_part, F.struct((acc["left"] - part).alias("left"), F.concat(acc["out"], F.array(block("child", h["child_text"], part))).alias("out"), acc["dropped"].alias("dropped")))
            .otherwise(F.struct(acc["left"].alias("left"), acc["out"].alias("out"), (acc["dropped"] + 1).alias("dropped")))
        )

    start = F.struct((F.lit(b.context) - fixed).cast("int").alias("left"), F.array().cast(f"array<{BLOCK}>").alias("out"), F.lit(0).alias("dropped"))
    folded = asked.withColumn("_p", F.aggregate(F.coalesce(F.col("_hits"), F.array().cast(grouped.schema["_hits"].dataType)), start, step))
    used = F.lit(b.context) - F.col("_p.left")
    numbered = F.transform("_p.out", lambda x, i: F.struct((i + 1).alias("ref"), *[x[n].alias(n) for n in ("kind", "parent_id", "text", "tokens", "source", "heading", "score", "score_kind")]))
    return folded.select("qid", "question", numbered.alias("blocks"), F.col("_p.dropped").alias("dropped"), used.alias("used_tokens"), F.lit(b.context).alias("budget"), F.round(used / b.context, 6).alias("utilization"))


def render_context(blocks: Column) -> Column:
    title = lambda x: F.concat(F.lit("["), x["ref"].cast("string"), F.lit(f"] {SOURCE_LABEL}"), F.coalesce(x["source"], F.lit("None")), F.when(F.length(x["heading"]) > 0, F.concat(F.lit(" / "), x["heading"])).otherwise(F.lit("")))
    return F.when(F.size(blocks) > 0, F.array_join(F.transform(blocks, lambda x: F.concat(title(x), F.lit("\n"), x["text"])), "\n\n")).otherwise(F.lit(NO_CONTEXT))


def render_prompt(blocks: Column, question: Column, strict: bool = False, history: Column | None = None, system: str | None = None) -> Column:
    head = F.lit(system if system is not None else STRICT_PROMPT if strict else SYSTEM_PROMPT)
    past = F.lit(None).cast("string") if history is None else F.when(~is_blank(history), F.concat(F.lit(HISTORY_TITLE + "\n"), history))
    return F.concat_ws("\n\n", head, past, F.concat(F.lit(CONTEXT_TITLE + "\n"), render_context(blocks)), F.concat(F.lit(QUESTION_TITLE + "\n"), question))
