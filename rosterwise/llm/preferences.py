"""Preference formatting: one prompt and two masked completions for each pair of conversations.

DataFrame functions only. Turns of the chosen and the rejected conversation are compared turn number by
turn number; the prompt is what lies before the first number at which they differ (or only one has a
turn). It is rendered once; what follows is rendered per side, with the spans that are trained on:
an assistant's words and the end mark after them. Everything up to the rendering works on turn rows,
combined by (pair, turn), so a conversation that holds most rows is spread; a rendered conversation is
one string and must fit a row.

Cases: a null text is empty, a null role is ``unknown``; turns without a number or conversation are left
out; of rows with the same number the smallest (role, text) counts, so repeated rows change nothing;
equal conversations are all prompt and have empty completions; marks within texts are broken up.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import with_next

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: Role whose words are trained on.
TRAINED = "assistant"


def _plain(column, empty):
    return F.replace(F.coalesce(column, F.lit(empty)), F.lit(OPEN), F.lit("< |"))


def clean_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, turn, role, text: one row per turn number, marks broken up."""
    said = F.struct(_plain(F.col("role"), "unknown").alias("role"), _plain(F.col("text"), "").alias("text"))
    rows = turns.dropna(subset=[*keys, "turn"]).groupBy(*keys, "turn").agg(F.min(said).alias("said"))
    return rows.select(*keys, "turn", "said.role", "said.text")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair of ``turns`` (pair_id, is_chosen, turn, role, text).

    pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans (arrays of start,
    end in code points of the completion, end exclusive).
    """
    rows = clean_turns(turns, ["pair_id", "is_chosen"])
    said = F.struct("role", "text")
    sides = rows.groupBy("pair_id", "turn").agg(
        F.max(F.when(F.col("is_chosen"), said)).alias("c"), F.max(F.when(~F.col("is_chosen"), said)).alias("r")
    )
    differ = F.col("c").isNull() | F.col("r").isNull() | (F.col("c") != F.col("r"))
    firsts = sides.groupBy("pair_id").agg(F.min(F.when(differ, F.col("turn"))).alias("first"))
    head = F.concat(F.lit(OPEN), "role", F.lit(CLOSE), F.lit("\n"))
    whole = F.concat(head, "text", F.lit(END), F.lit("\n"))
    shared = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    part = F.when(shared, F.lit("prompt")).when(F.col("is_chosen"), F.lit("chosen")).otherwise("rejected")
    placed = rows.join(firsts, "pair_id").withColumns({"part": part, "head": F.char_length(head), "whole": whole}).filter(
        (F.col("part") != "prompt") | F.col("is_chosen")  # the prompt is rendered once
    )
    before = Window.partitionBy("pair_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("whole")).over(before), F.lit(0)) + F.col("head")
    end = F.col("start") + F.char_length("text") + len(END)
    placed = placed.withColumn("start", start).withColumn("end", end)

    def strings(name):
        items = F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("turn", "whole"))))
        return F.array_join(F.transform(items, lambda i: i["whole"]), "")

    def spans(name):
        mine = (F.col("part") == name) & (F.col("role") == TRAINED)
        return F.array_sort(F.collect_list(F.when(mine, F.struct("start", "end"))))

    return placed.groupBy("pair_id").agg(
        F.sum((F.col("part") == "prompt").cast("long")).alias("n_prompt_turns"), strings("prompt").alias("prompt"),
        strings("chosen").alias("chosen"), strings("rejected").alias("rejected"),
        spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"),
    )


def crossed(conversations: DataFrame) -> DataFrame:
    """Pairs made of a table of single conversations: pair_id, rejected_id, is_chosen, turn, role, text.

    Each conversation is the chosen one of its pair. The rejected one has its first half (turn numbers
    up to half of the greatest) and goes on as the conversation with the next lower conv_id (the
    highest, after the lowest) does from there.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").dropna(subset=["conv_id", "turn"])
    heads = turns.groupBy("conv_id").agg(F.floor((F.max("turn") + 2) / 2).alias("half")).withColumn("tie", F.lit(""))
    links = with_next(heads, "conv_id", "tie").select(
        F.col("conv_id").alias("pair_id"), F.col("next.conv_id").alias("rejected_id"), "half"
    )
    own = turns.join(links, turns["conv_id"] == links["pair_id"])
    chosen = own.withColumn("is_chosen", F.lit(True))
    start = own.filter("turn < half").withColumn("is_chosen", F.lit(False))
    rest = turns.join(links, turns["conv_id"] == links["rejected_id"]).filter("turn >= half").withColumn("is_chosen", F.lit(False))
    names = ["pair_id", "rejected_id", "is_chosen", "turn", "role", "text"]
    return chosen.select(*names).union(start.select(*names)).union(rest.select(*names))


def preference_documents(conversations: DataFrame) -> DataFrame:
    """``preference_pairs`` of ``crossed``, with the spans as text (start:end, comma-joined)."""

    def listed(name):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(name)

    rows = preference_pairs(crossed(conversations))
    return rows.select(
        "pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", listed("chosen_spans"), listed("rejected_spans")
    )
