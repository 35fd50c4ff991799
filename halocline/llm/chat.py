"""Chat formatting (operator 1): preference pairs with a shared prompt; DataFrame operations only.

Conversations that open with the same turn are alternatives.  The table holds no preference, so which of two is chosen is
a rule: in order of (cell of the id's md5, id) the even ones are chosen and the odd ones rejected.  The longest common prefix of a pair's turns is rendered once as prompt; what follows
becomes the two completions.  In a completion the texts of assistant turns carry loss; turn markers and the turns
of others are masked.  Spans [start, end) are code points of the completion.

Defined results: a conversation without partner has no rejected side; its prompt ends before its last turn.  Null role or
text is rendered as empty; turns are ordered by (turn, role, text), repeated rows stay repeated turns; a null
conv_id is a conversation; texts of any length are rendered whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ranked, same

#: Markers around a turn (fixed values).
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, opening (md5 of the first turn), turns: array of (role, text) in order."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    bare = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    first = F.element_at("t", 1)
    return one.select("conv_id", F.md5(F.concat(first["role"], F.lit("\x00"), first["text"]).cast("binary")).alias("opening"), bare.alias("turns"))


def rendered(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(AFTER_ROLE), x["text"], F.lit(CLOSE))), "")


def spans(part: Column) -> Column:
    """start:end of every assistant text in the rendered part, comma-joined; ends come from a running sum of turn lengths."""
    length = lambda x: F.length(x["role"]) + F.length(x["text"]) + len(OPEN) + len(AFTER_ROLE) + len(CLOSE)
    seen = F.aggregate(
        part, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + length(x)).alias("at"),
            F.when(
                x["role"] == "assistant",
                F.concat(
                    acc["out"], F.when(acc["out"] != "", ",").otherwise(""), (acc["at"] + F.length(x["role"]) + len(OPEN) + len(AFTER_ROLE)).cast("string"), F.lit(":"),
                    (acc["at"] + length(x) - len(CLOSE)).cast("string"),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )
    return seen["out"]


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans per pair."""
    convs = turns(conversations)
    placed = ranked(convs.select("conv_id", "opening"), ["opening"], [], "conv_id", "nth")
    seats = placed.select("conv_id", "opening", F.floor(F.col("nth") / 2).alias("pair"), (F.col("nth") % 2).alias("side"))
    rows = same(convs.drop("opening"), seats, ["conv_id"])
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    pairs = rows.groupBy("opening", "pair").agg(
        side(0, "conv_id").alias("chosen_id"), side(1, "conv_id").alias("rejected_id"), side(0, "turns").alias("a"), side(1, "turns").alias("b")
    )
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.transform(F.sequence(F.lit(1), shorter), lambda i: F.element_at("a", i) != F.element_at("b", i))
    where = F.array_position(differs, True)
    back = F.array_position(F.reverse(F.transform("a", lambda x: x["role"])), "assistant")
    common = F.when(F.col("b").isNull(), F.size("a") - F.when(back > 0, back).otherwise(1)).when(where > 0, where - 1).otherwise(shorter).cast("int")
    pairs = pairs.withColumn("n", common)
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    has = F.col("b").isNotNull()
    return pairs.select(
        "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), rendered(F.slice("a", 1, F.col("n"))).alias("prompt"), rendered(rest("a")).alias("chosen"),
        F.when(has, rendered(rest("b"))).alias("rejected"), spans(rest("a")).alias("chosen_spans"), F.when(has, spans(rest("b"))).alias("rejected_spans"),
    )
