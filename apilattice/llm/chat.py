"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens choose turn-aligned spans; a turn is never cut.  Room is what the budget
leaves beside the conversation's system turn (all of it, if that turn alone is over the budget), and
a span holds the turns that end in the same half of the room.  Its first turn may begin up to a
quarter before that half; one that begins earlier is a span of its own.  A window is one span behind
repeated context: the system turn, if it came in an earlier span, and at most two turns before the
span that together fit a quarter of the room (and what a turn alone leaves of it).  So a window
keeps to its budget unless its system turn and one turn of its own alone pass it.  The loss mask
covers the assistant texts of the span; repeated ones are context and stay outside it, so every
assistant text is a target once.

Template: ``<s>[INST]role[/INST]text</s>`` for a turn, ``[AGAIN]`` in place of ``[INST]`` for
a repeated one.  Roles and texts write & as ``&amp;``, < as ``&lt;`` and [ as ``&#91;``, so no
control string can stand in them and reading back is exact.

Null roles and texts are empty.  Turns of a conversation are ordered by turn (null first),
role and text; equal rows stay.  A null conversation id is one conversation.  A conversation
is one training example and is the unit that one task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
TARGET = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _again(turn: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<s>[AGAIN]"), turn["role"], F.lit("[/INST]"), turn["text"], F.lit("</s>")), F.lit(""))


def windows(turns: DataFrame, budget: int = BUDGET, target: str = TARGET) -> DataFrame:
    """(conv_id, window, text, n_tokens, loss array<struct<start, end>>): a row for each window.

    Loss offsets count code points of ``text``, the end excluded.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("plain"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "plain", "text")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("tokens", (F.ceil(F.length("text") / 4) + 4).cast("bigint"))
    system = F.coalesce(F.first(F.when(F.col("plain") == "system", F.col("tokens")), ignorenulls=True).over(whole), F.lit(0))
    rows = rows.withColumn("room", F.when(system < budget, budget - system).otherwise(budget)).withColumn("half", F.greatest(F.expr("room div 2"), F.lit(1)))
    rows = rows.withColumn("end", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("cell", F.expr("(end - 1) div half"))
    rows = rows.withColumn("lone", F.expr("cell * half - (end - tokens) > room div 4"))
    opens = F.coalesce(F.col("lone") | F.lag("lone").over(order) | (F.lag("cell").over(order) != F.col("cell")), F.lit(True))
    rows = rows.withColumn("opens", opens).withColumn("span", F.sum(F.col("opens").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("role", escape(F.col("plain"))).withColumn("text", escape(F.col("text")))
    rows = rows.withColumn("turn", F.struct("pos", "tokens", "role", "text"))
    system = F.first(F.when(F.col("plain") == "system", F.col("turn")), ignorenulls=True).over(whole)
    rows = rows.withColumn("system", system).withColumn("one", F.lag("turn", 1).over(order)).withColumn("two", F.lag("turn", 2).over(order))
    opens = F.col("opens") & (F.col("pos") > 1)
    rows = rows.withColumn("spare", F.expr("if(lone, least(room div 4, room - tokens), room div 4)"))
    retained = F.when(F.col("system.pos") < F.col("pos"), F.col("system"))
    fits = lambda t: F.coalesce((F.col(f"{t}.pos") != F.coalesce(F.col("system.pos"), F.lit(0))), F.lit(False))
    one = F.when(fits("one") & (F.col("one.tokens") <= F.col("spare")), F.col("one"))
    two = F.when(fits("two") & one.isNotNull() & (F.col("one.tokens") + F.col("two.tokens") <= F.col("spare")), F.col("two"))
    rows = rows.withColumn("before", F.when(opens, F.concat(_again(retained), _again(two), _again(one))).otherwise(F.lit("")))
    extra = sum((F.coalesce(t["tokens"], F.lit(0)) for t in (retained, two, one)), F.lit(0))
    rows = rows.withColumn("tokens", F.col("tokens") + F.when(opens, extra).otherwise(F.lit(0)))
    head = F.concat(F.lit("<s>[INST]"), "role", F.lit("[/INST]"))
    rows = rows.select("conv_id", "span", "pos", "tokens", "plain", F.concat("before", head).alias("head"), F.concat("before", head, "text", F.lit("</s>")).alias("piece"), F.length("text").alias("chars"))
    inside = Window.partitionBy("conv_id", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(inside), F.lit(0)) + F.length("head")
    rows = rows.withColumn("start", start)
    mask = F.when(F.col("plain") == target, F.struct("start", (F.col("start") + F.col("chars")).alias("end")))
    made = rows.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"), F.sum("tokens").alias("n_tokens"), F.sort_array(F.collect_list(mask)).alias("loss"))
    return made.select("conv_id", F.col("span").alias("window"), F.array_join("pieces.piece", "").alias("text"), "n_tokens", "loss")


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, window, turns array<struct<role, text>>, targets array<string>, formatted_chars) parsed from windows."""
    pieces = F.filter(F.split("text", "</s>"), lambda p: p.startswith("<s>[INST]"))
    turn = lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(10)), "[/INST]", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "[/INST]") + 7)).alias("text"))
    target = lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return made.select("conv_id", "window", F.transform(pieces, turn).alias("turns"), F.transform("loss", target).alias("targets"), F.length("text").cast("bigint").alias("formatted_chars"))


def digests(made: DataFrame) -> DataFrame:
    """A row for each conversation: counts and SHA-256 of its turns and of its loss text, from the formatted output."""
    parts = read_back(made)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = parts.select("conv_id", "formatted_chars", F.size("turns").alias("k"), F.struct("window", joined.alias("turns"), F.array_join("targets", "").alias("loss")).alias("part"))
    by = parts.groupBy("conv_id").agg(F.sum("k").cast("bigint").alias("n_turns"), F.sort_array(F.collect_list("part")).alias("parts"), F.sum("formatted_chars").alias("formatted_chars"))
    all_turns, all_loss = F.array_join("parts.turns", ""), F.array_join("parts.loss", "")
    return by.select("conv_id", "n_turns", F.sha2(all_turns, 256).alias("turns_sha256"), F.length(all_loss).cast("bigint").alias("loss_chars"), F.sha2(all_loss, 256).alias("loss_sha256"), "formatted_chars")
