"""Chat formatting: one training string per conversation, with the spans the loss covers.

Template: ``<s>``, then per block of adjacent turns of one role ``<|start|>role<|text|>`` and the
texts, ``<|turn|>`` between them, ``<|end|>``; ``</s>`` closes. Control strings inside roles and
texts, those of other templates included, get a backslash after their first character
(``<\\|end|>``); strings that already look so get one more. ``unescape`` takes exactly one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, START, TEXT, TURN, END, CLOSE = "<s>", "<|start|>", "<|text|>", "<|turn|>", "<|end|>", "</s>"
_CONTROL = r"(\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", train_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_spans): one row per conversation.

    Turns are sorted by turn, then role and text, so repeated rows stay and ties have one order; a
    null turn comes first. Null roles and texts are empty strings; a null conversation id is a
    conversation of its own. loss_spans are (start, length) in code points, from 1, of each text of
    ``train_role``; an empty text has an empty span. No rows give no conversation. A conversation is
    one row of the output, so its turns are gathered in one row; places are running sums taken
    before that, in the same shuffle, so work grows with the number of turns. Other columns are not looked at.
    """
    clean = lambda c: escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))
    along = Window.partitionBy("conv").orderBy("turn", "role", "text")
    turns = turns.withColumn("n", F.row_number().over(along)).withColumn("opens", F.coalesce(F.lag("role").over(along) != F.col("role"), F.lit(True)))
    # The characters between a text's start and the end of the text before it.
    opening = F.when(F.col("n") == 1, len(BEGIN)).otherwise(len(END)) + len(START + TEXT) + F.char_length("role")
    size = F.char_length("text")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.when(F.col("opens"), opening).otherwise(len(TURN)) + size).over(upto) - size + 1
    turns = turns.withColumn("start", start.cast("int"))
    chats = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text", "opens", "start"))).alias("turns"))
    # Where a block of one role begins; the blocks are the slices between.
    starts = "transform(filter(turns, t -> t.opens), t -> t.n)"
    blocks = "transform(starts, (s, k) -> slice(turns, s, coalesce(get(starts, k + 1), size(turns) + 1) - s))"
    written = f"""concat('{BEGIN}', array_join(transform(blocks, b -> concat('{START}', b[0].role, '{TEXT}',
        array_join(transform(b, x -> x.text), '{TURN}'), '{END}')), ''), '{CLOSE}')"""
    spans = "transform(filter(turns, t -> t.role = train_role), t -> named_struct('start', t.start, 'length', char_length(t.text)))"
    chats = chats.withColumn("starts", F.expr(starts)).withColumn("train_role", escape(F.lit(train_role)))
    return chats.withColumn("blocks", F.expr(blocks)).select("conv", F.expr(written).alias("formatted"), F.expr(spans).alias("loss_spans"))


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) in a formatted conversation, unescaped, in order."""
    blocks = F.split(F.substring(formatted, F.lit(len(BEGIN) + 1), F.char_length(formatted) - len(BEGIN + CLOSE)), r"<\|end\|>")
    blocks = F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.split(b, r"<\|text\|>"))
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(b[1], r"<\|turn\|>"), lambda t: F.struct(
        unescape(F.substring(b[0], F.lit(len(START) + 1), F.char_length(b[0]))).alias("role"), unescape(t).alias("text")))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
