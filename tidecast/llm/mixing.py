"""Mixing sources to target weights: a token budget handed down a tree of domains, languages and sources.

A node's budget goes to its children by weight. A child that cannot use its share (all its tokens,
``max_epochs`` times) keeps what it can use; the shortage goes to its siblings first, and only what
a whole subtree cannot use leaves it, as a parent never gets more than its subtree holds. A leaf
repeats whole epochs while its budget lasts and takes the rest as a token prefix of one more
epoch, whose order the seed decides. Budgets are integers and add up exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import WORD, broadcast_up_to
from tidecast.staging import stage

# Leaves that may be broadcast to the documents; more of them are joined by a shuffle.
MOST_LEAVES = 50_000
# An epoch's order is cut into ranges of about this many tokens (16 times fewer at most), whatever the leaf's size:
# a range is summed in one place, and so are the sums of the ranges of a run, and of the runs.
RANGE = 50_000
# Hex digits of a place that tell ranges apart at most.
MOST_DIGITS = 12


def _weight(level: str, weights: Mapping[str, int] | None) -> Column:
    out = F.lit(1)
    for value, weight in (weights or {}).items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("decimal(38,0)")


def share_out(children: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Adds ``given``: each child's part of ``budget``, at most ``room``, the rest by weight ``w``.

    ``children`` has the columns of ``parents``, ``name``, ``room``, ``w`` (over 0) and ``budget`` (the
    parent's). Children that fill up come first by room per weight; what is left is split by
    cumulated weights, so that the parts of one parent add up to min(budget, all room).
    """
    # Decimals of no scale are exact for any token count; `div` keeps the whole part.
    by_need = Window.partitionBy(*parents, F.lit(0)).orderBy(F.col("room").cast("double") / F.col("w").cast("double"), name)
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        children.withColumn("room_before", F.coalesce(F.sum("room").over(before), F.lit(0)).cast("decimal(38,0)"))
        .withColumn("w_after", F.sum("w").over(after).cast("decimal(38,0)"))
        .withColumn("full", F.expr("room * w_after <= (budget - room_before) * w"))
    )
    family = Window.partitionBy(*parents, F.lit(0))
    upto = family.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    open_w = F.when(~F.col("full"), F.col("w")).otherwise(0)
    return (
        ranked.withColumn("left", (F.col("budget") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(family)).cast("decimal(38,0)"))
        .withColumn("w_open", F.sum(open_w).over(family).cast("decimal(38,0)"))
        .withColumn("w_upto", F.sum(open_w).over(upto).cast("decimal(38,0)"))
        .withColumn("given", F.expr(
            "cast(CASE WHEN full THEN room ELSE (left * w_upto) div w_open - (left * (w_upto - w)) div w_open END as decimal(38,0))"))
        .select(*parents, name, "room", "given")
    )


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget_share: tuple[int, int], max_epochs: int) -> DataFrame:
    """Leaves (``levels``, size) with ``given``: the tokens each is to deliver."""
    weight = F.lit(1).cast("decimal(38,0)")
    for level in levels:
        weight = F.when(_weight(level, weights.get(level)) > 0, weight).otherwise(0)
    usable = leaves.where((weight > 0) & (F.col("size") > 0))
    top, bottom = budget_share
    given = leaves.agg(F.expr(f"cast((coalesce(sum(size), 0) * {int(top)}) div {int(bottom)} as decimal(38,0))").alias("budget"))
    for depth, level in enumerate(levels):
        nodes = usable.groupBy(*levels[: depth + 1]).agg((F.sum("size") * max_epochs).cast("decimal(38,0)").alias("room"))
        nodes = nodes.withColumn("w", _weight(level, weights.get(level)))
        parents = list(levels[:depth])
        nodes = nodes.join(given, parents) if parents else nodes.join(F.broadcast(given))  # one row of totals
        given = share_out(nodes, parents, level).select(*parents, level, F.col("given").alias("budget"))
    return usable.join(given.withColumnRenamed("budget", "given"), list(levels))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], budget_share: tuple[int, int] = (1, 2),
        max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents to take, with how often: one row per row of ``docs`` that gives at least one token.

    ``levels`` maps the tree's levels, root first, to columns of ``docs``; null is a value like any
    other and shown as an empty string. ``weights`` has whole numbers by level and value, 1 for
    values not named, 0 to leave a subtree out. ``budget_share`` is the share of all tokens to
    deliver. Output: the id, the levels, n_tokens (words), full_epochs (whole passes),
    prefix_tokens (tokens taken from the start of the document in the last pass: its first ones if
    the prefix ends inside it) and taken_tokens. Texts without words, null ones included, give no
    row; so do empty tables. Repeated rows count each. A row without id has a place by its text.
    A level named like a column of the output is an error. Other columns are not looked at.
    """
    if clash := {id_col, "n_tokens", "full_epochs", "prefix_tokens", "taken_tokens"} & set(levels):
        raise ValueError(f"levels named like columns of the result: {sorted(clash)}")
    # Levels have names of their own inside, so that they may be called anything outside.
    names = [f"level_{k}" for k in range(len(levels))]
    weights = {n: weights.get(level) for n, level in zip(names, levels)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = stage(docs.select(
        F.col(id_col).alias("id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
        F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(text))).alias("key")), "sizes")
    leaves = stage(sizes.groupBy(*names).agg(F.sum("n_tokens").cast("decimal(38,0)").alias("size")), "leaves")
    plan = leaf_budgets(leaves, names, weights, budget_share, max_epochs)
    digits = F.least(F.lit(MOST_DIGITS), F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("size").cast("double") / RANGE)))).cast("int")
    plan = stage(plan.select(*names, F.expr("cast(given div size as bigint) AS full_epochs"), F.expr("cast(given % size as bigint) AS rest"), digits.alias("digits")), "plan")
    placed = sizes.where("n_tokens > 0").join(broadcast_up_to(plan, MOST_LEAVES), names).withColumn(
        "place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.col("key"))))
    # A run is a range without its last digits, the range the digits in all.
    placed = placed.withColumns({"run": F.expr("substring(place, 1, digits div 2)"), "range": F.expr("substring(place, 1, digits)")})
    ranges = stage(placed.groupBy(*names, "run", "range").agg(F.sum("n_tokens").alias("tokens")), "ranges")
    ahead = lambda tokens, order, *within: F.coalesce(F.sum(tokens).over(
        Window.partitionBy(*names, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = ranges.groupBy(*names, "run").agg(F.sum("tokens").alias("tokens")).select(*names, "run", ahead("tokens", ["run"]).alias("ahead_of_run"))
    ranges = ranges.select(*names, "run", "range", ahead("tokens", ["range"], "run").alias("ahead_in_run")).join(runs, [*names, "run"])
    ranges = stage(ranges.select(*names, "range", (F.col("ahead_of_run") + F.col("ahead_in_run")).alias("ahead")), "ahead")
    taken = placed.join(ranges, [*names, "range"]).withColumn("ahead", F.col("ahead") + ahead("n_tokens", ["place", "id", "n_tokens"], "range"))
    taken = taken.withColumn("prefix_tokens", F.greatest(F.lit(0), F.least("n_tokens", F.col("rest") - F.col("ahead"))).cast("long"))
    taken = taken.withColumn("taken_tokens", F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens"))
    return taken.where("taken_tokens > 0").select(
        F.col("id").alias(id_col), *[F.col(n).alias(level) for n, level in zip(names, levels)], "n_tokens", "full_epochs", "prefix_tokens", "taken_tokens")
