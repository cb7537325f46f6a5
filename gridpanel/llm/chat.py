"""Chat formatting: logged snapshots collapse into the longest conversation, from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.session import materialize

BLOCK = 512  # turn numbers per block: bounds what one task sees of a conversation


def _digest(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that also tell null from empty."""
    safe = [x for c in cols for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))]
    return [F.xxhash64(F.lit(seed), *safe) for seed in (1, 2)]


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Null-safe join on ``names``, keeping the left side's columns once."""
    renamed = right.select([F.col(c).alias(f"_r_{c}" if c in names else c) for c in right.columns])
    match = F.lit(True)
    for c in names:
        match &= F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in names])


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, p1, p2): a rolling hash of each conversation's first ``pos`` turns.

    Turns are ordered by number (null first), ties by content; repeated rows count once.
    Each turn's hash is salted with its position and the prefix is their running
    exclusive or, so it is summed up block by block: blocks of ``BLOCK`` turn numbers are
    windows of their own and a conversation with a third of all turns isn't one task.
    """
    h1, h2 = _digest(F.col("role"), F.col("text"))
    block = F.floor(F.col("turn") / F.lit(BLOCK))
    turns = conversations.select("conv_id", "turn", block.alias("block"), h1.alias("h1"), h2.alias("h2")).distinct()
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    ranked = materialize(turns.withColumn("rn", F.row_number().over(inside)), "turns")
    sizes = ranked.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.sum("n").over(over).alias("start")).where("start is not null")
    placed = _same(ranked, starts, ["conv_id", "block"], "left").withColumn("pos", F.col("rn") + F.coalesce("start", F.lit(0)))
    salted = placed.select("conv_id", "block", "pos", F.xxhash64("h1", "pos").alias("s1"), F.xxhash64("h2", "pos").alias("s2"))
    salted = materialize(salted, "salted")
    blocks = salted.groupBy("conv_id", "block").agg(F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"))
    earlier = blocks.select("conv_id", "block", *[F.bit_xor(x).over(over).alias(x) for x in ("x1", "x2")]).where("x1 is not null")
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolling = salted.select("conv_id", "block", "pos", *[F.bit_xor(s).over(within).alias(s) for s in ("s1", "s2")])
    joined = _same(rolling, earlier, ["conv_id", "block"], "left")
    return joined.select(
        "conv_id", "pos",
        F.col("s1").bitwiseXOR(F.coalesce("x1", F.lit(0))).alias("p1"), F.col("s2").bitwiseXOR(F.coalesce("x2", F.lit(0))).alias("p2"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): conversations that aren't the beginning of a longer one.

    Of conversations with equal turns the smallest conv_id stands for all ``copies``. A
    first turn shared by a third of all conversations is one prefix row per task before
    it is shuffled.
    """
    rolled = materialize(prefixes(conversations), "prefixes")
    ends = rolled.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.max_by(F.struct("p1", "p2"), "pos").alias("p"))
    ends = materialize(ends, "ends")
    full = ends.groupBy("n_turns", F.col("p.p1").alias("p1"), F.col("p.p2").alias("p2")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")
    )
    begun = _same(rolled, ends.select("conv_id", "n_turns"), ["conv_id"], "inner").where(F.col("pos") < F.col("n_turns"))
    begun = begun.groupBy("pos", "p1", "p2").agg(F.count(F.lit(1)).alias("longer"))
    kept = full.join(begun.select(F.col("pos").alias("n_turns"), "p1", "p2"), ["n_turns", "p1", "p2"], "left_anti")
    return kept.select("conv_id", "n_turns", "copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, first_turn, n_turns, copies, chat): the maximal conversations as training text.

    Each turn becomes ``<|role|>``, a line break, its text and ``<|end|>`` with a line
    break; a null role is ``unknown`` and a null text empty. A conversation is one row per
    block of ``BLOCK`` turn numbers (``part``, nearly always only 0; -1 for null turns), so no row holds
    an unbounded conversation. Rows without conv_id form one conversation of their own.
    Repeated rows count once; an empty table gives an empty result; other columns are
    ignored.
    """
    h1, h2 = _digest(F.col("role"), F.col("text"))
    block = F.floor(F.col("turn") / F.lit(BLOCK))
    turns = conversations.select("conv_id", "turn", "role", "text", block.alias("block"), h1.alias("h1"), h2.alias("h2"))
    kept = _same(turns, maximal(conversations), ["conv_id"], "inner")
    one = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "h1", "h2", "role", "text")
    parts = kept.groupBy("conv_id", "block", "n_turns", "copies").agg(
        F.array_sort(F.collect_set(one)).alias("turns"), F.min("turn").alias("first_turn")
    )

    def line(t: Column) -> Column:
        role, text = F.coalesce(t["role"], F.lit("unknown")), F.coalesce(t["text"], F.lit(""))
        return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))

    return parts.select(
        "conv_id", F.coalesce("block", F.lit(-1)).cast("int").alias("part"), "first_turn", "n_turns", "copies", F.array_join(F.transform("turns", line), "").alias("chat")
    )
