"""Chat formatting: collapse cumulative snapshots of conversations, then render what is left.

Loggers write a conversation again after each turn, so most logged conversations are prefixes of
longer ones. Every turn gets a rolling hash of all turns up to it (two sums of 64-bit hashes of
position, role and text). A conversation whose last hash is the hash before some further turn of
another one is a prefix of it; an anti-join drops it. Of equal conversations the smallest id stays.

Defined results: turns are ordered by turn, role and text (nulls first), so ties have a fixed order
and repeated rows are repeated turns; a null role or text counts as empty; turns without conversation
id are one conversation. An empty table gives an empty result; other columns are not read. One
rendered conversation must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import carry_blocks, numbered
from .common import stored

BLOCK = 256  # turn numbers scanned together
KEY = ["pos", "p1", "p2"]
OPEN, SHUT = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, role, text, pos (from 1) and the hash p1, p2 of the turns up to this one; h1, h2 is its own part."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    rows = numbered(rows, ["conv_id"], "block", ["turn", "role", "text"], "pos").withColumn("pos", F.col("pos") + 1)
    hashed = rows.withColumn("h1", F.xxhash64("pos", "role", "text").cast("decimal(20,0)")).withColumn("h2", F.xxhash64("text", "pos", "role", F.lit("b")).cast("decimal(20,0)"))
    out = carry_blocks(hashed, ["conv_id"], "block", {"s1": F.sum("h1"), "s2": F.sum("h2")}, {"c1": F.sum("s1"), "c2": F.sum("s2")})
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda h, c: (F.sum(h).over(upto) + F.coalesce(F.col(c), F.lit(0))).cast("decimal(38,0)")
    return out.select("conv_id", "role", "text", "pos", "h1", "h2", total("h1", "c1").alias("p1"), total("h2", "c2").alias("p2"))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that are no prefix of a longer one."""
    before = rows.filter("pos > 1").select((F.col("pos") - 1).alias("pos"), *[(F.col(f"p{i}") - F.col(f"h{i}")).cast("decimal(38,0)").alias(f"p{i}") for i in (1, 2)]).distinct()
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("k")).select("conv_id", *[F.col(f"k.{c}").alias(c) for c in KEY])
    left = last.join(before, KEY, "left_anti")
    return left.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")).select("conv_id", F.col("pos").alias("n_turns"), "copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn; markers inside a text are broken up."""
    quiet = F.replace(F.replace(text, F.lit("<|im_"), F.lit("< |im_")), F.lit("|>"), F.lit("| >"))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), quiet, F.lit(f"{SHUT}\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies (logged conversations equal to it) and its rendered text."""
    rows = stored(prefixes(conversations))
    keep = stored(maximal(rows))
    kept = rows.join(keep.select(F.col("conv_id").alias("k")), F.col("conv_id").eqNullSafe(F.col("k")), "left_semi")
    turn = F.struct("pos", rendered(F.col("role"), F.col("text")).alias("piece"))
    whole = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.array_join("turns.piece", "").alias("rendered"))
    named = whole.withColumnRenamed("conv_id", "w")
    return keep.join(named, F.col("conv_id").eqNullSafe(F.col("w"))).drop("w")
