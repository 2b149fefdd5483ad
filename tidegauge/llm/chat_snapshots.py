"""Collapse of cumulative chat snapshots, then rendering of the conversations that remain.

A chat that is logged again after every turn leaves many conversations that are
prefixes of a longer one. The hash of a prefix is the XOR of two 64-bit hashes of
(position, role, text) of its turns: it rolls along the turns and sums up in any
order, so a long conversation need not be gathered. A conversation whose whole hash
is the hash of a proper prefix of another one is dropped by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written

#: Turns with neighbouring numbers that one window takes; longer conversations take several.
CHUNK = 1_024


def _placed(turns: DataFrame) -> DataFrame:
    """The turns with their chunk, place in it (by turn, role and text) and two hashes, written once: the prefixes
    are worked out from the narrow columns, and texts are read again only for rendering."""
    marks = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")] + [F.col(c).isNull() for c in ("role", "text")]
    chunk = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / CHUNK)
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text", chunk.alias("_chunk")).withColumn("_in", F.row_number().over(inside))
    return written(rows.withColumns({f"t{i}": F.xxhash64(F.lit(i), *marks) for i in (1, 2)}), "chat-turns")


def _rolled(placed: DataFrame) -> DataFrame:
    """``conv_id``, ``_chunk``, ``_in``, ``pos`` (from 1), ``n`` (the conversation's turns) and the rolling ``h1``, ``h2``."""
    narrow = placed.select("conv_id", "_chunk", "_in", "t1", "t2")
    before = Window.partitionBy("_c").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    by = [F.col("conv_id").alias("_c"), F.col("_chunk").alias("_k")]
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_chunk") == F.col("_k"))
    sizes = narrow.groupBy(*by).agg(F.count("*").alias("_n")).select(
        "_c", "_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("_c")).alias("n")
    )
    there = narrow.join(sizes, same).withColumn("pos", F.col("_start") + F.col("_in")).drop("_c", "_k")
    hashed = there.withColumns({f"x{i}": F.xxhash64(F.col(f"t{i}"), "pos") for i in (1, 2)})
    sums = hashed.groupBy(*by).agg(F.bit_xor("x1").alias("_x1"), F.bit_xor("x2").alias("_x2"))
    sums = sums.select("_c", "_k", *[F.coalesce(F.bit_xor(f"_x{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv_id", "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("*", *[F.bit_xor(f"x{i}").over(upto).alias(f"_r{i}") for i in (1, 2)])
    return rolled.join(sums, same).select(
        "conv_id", "_chunk", "_in", "pos", "n",
        F.col("_r1").bitwiseXOR(F.col("_b1")).alias("h1"), F.col("_r2").bitwiseXOR(F.col("_b2")).alias("h2"),
    )


def maximal_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``pos`` and ``n`` of the conversations that are no proper prefix of another one.

    Turns stand in the order of ``turn`` (null first), ties by role and text. Equal
    conversations are not longer than one another, so all of them stay. Null roles
    and texts are values of their own; a null conv_id is one conversation. Equality of prefixes is that of their length
    and of 128 bits of hashes. Other columns, of whatever name, are not read.
    """
    placed = _placed(turns)
    rows = written(_rolled(placed), "chat-prefixes")
    # distinct: a first turn that very many conversations share is one row for each task
    prefixes = rows.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    whole = rows.where("pos = n").select("conv_id", "n", "h1", "h2")
    kept = whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("_c"))
    starts = rows.where("_in = 1").select(
        F.col("conv_id").alias("_d"), F.col("_chunk").alias("_k"), (F.col("pos") - 1).alias("_start"), "n"
    )
    starts = written(starts.join(kept, F.col("_d").eqNullSafe(F.col("_c"))).drop("_c"), "chat-kept")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    found = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("_d")) & (F.col("_chunk") == F.col("_k")))
    return found.select("conv_id", "turn", "role", "text", (F.col("_start") + F.col("_in")).alias("pos"), "n")


def rendered(turns: DataFrame, form: Column | None = None) -> DataFrame:
    """``conv_id``, ``part``, ``n_turns`` and ``chat``: maximal conversations as text.

    ``form`` renders one turn from ``role`` and ``text``; the default is
    ``<|role|>`` and the text, each on a line. A part holds CHUNK turns at most, so
    that no conversation is gathered without bound; most have part 0 only. An
    empty table gives an empty result.
    """
    if form is None:
        role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
        form = F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))
    part = F.floor((F.col("pos") - 1) / CHUNK)
    kept = maximal_turns(turns).select("conv_id", part.alias("part"), F.col("n").alias("n_turns"), "pos", form.alias("turn"))
    return kept.groupBy("conv_id", "part", "n_turns").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "turn"))), lambda t: t["turn"]), "").alias("chat")
    )
