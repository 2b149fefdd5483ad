"""Mixing sources to target weights over a time-varying curriculum, in DataFrame functions only.

A source has a weight schedule: a piecewise linear density over training time 0..1.
Its integral, scaled to the source's target, is the source's cumulative demand of
tokens. The source's documents stand in a fixed order, repeated as often as needed;
a document's place in that run of tokens, put through the inverse of the demand, is
its training position. Sorting by position interleaves all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written
from .prefix import order_key, running_sum

#: No source is repeated more often than this.
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to ``sources(source, source_size, weight)``, one row per source.

    All sizes are shared by weight; a target stops at ``most_repeats`` times its
    source's size, and the excess is shared again by weight until none is above.
    Closed form: sources fill up in the order of room per weight; one is full if the
    level reached with all earlier ones full is at least its own. The table has a row per
    source, not per document.
    """
    room = F.col("source_size") * most_repeats
    by_room = Window.orderBy(F.col("_per_weight"), "source")
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("_room", room.cast("bigint"))
        .withColumn("_per_weight", F.coalesce(F.try_divide("_room", "weight"), F.lit(float("inf"))))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_room_before", F.sum("_room").over(by_room.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_room"))
        .withColumn("_weight_before", F.sum("weight").over(by_room.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"))
        .withColumn(
            "_level",
            F.try_divide((F.col("_all") - F.col("_room_before")).cast("double"), F.col("_weights") - F.col("_weight_before")),
        )
        .withColumn("_full", F.coalesce(F.col("_level") >= F.col("_per_weight"), F.lit(False)))
    )
    # fullness is a prefix of the order; the level of the first source that is not full holds for all later ones
    level = F.min(F.when(~F.col("_full"), F.struct("_per_weight", "source", "_level"))).over(everything)["_level"]
    return ranked.withColumn(
        "target",
        F.when(F.col("_full"), F.col("_room").cast("double")).otherwise(F.coalesce(level * F.col("weight"), F.lit(0.0))),
    ).drop("_room", "_per_weight", "_all", "_weights", "_room_before", "_weight_before", "_level", "_full")


def invert_ramp(share: Column, slope: Column) -> Column:
    """Time t at which the density 1 + slope * (2t - 1) has integrated to ``share``; slope in -1..1.

    The integral is (1 - slope) * t + slope * t^2; the root is written so that a
    slope of 0 needs no case of its own; at a share of 0 it is 0.
    """
    b = 1 - slope
    return F.coalesce(F.try_divide(2 * share, b + F.sqrt(b * b + 4 * slope * share)), F.lit(0.0))


def mixed(
    docs: DataFrame,
    sources: DataFrame | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    carry: tuple[str, ...] = (),
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``slope``, ``copies``,
    ``before`` (tokens of the source that come earlier), and columns ``carry`` as a struct ``row``.

    ``sources(source, source_size)`` may be given with columns ``weight`` and
    ``slope``. Without it sources sorted by code point, null last, weigh 1, 2, 3,
    repeating, and ramp down, stay level and ramp up in turn. A document has one
    more copy for every whole pass of its source, and one for the last, partial pass
    if its middle lies before that pass ends. Null texts and ids are allowed; a null
    source is a source. Repeated rows are documents of their own. No words anywhere: no copies. An empty table gives an empty result.
    Columns of other names, also those of the result, are only read if ``carry`` names them.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        (F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)).alias("row"),
        order_key(doc_id).alias("key"),
    )
    # words are counted once: totals of sources and shards come from a narrow table
    sizes = written(rows.select("source", "key", "size"), "mix-sizes") if carry else (rows := written(rows, "mix-sizes"))
    if sources is None:
        sources = default_sources(sizes)
    plan = targets(sources, most_repeats).select("source", "source_size", "target", "slope")
    joined = running_sum(rows, "source", "key", ["key", "doc_id", "size"], F.col("size"), sizes, plan)
    return joined.withColumn("copies", _copies()).select(
        "doc_id", "source", "size", "source_size", "target", "slope", "copies", "before", "row"
    )


def _copies() -> Column:
    passes = F.floor(F.col("target") / F.col("source_size"))
    middle = passes * F.col("source_size") + F.col("before") + F.col("size") / 2.0
    last = F.when(middle < F.col("target"), 1).otherwise(0)
    return F.when(F.col("source_size") > 0, passes + last).otherwise(0).cast("bigint")


def default_sources(rows: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``slope`` from ``rows(source, size)``."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return (
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", (rank % 3 + 1).cast("bigint"))
        .withColumn("slope", (F.col("weight") - 2) / 2)
    )


def position(copy: Column) -> Column:
    """Training position, 0..1, of the ``copy``-th (from 0) copy of a row of ``mixed``."""
    place = copy * F.col("source_size") + F.col("before") + F.col("size") / 2.0
    return invert_ramp(F.least(F.lit(1.0), F.coalesce(F.try_divide(place, F.col("target")), F.lit(0.0))), F.col("slope"))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, range-sorted by training position.

    All columns are carried, whatever their names; those of the mix do not clash with them. Null ids, texts and sources are
    those of ``mixed``; rows with one position stand by id. An empty table gives an empty result.
    """
    names = docs.columns
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    cols = {k: f"c{names.index(options.pop(k, k))}" for k in ("doc_id", "text", "source")}
    chosen = mixed(plain, carry=tuple(plain.columns), **cols, **options).where("copies > 0")
    each = chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    ordered = each.withColumn("position", position(F.col("copy"))).orderBy("position", "doc_id")
    return ordered.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
