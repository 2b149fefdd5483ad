"""Packing into length buckets that minimise padding, and token-budget batches inside each.

Documents longer than the context are cut into pieces of its length, so lengths are
1..``context`` and the global histogram has at most ``context`` rows, whatever the
number of documents. Dynamic programming over that histogram chooses the bucket
boundaries. Rows of a bucket are ranked without gathering the bucket, in the order given or by a hash, and fill
batches of floor(budget / boundary) rows. Only the ranks are narrow: every piece leaves with its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import place, written
from .prefix import order_key, running_sum

#: Batches that follow each other and among which rows are dealt in turn.
SPREAD = 8
STORED_BLOCK = 50_000
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding in total.

    ``lengths`` are distinct and positive. Splitting points move right with the
    length (the padding is a Monge cost), so each layer is solved by divide and conquer.
    """
    order = np.argsort(lengths)
    length, count = lengths[order].astype(np.int64), counts[order].astype(np.float64)
    m = len(length)
    if not m:
        return []
    rows = np.append(0, np.cumsum(count))
    tokens = np.append(0, np.cumsum(count * length))
    best = length * rows[1:] - tokens[1:]  # one bucket for lengths 0..j
    cuts: list[np.ndarray] = []
    for _ in range(min(buckets, m) - 1):
        after, cut = best.copy(), np.full(m, -1)
        todo = [(1, m - 1, 0, m - 2)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(j - 1, b) + 1)
            cost = best[i] + length[j] * (rows[j + 1] - rows[i + 1]) - (tokens[j + 1] - tokens[i + 1])
            k = int(cost.argmin())
            if cost[k] < best[j]:
                after[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        cuts.append(cut)
        best = after
    out, j = [], m - 1
    for cut in reversed(cuts):
        if j >= 0 and cut[j] >= 0:
            out.append(int(length[j]))
            j = int(cut[j])
    return sorted([*out, int(length[j])])


def word_cuts(raw: bytes, context: int) -> tuple[int, list[int]]:
    """Number of words of ``raw``, and where every ``context``-th one starts, the first apart."""
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    return len(starts), starts[context::context].tolist()


def pieces(docs: DataFrame, context: int, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document in pieces of ``context`` words, the last shorter: ``doc_id``, ``piece`` (from 0), ``start`` and
    ``length`` in words, ``text`` and the columns ``carry``.

    A piece's text ends where the next one's first word starts, so a document's pieces joined are its text again.
    Texts without a word have one piece of length 0.
    """
    taken = docs.select(F.col(doc_id).alias("doc_id"), *carry, F.col(text).alias("text"))
    kept = len(carry) + 1
    names = [*taken.columns[:-1], "piece", "start", "length", "text"]
    schema = ", ".join([f"`{c}` {t}" for c, t in taken.dtypes[:-1]] + ["piece int", "start bigint", "length bigint", "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(kept).to_pylist()):
                raw = (value or "").encode("utf-8", "surrogatepass")
                n, cuts = word_cuts(raw, context)
                for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(raw)], strict=True)):
                    piece = raw[a:b].decode("utf-8", "surrogatepass") if cuts else value
                    rows.append((i, k, k * context, min(n - k * context, context), piece))
            at, *made = zip(*rows, strict=True) if rows else ((),) * 5
            types = (pa.int32(), pa.int64(), pa.int64(), pa.string())
            held = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:kept]]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names=names)

    return taken.mapInArrow(run, schema)


def packed(
    docs: DataFrame,
    context: int = 2048,
    buckets: int = 8,
    budget: int = 16_384,
    text: str = "text",
    doc_id: str = "doc_id",
    order: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``bucket`` (its boundary),
    ``batch`` (from 0 in each bucket), ``slot``, ``padding`` and ``text``.

    A batch holds floor(``budget`` / ``bucket``) rows at most, so its padded size is
    within the budget; all but a bucket's last are full. ``order`` names two columns of ``docs``, a block of the
    training order and a place in it (both texts that sort in that order): batches follow it, by stretches of SPREAD batches.
    Without it rows stand by a hash of id and piece. In a stretch, rows with one id and piece go to batches in turn: they
    share a batch only if the stretch has fewer batches than such rows.

    Pieces of length 0 (null, empty and blank texts) are in bucket 0 with one batch per ``budget`` rows, so nothing is
    dropped. Null ids are ids. Repeated rows are packed each. Columns of other names are not read. An empty table gives
    an empty result.
    """
    if budget < context:
        raise ValueError("the budget must hold one row of full context")
    given = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        *[F.col(c).alias(n) for c, n in zip(order or (), ("block", "at"), strict=False)],
    )
    cut = written(pieces(given, context, carry=("block", "at") if order else ()), "pieces")  # words are counted once
    histogram = cut.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()  # context rows at most
    bounds = boundaries(
        np.array([r["length"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64), buckets
    )
    bucket = F.lit(0)
    for bound in reversed(bounds):
        bucket = F.when((F.col("length") > 0) & (F.col("length") <= bound), F.lit(bound)).otherwise(bucket)
    # nested so that the smallest boundary that fits wins
    same = order_key("doc_id", "piece")
    rows = cut.select(place().alias("place"), bucket.cast("bigint").alias("bucket"), same.alias("same"), "piece", "length", *(("block", "at") if order else ()))
    if order:
        ranked = running_sum(rows, "bucket", "at", ["at", "piece", "same"], shard=F.col("block"))
    else:
        ranked = running_sum(rows, "bucket", "same", ["same", "length", "place"])
    fits = F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))
    stretches = F.greatest(F.floor(F.ceil(F.col("group_total") / fits) / SPREAD), F.lit(1))
    ranked = ranked.withColumn("fits", fits).withColumn(
        "stretch", F.least(F.floor(F.col("before") / (fits * SPREAD)), stretches - 1)
    )
    begins = F.col("stretch") * F.col("fits") * SPREAD
    size = F.when(F.col("stretch") == stretches - 1, F.col("group_total") - begins).otherwise(F.col("fits") * SPREAD)
    inside = Window.partitionBy("bucket", "stretch").orderBy("same", "before")
    dealt = ranked.withColumn("i", F.row_number().over(inside) - 1).withColumn("n", F.ceil(size / F.col("fits")))
    # the last batch takes what is over: it goes round with the others until it has its rows
    over = size - (F.col("n") - 1) * F.col("fits")
    late = F.col("i") - over * F.col("n")
    first = F.col("i") < over * F.col("n")
    others = F.greatest(F.col("n") - 1, F.lit(1))
    batch = F.when(first, F.pmod(F.col("i"), F.col("n"))).otherwise(F.pmod(late, others))
    slot = F.when(first, F.floor(F.col("i") / F.col("n"))).otherwise(over + F.floor(late / others))
    placed = dealt.select(
        "place", "bucket", (F.col("stretch") * SPREAD + batch).cast("bigint").alias("batch"), slot.cast("bigint").alias("slot")
    )
    whole = cut.select(place().alias("place"), "doc_id", "piece", "start", "length", "text").join(placed, "place")
    return whole.select(
        "doc_id", "piece", "start", "length", "bucket", "batch", "slot", (F.col("bucket") - F.col("length")).alias("padding"), "text"
    )


def stored_order(docs: DataFrame) -> DataFrame:
    """``docs``, read from files that were written in training order, with that order as columns ``_block`` and ``_at``.

    A file's name has the number of its part, and a row its number in the file; both are read with the row, so the order
    holds however the files are read. Blocks are STORED_BLOCK rows at most.
    """
    part = F.lpad(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), 10, "0")
    row = F.col("_metadata.row_index")
    block = F.concat(part, F.lpad(F.floor(row / STORED_BLOCK).cast("string"), 12, "0"))
    return docs.withColumns({"_block": block, "_at": F.lpad(row.cast("string"), 18, "0")})
