"""Exact removal of long repeated strings by a logarithmic family of sampled suffix arrays.

A string of LENGTH bytes is found by one of its suffixes. Of the suffixes that start in its first LENGTH - SHARED + 1 bytes the
one is taken whose first SHARED bytes have the least hash: equal strings take the same one, and neighbouring strings share
theirs. So a text has a *run* of strings for each suffix taken (one in about 74 bytes), and these suffixes, in the order of
their rank (their first two bytes, then a hash of the first SHARED), are its suffix array. Equal ranks are neighbours; no
other property of the order is used.

Documents come in batches. A batch's suffix array is merged with those of all levels in one sorted stream:

* suffixes whose runs are equal throughout (the bytes of all strings in them) are repeats, all strings of the run with them;
* suffixes with equal rank and other runs share SHARED bytes and may share strings: their ranks are *open*.

The stream that finds this is also the next level: levels of equal size merge with the batch, so that there are as many
levels as ones in the binary number of batches. Last, the strings of the runs with an open rank, few by then, are compared
one by one by the hash of all their bytes.

Equality is that of hashes of 64 bits over all bytes of a string. Nothing is capped: a rank with many different runs is spread over
tasks, as ranges are cut by rank and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh_path, parquet_path
from .common import written as stored
from .fill_middle import buffers_of

LENGTH, SHARED = 400, 256
#: Bytes of texts whose suffixes are hashed at a time; strings of longer texts come in parts.
PIECE = 1 << 20
#: Batches that a table is dealt into; four end in one level.
BATCHES = 4
#: Ranks (eight bytes each) up to this many are broadcast; more are joined by a shuffle.
BROADCAST_RANKS = 2_000_000

_BITS = np.uint64(21)  # of a place in a piece
_LOW = (np.uint64(1) << _BITS) - np.uint64(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_BYTES = np.arange(1, 257, dtype=np.uint64) * _MIX[0]
_BYTES = (_BYTES ^ (_BYTES >> np.uint64(29))) * _MIX[1]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two strings that follow each other, from theirs."""
    out = left * _MIX[0]
    out += right
    out ^= out >> np.uint64(29)
    out *= _MIX[1]
    out ^= out >> np.uint64(32)
    return out


def hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """A hash of every string of ``length`` bytes (a power of two): two of half the length make one."""
    out, size = _BYTES[raw], 1
    while size < length:
        out = _joined(out[:-size], out[size:]) if len(out) > size else out[:0]
        size *= 2
    return out


def _least(values: np.ndarray, width: int, n: int) -> np.ndarray:
    """The least of every ``width`` values that follow each other, for the first ``n`` of these windows."""
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Runs:
    """Runs of strings that share their suffix: the text's number, the suffix, the first and the last string (places in bytes),
    the suffix's rank and the hash of the run."""

    text: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rank: np.ndarray
    run: np.ndarray


def _pieces(sizes: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Text, start and end of pieces that together are PIECE bytes or little more; all strings of a text are in one of its pieces."""
    held: list[tuple[int, int, int]] = []
    size = 0
    for text in np.flatnonzero(sizes >= LENGTH).tolist():
        for at in range(0, int(sizes[text]) - LENGTH + 1, PIECE):
            end = min(at + PIECE + LENGTH - 1, int(sizes[text]))
            if held and size + end - at > PIECE:
                yield held
                held, size = [], 0
            held.append((text, at, end))
            size += end - at
    if held:
        yield held


def runs_of(raw: np.ndarray, starts: np.ndarray) -> Iterator[Runs]:
    """The runs of all strings of LENGTH bytes in texts that stand one after the other in ``raw``."""
    for pieces in _pieces(np.diff(starts)):
        data = np.concatenate([raw[starts[t] + a : starts[t] + b] for t, a, b in pieces])
        sizes = np.array([b - a for _, a, b in pieces])
        ends = np.cumsum(sizes)
        n = len(data) - LENGTH + 1
        h = hashes(data, SHARED)
        marked = (h >> _BITS << _BITS) | np.arange(1, len(h) + 1, dtype=np.uint64)
        least = _least(marked, LENGTH - SHARED + 1, n)
        owner = np.repeat(np.arange(len(pieces)), sizes)[:n]
        whole = np.flatnonzero(np.arange(n) + LENGTH <= ends[owner])
        new = np.append(True, (np.diff(least[whole]) != 0) | (np.diff(owner[whole]) != 0))
        begin = np.flatnonzero(new)
        first, last = whole[begin], whole[np.append(begin[1:], len(whole)) - 1]
        at = (least[first] & _LOW).astype(np.int64) - 1
        more = LENGTH - SHARED
        run = _joined(_joined(h[first], h[first + more]), h[last + more])  # these three cover all bytes of the run
        run = _joined(run, ((at - first) << 16 | (last - first)).astype(np.uint64))
        two = data[at].astype(np.uint64) << np.uint64(56) | data[at + 1].astype(np.uint64) << np.uint64(48)
        rank = (two | h[at] >> np.uint64(16)) ^ np.uint64(1 << 63)  # signed numbers in the order of unsigned ones
        piece = owner[first]
        shift = np.array([a for _, a, _ in pieces])[piece] - (ends - sizes)[piece]
        text = np.array([t for t, _, _ in pieces])[piece]
        yield Runs(text, at + shift, first + shift, last + shift, rank.view(np.int64), run.view(np.int64))


def strings_of(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the strings that start at first..last, for all of these ranges in turn."""
    out = [np.zeros(0, np.int64)]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        h = hashes(raw[a : b + LENGTH], SHARED)
        out.append(_joined(h[: b - a + 1], h[LENGTH - SHARED :][: b - a + 1]).view(np.int64))
    return np.concatenate(out)


_RUNS = "file bigint, row bigint, at int, first int, last int, rank bigint, run bigint"


def suffixes(rows: DataFrame) -> DataFrame:
    """The runs of all texts of ``rows(file, row, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = buffers_of(batch.column(2))
            file, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for x in runs_of(raw, starts):
                columns = (file[x.text], row[x.text], *(c.astype(np.int32) for c in (x.at, x.first, x.last)), x.rank, x.run)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file", "row", "at", "first", "last", "rank", "run"])

    return rows.mapInArrow(run, _RUNS)


def _summed(rank: np.ndarray, run: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries sorted by rank and run, equal ones as one with their counts summed."""
    start = np.flatnonzero(np.append(True, (rank[1:] != rank[:-1]) | (run[1:] != run[:-1]))) if len(rank) else np.zeros(0, np.int64)
    return rank[start], run[start], *((np.add.reduceat(c, start) if len(start) else c) for c in counts)


_ENTRIES = "rank bigint, run bigint, n bigint, merging boolean"
_SCANNED = "rank bigint, run bigint, n bigint, total bigint, open boolean, edge boolean"


def entries_of(runs: DataFrame) -> DataFrame:
    """Suffix entries of a batch, equal ones of an Arrow batch summed up before they are shuffled."""

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, run = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((run, rank))
            made = _summed(rank[order], run[order], np.ones(len(order), np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(np.ones(len(made[0]), bool))], names=["rank", "run", "n", "merging"])

    return runs.select("rank", "run").mapInArrow(collapsed, _ENTRIES)


def merge_scanned(entries: DataFrame) -> DataFrame:
    """The one sorted stream of a batch's suffixes and the levels'.

    Equal entries become one: ``n`` counts those of the batch and of levels that merge with it, ``total`` all. ``open`` tells
    whether a neighbour has the same rank and another run. A rank may go on in the next task: the first and the last of a
    task are an ``edge``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, behind, first = None, None, True  # the last entry, whose partners may follow; the rank before it

        def out(made, open_, edge):
            return pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(open_), pa.array(edge)], names=["rank", "run", "n", "total", "open", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rank, run, n = (batch.column(k).to_numpy() for k in range(3))
            merging = np.where(batch.column(3).to_numpy(zero_copy_only=False), n, 0)
            fresh = (rank, run, merging, n)
            if held is not None:
                fresh = tuple(np.concatenate(x) for x in zip(held, fresh, strict=True))
            made = _summed(*fresh)
            before = np.append(behind is not None and behind == made[0][0], made[0][1:] == made[0][:-1])
            open_ = before | np.append(before[1:], False)
            edge = np.zeros(len(open_), bool)
            held = tuple(c[-1:] for c in made)
            if len(open_) > 1:
                if first:
                    edge[0], first = True, False
                behind = made[0][-2]
                yield out([c[:-1] for c in made], open_[:-1], edge[:-1])
        if held is not None:
            yield out(held, np.array([behind is not None and bool(behind == held[0][0])]), np.array([True]))

    dealt = entries.repartitionByRange("rank", "run").sortWithinPartitions("rank", "run")
    return dealt.mapInArrow(scan, _SCANNED)


@dataclass
class SuffixIndex:
    """Levels of sampled suffixes, and what scans have found. ``add`` takes a batch's runs, in any number of calls."""

    spark: SparkSession
    levels: list[tuple[int, DataFrame]] = field(default_factory=list)
    found: list[DataFrame] = field(default_factory=list)

    def add(self, runs: DataFrame) -> None:
        """Scans a batch against all levels and merges levels of equal size.

        If all merge, the new level holds all that earlier scans have found, and they are let go. A scan that is lost starts
        again from tables in the shared folder.
        """
        size, merged = 1, 0
        for held, _ in reversed(self.levels):
            if held != size:
                break
            size, merged = size * 2, merged + 1
        keep = len(self.levels) - merged
        entries = entries_of(runs)
        for k, (_, level) in enumerate(self.levels):
            entries = entries.union(level.where("n > 0").select("rank", "run", "n", F.lit(k >= keep).alias("merging")))
        scanned = merge_scanned(entries)
        if keep:  # of what other levels hold only matches are written
            scanned = scanned.where("n > 0 or total > 1 or open or edge")
        scanned = stored(scanned, "suffixes")
        self.levels = [*self.levels[:keep], (size, scanned)]
        self.found = [*self.found, scanned] if keep else [scanned]

    def repeated(self) -> DataFrame:
        """``rank`` and ``run`` of the runs that stand in two places or more."""
        return self._all().where("total > 1").select("rank", "run").distinct()

    def open_ranks(self) -> DataFrame:
        """``rank`` of suffixes that share their first bytes with one of another run, if one of these stands only once."""
        all_ = self._all()
        edges = all_.where("edge").groupBy("rank").agg(F.min("run").alias("a"), F.max("run").alias("b")).where("a <> b")
        single = all_.where("open and total = 1").select("rank")
        return single.union(edges.select("rank")).distinct()

    def _all(self) -> DataFrame:
        out = self.found[0]
        for more in self.found[1:]:
            out = out.union(more)
        return out


def _near(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def _with_text(rows: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(_near(wanted, BROADCAST_ROWS), ["file", "row"], how)


def single_strings(rows: DataFrame, open_runs: DataFrame) -> DataFrame:
    """Places ``file``, ``row``, ``start`` of strings in ``open_runs`` that another run holds too."""
    by_row = open_runs.groupBy("file", "row").agg(F.collect_list(F.struct("first", "last", "run", "repeated")).alias("runs"))
    by_row = stored(by_row, "open-runs")  # a row's runs are fewer than its bytes

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = buffers_of(batch.column(2))
            for k, (file, row, runs) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                text = raw[starts[k] : starts[k + 1]]
                for at in range(0, len(runs), 1_000):
                    some = runs[at : at + 1_000]
                    first, last, run = (np.array([r[c] for r in some], np.int64) for c in ("first", "last", "run"))
                    n = last - first + 1
                    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                    alone = np.repeat([not r["repeated"] for r in some], n)
                    columns = (strings_of(text, first, last), np.repeat(run, n), np.full(len(start), file), np.full(len(start), row), np.where(alone, start, -1))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["string", "run", "file", "row", "start"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)  # the first row of the last string, as long as it is the only one
        key = None
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            goes_on = not held.shape[1] and key is not None and bool(key == rows[0, 0])
            same = np.append(goes_on, rows[0, 1:] == rows[0, :-1])
            both = same | np.append(same[1:], False)
            key, held = rows[0, -1], rows[:, :0] if both[-1] else rows[:, -1:]
            some = rows[:, both & (rows[4] >= 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in some[2:]], names=["file", "row", "start"])

    made = _with_text(rows, by_row).select("file", "row", "text", "runs").mapInArrow(strings, "string bigint, run bigint, file bigint, row bigint, start bigint")
    dealt = made.repartition("string").sortWithinPartitions("string")
    return dealt.mapInArrow(met, "file bigint, row bigint, start bigint")


def repeated_spans(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``file``, ``row`` and ``spans`` (starts and ends of maximal ranges of bytes, in order) of the rows of ``rows(file, row, text)``
    that hold a byte covered by a repeated string of LENGTH bytes."""
    spark = rows.sparkSession
    path = fresh_path(spark, "runs")
    suffixes(rows).withColumn("batch", F.pmod(F.xxhash64("file", "row"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    runs = spark.read.schema(f"{_RUNS}, batch int").parquet(path)
    index = SuffixIndex(spark)
    for k in range(batches):
        index.add(runs.where(F.col("batch") == k))
    open_ranks = stored(index.open_ranks().withColumn("open", F.lit(True)), "open-ranks")
    repeated = stored(index.repeated().withColumn("repeated", F.lit(True)), "repeated-runs")
    shared = stored(repeated.select("rank").union(open_ranks.select("rank")).distinct(), "shared-ranks")
    few = stored(runs.drop("batch").join(_near(shared, BROADCAST_RANKS), "rank", "left_semi"), "shared-runs")
    some = few.join(repeated, ["rank", "run"], "left").join(open_ranks, "rank", "left")
    some = stored(some.withColumn("repeated", F.coalesce("repeated", F.lit(False))), "judged-runs")
    one_each = F.min(F.struct("file", "row", "first", "last", "repeated"))
    open_runs = some.where("open").groupBy("rank", "run").agg(one_each.alias("who")).select("who.*", "run")
    single = single_strings(rows, open_runs).select("file", "row", "start", (F.col("start") + LENGTH).alias("end"))
    whole = some.where("repeated").select("file", "row", F.col("first").cast("bigint").alias("start"), (F.col("last") + LENGTH).cast("bigint").alias("end"))
    by = Window.partitionBy("file", "row")
    before = F.max("end").over(by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    number = F.sum("new").over(by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    islands = whole.union(single).withColumn("new", new).withColumn("number", number)
    spans = islands.groupBy("file", "row", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` and ``kept`` (binary), one row per row of ``docs``.

    Each byte covered by a string of LENGTH bytes that also starts elsewhere, in the same text or another, is removed;
    strings are judged on the input and may overlap, so all places of a repeat go. Spans are maximal ranges of removed bytes,
    ends past the last. Null texts count as empty; shorter texts stay whole. Rows are named by their place in a file, so
    repeated rows, repeated or null ids and columns of any other name do no harm: repeated rows are copies of each other.
    Anything but a plain read of Parquet is written first. An empty table gives an empty result.
    """
    spark, path = docs.sparkSession, parquet_path(docs, "suffix-input")
    read = spark.read.schema(docs.schema).parquet(path)
    place = (F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = read.select(*place, F.col(text).alias("text"))
    spans = stored(repeated_spans(rows, batches), "removed-spans")
    named = read.select(*place, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    both = _with_text(named, spans, "left").select("doc_id", "text", "spans")
    kind = both.schema["doc_id"].dataType.simpleString()
    pairs = both.schema["spans"].dataType.simpleString()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            raw, starts = buffers_of(batch.column(1))
            view, kept, removed, number = memoryview(raw), [], [], []
            for a, b, found in zip(starts[:-1].tolist(), starts[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                ends = [0, *(x["end"] for x in found or ())]
                left = zip(ends, [*(x["start"] for x in found or ()), b - a], strict=True)
                kept.append(b"".join(view[a + x : a + y] for x, y in left))
                removed.append(b - a - len(kept[-1]))
                number.append(len(ends) - 1)
            sizes = pa.array(np.diff(starts), pa.int64())
            columns = [batch.column(0), sizes, pa.array(removed, pa.int64()), pa.array(number, pa.int64()), batch.column(2), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans {pairs}, kept binary")
