"""Hard negatives by a search in buckets of candidates sorted by norm.

By Cauchy and Schwarz no score exceeds the product of the anchor's and the candidate's norms. Candidates are ranged by
label and sorted by falling norm, so the batches that a task gets are buckets whose largest norm stands in front. A bucket is
passed over for an anchor whose bound lies below all that it still asks for: its windows' lower limits, and the running
k-th score of each window. Buckets that stay are scored by one matrix product with a block of anchors.

Anchors are a stated query set. They meet all rows in blocks of bounded size, each broadcast: no row meets a row of its own
group by a join, and a hot label or vector only makes more buckets. Sums of products of integers are exact in doubles
below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Anchors of a block: its vectors and windows go to every task.
ANCHORS_AT_ONCE = 8_192
#: Candidates of a bucket and anchors that are scored together; their matrix of scores is held by a task.
BUCKET, TOGETHER = 1_024, 512
#: Rows, about, whose scores give windows a k-th score to begin with. They prune and decide nothing.
SEEDS = 4_096
#: Largest sum of products that doubles hold exactly.
EXACT = 2.0**53

_NONE = np.iinfo(np.int64).max


@dataclass
class Block:
    """Anchors with the windows asked for: scores low..high of the ``same`` label or of the others, the first ``most``."""

    anchor: np.ndarray  # one for each window, rising: its row in ``vectors``
    low: np.ndarray
    high: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same: bool
    most: int


def matrix_of(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str | Column) -> DataFrame:
    """``vec_id``, ``label``, ``v`` (256 times the components, rounded down) and ``norm`` of the rows that take part."""
    taken = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
        F.col(embedding).cast("array<double>").alias("v"),
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cells = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    kept = taken.where("vec_id is not null and label is not null and v is not null").where(~bad)
    return kept.withColumn("v", cells).withColumn("norm", norm)


class Running:
    """The first scores of each window so far, by falling score and rising id."""

    def __init__(self, block: Block):
        shape = (len(block.anchor), block.most)
        self.block = block
        self.score, self.id = np.full(shape, -np.inf), np.full(shape, _NONE)
        self.norm = np.sqrt((block.vectors**2).sum(axis=1))

    def asks(self) -> np.ndarray:
        """The least score that each window can still take."""
        return np.maximum(self.block.low, self.score[:, -1])

    def meet(self, ids: np.ndarray, labels: np.ndarray, norm: float, vectors: np.ndarray) -> None:
        """Takes in a bucket whose largest norm is ``norm``, with anchors' windows in groups of bounded size."""
        b = self.block
        # the bound is a rounded number: a little above it nothing is lost
        alive = self.norm[b.anchor] * norm * (1 + 1e-9) + 1e-6 >= self.asks()
        held = np.unique(labels)
        if b.same or len(held) == 1:  # a bucket without a row of a label that counts
            alive &= np.isin(b.labels[b.anchor], held) == b.same
        windows = np.flatnonzero(alive)
        at = 0
        while at < len(windows):
            some, of = np.unique(b.anchor[windows[at : at + TOGETHER]], return_inverse=True)
            mine = windows[at : at + TOGETHER]
            at += len(mine)
            scores = b.vectors[some] @ vectors.T
            scores[(labels[None, :] == b.labels[some, None]) != b.same] = -np.inf
            if b.same:
                scores[ids[None, :] == b.ids[some, None]] = -np.inf
            self._take(mine, scores[of], ids)

    def _take(self, windows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        b, k = self.block, self.block.most
        last, last_id = self.score[windows, -1, None], self.id[windows, -1, None]
        fits = (scores >= b.low[windows, None]) & (scores <= b.high[windows, None]) & (scores > -np.inf)
        fits &= (scores > last) | ((scores == last) & (ids[None, :] < last_id))
        row, column = np.nonzero(fits)
        if not len(row):
            return
        hit = np.unique(row)
        who = np.concatenate([row, np.repeat(hit, k)])
        score = np.concatenate([scores[row, column], self.score[windows[hit]].ravel()])
        name = np.concatenate([ids[column], self.id[windows[hit]].ravel()])
        order = np.lexsort((name, -score, who))
        who, score, name = who[order], score[order], name[order]
        start = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        first = (start[:, None] + np.arange(k)).ravel()
        self.score[windows[hit]], self.id[windows[hit]] = score[first].reshape(-1, k), name[first].reshape(-1, k)

    def rows(self) -> pa.RecordBatch:
        window, place = np.nonzero(self.score > -np.inf)
        made = {"window": window, "score": self.score[window, place].astype(np.int64), "id": self.id[window, place]}
        return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in made.items()})


def searched(candidates: DataFrame, block: Block) -> DataFrame:
    """``window`` (its number in the block), ``score`` and ``id``: at least the first ``most`` of each window, from every task its own."""
    width = block.vectors.shape[1]
    top = float(np.abs(block.vectors).max(initial=0))
    sent = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = Running(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                bucket = batch.slice(at, BUCKET)
                norms = bucket.column(3).to_numpy()
                vectors = matrix_of(bucket.column(2), max(width, int(np.diff(bucket.column(2).offsets.to_numpy()).max())))[:, :width]
                if top * float(np.abs(vectors).max(initial=0)) * width >= EXACT:
                    raise ValueError("components are too large for exact scores")
                running.meet(bucket.column(0).to_numpy(), bucket.column(1).to_numpy(), float(norms.max()), vectors)
        yield running.rows()

    return candidates.select("vec_id", "label", "v", "norm").mapInArrow(run, "window bigint, score bigint, id bigint")


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each window with their ``rank``; a window has as many rows before as tasks times ``most``."""
    by = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def best_of(candidates: DataFrame, seeds: DataFrame, block: Block) -> DataFrame:
    """The first ``most`` candidates of each window. The k-th score among the ``seeds``, rows of the candidates, raises its lower
    limit beforehand, so that tasks return few rows that others will beat."""
    floor = first_of(searched(seeds, block), block.most).where(F.col("rank") == block.most)
    known = floor.select("window", "score").collect()  # one row a window of the block at most
    low = block.low.copy()
    for window, score in known:
        low[window] = max(low[window], score)
    return first_of(searched(candidates, replace(block, low=low)), block.most)


def blocks_of(anchors: DataFrame, most: int = ANCHORS_AT_ONCE) -> Iterator[list]:
    """Rows of ``anchors`` in blocks of ``most``: one block at a time is on the driver."""
    block: list = []
    for row in anchors.toLocalIterator(prefetchPartitions=False):
        block.append(row)
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def mined(
    vectors: DataFrame,
    is_anchor: Column,
    label: str | Column = "label",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    at_once: int = ANCHORS_AT_ONCE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for which ``is_anchor`` (of the table's own columns) holds. The first ``positives`` others of the
    same label are an anchor's positives, and for each of these the first ``negatives`` of other labels with ``low`` to
    ``high`` per cent of the positive's score are returned, by falling score and then rising id. A negative score has no
    such window. Rows with a null id, label or vector, or a null or non-finite component, take no part; a vector that is
    shorter than another counts as filled with zeros, an empty one scores 0. Rows with one id are rows each, but are never
    each other's positives; if an anchor's id is repeated, its rows are one search each. Scores above 2^53 raise an error. An
    empty table, or one without anchors, gives an empty result. Columns of other names are not read.
    """
    spark = vectors.sparkSession
    flagged = vectors.withColumn("_anchor_" + "_" * max(map(len, vectors.columns)), F.coalesce(is_anchor, F.lit(False)))
    flag = flagged.columns[-1]
    chosen = usable(flagged.where(F.col(flag)), vec_id, embedding, label)
    rows = usable(vectors, vec_id, embedding, label)
    # ranges of labels, so that most tasks have no row of an anchor's label or none of another; then by falling norm
    candidates = written(rows.repartitionByRange("label", F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), "vectors-by-norm")
    share = min(1.0, SEEDS / max(candidates.count(), 1))
    seeds = written(candidates.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "seeds")
    out = None
    for block in blocks_of(written(chosen.orderBy("vec_id"), "anchors"), at_once):
        ids, labels = (np.array([r[k] for r in block], np.int64) for k in (0, 1))
        width = max(len(r[2]) for r in block)
        matrix = np.zeros((len(block), width))
        for k, r in enumerate(block):
            matrix[k, : len(r[2])] = r[2]
        every = np.arange(len(block))
        open_ended = np.full(len(block), -EXACT), np.full(len(block), EXACT)
        near = best_of(candidates, seeds, Block(every, *open_ended, ids, labels, matrix, True, positives))
        pairs = sorted((r["window"], -r["score"], r["id"]) for r in near.select("window", "score", "id").collect())  # positives of a block
        if not pairs:
            continue
        anchor, score, positive = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        score = -score
        limits = -(-low * score // 100), high * score // 100
        far = best_of(candidates, seeds, Block(anchor, *(x.astype(float) for x in limits), ids, labels, matrix, False, negatives))
        columns = (range(len(anchor)), ids[anchor].tolist(), positive.tolist(), score.tolist())
        named = spark.createDataFrame(list(zip(*columns, strict=True)), "window bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        made = far.join(F.broadcast(named), "window").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        made = written(made, "negatives")
        out = made if out is None else out.union(made)
    if out is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return out
