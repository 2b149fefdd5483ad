"""Claims that are taken once and looks that are counted, as keyed state without an end.

A notification is sent by the first that claims its key; a look at held-out data is counted for its key. Both have to hold
for ever, across restarts and files in any order of time, so there is no watermark: state is on disk, a few bytes a key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import run_to_end

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
#: Beside the keys: the claim (null if it was taken in an earlier batch), looks before this batch, and looks in it.
RESULT = "claimed_at bigint, claimed_by bigint, looks_before bigint, looks bigint"


class Claims(StatefulProcessor):
    """One claim and one counter per key. A key's rows pass by one by one; of a batch that takes the claim the earliest row has it."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("claim", "looks bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        best, n = None, 0
        for row in rows:
            n += 1
            mine = (row["at"], row["id"])
            best = mine if best is None else min(best, mine)
        held = self.state.get()
        before = int(held[0]) if held else 0
        if n:
            self.state.update((before + n,))
            claim = best if before == 0 else (None, None)
            yield Row(**dict(zip(self.keys, key, strict=True)), claimed_at=claim[0], claimed_by=claim[1], looks_before=before, looks=n)

    def close(self) -> None:
        pass


def claims(events: DataFrame, keys: list[str], at: str, row_id: str) -> DataFrame:
    """``keys``, ``claimed_at``, ``claimed_by``, ``looks_before`` and ``looks`` of a stream: a row per key and batch.

    A key is claimed in the first batch that has it, by its earliest row there (``at``, then ``row_id``); later batches only count.
    Rows with a null time, id or key have no claim. Times are microseconds since 1970 in the result.
    """
    taken = events.select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(row_id).cast("bigint").alias("id")).dropna()
    kinds = ", ".join(f"`{k}` {t}" for k, t in taken.dtypes[: len(keys)])
    return taken.groupBy(*keys).transformWithState(Claims(keys), outputStructType=f"{kinds}, {RESULT}", outputMode="Append", timeMode="None")


def claimed(events: DataFrame, keys: list[str], at: str, row_id: str, folder: str) -> DataFrame:
    """Runs ``claims`` over what the stream's source holds now; state, progress and all results so far are in ``folder``.

    A run that is lost, or stopped between files, goes on from there with the next call: a batch's results are replaced, not added.
    """
    spark = events.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        return run_to_end(claims(events, keys, at, row_id), folder, "append")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def holders(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``claimed_at``, ``claimed_by`` and ``looks`` (all so far) from the rows of ``claimed``: one row per key."""
    return found.groupBy(*keys).agg(F.max("claimed_at").alias("claimed_at"), F.max("claimed_by").alias("claimed_by"), F.sum("looks").alias("looks"))
