"""Streams over several files give what a batch gives, and state survives a restart."""

from __future__ import annotations

import datetime as dt

from tidegauge.streaming import claims
from tidegauge.streaming import events as streams

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def rows(k):
    start = dt.datetime(2024, 1, 1, k)
    return [(k * 10 + i, start + dt.timedelta(minutes=20 * i), i % 2, "ab"[i % 2], float(i)) for i in range(6)]


def put(spark, folder, k):
    spark.createDataFrame(rows(k), SCHEMA).write.mode("append").parquet(folder)


def test_windows_over_two_runs(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, source, 0)
    schema = spark.read.parquet(source).schema
    run = lambda: streams.run_to_end(streams.window_totals(streams.file_stream(spark, source, schema)), out)
    assert sum(r.n for r in run().collect()) == 6
    put(spark, source, 1)
    wanted = {tuple(r) for r in streams.window_totals(spark.read.parquet(source)).collect()}
    assert {tuple(r) for r in run().collect()} == wanted and sum(r[2] for r in wanted) == 12


def test_claims_are_taken_once(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, source, 0)
    schema = spark.read.parquet(source).schema
    run = lambda: streams.run_to_end(streams.claimed_once(streams.file_stream(spark, source, schema), ["user_id", "event_type"]).select("user_id", "event_type"), out, "append")
    assert run().count() == 2
    put(spark, source, 1)
    assert run().count() == 2  # the second run knows what the first one claimed


def test_sessions(spark):
    got = {(r.user_id, r.n) for r in streams.sessions(spark.createDataFrame(rows(0) + rows(9), SCHEMA), gap="1 hour").collect()}
    assert got == {(0, 3), (1, 3)}


def test_claims_over_files_of_many_months_in_no_order(spark, tmp_path):
    """Each key has one claim, however far apart its files are and however often the stream is started."""
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    keys, start = ["user_id", "event_type"], dt.datetime(2024, 1, 1)
    wanted, looks = {}, {}
    for run, months in enumerate(([7, 7, 1], [0, 12], [3])):
        for month in months:
            made = [(run * 1000 + month * 10 + i, start + dt.timedelta(days=30 * month, minutes=i), i % 3, "ab"[i % 2], 1.0) for i in range(6)]
            made += [(None, start, 1, "a", 1.0), (5, None, 1, "a", 1.0), (5, start, None, "a", 1.0)]
            spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            for i, at, user, kind, _ in made[:6]:
                looks[user, kind] = looks.get((user, kind), 0) + 1
        stream = streams.file_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
        found = claims.claimed(stream, keys, "ts", "event_id", out)
        rows_ = found.collect()
        held = [(r.user_id, r.event_type) for r in rows_ if r.claimed_at is not None]
        assert sorted(held) == sorted(looks) and len(set(held)) == len(held)
        holders = {(r.user_id, r.event_type): (r.claimed_at, r.claimed_by, r.looks) for r in claims.holders(found, keys).collect()}
        assert {k: v[2] for k, v in holders.items()} == looks
        wanted = wanted or {k: v[:2] for k, v in holders.items()}
        assert {k: v[:2] for k, v in holders.items()} == wanted  # later files, also of earlier days, do not take a claim away
        for r in rows_:
            assert r.looks_before == 0 if r.claimed_at is not None else r.looks_before > 0


def test_claims_read_plain_rows_and_the_state_once():
    """No table is made for each key, and state is asked for once a key and batch."""
    from pyspark.sql import Row

    class State:
        held, asked = None, 0

        def get(self):
            self.asked += 1
            return self.held

        def update(self, value):
            self.held = value

    one = claims.Claims(["user_id", "event_type"])
    one.state = State()
    seen = [Row(user_id=1, event_type="a", at=at, id=i) for at, i in ((9, 1), (4, 7), (4, 3))]
    run = lambda rows: [r.asDict() for r in one.handleInputRows((1, "a"), iter(rows), None)]
    key = {"user_id": 1, "event_type": "a"}
    assert run(seen) == [key | {"claimed_at": 4, "claimed_by": 3, "looks_before": 0, "looks": 3}]
    assert run([Row(user_id=1, event_type="a", at=1, id=0)]) == [key | {"claimed_at": None, "claimed_by": None, "looks_before": 3, "looks": 1}]
    assert one.state.asked == 2
