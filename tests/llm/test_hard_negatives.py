from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import hard_negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plainly(rows, anchor=lambda i: i % 50 == 0):
    """The contract by all scores."""
    held = []
    for vec_id, v, label in rows:
        if None in (vec_id, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a, u, la in (h for h in held if anchor(h[0])):
        scored = [(-sum(x * y for x, y in zip(u, v, strict=False)), i, lb == la) for i, v, lb in held if i != a]
        for p, i, _ in sorted(x for x in scored if x[2])[:5]:
            others = sorted(x for x in scored if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p)
            out += [(a, i, k, j, -p, -n) for k, (n, j, _) in enumerate(others[:3], 1)]
    return sorted(out)


def found_in(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    made = hard_negatives.mined(df, F.col("vec_id") % 50 == 0, label, **how)
    return sorted(tuple(r) for r in made.collect())


def some_rows(n, seed, labels=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        size = r.choice([0.2, 1.0, 3.0])
        rows.append((i, [size * r.gauss(0.3, 1) for _ in range(6)], r.randrange(labels)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_give_the_same(spark, monkeypatch, seed):
    rows = some_rows(900, seed)
    wanted = plainly(rows)
    assert len(wanted) > 150
    assert found_in(spark, rows) == wanted
    # several blocks of anchors, small buckets and few seeds
    monkeypatch.setattr(hard_negatives, "SEEDS", 50)
    assert found_in(spark, rows, at_once=5) == wanted


def test_odd_rows_ties_and_one_hot_vector(spark):
    rows = some_rows(300, 5) + [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.25, 0.0], i % 2) for i in range(400)]
    rows += [(None, [1.0], 1), (2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")], 1), (2150, [float("inf")], 2)]
    rows += [(2200, [], 1), (2250, [1.0, 1.0], None), (2300, [1.0, 2.0], 1), (2350, [-1.0] * 6, 1), (2400, [1.0] * 9, 0)]
    wanted = plainly(rows)
    assert {r[0] for r in wanted} >= {1000, 2300, 2400}
    assert found_in(spark, rows) == wanted


def test_repeated_ids(spark):
    rows = some_rows(200, 9)
    twice = [*rows, *[(i, v, label) for i, v, label in rows if i % 11 == 3]]
    found = found_in(spark, twice)
    assert [r[4:] for r in found] == [r[4:] for r in plainly(twice)]


def test_empty_table_no_anchor_and_other_columns(spark):
    assert found_in(spark, []) == []
    assert found_in(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == []
    assert found_in(spark, [(0, [1.0], 0), (2, [1.0], 1)]) == []  # no positive
    rows = some_rows(120, 4)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "norm", "window", "score", "rank")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    made = hard_negatives.mined(df, F.col("vec_id") % 50 == 0, label)
    assert sorted(tuple(r) for r in made.collect()) == plainly(rows)


def test_scores_beyond_exact_doubles_are_refused(spark):
    rows = [(0, [1e12, 1.0], 1), (1, [1e12, 1.0], 1), (2, [1e12, 1.0], 2)]
    with pytest.raises(Exception, match="too large"):
        found_in(spark, rows)


def test_buckets_beyond_the_bound_are_not_scored(monkeypatch):
    one = np.array([0])
    block = hard_negatives.Block(one, np.array([100.0]), np.array([1e9]), np.array([0]), np.array([0]), np.array([[3.0, 4.0]]), False, 2)
    running = hard_negatives.Running(block)
    seen = []
    monkeypatch.setattr(hard_negatives.Running, "_take", lambda self, windows, scores, ids: seen.append(len(ids)))
    running.meet(np.array([1]), np.array([1]), 19.9, np.array([[0.0, 19.9]]))
    assert seen == []  # 5 * 19.9 is below the window
    running.meet(np.array([1]), np.array([1]), 20.0, np.array([[0.0, 20.0]]))
    assert seen == [1]
    running.score[0] = [200.0, 150.0]
    running.meet(np.array([1]), np.array([1]), 29.0, np.array([[0.0, 29.0]]))
    assert seen == [1]  # nor does it reach the second score
    running.meet(np.array([1]), np.array([0]), 40.0, np.array([[0.0, 40.0]]))
    assert seen == [1]  # the anchor's own label


def test_shorter_vectors_are_filled():
    lists = pa.array([[1.0], [], [2.0, 3.0, 4.0], [5.0]])[1:]
    assert hard_negatives.matrix_of(lists, 3).tolist() == [[0, 0, 0], [2, 3, 4], [5, 0, 0]]


def test_query_on_a_stored_table(spark, stored):
    rows = some_rows(200, 8, labels=10)
    folder = stored(embeddings=spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in queries.op12_hard_negatives(spark, folder).collect()) == plainly(rows)
