import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import mixing, packing, queries


def _brute_targets(sizes, weights, most=3):
    total, free, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w >= most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
            free.remove(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


@pytest.mark.parametrize("sizes", [[100, 10, 1], [5, 5, 5, 5], [1000, 1, 2, 3, 4], [0, 50, 10], [7], [0, 0]])
def test_targets_match_rounds_of_sharing(spark, sizes):
    weights = [k % 3 + 1 for k in range(len(sizes))]
    df = spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size bigint, weight bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(_brute_targets(sizes, weights))


def _docs(spark, n=600):
    r = random.Random(1)
    names = [None, "a", "b", "c", "hot"]
    rows = [(i, "w " * r.randint(0, 30), "en", "hot" if i % 2 else r.choice(names), 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_mix_comes_near_targets_and_agrees(spark, stored):
    folder = stored(documents=_docs(spark))
    out = queries.op8_mixing(spark, folder).collect()
    again = queries.op8_mixing(spark, folder).collect()
    assert len(out) == 600 and sorted(out) == sorted(again)
    by = {}
    for r in out:
        assert r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), rows in by.items():
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in out))


def test_positions_invert_the_demand(spark):
    df = spark.createDataFrame([(s, float(k)) for s in np.linspace(0, 1, 21).tolist() for k in (-1, -0.5, 0, 0.5, 1)], "share double, slope double")
    for r in df.select("share", "slope", mixing.invert_ramp(F.col("share"), F.col("slope")).alias("t")).collect():
        t = r.t if r.t is not None else 0.0
        assert (1 - r.slope) * t + r.slope * t * t == pytest.approx(r.share, abs=1e-9)


def test_curriculum_repeats_rows_in_order(spark, odd_docs, no_docs):
    docs = _docs(spark, 200)
    taken = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    rows = mixing.curriculum(docs)
    assert rows.columns == docs.columns
    got = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in taken.items() if v}
    clash = odd_docs.withColumnRenamed("n_chars", "size").withColumnRenamed("lang", "target")
    assert mixing.curriculum(clash).columns == clash.columns
    assert mixing.mixed(odd_docs).count() == odd_docs.count()
    assert mixing.curriculum(no_docs).count() == 0


def _brute_padding(lengths, counts, k):
    best = None
    for cut in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1):
        bounds = [*cut, lengths[-1]]
        pad = sum(c * (next(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
        best = pad if best is None else min(best, pad)
    return best


def test_boundaries_are_optimal():
    r = random.Random(2)
    for _ in range(40):
        lengths = sorted(r.sample(range(1, 60), r.randint(1, 9)))
        counts = [r.randint(1, 50) for _ in lengths]
        for k in (1, 2, 3, 5):
            bounds = packing.boundaries(np.array(lengths), np.array(counts), k)
            pad = sum(c * (next(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
            assert len(bounds) <= k and pad == _brute_padding(lengths, counts, k)


def test_batches_keep_budget_and_everything(spark, odd_docs, no_docs):
    docs = _docs(spark).unionByName(odd_docs)
    out = packing.packed(docs, context=64, buckets=4, budget=256).collect()
    words = sum(r.n for r in docs.select(mixing.word_count(F.col("text")).alias("n")).collect())
    assert sum(r.length for r in out) == words
    assert all(r.length <= r.bucket <= 64 and r.padding == r.bucket - r.length for r in out)
    by = {}
    for r in out:
        by.setdefault((r.bucket, r.batch), []).append(r.slot)
    assert all(len(v) * k[0] <= 256 and sorted(v) == list(range(len(v))) for k, v in by.items())
    for bucket in {k[0] for k in by}:  # all batches but the last are full
        fits = 256 // max(bucket, 1)
        batches = sorted(k[1] for k in by if k[0] == bucket)
        assert batches == list(range(len(batches))) and all(len(by[bucket, b]) == fits for b in batches[:-1])
    assert packing.packed(no_docs).count() == 0


def test_pieces_joined_are_the_texts(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(_docs(spark, 40).withColumn("doc_id", F.col("doc_id") + 100))
    rows = packing.packed(docs, context=16, buckets=4, budget=64).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, text in texts.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert "".join(r.text or "" for r in mine) == (text or "")
        assert all(len((r.text or "").encode().split()) == r.length and r.start == 16 * r.piece for r in mine)


def test_batches_follow_the_order_and_part_repeats(spark):
    r, rows = random.Random(4), []
    for i in range(1500):
        rows.append((r.randrange(1000), "w " * r.randint(1, 64), f"{i // 100:05}", f"{i:08}", i))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block string, at string, i int").repartition(7)
    out = packing.packed(docs, context=64, buckets=3, budget=256, order=("block", "at")).collect()
    assert len(out) == 1500
    place = {}
    for doc_id, text, _, _, i in rows:
        place.setdefault((doc_id, text), []).append(i)
    by, repeated = {}, {}
    for x in out:
        by.setdefault(x.bucket, []).append((x.batch, min(place[x.doc_id, x.text]), len(place[x.doc_id, x.text])))
        repeated.setdefault((x.bucket, x.doc_id, x.piece), []).append(x.batch)
    assert sum(len(v) > 1 for v in repeated.values()) > 100
    for key, batches in repeated.items():  # a stretch has 8 batches or more, or the bucket has no more
        assert len(set(batches)) == len(batches), key
    for found in by.values():  # stretches follow the order
        once = sorted((i, b // packing.SPREAD) for b, i, n in found if n == 1)
        last = max(s for _, s in once)
        stretch = [min(s, max(last - 1, 0)) for _, s in once]
        assert stretch == sorted(stretch)


def test_mixed_copies_are_packed_apart_in_training_order(spark, stored):
    import corpus_pipeline
    from tidegauge.llm.common import written

    docs = spark.read.parquet(f"{stored(documents=_docs(spark, 900))}/documents.parquet")
    mixed = written(corpus_pipeline.mix(spark, docs, ""), "mixed")
    out = corpus_pipeline.pack(spark, mixed, "").collect()
    copies = {}
    for x in out:
        copies.setdefault((x.doc_id, x.piece), []).append((x.bucket, x.batch))
    batches = {}
    for x in out:
        batches.setdefault(x.bucket, set()).add(x.batch)
    several = [v for v in copies.values() if len(v) > 1]
    assert several and all(len(set(v)) == min(len(v), len(batches[v[0][0]])) for v in several)
    assert sum(x.length for x in out) == sum(len((r.text or "").split()) for r in mixed.collect())


def test_packing_with_clashing_names(spark, odd_docs):
    names = ("piece", "start", "length", "bucket", "batch", "slot", "padding", "_n")
    more = odd_docs.withColumns({c: F.lit("x") for c in names})
    assert sorted(map(repr, packing.packed(more).collect())) == sorted(map(repr, packing.packed(odd_docs).collect()))
