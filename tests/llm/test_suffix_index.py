from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import queries, suffix_index
from tidegauge.llm.fill_middle import buffers_of

N = suffix_index.LENGTH


def plainly(texts):
    """Bytes, removed bytes, spans and what is left of each text, by counting every string."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + N] for r in raws for i in range(len(r) - N + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - N + 1):
            if seen[r[i : i + N]] > 1:
                gone[1 + i : 1 + i + N] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[1:-1]])
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), kept))
    return out


def letters(r, n, of="abcdefgh "):
    return "".join(r.choices(of, k=n))


def crossed(seed, n=60):
    """Texts made of shared passages of lengths about the limit, with other bytes around and edits within."""
    r = random.Random(seed)
    shared = [letters(r, k) for k in (150, 256, 300, 399, 400, 401, 520, 800, 1_500)]
    out = []
    for _ in range(n):
        text = letters(r, r.randrange(60))
        for _ in range(r.randrange(1, 5)):
            part = r.choice(shared)
            if r.random() < 0.5:
                part = part[r.randrange(60) : len(part) - r.randrange(60)]
            if r.random() < 0.3 and part:
                at = r.randrange(len(part))
                part = part[:at] + "é" + part[at + 1 :]
            text += part + letters(r, r.choice([0, 0, 1, 3, 40]))
        out.append(text)
    return out


def found_in(spark, stored, texts, **how):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = spark.read.parquet(stored(documents=docs.repartition(3)) + "/documents.parquet")
    rows = suffix_index.without_repeats(docs, **how).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for r in rows:
        spans = r["spans"] or []
        assert sum(s["end"] - s["start"] for s in spans) == r["n_removed"] and len(spans) == r["n_spans"]
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows]


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_every_string_counted(spark, stored, batches):
    texts = crossed(batches)
    wanted = plainly(texts)
    assert 0.3 < sum(w[1] for w in wanted) / sum(w[0] for w in wanted) < 0.95
    assert found_in(spark, stored, texts, batches=batches) == wanted


def test_periods_ties_and_odd_texts(spark, stored):
    r = random.Random(7)
    one = letters(r, 900)
    texts = [None, "", " \t\n", "x" * 399, "y" * 400, "z" * 401, "w" * 2_000, "ab" * 300, one, one, one[100:700], "é漢" * 200]
    texts += [one[:500] + letters(r, 300), letters(r, 300) + one[400:], letters(r, 399), letters(r, 5_000)]
    assert found_in(spark, stored, texts) == plainly(texts)


def test_one_passage_in_many_contexts(spark, stored):
    """A rank that many different runs share."""
    r = random.Random(8)
    passage = letters(r, 420)
    texts = [letters(r, 200) + passage[r.randrange(30) : 420 - r.randrange(30)] + letters(r, 200) for _ in range(150)]
    assert found_in(spark, stored, texts) == plainly(texts)


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_index, "PIECE", 700)
    r = random.Random(9)
    texts = [letters(r, n) for n in (0, 399, 400, 699, 700, 701, 1_100, 5_000)]
    raw, starts = buffers_of(pa.array(texts))
    seen = []
    for x in suffix_index.runs_of(raw, starts):
        for t, at, a, b in zip(x.text, x.at, x.first, x.last, strict=True):
            assert all(i <= at <= i + N - suffix_index.SHARED for i in (a, b))
            seen += [(int(t), i) for i in range(a, b + 1)]
    assert sorted(seen) == [(t, i) for t, text in enumerate(texts) for i in range(len(text) - N + 1)]


def test_levels_merge_geometrically_and_batches_find_what_one_finds(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(crossed(21, 40))], "file bigint, row bigint, text string")
    runs = suffix_index.suffixes(rows).cache()
    index = suffix_index.SuffixIndex(spark)
    sizes = []
    for k in range(7):
        index.add(runs.where(F.col("row") % 7 == k))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    whole = suffix_index.SuffixIndex(spark)
    whole.add(runs)
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    assert pairs(index.repeated()) == pairs(whole.repeated()) != []
    assert set(pairs(index.open_ranks())) >= set(pairs(whole.open_ranks())) != set()
    held = sum(level.where("n > 0").agg(F.sum("n")).first()[0] for _, level in index.levels)
    assert held == runs.count()
    ranks = [r["rank"] for r in index.levels[0][1].select("rank").collect()]
    assert ranks == sorted(ranks)  # a level is stored in order


def test_a_rank_at_the_edge_of_tasks(spark):
    """Runs of one rank that different tasks get are open all the same."""
    entries = spark.createDataFrame([(7, k, 1, True) for k in range(40)], "rank bigint, run bigint, n bigint, merging boolean")
    index = suffix_index.SuffixIndex(spark, found=[suffix_index.merge_scanned(entries)])
    assert [r["rank"] for r in index.open_ranks().collect()] == [7]
    two = spark.createDataFrame([(7, 1, 1, True), (8, 2, 1, True), (9, 3, 2, True)], entries.schema)
    index = suffix_index.SuffixIndex(spark, found=[suffix_index.merge_scanned(two)])
    assert index.open_ranks().collect() == []
    assert [tuple(r) for r in index.repeated().collect()] == [(9, 3)]


def test_odd_rows_clashing_names_and_empty_table(spark, odd_docs, no_docs, stored):
    more = odd_docs.withColumns({c: F.lit("x") for c in ("file", "row", "spans", "rank", "run", "batch", "kept")})
    found = suffix_index.without_repeats(more)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    rows = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in found.collect())
    source = odd_docs.collect()
    wanted = plainly([r["text"] for r in source])
    assert rows == sorted((repr(r["doc_id"]), w[0], w[1], w[3]) for r, w in zip(source, wanted, strict=True))
    assert suffix_index.without_repeats(no_docs).collect() == []
    made = queries.op13_suffix_dedup(spark, stored(documents=odd_docs))
    assert made.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(r["kept_sha256"] for r in made.collect()) == sorted(hashlib.sha256(w[3]).hexdigest() for w in wanted)
