from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm.common import written
from .conftest import words


def _tables(spark):
    good = {i: words(60, i) for i in range(60)}
    good[70] = good[1]
    good[71] = good[2].upper()
    junk = {100 + i: " ".join(f"#{w}%" for w in words(60, 600 + i).split()) for i in range(30)}
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in (good | junk).items()] + [(200, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in [*good, *junk]], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_stages_on_a_small_corpus(spark, stored):
    docs, labels = _tables(spark)
    folder = stored(documents=docs, labels=labels)
    seen, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, folder), name)
        assert now.columns == docs.columns
        seen[name] = [r.doc_id for r in now.collect()]
    assert set(seen["quality_rules"]) == {*range(60), 70, 71}
    assert set(seen["exact_dedup"]) == {*range(60), 70, 71} - {1}
    assert set(seen["simhash_near_dedup"]) == {*range(60), 70} - {1}
    assert set(seen["mixing"]) <= set(seen["simhash_near_dedup"])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in packed) == 60 * len(seen["mixing"])
    assert {r.doc_id for r in packed} == set(seen["mixing"])


def test_near_copies_go_by_the_similarity_of_texts(spark):
    texts = {}
    for g in range(30):
        a = words(120, 900 + g).split()
        b, c = a.copy(), a.copy()
        b[30], b[60] = "edited", "there"
        for k in range(5, 115, 10):
            c[k] = "other"
        texts |= {3 * g + i: " ".join(w) for i, w in enumerate((a, b, c))}
    texts |= {90: None, 91: " \t", 92: "few words", 93: "Few  Words", 94: "few other"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    stay = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert stay == {i for i in range(90) if i % 3 != 1} | {90, 92, 94}


def test_empty_tables(spark, stored):
    docs, labels = _tables(spark)
    folder = stored(documents=docs.limit(0), labels=labels.limit(0))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_odd_rows_and_clashing_names_go_through(spark, stored, odd_docs):
    docs, labels = _tables(spark)
    extra = {"lang": "bucket", "n_chars": "place"}
    more = odd_docs.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(docs).withColumnsRenamed(extra)
    folder = stored(documents=more, labels=labels)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, folder), name)
        assert now.columns == more.columns
    kept = {r.doc_id: r.text for r in now.collect()}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == set(kept)
    for i, text in kept.items():
        copies = sum(r.piece == 0 for r in out if r.doc_id == i)
        assert sum(r.length for r in out if r.doc_id == i) == copies * len((text or "").split())


def test_a_very_long_text_and_null_ids_are_packed_whole(spark):
    rows = [(6, words(60_000, 1)), (None, words(50, 3)), (None, words(50, 3)), (None, None), (7, "")]
    docs = written(spark.createDataFrame(rows, "doc_id bigint, text string"), "docs")
    out = corpus_pipeline.pack(spark, docs, "").collect()
    long = sorted((r for r in out if r.doc_id == 6), key=lambda r: r.piece)
    assert len(long) == 30 and "".join(r.text for r in long) == rows[0][1]
    assert sorted(r.length for r in out if r.doc_id is None) == [0, 50, 50] and len(out) == 34


def test_stages_send_small_batches_of_texts_to_python(spark, monkeypatch):
    """Workers keep what a batch took, so no stage sends them thousands of texts at a time."""
    import pyarrow as pa

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    counted = lambda docs, *a, **b: docs.select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [x.num_rows]}) for x in bs), "n long")
    docs = written(spark.range(4_000).select("id", F.lit("some text").alias("text")).coalesce(1), "many")
    monkeypatch.setattr(corpus_pipeline.quality_rules, "fit", lambda *a: [])
    monkeypatch.setattr(corpus_pipeline, "labels", lambda *a: None)
    for module, name, stage in ((corpus_pipeline.quality_rules, "passing", 0), (corpus_pipeline.simhash, "without_near_copies", 2), (corpus_pipeline.packing, "packed", 4)):
        monkeypatch.setattr(module, name, counted)
        spark.conf.unset(size)
        try:
            sizes = [r.n for r in corpus_pipeline.STAGES[stage][1](spark, docs, "").collect()]
        finally:
            spark.conf.unset(size)
        assert sum(sizes) == 4_000 and max(sizes) <= 1_000, (name, sizes)
