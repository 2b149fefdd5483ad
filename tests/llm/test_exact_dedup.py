from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup, queries


def _brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    return {k: (max((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


def test_query_matches_brute_force(spark, odd_docs, stored):
    rows = odd_docs.collect()
    want = _brute(rows)
    folder = stored(documents=odd_docs)
    out = queries.op5_exact_dedup(spark, folder).collect()
    digest = {r.sha: r.text or "" for r in odd_docs.select("text", exact_dedup.sha256(F.col("text")).alias("sha")).collect()}
    assert len(out) == len(rows)
    for r in out:
        assert (r.keep_id, r.group_size) == want[digest[r.text_sha256]]
    kept = [r for r in out if r.kept]
    assert len(kept) == len(want) and {r.text_sha256 for r in kept} == set(digest)


def test_single_file_and_several_batches(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    df = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 90).cast("string").alias("text"))
    df.repartition(6).write.parquet(path)
    out = exact_dedup.exact_duplicates(spark, path, bytes_per_batch=1)
    assert out.where("kept").count() == 90
    assert out.agg(F.min("keep_id"), F.max("group_size")).first()[:] == (310, 5)
    df.coalesce(1).write.parquet(f"{path}2")
    (one,) = (f for f in tmp_path.joinpath("t.parquet2").glob("*.parquet"))
    assert exact_dedup.exact_duplicates(spark, f"file://{one}").where("kept").count() == 90


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, state = f"file://{tmp_path}/t", f"file://{tmp_path}/state"
    rows = lambda *ids: spark.createDataFrame([(i, "same") for i in ids], "doc_id bigint, text string")
    rows(1, 2).write.parquet(path)
    schema = rows(1).schema
    assert exact_dedup.digest_state(spark, path, schema, state_path=state).first().n == 2
    rows(9).write.mode("append").parquet(path)
    (r,) = exact_dedup.digest_state(spark, path, schema, state_path=state).collect()
    assert (r.n, r.keep.doc_id) == (3, 9)


def test_colliding_digests_are_told_apart_by_bytes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 20).alias("text"))
    df.write.parquet(path)
    weak = lambda body: F.substring(exact_dedup.sha256(body), 1, 1)
    out = exact_dedup.exact_duplicates(spark, path, digest=weak)
    assert out.count() == 60
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out.collect()} == {(i, i % 20 + 40, 3) for i in range(60)}
    assert out.where("kept").count() == 20


def test_rows_that_stay(odd_docs, no_docs):
    clash = odd_docs.withColumnRenamed("source", "digest").withColumnRenamed("lang", "_place")
    left = exact_dedup.without_copies(clash)
    assert left.columns == clash.columns and left.count() == odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_dedup.without_copies(no_docs).count() == 0
