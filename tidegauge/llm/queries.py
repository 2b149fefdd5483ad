"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_snapshots,
    exact_dedup,
    fill_middle,
    hard_negatives,
    language_id,
    mixing,
    packing,
    passages,
    pu_quality,
    quality_rules,
    simhash,
    suffix_index,
    token_counts,
)
from .common import documents, id_crc, labels, written

#: Labelled documents that the classifier is fitted on, about.
MOST_LABELLED = 8_000
#: Vocabulary of ranks of a public tokenizer; the same path on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", "lang", (id_crc("doc_id") % 3 == 1).alias("held_out")
    )
    profiles = language_id.prototypes(docs.where("not held_out"))
    return language_id.identify(docs, profiles, ("doc_id", "held_out"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(documents(spark, sf_dir), VOCABULARY)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality_rules.fit(docs, labels(spark, sf_dir))
    return quality_rules.judged(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mixed(documents(spark, sf_dir))
    first = F.when(F.col("copies") > 0, F.round(mixing.position(F.lit(0)), 6))
    return chosen.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        first.alias("first_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = written(passages.repeated_passages(documents(spark, sf_dir)), "passage-links")
    return passages.passage_classes(links)


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_crc("doc_id") % 5 == 0
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out.alias("held_out"))
    seen = written(quality_rules.with_stats(docs, ("doc_id", "held_out")), "pu-stats")
    known = labels(spark, sf_dir).where(~held_out)
    labelled = quality_rules.labelled_stats(docs.where("not held_out"), known, "quality", MOST_LABELLED, pu_quality.USED)
    model = pu_quality.fit_stats(seen.where("not held_out"), labelled)
    scored = pu_quality.scored(seen, model, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.with_restored(fill_middle.transformed(documents(spark, sf_dir)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(vectors, F.col("vec_id") % 50 == 0, label)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_index.without_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_passages": op9_passages,
    "op10_pu_quality": op10_pu_quality,
    "op11_fill_middle": op11_fill_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL = {
    "op4_chat": """
        WITH c AS (
            SELECT conv_id, count(*) AS n,
                   list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns
            FROM conversations GROUP BY conv_id
        )
        SELECT conv_id, 0::BIGINT AS part, n AS n_turns,
               array_to_string(list_transform(turns, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || chr(10)), '') AS chat
        FROM c
        WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.turns[1] = c.turns[1] AND b.n > c.n AND b.turns[1:c.n] = c.turns)
    """,
    "op5_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5(doc_id::VARCHAR) AS k,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
            FROM d GROUP BY source
        ), r AS (
            SELECT *, 3 * source_size / weight AS per_weight, sum(source_size) OVER () AS everything,
                   sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights,
                   coalesce(sum(3 * source_size) OVER o, 0) AS room_before
            FROM s
            WINDOW o AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), f AS (
            SELECT *, ((everything - room_before)::DOUBLE / weights) AS level,
                   ((everything - room_before)::DOUBLE / weights) >= per_weight AS is_full
            FROM r
        ), t AS (
            SELECT source, source_size, (weight - 2) / 2 AS slope,
                   CASE WHEN is_full THEN (3 * source_size)::DOUBLE
                        ELSE weight * (SELECT arg_min(level, per_weight) FROM f WHERE NOT is_full) END AS target
            FROM f
        ), p AS (
            SELECT d.*, source_size, target, slope,
                   (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), c AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)
                + (floor(target / source_size) * source_size + before + size / 2 < target)::INT ELSE 0 END::BIGINT AS copies,
                least(1.0::DOUBLE, (before + size / 2) / target) AS share
            FROM p
        )
        SELECT doc_id, size, source_size, target, copies * size AS taken,
               CASE WHEN copies > 0
                    THEN round(2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)), 6) END AS first_position
        FROM c
    """,
    "op11_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
            FROM documents
        ), k AS (
            SELECT doc_id, text, u, len(u)::BIGINT AS n,
                   ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                        WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT doc_id, text, n, form,
                   coalesce(array_to_string(u[1:least(x, y)], ''), '') AS prefix,
                   coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS middle,
                   coalesce(array_to_string(u[greatest(x, y) + 1:n], ''), '') AS suffix
            FROM k
        )
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
            FROM e AS a, e WHERE a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 3
    """,
    "op13_suffix_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
        ), w AS (
            SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400
        ), k AS (
            SELECT r, i, md5(array_slice(b, i, i + 399)) AS string FROM w
        ), m AS (
            SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY string) > 1
        ), n AS (
            SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 400)::INT AS new FROM m
        ), g AS (
            SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM n
        ), s AS (
            SELECT r, span, min(i) AS a, max(i) + 399 AS z FROM g GROUP BY ALL
        ), l AS (
            SELECT r, count(*) AS n_spans, sum(z - a + 1)::BIGINT AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM s GROUP BY r
        )
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               CASE WHEN n_spans IS NULL THEN sha256(b)
                    ELSE sha256(unhex(array_to_string(list_transform(
                             list_zip(list_prepend(1, list_transform(z, lambda x: x + 1)), list_append(list_transform(a, lambda x: x - 1), octet_length(b)::BIGINT)),
                             lambda x: hex(array_slice(b, x[1], x[2]))), ''))) END AS kept_sha256
        FROM d LEFT JOIN l USING (r)
    """,
}
