"""The queries registered for the training-data operators: each derives its contract's columns from an operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.llm.common import for_workers, table, unsigned_hex
from supplyscope.llm.decontaminate import find_benchmark
from supplyscope.llm.filter_audit import audit_filters
from supplyscope.llm.hard_negatives import mine_hard_negatives
from supplyscope.llm.line_dedup import line_classes
from supplyscope.llm.mixing import mix
from supplyscope.llm.packing import pack
from supplyscope.llm.quality import quality_verdicts
from supplyscope.llm.secret_scan import scan_secrets
from supplyscope.llm.simhash import simhash_components
from supplyscope.llm.token_store import write_tokens
from supplyscope.llm.substring_dedup import remove_repeats
from supplyscope.llm.toxicity import held_out, score, train
from supplyscope.llm.warc import read_warc, write_warc


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the benchmark items it holds."""
    docs = table(spark, sf_dir, "documents")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id"), "item_ids", "cosine", "cover")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    merged = found.groupBy("found_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
                                           F.max("cosine").alias("cosine"), F.max("cover").alias("cover"))
    return ids.join(merged, ids["doc_id"].eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", F.col("cover").isNotNull().alias("contaminated"), "item_ids", "cosine", "cover")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines that go, the class of each, and the document that keeps the line of that class."""
    docs = table(spark, sf_dir, "documents")
    gone = F.when(~F.col("kept"), F.struct("line_no", "class_id", "first_doc"))
    lines = line_classes(docs).groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_lines"), F.array_sort(F.collect_list(gone)).alias("gone")).select(F.col("doc_id").alias("line_doc"), F.col("text_hash").alias("line_hash"), "n_lines", "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    out = rows.join(lines, F.col("doc_id").eqNullSafe(F.col("line_doc")) & (F.col("h") == F.col("line_hash")), "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                      F.col("gone.line_no").alias("removed_lines"), F.col("gone.class_id").alias("removed_classes"), F.col("gone.first_doc").alias("kept_in"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    store = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return store.read_all(docs.select("doc_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and behind them whether anything goes from the document."""
    return remove_repeats(table(spark, sf_dir, "documents"), least=400).withColumn("repeats", F.col("n_removed") > 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: for_workers(f) for f in (
    op1_toxicity, op2_decontamination, op3_secret_scan, op4_line_dedup, op5_quality_rules, op6_warc, op7_token_store, op8_simhash, op9_substring_dedup, op10_mixing,
    op11_filter_audit, op12_hard_negatives, op13_packing)}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        r AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
        FROM r""",
    "op11_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
        b AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS bits FROM w),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY part, bits),
        f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (SELECT f1.letter || f2.letter || f3.letter || f4.letter || f5.letter AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bit
                   FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31),
        steps AS (SELECT filter_order, step, bit[step] AS own, coalesce(list_sum(bit[1:step - 1]), 0)::BIGINT AS earlier FROM orders, range(1, 6) r(step)),
        counted AS (SELECT part, filter_order, step, own,
                      sum(CASE WHEN bits & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
                      sum(CASE WHEN bits & earlier = 0 AND bits & own != 0 THEN n ELSE 0 END) AS removed,
                      sum(CASE WHEN bits & earlier != 0 AND bits & own != 0 THEN n ELSE 0 END) AS redundant,
                      sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
                      sum(CASE WHEN bits & earlier = 0 AND bits & own != 0 THEN good ELSE 0 END) AS good_lost,
                      sum(CASE WHEN bits & earlier = 0 AND bits & own != 0 THEN toxic ELSE 0 END) AS toxic_lost
                    FROM c, steps GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted""",
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
              FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id != b.vec_id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
        QUALIFY row_number() OVER w <= 5""",
}
