"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, line_dedup, mixing, near_dedup, packing, quality_rules, repair, spelling, toxicity, url_filter, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(hard)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_matches(_documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_quality_rules, op4_mixing, op5_warc, op6_near_dedup, op7_chat, op8_line_dedup, op9_url_filter, op10_packing, op11_repair, op12_spelling, op13_decontaminate)}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op7_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
            SELECT *, CAST(max(CAST(regexp_matches(text, '</?s>|\[/?INST') AS INT)) OVER (PARTITION BY conv_id) AS INT) AS level,
                   regexp_matches(text, '</?s>|\[/?INST') AS control FROM rows),
        shown AS (
            SELECT *, '<s>[INST' || CASE WHEN level = 1 AND control THEN '*' ELSE '' END || '] ' || role || chr(10)
                   || CASE WHEN level = 1 AND control THEN replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') ELSE text END
                   || ' [/INST]</s>' AS piece FROM marked)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(piece)) AS BIGINT) AS formatted_chars, max(level) AS level, true AS identical
        FROM shown GROUP BY conv_id""",
    "op13_decontaminate": r"""
        WITH split AS (
            SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        words AS MATERIALIZED (
            SELECT kind, id, row_number() OVER () AS r,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM split),
        item_windows AS MATERIALIZED (
            SELECT DISTINCT id AS item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win
            FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM words WHERE kind = 'i' AND len(w) > 0)),
        places AS (
            SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM words, (SELECT DISTINCT n FROM item_windows) WHERE kind = 'd' AND len(w) >= n)),
        hits AS MATERIALIZED (SELECT r, k, p.n, item_id FROM places p JOIN item_windows i ON p.win = i.win AND p.n = i.n),
        hit_words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
        SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r) WHERE kind = 'd'""",
}
