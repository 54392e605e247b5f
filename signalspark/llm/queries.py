"""The queries of this subpackage for ``__spark_entry__.py``: each applies one operator, with the parameters
meant for production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm import chat_format, decontamination, fill_middle, language_id, license_scan, lm_scoring, mixing, ngram_join, secret_scan, simhash, token_counts, topk_search, whitening
from signalspark.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("doc_key")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


#: The conversation that holds the template's own marks.
MARKS = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame([(-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS)], "conv_id long, turn long, role string, text string")
    messages = rows.unionByName(marks).select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    return chat_format.digests(chat_format.read_back(chat_format.format_conversations(messages)))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = language_id.remainder(F.col("doc_id"), 7) == 2
    return lm_scoring.score(table(spark, sf_dir, "documents"), held_out, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    part = language_id.remainder(F.col("doc_id"), 3)
    profiles = language_id.learn(documents, language_id.remainder(F.col("i"), 3) != 1)
    found = language_id.predict(documents, profiles)
    return found.select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_benchmark_decontamination, op3_license_scan, op4_simhash_dedup, op5_chat_format, op6_lm_scoring, op7_language_id, op8_mixing,
        op9_topk_search, op10_secret_scan, op11_ngram_jaccard_join, op12_embedding_whitening, op13_fill_in_middle,
    )
}

ORACLES: dict[str, str] = {
    "op3_license_scan": license_scan.duckdb_sql(),
    "op13_fill_in_middle": fill_middle.duckdb_sql(),
    "op5_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
shown AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
            + length('<|im_start|>') + length('<|im_sep|>') + length('<|im_end|>') + 1 AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       cast(sum(chars) AS bigint) AS formatted_chars,
       cast(sum(ceil(length(text) / 4)) AS bigint) AS n_tokens,
       cast(0 AS bigint) AS n_attachments
FROM shown GROUP BY conv_id
""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), text, '')), 1, 15) AS bigint) AS h
  FROM documents),
s AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0::double, 2.0::double, 1.0::double][(k - 1) % 3 + 1] AS w, 2.0::double * source_size AS full_size FROM s),
a AS (SELECT *, full_size / w AS fits FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::double - coalesce(sum(full_size) OVER before, 0))
            / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER before, 0)) AS level
  FROM a WINDOW before AS (ORDER BY fits, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(full_size, (SELECT arg_min(level, (fits, k)) FROM l WHERE level <= fits) * w) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT g.*, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (
  SELECT c.source, CASE WHEN c.size - (b.target - b.base * b.source_size - (c.upto - c.size)) < b.target - b.base * b.source_size - (c.upto - c.size)
                        THEN c.h + 1 ELSE c.h END AS under
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
  WHERE c.upto - c.size < b.target - b.base * b.source_size AND b.target - b.base * b.source_size <= c.upto AND b.target - b.base * b.source_size > 0)
SELECT d.doc_id, d.size, b.source_size, b.target,
       cast(d.size * (b.base + CASE WHEN b.target - b.base * b.source_size > 0 AND d.h < coalesce(e.under, 1152921504606846976) THEN 1 ELSE 0 END) AS bigint) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
""",
    "op9_topk_search": r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.v, c.v) AS bigint) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}
