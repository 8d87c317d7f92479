"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .chat import digest_conversations
from .common import crc_of_id, read
from .flac import media_digest
from .htmltext import main_text
from .minhash import near_duplicates
from .packing import pack
from .quality import quality_scores, train_quality
from .topk import topk_search
from .toxicity import toxicity_scores, train_toxicity
from .urlfilter import DEFAULT_ENTRIES, default_entries, judge


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return topk_search(table, table.where(F.col("vec_id") % 100 == 0), k=10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(read(spark, sf_dir, "documents"))


def op4_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return pack(read(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"), remember=600_000)


def _scored(scores: DataFrame, fold: int, held: int, cut: float) -> DataFrame:
    out = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(fold)) == held, F.lit(False))
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _scored(quality_scores(docs, train_quality(docs, read(spark, sf_dir, "labels"), fold=3, held=1)), 3, 1, 0.5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _scored(toxicity_scores(docs, train_toxicity(docs, read(spark, sf_dir, "labels"), fold=4, held=2)), 4, 2, 0.3)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return round_trip(read(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts are made of other templates' control strings."""
    trap = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    table = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digest_conversations(table.unionByName(more))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, and of each a copy in its host's archive, under a deep path in mixed case, with the id -1 - page_id.

    The tables hold no fetch time, so page n and its copy count as fetched n mod 366 days after 2024-01-01.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    host = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    copy = F.concat(host, F.lit("/Archive/2024/Q"), F.pmod("page_id", F.lit(4)), F.lit("/en/pages/"), F.col("page_id"))
    both = pages.withColumn("c", F.explode(F.array(F.struct("page_id", "url"), F.struct((-1 - F.col("page_id")).alias("page_id"), copy.alias("url")))))
    return judge(both.select("c.page_id", "c.url", "fetched"), default_entries(spark))


OP9_SQL = f"""
WITH entries(list, pattern, action, day) AS (VALUES
  {", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in DEFAULT_ENTRIES)}
), days AS (
  SELECT list, lower(split_part(pattern, '/', 1)) || regexp_replace(regexp_replace(pattern, '^[^/]*', ''), '/+$', '') AS pattern, day, max(action) AS action
  FROM entries WHERE NOT starts_with(pattern, '/') GROUP BY ALL
), turns AS (
  SELECT *, lag(action) OVER (PARTITION BY list, pattern ORDER BY day) AS was FROM days
), spans AS (
  SELECT list, pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to
  FROM turns WHERE coalesce(was, 'remove') <> action
), c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day FROM pages
  UNION ALL SELECT -1 - page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/Archive/2024/Q' || page_id % 4 || '/en/pages/' || page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) FROM pages
), p AS (
  SELECT page_id, day, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM c
), h AS (
  SELECT page_id, list, pattern FROM p JOIN spans ON action = 'add' AND day >= valid_from AND (valid_to IS NULL OR day < valid_to)
  AND (host = pattern OR ends_with(host, '.' || pattern) OR starts_with(host || path || '/', pattern || '/') AND contains(pattern, '/'))
)
SELECT p.page_id, count(h.list) > 0 AS blocked,
       coalesce(string_agg(DISTINCT h.list, ',' ORDER BY h.list), '') AS lists,
       coalesce(string_agg(DISTINCT h.pattern, ',' ORDER BY h.pattern), '') AS patterns
FROM p LEFT JOIN h USING (page_id) GROUP BY p.page_id
"""

OP8_SQL = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(21 + length(role) + length(text)
         + length(text) - length(regexp_replace(text, '[\\\\<\\[\\]]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def queries() -> dict:
    return {"op1_topk_search": op1_topk_search, "op2_flac": op2_flac, "op3_best_fit_packing": op3_best_fit_packing, "op4_html_consensus": op4_html_consensus, "op5_quality": op5_quality, "op6_byte_bpe": op6_byte_bpe, "op7_minhash_dedup": op7_minhash_dedup, "op8_chat_format": op8_chat_format, "op9_url_filter": op9_url_filter, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op8_chat_format": OP8_SQL, "op9_url_filter": OP9_SQL}
