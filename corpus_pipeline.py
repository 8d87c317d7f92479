"""The corpus pipeline: documents of low quality go, then toxic ones, then all but one of each group of near-duplicates; the rest is packed.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it. The two classifiers are
trained on the labelled part of the tables in ``sf_dir``, so a stage's decisions don't depend on what
earlier stages removed. All but the last stage return the columns of ``docs`` unchanged, whatever their names beside doc_id and text.

Odd rows: a null text counts as an empty one in every stage and is judged by its score like any other; texts of any length are read whole;
rows that repeat, share an id or have none are judged each by itself, and the near-duplicate stage keeps one of each group of them; equal
scores get equal decisions, and between copies the smallest id stays; an empty table gives no rows in every stage.

Memory: a stage's rows are written by its caller, and Parquet keeps a row group of 128 MB a core in the heap, when it writes and when the next
stage reads. So the stages that return texts set ``parquet.block.size`` of the session to 16 MB, unless somebody has set it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm.common import bound_row_groups, materialize, read
from ledgerframe.llm.minhash import near_duplicates
from ledgerframe.llm.packing import pack
from ledgerframe.llm.quality import quality_scores, train_quality
from ledgerframe.llm.toxicity import toxicity_scores, train_toxicity


#: So many dropped keys, eight bytes each, are sent to all executors.
BROADCAST_KEYS = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a quality score of 0.5 or more, each row by itself; null and empty texts have a score too."""
    forest = train_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return _kept(docs, quality_scores, forest, F.col("score") >= 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a toxicity score under 0.3, each row by itself; null and empty texts have a score too."""
    net = train_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return _kept(docs, toxicity_scores, net, F.col("score") < 0.3)


def _kept(docs: DataFrame, scores, model, rule) -> DataFrame:
    """The rows that a score keeps. All columns pass through the scoring itself, so nothing is joined back."""
    bound_row_groups(docs)
    own = docs.columns
    inner = [n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(own)]
    found = scores(docs.toDF(*inner), model, carry=tuple(n for n in inner if n != "doc_id")).where(rule)
    return found.select(*(F.col(i).alias(n) for i, n in zip(inner, own)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, the one with the smallest id; rows without an id come last.

    Every row is a document of its own, under a key written with the stage's input, whatever its id: repeated rows and rows without
    an id fall into groups too, and of rows that share an id only copies go. Among equal ids the text's hash decides.
    """
    bound_row_groups(docs)
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    found = materialize(near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id"))
    order = keyed.select(key, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), F.col(key).alias("key")).alias("order"))
    first = found.join(order, key).groupBy("component_id").agg(F.min("order").alias("order")).select(F.col("order.key").alias(key))
    dropped = materialize(found.select(key).join(first, key, "left_anti"))
    # Keys alone travel to the rows; only beyond a counted size are the whole rows shuffled to meet them.
    few = dropped.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return keyed.join(F.broadcast(dropped) if few else dropped.hint("merge"), key, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 2048 tokens; a null or empty text is a piece of one token, each row a document."""
    # A worker that has run the stages before has less room than one of a packing by itself, so it remembers fewer words.
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=100_000)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", dedup_stage), ("packing", packing_stage)]

#: Trained models and the packing search are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
