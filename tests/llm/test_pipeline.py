"""The pipeline against its brute-force version: plain scoring, all pairs, and the pieces of what is left."""

import os
import random
import re
import subprocess
import sys

import numpy as np
import public_tokenizers as public
import pyarrow.dataset
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerframe.llm import common, quality, toxicity

from .test_classifiers import DOCS, LABELS, corpus
from .test_minhash import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = corpus(400)
    rng = random.Random(5)
    for i in range(60):
        words = docs[i][1].split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        docs.append((1000 + i, " ".join(words), docs[i][2], "copy"))
    docs += [(2000, None, "en", ""), (2001, "", "en", ""), (2002, docs[0][1], "en", "")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path, docs


def test_stages_equal_brute_force(spark, folder):
    path, docs = folder
    frame, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    forest, net = quality.train_quality(frame, labels), toxicity.train_toxicity(frame, labels)
    good = [d for d in docs if forest.score(quality.statistics(d[1])[None, :])[0] >= 0.5]
    clean = [d for d, s in zip(good, toxicity.Scorer(net).score([d[1] for d in good])) if s < 0.3]
    comp = brute([d[:2] for d in clean])
    left = {d[0]: d[1] for d in clean if comp[d[0]][1] == d[0]}
    assert len(docs) > len(good) > len(clean) > len(left) > 50

    now, expect = frame, (good, clean, [d for d in clean if d[0] in left])
    for (_, stage), want in zip(corpus_pipeline.STAGES, expect):
        now = stage(spark, now, path)
        assert now.columns == frame.columns
        assert sorted(map(tuple, now.collect()), key=str) == sorted(map(tuple, want), key=str)
    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    sizes = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    rows = corpus_pipeline.run(spark, path).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes
    fill = np.bincount([r.sequence_id for r in rows], [r.length for r in rows])
    assert fill.max() <= 2048


def test_an_empty_table_goes_through(spark, folder):
    path, _ = folder
    now = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, path)
        assert now.count() == 0


def test_rows_are_told_apart_without_unique_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    a, b, c, d = map(text, "abcd")
    rows = [
        (1, a, "en", ""), (1, a, "en", ""),  # repeated row: one stays
        (None, b, "en", ""), (None, b, "en", ""),  # copies without an id: one stays
        (5, a, "en", ""), (5, c, "en", ""),  # one id, two texts: only the copy of a goes
        (None, d, "en", ""), (9, d, "en", ""),  # the row with an id stays
        (None, None, "en", ""), (None, None, "en", ""),  # no text: both stay
    ]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = corpus_pipeline.dedup_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = [rows[0], rows[2], rows[5], rows[7], rows[8], rows[9]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_clashing_names_and_odd_rows_go_through_all_stages(spark, folder, tmp_path):
    """Columns named like those that stages make, null and empty texts, repeated rows and a very long text."""
    path, docs = folder
    rows = [(d[0], d[1], 0.5, "s", i, "c") for i, d in enumerate(docs[:120])] + [(docs[0][0], docs[0][1], 0.5, "s", 0, "c"), (7000, None, None, None, None, None), (7001, "", 1.0, "", 1, ""), (7002, docs[1][1] + " " + " ".join(f"w{i}" for i in range(30_000)) + ".", 1.0, "", 1, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, component_id string, length int, _row_key string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {(r.doc_id, r.text, r.length) for r in now.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert now.columns == frame.columns
        after = {(r.doc_id, r.text, r.length) for r in now.collect()}
        assert after <= before
        before = after
    left = now.collect()
    pieces = corpus_pipeline.packing_stage(spark, now, path).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in left} and sum(r.piece == 0 for r in pieces) == len(left)


@pytest.mark.parametrize("few", [True, False])
def test_rows_are_shuffled_for_dropped_keys_only_beyond_a_counted_size(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", 3)
    texts = [" ".join(f"w{i % 20}x{j}" for j in range(30)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.dedup_stage(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in out.collect()) == list(range(20))
        assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (few, not few)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scoring_sends_each_text_to_the_workers_once(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage):
        plan = stage(spark, docs, path)._jdf.queryExecution().optimizedPlan().toString()
        sent = plan[plan.index("MapInArrow") :].splitlines()[1]
        assert len(re.findall(r"\btext#\d+", sent)) == 1, plan


def test_quality_scoring_lets_go_of_what_a_worker_remembers_of_other_stages(monkeypatch):
    found, forest = [], quality.fit_forest(np.zeros((0, len(quality.NAMES))), np.zeros(0))
    monkeypatch.setattr(quality, "scored", lambda docs, score, carry: found.append(score))
    quality.quality_scores(None, forest)
    monkeypatch.setattr(sys, "_ledgerframe_cache", {"packing": "words"}, raising=False)
    assert found[0](["A text."]) == [0.5] and "packing" not in sys._ledgerframe_cache


def test_workers_need_not_have_the_package(folder, tmp_path):
    """Only the driver's process finds the package here; workers start in another folder, without a path to it."""
    path, _ = folder
    own = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    script = f"""
import sys
sys.path.insert(0, {own!r})
import corpus_pipeline
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
print("rows:", corpus_pipeline.run(spark, {path!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("PYSPARK_", "SPARK_"))}
    got = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows: " in got.stdout, got.stderr[-2000:]


def test_a_stages_rows_are_written_in_bounded_row_groups(spark, folder, monkeypatch, tmp_path):
    """Parquet holds a row group a core in the heap, so over 0.6 GB and with Spark's default heap the second stage ran out of it."""
    path, _ = folder
    monkeypatch.setattr(common, "ROW_GROUP", 200_000, raising=False)
    for name, stage in corpus_pipeline.STAGES[:3]:
        session = spark.newSession()
        docs = session.read.parquet(f"{path}/documents.parquet").crossJoin(session.range(20).toDF("i"))
        if name == "near_duplicates":
            docs = session.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 10), x -> sha2(string(id * 100 + x), 256))) AS text")
        else:
            docs = docs.selectExpr("doc_id", "concat(text, ' ', doc_id, ' ', i) AS text")
        stage(session, docs.coalesce(1), path).coalesce(1).write.parquet(out := str(tmp_path / name))
        sizes = [g.total_byte_size for f in pyarrow.dataset.dataset(out, format="parquet").get_fragments() for g in f.row_groups]
        assert sum(sizes) > 1_000_000 and max(sizes) < 500_000, (name, sizes)
