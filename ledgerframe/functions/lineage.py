"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it is unset, a private one serves a local master; a cluster is refused."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerframe-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder. Spark deletes it with its frame where spark.cleaner.referenceTracking.cleanCheckpoints is set.

    A checkpoint keeps the size that was estimated for its plan, which for joins is a product. Over the rounds of a loop that number gets
    so many digits that they fill the driver's memory, so one beyond a long gives way to Spark's default for tables of unknown size.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    plan = out._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() < 64:
        return out
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), session)
