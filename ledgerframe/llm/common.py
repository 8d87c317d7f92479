"""Helpers shared by the operators: table reading, shared materialisation, Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the corpus tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``. Where that is unset a private one serves a local master (tests); a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of a Parquet row group. Every task that writes or reads one holds it in the JVM's heap; Parquet's own 128 MB, times the cores, fill Spark's default heap.
ROW_GROUP = 16 << 20


def bound_row_groups(df: DataFrame) -> None:
    """Have the session of ``df`` write row groups of ``ROW_GROUP`` bytes from now on, where nobody has set ``parquet.block.size``.

    For frames that a caller writes: only the session's setting reaches such a write.
    """
    conf, key = df.sparkSession.conf, "parquet.block.size"
    if not any(conf.get(f"{p}{key}", None) for p in ("", "spark.hadoop.")) and not df.sparkSession.sparkContext._jsc.hadoopConfiguration().get(key):
        conf.set(key, str(ROW_GROUP))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write as Parquet under the shared folder and read back.

    The table survives the loss of executors and is recomputed by nobody, unlike a cached one. An application's tables lie in one
    folder of its own, which may be deleted when it has ended; ``release`` deletes one that no plan reads any more.
    """
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` gave; other frames are left alone."""
    path = getattr(df, "_written_to", None)
    if path:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


BROADCAST_ROWS = 100_000


def join_heads(rows: DataFrame, heads: DataFrame, keys: list[str], count: str = "n", how: str = "left", small: int = BROADCAST_ROWS, share: int = 1_000) -> DataFrame:
    """Join a large table to one with a row per key, without one task for a key that holds a large part of the rows.

    ``heads`` (written already) has the number of rows of every key in column ``count``, which the result hasn't. Up to ``small``
    heads are broadcast. Beyond, keys with over a ``share``-th of all rows are: there are fewer than ``share`` of them; the rest
    is joined by a shuffle in which no key has more. Null keys match nothing.
    """
    if heads.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(heads.drop(count)), keys, how)
    most = heads.agg(F.sum(count)).first()[0] // share
    hot, cold = heads.where(F.col(count) > most).drop(count), heads.where(F.col(count) <= most).drop(count)
    full = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    first = full.join(F.broadcast(hot), keys)
    rest = full.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how)
    out = first.unionByName(rest)
    if how == "left":
        out = out.unionByName(rows.where(" or ".join(f"`{k}` is null" for k in keys)), allowMissingColumns=True)
    return out


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def process_cache(key: object, build: Callable[[], object], keep: int = 2) -> object:
    """A value built once per Python worker process, whatever copy of this function asks for it.

    A worker outlives its stage, so when one is built only the last ``keep`` - 1 of the others stay.
    """
    store = sys.__dict__.setdefault("_ledgerframe_cache", {})
    if key in store:
        store[key] = store.pop(key)
        return store[key]
    if len(store) >= keep:
        while len(store) >= keep:
            del store[next(iter(store))]
        give_back()
    store[key] = build()
    return store[key]


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 256) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, as columns of Python values.

    Only ``rows`` rows are held as Python objects at a time, so memory follows the
    longest texts and not the size of the Arrow batch.
    """
    names = df.columns
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)
                del part, got
            batch = None  # before the next one comes
        give_back()  # a worker outlives its task

    return df.mapInArrow(run, out)


def scored(docs: DataFrame, score: Callable[[list], list[float]], carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``carry``, and the score of each text. Names of carried columns may be any, the score's gives way.

    A carried text is the one that is scored: it goes to the workers once.
    """
    keep = ["doc_id", *carry]
    name = "score"
    while name in keep:
        name += "_"
    inner = [f"c{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    text = inner[keep.index("text")] if "text" in keep else "text"

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {c: cols[c] for c in inner} | {"score": score(cols[text])}

    rows = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)), *[F.col("text").alias("text")] * (text not in inner))
    return map_arrow(rows, run, ", ".join(f"{i} {k}" for i, k in zip(inner, kinds)) + ", score double").toDF(*keep, name)


def crc_of_id(col: Column) -> Column:
    """crc32 of an id written as text: the fold rule of the labelled tables."""
    return F.crc32(col.cast("string").cast("binary"))
