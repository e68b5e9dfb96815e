"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of one Arrow batch sent to a Python worker, so that a worker's
#: memory does not depend on how long the texts are (one row at least).
ARROW_BATCH_BYTES = 8 << 20

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where the session names none, a local
    session gets a temporary folder; on a cluster, where no folder of one machine will do, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="clausegrid-"))
    return f"file://{_local[0]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to a table in the shared folder and reads it back, which
    cuts its lineage: later steps survive lost executors and never redo the work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds this share of all rows, so that there are at most so many hot keys: they may be broadcast.
HOT_KEYS = 1024


def spread_join(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined on ``key`` with ``named`` (key, n: its rows, and more), every row's key being there; without n. Rows of
    hot keys stay where they are and meet at most HOT_KEYS broadcast ones; all other keys hold few rows each."""
    hot = F.col("n") * HOT_KEYS >= total
    few = F.broadcast(named.where(hot))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(named.where(hot).select(key)), key, "left_anti").join(named.where(~hot), key)).drop("n")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes for the plans made after this call."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def utf8(column: pa.Array) -> list[bytes]:
    """The column's strings as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def id_mod(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
