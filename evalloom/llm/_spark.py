"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is set; a cluster without a
    shared folder is refused, as its machines couldn't read each other's tables.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evalloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, so lost executors cost no recomputation of what stands before, and later
    readers prune columns.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    had = {c.lower() for c in df.columns}
    while name.lower() in had:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` as long and ``text`` with null read as empty, plus the columns ``keep``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


#: Rows of a slice at most, whatever the session's Arrow batches hold.
ROWS = 1 << 15


def slices(batch: pa.RecordBatch, most: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch of rows into runs of about ``most`` text bytes and at most ``ROWS`` rows, so that work memory stays bounded."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if (total and total + n > most) or i - start >= ROWS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, most: int = 2 << 20) -> DataFrame:
    """``mapInArrow`` with ``work`` called on runs of about ``most`` text bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                out = work(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)
