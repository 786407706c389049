"""Outputs of workers: appended exactly once by batch, read without what isn't committed, merged in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.storage import cut


class AnswerLog:
    """Answers by id in a folder: ``rows`` and ``ids``, a directory a batch in each.

    A batch first writes its rows, then their ids; only batches with ids count. One that dies in between is not read, and
    is overwritten when the batch comes again. Rows whose id is in already, or that repeat an id, are left out, so batches may
    overlap. As a sink of a stream: ``foreachBatch(log.append)``. One writer at a time; a batch's number is never used for other rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _batches(self) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/ids")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        # a directory of ids is whole once its writer has left the mark of success
        return sorted(str(s.getPath().getName()) for s in files.listStatus(root) if files.exists(hadoop.Path(s.getPath(), "_SUCCESS")))

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/{b}" for b in self._batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ids(self) -> DataFrame:
        """Ids that are answered."""
        kind = dict(self.spark.createDataFrame([], self.schema).dtypes)[self.key]
        return self._read("ids", f"{self.key} {kind}")

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema)

    def pending(self, questions: DataFrame, key: str | None = None) -> DataFrame:
        """Questions without an answer."""
        return questions.join(self.ids().withColumnRenamed(self.key, key or self.key), key or self.key, "left_anti")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add a batch; nothing happens if it is in already. Of repeated ids the least row counts."""
        if f"batch={batch}" in self._batches():
            return
        names = self.spark.createDataFrame([], self.schema).columns
        one = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(*names)).alias("r")).select("r.*")
        self._put(one.join(self.ids(), self.key, "left_anti").select(*names), "rows", batch)
        self._put(self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/batch={batch}").select(self.key), "ids", batch)

    def _put(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")


def worker_rows(spark: SparkSession, pattern: str, schema: str, number: str = r"(?:worker|rank)_?(\d+)") -> tuple[DataFrame, DataFrame]:
    """Rows of the JSON lines that workers left, with their ``worker`` number, and the lines that can't be read (a crash cuts the last)."""
    lines = spark.read.text(pattern).where(F.length(F.trim("value")) > 0).withColumn("worker", F.regexp_extract(F.input_file_name(), number, 1).try_cast("int"))
    parsed = lines.select("worker", "value", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.where("r is not null and r._corrupt_record is null").select("worker", "r.*").drop("_corrupt_record")
    return good, parsed.where("r is null or r._corrupt_record is not null").select("worker", "value")


def merged(parts: DataFrame, key: str, rank: str, last_wins: bool = False) -> DataFrame:
    """Outputs of all ranks in order of ``key`` (null as empty), then rank; or one row a key, that of the highest rank."""
    order = [F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(rank)]
    if not last_wins:
        return parts.orderBy(*order)
    names = [c for c in parts.columns if c != rank]
    return parts.groupBy(key).agg(F.max_by(F.struct(*names), rank).alias("r")).select("r.*")


def snapshot(log: AnswerLog) -> DataFrame:
    """The log's rows as they are now, as a table of their own."""
    return cut(log.rows())
