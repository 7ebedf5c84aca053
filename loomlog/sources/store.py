"""Known lines as a table: log_md5, template_id, expires_at.  It replaces a key-value cache of any backend."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.tables import shared_dir

SCHEMA = "log_md5 string, template_id string, expires_at timestamp"


class AssignmentStore:
    """get, set, delete, clear and exists over a folder of Parquet files, versioned so that a reader never sees half a write.

    A version counts once its _SUCCESS file is there; a store that is opened again goes on from the largest such version.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: int = 86_400):
        if not path:
            raise ValueError("a store needs a path")
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath() for f in files.listStatus(at)] if files.exists(at) else []
        done = [int(p.getName()[1:]) for p in names if re.fullmatch(r"v\d+", p.getName()) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        self.version = max(done, default=0)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{self.version}") if self.version else self.spark.createDataFrame([], SCHEMA)

    def _write(self, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1

    def get(self) -> DataFrame:
        """Entries that have not expired."""
        return self._read().where(F.col("expires_at") > F.current_timestamp())

    def set(self, entries: DataFrame) -> None:
        """entries: log_md5, template_id; a later entry replaces an earlier one."""
        fresh = entries.select("log_md5", "template_id").groupBy("log_md5").agg(F.max("template_id").alias("template_id")).withColumn("expires_at", F.current_timestamp() + F.make_interval(secs=F.lit(self.ttl)))
        self._write(self._read().join(fresh.select("log_md5"), "log_md5", "left_anti").unionByName(fresh))

    def delete(self, keys: DataFrame) -> None:
        self._write(self._read().join(keys.select("log_md5"), "log_md5", "left_anti"))

    def clear(self) -> None:
        self._write(self._read().limit(0))

    def exists(self, keys: DataFrame) -> DataFrame:
        """keys with exists."""
        known = self.get().select("log_md5", F.lit(True).alias("_is"))
        return keys.join(known, "log_md5", "left").withColumn("exists", F.coalesce("_is", F.lit(False))).drop("_is")


def open_store(spark: SparkSession, backend: str, path: str = "", ttl: int = 86_400) -> AssignmentStore:
    """'memory' is a store of this session: a folder of its own beside other intermediate tables.  'file' and 'table' need a path and outlive it."""
    if backend not in ("memory", "file", "table"):
        raise ValueError(f"no cache backend {backend!r}")
    if backend == "memory" and not path:
        path = f"{shared_dir(spark).rstrip('/')}/loomlog-{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    return AssignmentStore(spark, path, ttl)


def evicted(table: DataFrame, most: int = 10_000, accessed: str = "accessed_at") -> DataFrame:
    """The `most` entries used last."""
    return table.orderBy(F.desc(accessed)).limit(most)
