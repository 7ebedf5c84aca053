"""Tables kept between the steps of an iteration, and ranks that no single task computes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank tables of at most so many rows (24 bytes each) are broadcast.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which spark.checkpoint.dir names.

    Only in local mode, where one machine is all there is, may it be unset: then it is a temporary one.  On a cluster that is an
    error, since executors would write to their own disks.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="loomlog-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder, so that a lost executor costs no recomputation.

    Unlike a checkpoint, which carries over its plan's size estimates (products of products in an iteration, until planning
    takes minutes), a table has its true size, by which Spark decides whether a join may broadcast it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomlog-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._kept_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that kept() returned and that no plan reads any more."""
    for table in tables:
        path = getattr(table, "_kept_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranked(df: DataFrame, order: list[Column], group: list[str] = (), name: str = "rank") -> DataFrame:
    """df with each row's rank from 0 in the total order `order`, within the columns `group`; no task holds a whole group.

    Rows are dealt by ranges of (group, order), sorted and kept; a partition's rows then need only the number of
    rows of their group in earlier partitions.  That table has a row for each group and partition: it is broadcast
    up to BROADCAST_ROWS, else joined.  Rows equal in all columns share out their ranks arbitrarily.
    """
    spark, group = df.sparkSession, list(group)
    keys = [F.col(c).asc_nulls_last() for c in group] + order
    shared_dir(spark)
    at = (
        df.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    parts = at.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    rows = parts.count() if group else at.rdd.getNumPartitions()
    before = F.expr(
        f"sum(_n) over ({'partition by ' + ', '.join(f'`{c}`' for c in group) if group else ''} order by _part rows between unbounded preceding and 1 preceding)"
    )
    starts = parts.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_shift"))
    if rows <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return at.join(starts, same).withColumn(name, (F.col("_at") + F.col("_shift")).cast("long")).select(*df.columns, name)
