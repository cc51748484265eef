"""Tables written on the way: where lineage ends, a lost executor costs nothing and nothing stays in executors' memory."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own where it is unset.

    A machine-local folder is only ever chosen for a local master, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    set_by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_code.isDefined():
        return set_by_code.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="thicket-"))
    return f"file://{_own[0]}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/thicket-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(spark: SparkSession, rows: int, most: int = 16384) -> int:
    """Into how many buckets to deal so many documents: of at most ``most`` each, and some for every core if there are enough."""
    return max(1, ceil(rows / most), min(ceil(rows / 1024), 3 * spark.sparkContext.defaultParallelism))


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table of buckets by ``key`` in the shared folder, read again.

    Joins and groups by the key, alone or with others, find their rows in one bucket: nothing of
    the table is shuffled for them.  Rows that are dealt into as many partitions by the key
    already (``repartition(buckets, key)``) make one file a bucket.  The session is told that
    joins by more keys than the buckets' need no other partitioning, and to go by counts of rows:
    files of nodes are so small beside their rows that a join would send millions to the driver.
    """
    spark, name = df.sparkSession, f"thicket_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.cbo.planStats.enabled", "true")
    # A task's rows are mostly of one bucket: it keeps a few files open rather than sort by the bucket.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "8")
    try:
        df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    finally:
        spark.conf.set(writers, before)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    return spark.table(name)
