"""SparkSession with the settings that the operators assume: UTC, ANSI, adaptive execution; tables in the shared folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lumenbase", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cores}]")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    share_code(spark)
    return spark


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it; clusters use ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only where that setting is absent and the master is local (tests) a folder
    of this machine is chosen and set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = "file://" + tempfile.mkdtemp(prefix="lumenbase-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def written(df: DataFrame, name: str = "lumenbase") -> DataFrame:
    """A table written to the cluster's shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``written``, with one sorted file for each bucket of ``key``: groups and joins by it need neither exchange nor sort."""
    spark, own = df.sparkSession, uuid.uuid4().hex
    path, name = f"{shared_folder(spark)}/lumenbase-{own}", f"lumenbase_{own}"
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # buckets of one file keep their order
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def dropped(table: DataFrame) -> None:
    """Remove the files of a table made by ``written`` or ``bucketed`` that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if "/lumenbase-" in path:
            spark.sql(f"DROP TABLE IF EXISTS {path.rpartition('/')[2].replace('-', '_')}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dealt(rows: DataFrame, n: float, each: int, *by: str) -> DataFrame:
    """Rows dealt to a task for every ``each`` of ``n``, by columns where given. A number that is asked for is not lowered at run time,
    while tasks that Spark sizes by bytes become few where narrow rows make much work."""
    return rows.repartition(max(1, math.ceil(n / each)), *by)
