"""Session settings and the shared folder used to cut lineage."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, cores: int | None = None, app: str = "docspark") -> SparkSession:
    """A session tuned for the package; on a cluster leave `master` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        n = cores or 8
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(n))
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}  # the folder of a local session that names none


def shared_dir(spark: SparkSession) -> str:
    """A fresh sub-folder of the folder named in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder; a cluster has to
    name one that every executor can reach.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _LOCAL["dir"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that later jobs start
    from files that outlive any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    written.add(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of intermediate tables that this process wrote and has not removed.
written: set[str] = set()


def reads(df: DataFrame) -> set[str]:
    """Those of the written folders that `df` still reads."""
    files = [f.replace("file://", "") for f in df.inputFiles()]
    return {p for p in written if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)}


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remove(spark: SparkSession, paths: set[str]) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    for path in set(paths) & written:
        remove_folder(spark, path)
        written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the written tables behind `tables`, which must not be read again."""
    for df in tables:
        remove(df.sparkSession, reads(df))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partitions by `key` when the scan has fewer partitions than the session has cores.

    Text functions are CPU-bound, so a table of a few large row groups would leave cores
    idle. A table with enough partitions is returned as it is, without a shuffle.
    """
    return df.repartition(key) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df
