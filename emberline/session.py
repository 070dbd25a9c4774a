"""Session helpers: a tuned local session for tests and fault-tolerant lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "emberline", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, one that the driver and all executors reach.

    It is the folder of ``spark.checkpoint.dir``. Where that is unset, a folder beside the warehouse is used and set; if the
    warehouse is a plain local path while executors run elsewhere, this raises, as such a folder would be a different one on
    each machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            scheme = warehouse.split(":", 1)[0] if "://" in warehouse or warehouse.startswith("file:") else ""
            if scheme in ("", "file") and not is_local(spark):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{warehouse.rstrip('/')}/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/emberline-{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether something was written to ``path``, on whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what was written below ``path``, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def reliable_cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to a table in the shared folder and go on from its files.

    The rows outlive any executor, are computed once however often they are read, and come back with their true size, by
    which Spark picks its joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
