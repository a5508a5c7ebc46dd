"""Session defaults and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("threatloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC; text forms and calendar dates depend on the session zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def free_shuffles(spark: SparkSession) -> None:
    """From now on a session drops the shuffle files of each of its queries when that has ended, not when the driver
    happens to collect its garbage. Spark makes a shuffle again where a cached frame still needs one."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate results, on whatever store it lies; a missing one is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unique folder below the cluster's shared `spark.checkpoint.dir`.

    Only where that setting is absent (local tests) does a temporary folder stand in.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="threatloom-")
    return os.path.join(shared, f"{label}-{uuid.uuid4().hex}")
