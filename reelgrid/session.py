"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "reelgrid", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a single-process session without that setting (tests, benchmarks) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reelgrid-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, kind: str = "tables") -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/reelgrid/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def _remove(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already; retention of the folder is the fallback
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def written_once(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read, and continue from the files.

    The branches share one computation, columns are pruned at the scan, and a lost executor re-reads
    files instead of recomputing the lineage. The files live until the driver ends.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
