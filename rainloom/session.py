"""Session defaults for local runs and lineage cutting that respects the cluster's settings."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_CLEARED_AT_EXIT: set[str] = set()


def local_session(app: str = "rainloom", cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks.  On a cluster use the session that is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else one below the session's warehouse; the same on every master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def application_folder(spark: SparkSession, folder: str | None = None) -> str:
    return f"{(folder or shared_folder(spark)).rstrip('/')}/rainloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, folder: str | None = None) -> str:
    """A new path for this application in the shared folder; it goes with :func:`clear_scratch` or when Python ends."""
    own = application_folder(spark, folder)
    if own not in _CLEARED_AT_EXIT:
        _CLEARED_AT_EXIT.add(own)
        atexit.register(clear_scratch, spark, folder)
    return f"{own}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession, folder: str | None = None) -> None:
    """Remove every table this application has written for itself."""
    with suppress(Exception):  # at exit the session may have ended before
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_folder(spark, folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Lost executors then do not replay the plan above it.  Being a Parquet table
    it is pruned by column, filtered at the scan, and its real size decides
    whether Catalyst broadcasts it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
