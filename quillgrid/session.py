"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app_name: str = "quillgrid") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    parallel = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", os.environ.get("QUILLGRID_SCRATCH", f"file:{os.path.abspath('spark-warehouse')}/_scratch"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, a folder beside the warehouse's tables, which all
    executors share as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/quillgrid/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application stored. Results that still read it must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used for small derived tables that are needed more than once. The result
    survives lost executors, ends the lineage, and has a real size, so Spark
    broadcasts it only when it is below ``spark.sql.autoBroadcastJoinThreshold``
    and otherwise shuffles it (with adaptive skew handling). Texts that are much
    alike take far fewer bytes in a file than in memory: ``plain`` writes without
    compression and dictionaries, so that the size is that of the values.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if plain:
        df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
