"""Session helpers shared by tests, the bench and the driver entry."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "lexispark") -> SparkSession:
    """A local session with the settings the engine is written for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. A local session
    without one gets a temporary one; on a cluster that would be each machine's own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexispark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A name for a folder in the shared one, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            files(spark, path)[0].delete(files(spark, path)[1], True)
        except Exception:  # noqa: BLE001  the session may have ended first
            pass

    atexit.register(remove)
    return path


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own Hadoop objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def saved(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, which ends their lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, whichever file system holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
