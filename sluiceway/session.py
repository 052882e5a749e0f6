"""Session defaults shared by the tests, the bench and ad-hoc use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "sluiceway", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitter's own settings win."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.appName(app).master(f"local[{n}]")
    b = b.config(map=DEFAULTS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g"} | conf)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A test-data table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df):
    """df read from a checkpoint: its lineage ends. The folder is the cluster's; only a local session without one gets its own."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sluiceway-"))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """The application's own folder in the cluster's shared one, deleted when the driver ends; only a local session without one gets its own."""
    checkpointed(spark.range(0))
    sc = spark.sparkContext
    found = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/sluiceway-tables/{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return found
