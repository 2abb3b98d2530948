"""Session factory and the few settings every operator relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "codequarry", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; for tests and the bench."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each application, through Spark's file
    server; so it need not be installed on the executors or lie in their working directory."""
    sc = spark.sparkContext
    if getattr(sc, "_codequarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="codequarry-")) / "codequarry.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(target))
    sc._codequarry_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors share: that of spark.checkpoint.dir.

    The setting is read from the session. Only a local master that has none gets a folder of its
    own, removed when it ends; on a cluster a missing setting is an error, for a folder of one
    machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="codequarry-checkpoints-")
            remove_at_end(spark, shared)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Have the folder removed when the driver's JVM ends."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
