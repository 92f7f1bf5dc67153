"""Session settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings, safe on a session somebody else built.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time, even where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    # In one JVM the stock 200 shuffle partitions only add scheduling; a cluster keeps its own.
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(max(8, spark.sparkContext.defaultParallelism)))
    return spark


def local_session(app: str = "corpusframe", cpus: str | int = "*") -> SparkSession:
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Tasks run wherever an executor is, so they cannot rely on the driver's import path.
    Nothing is added when the package itself came in an archive (``--py-files``).
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="corpusframe-")) / "corpusframe.zip"
    with ZipFile(archive, "w") as files:
        for source in sorted(package.rglob("*.py")):
            files.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, or one the caller set on the context."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder:
            context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute once what several later steps read.

    With a shared checkpoint folder this is a reliable checkpoint, which survives executor
    loss and cuts the lineage. Without one (a laptop) it is a plain cache over the full
    lineage, so lost parts are recomputed.
    """
    if checkpoint_folder(df.sparkSession):
        return df.checkpoint(eager=True)
    return df.persist()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for tables written on the way.

    It lies in the checkpoint folder; where none is named, in the warehouse, or in one local JVM in a temporary folder.
    """
    base = checkpoint_folder(spark)
    if base is None:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            return tempfile.mkdtemp(prefix="corpusframe-")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/tables-{uuid.uuid4().hex}"
