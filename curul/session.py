"""Session helpers: settings the jobs rely on, and durable cut points for long lineages."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType

# Runtime settings only, so they can be applied to a session that somebody else built.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where the plan then needs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A generated method beyond this size is not compiled by the JVM; smaller pieces are.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Groups of a task are gathered in a hash map; sorting begins where very many are open at once.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their workers import it by name."""
    context = spark.sparkContext
    if getattr(context, "_curul_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-curul-")  # on the driver, which serves the archive from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    staged = shutil.copytree(package, f"{folder}/tree/curul", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/curul-package", "zip", os.path.dirname(staged), "curul"))
    context._curul_shipped = True


def tune(spark: SparkSession) -> SparkSession:
    """Switch on adaptive execution with skew splitting; sizes stay as the cluster set them."""
    ship(spark)
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "curul", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    A folder of our own is chosen only for a local master with none set; on a cluster a missing
    setting is an error, because a machine-local folder would not survive the loss of an executor.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        context = spark.sparkContext
        if getattr(context, "_curul_folder", None) is None:  # one for the application, removed with it
            context._curul_folder = tempfile.mkdtemp(prefix="spark-curul-", dir="/tmp")
            atexit.register(shutil.rmtree, context._curul_folder, ignore_errors=True)
        folder = context._curul_folder
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage (never executor-local blocks).

    Parquet, as a checkpoint is neither compressed nor read by column. Names or types that Parquet cannot hold are checkpointed.
    """
    spark = df.sparkSession
    names = {name.lower() for name in df.columns}
    if len(names) == len(df.columns) and names and not any(isinstance(f.dataType, NullType) for f in df.schema):
        path = f"{shared_folder(spark).rstrip('/')}/durable-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
