"""Session settings that the engine's semantics rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to Python while a stage is written: two buffers of it a task are outside the JVM's heap.
ARROW_BYTES = 8 << 20


def get_session(app: str = "sluice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and Arrow transfer; other settings stay the cluster's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary folder where that is unset and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def _held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold within, what was set before holds again after."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Later stages then depend on files that every executor can read, not on shuffle
    blocks of an executor that may be lost, and the optimizer sees the table's real size.
    The write's shuffle files go when it ends, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with _held(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of cut frames; nothing that reads them may be left to run."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._cut)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
