"""Session settings, table loading and the shared scratch area."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app: str = "analystry", cores: int | str = "*", memory: str = "8g",
                  shuffle_partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass your own session instead.

    `scratch` is the folder for checkpoints and intermediate tables; by default a new one that goes when Python ends.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", scratch or _own_folder())
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder() -> str:
    base = tempfile.mkdtemp(prefix="run-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`; in a single JVM without that setting, a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _own_folder()
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table that a job writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/analystry/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that loops keep short plans and survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Give heavy row work one task per core when the input has fewer splits than that; with `rows`, one per so many rows if these are more."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        wanted = max(wanted, -(-df.count() // rows))
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
