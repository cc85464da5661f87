"""Session settings and the shared work folder."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

def build_session(app: str = "eventwarden", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


# Runtime settings of every job: one time zone, and no per-expression call-site capture, which costs more
# than building the plans themselves. Tables are broadcast by themselves only when tiny: the engine's limit of 10 MB is
# one of compressed bytes, and such tables of events took up to 436 MB in the driver, one for each join.
BROADCAST_LIMIT = str(256 << 10)
# A folder of tables by event type is written with a file open for each type of a task: sorting whole events by type first,
# as the engine does without this, needs memory for all of a task's events and spills where they do not fit.
# Generated methods of more than 8,000 bytes of code are never compiled by the JVM: wide event projections then run
# interpreted, four times slower than without whole-stage code.
EVENT_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": BROADCAST_LIMIT,
    "spark.sql.adaptive.autoBroadcastJoinThreshold": BROADCAST_LIMIT,
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}
RUNTIME_SETTINGS = {
    **EVENT_SETTINGS,
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every job relies on; safe to call on a running session."""
    for key, value in RUNTIME_SETTINGS.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # a cluster may pin a setting
            log.debug("setting %s is pinned", key)
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only when the session names none and runs in local mode: on a cluster a
    machine-local folder would vanish with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="eventwarden-")
    sc.setCheckpointDir(made)
    return made


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions; used as the salt range for hot groups."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def work_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, inside the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/eventwarden/{spark.sparkContext.applicationId}"


def clear_work_folder(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; call it when its queries are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write an intermediate result once and read it back.

    Used where a result feeds several branches of one plan: each branch then reads the narrow table
    instead of recomputing its lineage, and a lost executor costs one read. ``release`` removes it.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.stage_path = path
    return read


def together(*jobs: Callable) -> list:
    """Results of independent jobs, which run at the same time and share the cluster; the first error is raised at the end."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [done.result() for done in [pool.submit(job) for job in jobs]]


def release(df: DataFrame) -> None:
    """Remove a staged table whose last reader has been written."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
