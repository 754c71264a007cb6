"""Session settings and the few helpers that every operator shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "sedimark") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SEDIMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory (a file or a directory of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; set to a temporary one only where the session names none (tests)."""
    sc = spark.sparkContext
    own, at = sc.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)
    if at:
        if not own:
            sc.setCheckpointDir(at)
        return at
    if own:
        return own
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sedimark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: later stages restart from files, whichever executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """As `cut`, for rows with texts: a compressed Parquet table in the shared folder, which `sweep` removes, at the latest when the process ends."""
    spark = df.sparkSession
    if not _STAGED:
        atexit.register(_leave, spark)
    path = f"{shared_dir(spark)}/sedimark-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: list[str]) -> DataFrame:
    """`df` as a table in the shared folder in as many buckets of `by` as a shuffle has partitions: a later join or aggregation by the
    same columns reads each bucket in place. Rows are written by the tasks that hold them: one file a bucket if they already lie by `by`."""
    spark = df.sparkSession
    if not _STAGED:
        atexit.register(_leave, spark)
    name = f"sedimark_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _STAGED.append(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *by).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


#: Most rows of a table that is sent to every executor.
BROADCAST_ROWS = 100_000


def is_small(df: DataFrame) -> bool:
    """Whether `df` has at most BROADCAST_ROWS rows; it is counted."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def bounded(df: DataFrame) -> DataFrame:
    """`df` marked for broadcasting if it is small, else as it is: the join then shuffles."""
    return F.broadcast(df) if is_small(df) else df


_STAGED: list[str] = []


def sweep(spark: SparkSession) -> None:
    """Removes the tables that `staged` wrote; only when no query reads them any more."""
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _leave(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        sweep(spark)


def spread(df: DataFrame, rows_per_task: int = 0) -> DataFrame:
    """`df` over at least as many partitions as the cluster has cores, for stages whose CPU time is large against their bytes.

    A small input is otherwise one file split, hence one task. Only adds a round-robin exchange where the scan has fewer
    partitions than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def safe_join_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the columns an operator works with, so that extra columns with clashing names cannot collide."""
    return df.select(*[F.col(f"`{c}`") for c in keep])
