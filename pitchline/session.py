"""Session defaults and lineage cutting.

Operators never hold state outside the session.  Where a plan must be
materialised (iterations, results read more than once) it is written as a
Parquet table below ``spark.checkpoint.dir``, the one folder a cluster shares,
so an executor that is lost takes nothing with it.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "pitchline", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC time and ANSI arithmetic."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh local one only where
    a local session names none (tests, a laptop).

    On a cluster a local folder would be another one on each machine, so there
    the setting is required.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-cut-")
        spark.conf.set(CHECKPOINT_DIR, path)
    return path.rstrip("/")


@contextmanager
def shuffle_files_end_with_query(spark: SparkSession):
    """Within this block each query's shuffle files go when it has ended."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` is ``value`` within this block; what it was before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows of a task that holds its rows, and how many bytes of short rows, as shuffled or in files, are about as many.
TASK_ROWS, TASK_BYTES = 1 << 20, 8 << 20


@contextmanager
def bounded_tasks(spark: SparkSession, rows: int = 0):
    """Within this block a task that sorts or hashes short rows gets about ``TASK_ROWS`` of them.

    Spark joins partitions up to a size in bytes, and short rows are shuffled
    and stored so small that many millions of them would meet in one task.
    ``rows`` is how many the largest shuffle has, where that is known.
    """
    size = lambda key: int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    bounds = {key: str(min(size(key), most)) for key, most in (("spark.sql.files.maxPartitionBytes", 2 * TASK_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES))}
    bounds["spark.sql.shuffle.partitions"] = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)))
    with ExitStack() as held:
        for key, value in bounds.items():
            held.enter_context(setting(spark, key, value))
        yield


def cut(df: DataFrame, partitioned_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once below the shared folder and return a scan of it.

    The scan starts a new lineage, has file statistics for the planner, and
    can be read again by any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partitioned_by:
        writer = writer.partitionBy(*partitioned_by)
    with shuffle_files_end_with_query(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pitchline_cut = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the session has cores: for rows that many passes compute on.

    Only what is read in fewer is shuffled, so at a size that fills the cluster nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` returned and nothing reads any more."""
    path = getattr(df, "_pitchline_cut", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Up to so many rows of one key an ordered window over the key fits a task well.
HOT_ROWS = 1 << 20


def has_hot_key(df: DataFrame, key: str) -> bool:
    """Whether one key has more rows than a task should order; reads the key column only."""
    most = df.groupBy(key).count().agg({"count": "max"}).first()[0]
    return (most or 0) > HOT_ROWS


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Bound the bytes of the Arrow batches of this session, so that long texts fit a worker.

    A plan runs after the function that made it has returned, so the bound
    stays set; a smaller one of the user's is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > size:
        spark.conf.set(key, str(size))
