"""Spark session defaults and lineage-cutting helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins and coalesces shuffle
# output at run time, skew-join splitting handles a hot key holding a large
# share of the rows, and UTC keeps timestamps engine-independent.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "tagtriage",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster leave ``master`` unset so spark-submit decides; tests pass
    ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        b = b.config("spark.driver.memory", os.environ.get("TAGTRIAGE_DRIVER_MEM", "8g"))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in _DEFAULTS.items():
        if not k.startswith("spark.ui"):
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, read from ``spark.checkpoint.dir``.

    On a cluster the deployment sets it to a shared file system; when it is
    unset there, this raises. Only a local session, whose tasks share the
    driver's disk, gets a private folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tagtriage-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def current_session() -> SparkSession:
    """The session of this thread, or the application's: a streaming batch runs
    in a thread of its own."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package: Python stages import it there. Once a
    session; a deployment that installs the package does not need it."""
    sc = spark.sparkContext
    if getattr(sc, "_tagtriage_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tagtriage-zip-")  # on the driver only: Spark serves it from there
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "tagtriage"), "zip", root, "tagtriage"))
    sc._tagtriage_shipped = True


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (the data lives on the shared file system), unlike
    a local checkpoint. Used by iterative operators (greedy selection, EM,
    self-training) every few rounds.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read
    back: for tables that grow with the input, which a checkpoint would write as
    serialised rows and read whole where a few columns are asked for. With
    ``free`` the shuffle files of the write go when it ends, not when the driver
    happens to collect its garbage."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "stored", uuid.uuid4().hex)
    before = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


# rows of a partial sum below which another partial costs a round more than it saves
PARTIAL_ROWS = 8192


def few_partials(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` in at most as many partitions as the cluster runs tasks, without a
    shuffle. For fits whose every round sends one partial sum a partition (the
    2 MB gradient of 2^18 slots): their number must not grow with the input. A
    partial costs the same however few rows are in it, so with the number of
    ``rows`` given it has PARTIAL_ROWS of them at least."""
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    if rows is not None:
        parts = min(parts, max(1, -(-rows // PARTIAL_ROWS)))
    return df.coalesce(parts)


def parallel_map(fn, items, workers: int = 4) -> list:
    """Run independent Spark jobs (e.g. one model fit per fold) from a small
    driver thread pool, as spark.ml's CrossValidator does with
    ``parallelism``; results keep the input order."""
    items = list(items)
    if workers <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(workers, len(items))) as pool:
        return list(pool.map(fn, items))
