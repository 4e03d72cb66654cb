"""Session set-up, lineage cutting and staged tables.

Iterative jobs and multi-pass jobs cut their lineage either with a reliable checkpoint or with
a parquet table. Both live in the shared folder named by ``spark.checkpoint.dir``, so that a lost
executor only costs the recomputation of the tasks it ran.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "murmurlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on. Extra settings go in ``conf``
    with ``__`` for each dot (``spark__sql__shuffle__partitions="8"``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the workers this package where it isn't installed on them, as a zip of its sources."""
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    folder = Path(tempfile.mkdtemp(prefix="murmurlens-ship-"))  # on the driver, which serves it to the workers
    target = folder / "murmurlens.zip"
    target.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(target))
    return spark


def pin_settings(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that results depend on to a session built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster's ``spark.checkpoint.dir`` wins. Where it is unset, a local session gets a
    temporary folder; a cluster session is refused, since a machine-local folder would be lost
    together with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="murmurlens-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint. Keeps partitioning and ordering, drops the lineage behind it."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Preferred over :func:`cut` where later passes need only some of the columns or where the
    planner should see true sizes. ``compression`` is a parquet codec, for tables that hold whole texts.
    """
    path = f"{checkpoint_root(df.sparkSession)}/stage/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables that :func:`stage` wrote and forgot. For the end of a job, when nothing
    that reads them is left; checkpoints go with their DataFrames."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/stage")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Deal an input that comes in fewer pieces than there are cores over all cores. Inputs with
    enough pieces, which is every large one, pass through without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def even_tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for a table that an iterative job keeps: few for small data, the session's
    setting above a million rows, and more than that where partitions would exceed 500,000 rows."""
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows < 1_000_000:
        return max(1, min(configured, -(-rows // 50_000)))
    return max(configured, -(-rows // 500_000))


def level_tasks(spark: SparkSession, rows: int) -> int:
    """:func:`even_tasks` for many short rounds with plans that are fixed: none of less than 150,000 rows."""
    return min(even_tasks(spark, rows), max(1, -(-rows // 150_000)))


@contextmanager
def fixed_plans(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Plans without run-time changes and with ``partitions`` at each shuffle, for rounds that repeat the same
    small query: adaptive plans need a job for each shuffle."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    held = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


class Workspace:
    """Named tables that are written on first use and read from then on.

    Stands where the original keeps a database file and in-memory caches: the posts table, the
    graph tables and the ranks are computed once and every later query scans the stored columns.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = checkpoint_root(spark)
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = stage(build(), name, compression="zstd")
        return self._tables[name]
