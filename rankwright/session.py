"""Session factory, table loading and the shared-folder cut."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The driver's tables.
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankwright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset in a local session, as in tests, a temporary folder is
    made, set as the checkpoint folder and removed when the process ends. On a
    cluster it has to be set: executors do not share the driver's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not folder:
        own = tempfile.mkdtemp(prefix="rankwright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer tasks than there are, as a file of one row group has; else as it is.

    For operators with much work a row; large tables have tasks enough and are never shuffled by this.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


_cuts: list[list[str]] = []


def cut(df: DataFrame, name: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Ends the lineage: later stages start from files that outlive any
    executor. The row order inside a file is kept; ids made by
    ``monotonically_increasing_id`` before the cut are fixed by it. ``by``: a
    column of few values that gets folders, so that a filter on it reads its
    own files alone.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    if _cuts:
        _cuts[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut inside go when the block ends, but for those passed to ``kept``, which stay with the block around.

    What is returned from the block may read kept tables only.
    """
    held: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        held.append(_cuts[-1][-1])
        return df

    _cuts.append([])
    try:
        yield kept
    finally:
        paths = _cuts.pop()
        remove(spark, [p for p in paths if p not in held])
        if _cuts:
            _cuts[-1].extend(held)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables cut inside, for ``remove`` when what reads them is done."""
    _cuts.append([])
    try:
        yield _cuts[-1]
    finally:
        _cuts.pop()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Nothing to do where PYTHONPATH leads to it, as an installed package or a
    cluster's environment does; else Spark hands a zip of it to every worker.
    """
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or str(root.parent) in on_path or root.parent.name == "site-packages":
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="rankwright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/rankwright.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/rankwright.zip")
