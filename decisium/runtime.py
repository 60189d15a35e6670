"""Session, shared storage and lineage cuts used by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[str] = []


def session(app: str = "decisium", cpus: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset (tests, local mode) a temporary folder of this process stands in, and
    is removed at exit.
    """
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="decisium-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, used by nobody else."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: lost executors cost nothing that was written, and
    expensive columns are computed once however many plans read them.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove every table that ``materialise`` wrote in this process, once no result is read any more; gives their number."""
    n = 0
    while _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return n


def latency(df: DataFrame) -> tuple[int, float]:
    """(rows, milliseconds a row) of computing ``df`` and dropping the result."""
    seen = Observation()
    begun = time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    took = 1000 * (time.perf_counter() - begun)
    n = seen.get["n"]
    return n, took / n if n else 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
