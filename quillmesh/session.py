"""Session settings and helpers that depend on the running cluster."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

_shipped: set[str] = set()


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's settings apply."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillmesh")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLMESH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it
    wherever they run. The archive is served by the driver; nothing is expected on executors' disks."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
    folder = tempfile.mkdtemp(prefix="quillmesh-")
    atexit.register(shutil.rmtree, folder, True)
    target = Path(folder) / "quillmesh_src.zip"
    target.write_bytes(buffer.getvalue())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


#: Input bytes for each core from which a scan keeps the cores busy by itself.
BUSY_BYTES = 2 << 20


def input_bytes(df: DataFrame) -> int:
    """The size of what a plan reads, from the statistics of its leaves; nothing is run for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows evenly over two tasks a core, for Python-heavy work behind small inputs. Where the input is large enough to
    keep the cores busy it stays as it is, without a shuffle. Decided by the plan's sizes alone, which runs no job."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if input_bytes(df) >= cores * BUSY_BYTES:
        return df
    return df.repartition(cores * 2, *keys) if keys else df.repartition(cores * 2)
