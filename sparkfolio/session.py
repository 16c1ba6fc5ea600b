"""A session with the settings this library is tested with; a cluster's own session does as well."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "sparkfolio", cpus: int | None = None, **conf: str) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    spark = SparkSession.builder.appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once a session, so that Python workers can import it.

    The archive is served by the driver; executors read no folder of the driver's. Arrow batches are held to BATCH_ROWS rows from here on: rows
    are documents, and a batch is in memory on both sides of a worker.
    """
    if int(spark.conf.get(BATCH_CONF, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sparkfolio-")) / "sparkfolio.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


#: Partitions for each task of a scan, at least.
PER_SCAN_TASK = 4
#: How many narrow rows, or how many characters of text, one task sorts and aggregates.
ROWS_A_TASK, CHARS_A_TASK = 1_000_000, 2_000_000


def shares(scan: DataFrame, text: str | None = None) -> int:
    """Partitions for rows of files, so many that a task's share of rows (of characters, if a column of text is named) stays the same whatever the input.

    Scan tasks alone do not tell: they stay as many as there are cores until the files exceed these by far.
    """
    total = scan.agg(F.count(F.lit(1)) if text is None else F.sum(F.length(text).cast("long"))).first()[0] or 0
    return max(PER_SCAN_TASK * scan.rdd.getNumPartitions(), parts_for(scan.sparkSession, total, ROWS_A_TASK if text is None else CHARS_A_TASK))


def parts_for(spark: SparkSession, total: int, share: int) -> int:
    """Partitions of at most about `share` each, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // share))


def spread(scan: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Rows of files by hash of keys, in a number of partitions that grows with the rows, so that what one task sorts and aggregates does not."""
    return scan.repartition(parts or shares(scan), *keys)


_cuts: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """df computed once, written to the folder in spark.checkpoint.dir, which all executors share, and read from there; deleted at the end.

    Where that setting is unset, a temporary folder is made if everything runs in one JVM (tests); elsewhere it is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sparkfolio-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    _cuts.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _delete_cuts() -> None:
    for spark, path in _cuts:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone, and with it the way to the folder
            pass
