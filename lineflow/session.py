"""Session helpers."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch sent to Python while wide rows are written.
WIDE_ROWS = 200


def local_session(cores: str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lineflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names for intermediate tables. A local master may name
    none, as in tests, and gets a temporary one; a cluster has to name one that all executors
    share."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lineflow-")
        context.setCheckpointDir(named)
    return named


@contextmanager
def small_batches(spark: SparkSession, rows: int = WIDE_ROWS) -> Iterator[None]:
    """Batches of at most ``rows`` for Python while it lasts. Spark keeps the whole of every row
    that Python has not answered yet, so with batches counted in thousands a task holds, and
    spills, thousands of parses as soon as it has as many rows."""
    before = spark.conf.get(BATCH_KEY)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, into a table of the shared folder, and read back from there.

    For small tables that several steps of one operator read: without it every step, and every
    job an operator starts to size its buckets, would scan the input again.
    """
    path = f"{shared_folder(df.sparkSession)}/lineflow-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: dict[tuple[str, str], str] = {}


def written_once(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``key``, written to the shared folder on first use in this application.

    Later uses read the files, so they neither repeat the work nor hold it in memory, and a
    lost executor costs no recomputation. Its rows are wide, graphs or parses, and go to Python
    in small batches.
    """
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _WRITTEN:
        name = hashlib.sha1(":".join(slot).encode()).hexdigest()[:16]
        path = f"{shared_folder(spark)}/lineflow-tables/{name}"
        with small_batches(spark):
            make().write.mode("overwrite").parquet(path)
        _WRITTEN[slot] = path
    return spark.read.parquet(_WRITTEN[slot])
