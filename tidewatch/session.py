"""Session settings, written intermediates and per-batch parts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_scratch: dict[str, str] = {}
_shipped: set[str] = set()
_scope: ContextVar[str | None] = ContextVar("scope", default=None)
_shared: ContextVar[list | None] = ContextVar("shared", default=None)


def build_session(master: str | None = None, app: str = "tidewatch", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="tidewatch-package-"), "tidewatch")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(context.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    ``spark.checkpoint.dir`` decides.  Only a local session without that setting
    gets a folder of its own; a cluster session without it is refused, because a
    machine-local folder would not be visible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _own_scratch:
        _own_scratch[context.applicationId] = tempfile.mkdtemp(prefix="tidewatch-")
    return _own_scratch[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(_scope.get() or scratch_dir(spark), f"tidewatch-{name}-{uuid.uuid4().hex}")


@contextmanager
def scratch_scope(spark: SparkSession):
    """Intermediates of the block share one folder; it and broadcasts go at the end.

    For long-running jobs.  Results that outlive the block must be written elsewhere.
    """
    folder = scratch_path(spark, "scope")
    token, shared = _scope.set(folder), _shared.set([])
    try:
        yield folder
    finally:
        for broadcast in _shared.get():
            broadcast.destroy()
        _shared.reset(shared)
        _scope.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: consumers share one computation, and a lost executor costs a
    re-read of files instead of a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value):
    """Broadcast a Python value whose size the caller has checked."""
    broadcast = spark.sparkContext.broadcast(value)
    if _shared.get() is not None:
        _shared.get().append(broadcast)
    return broadcast


@contextmanager
def shared_here():
    """What the block shares with the executors goes at its end."""
    token = _shared.set([])
    try:
        yield
    finally:
        for broadcast in _shared.get():
            broadcast.destroy()
        _shared.reset(token)


def read_parts(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows written as ``path/batch=<id>``, of batches below ``before`` if given.

    A folder that does not exist yet reads as an empty frame.
    """
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        parts = spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        parts = spark.createDataFrame([], full)
    return parts if before is None else parts.where(F.col("batch") < before)


def write_part(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the part of one batch; writing it again replaces it, so replays are safe."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def part_before(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """The part of the preceding batch, read by name: no listing of older parts.

    Only the first batch has none.  A part lost later is an error, not an empty past.
    """
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(f"{path}/batch={batch_id - 1}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"{path}/batch={batch_id - 1} is missing: batches before {batch_id} were lost") from error
