"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation


def build_session(app_name: str = "scanmill", master: str | None = None, **conf) -> SparkSession:
    """Create a session with the settings the jobs are tuned for.

    AQE splits skewed joins and coalesces small shuffle partitions; everything
    else is left to the cluster's own configuration.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # intermediate tables that are no longer referenced are removed from the checkpoint folder
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # one image line is a wide row: small Arrow batches keep decoders within memory
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; make a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="scanmill-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/files/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# bytes counted per value for the types whose width is fixed
_FIXED_WIDTH = 16


def pin_and_measure(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Pin ``df`` and return it with its row count and an upper estimate of its bytes.

    Both numbers are observed by the job that writes the checkpoint, so checking
    the size costs no pass of its own.
    """
    width = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + _FIXED_WIDTH + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            text = F.to_json(F.struct(F.col(field.name)))
            width = width + _FIXED_WIDTH + 2 * F.coalesce(F.octet_length(text), F.lit(0))
        else:
            width = width + _FIXED_WIDTH
    size = Observation()
    watched = df.observe(
        size,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(width.cast("long")), F.lit(0).cast("long")).alias("bytes"),
    )
    pinned = pin(watched)
    seen = size.get
    return pinned, int(seen["rows"]), int(seen["bytes"])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Mappers that run inside tasks refer to functions of the package, which an
    executor does not have unless it was installed there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="scanmill-package-")
    archive = os.path.join(folder, "scanmill.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for base, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    bundle.write(path, os.path.join("scanmill", os.path.relpath(path, package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
