"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A repeated key of a JSON object has its last value, as in most readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Checkpoint files go once nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
PARTITION_BYTES = 128 * 1024 * 1024


def sizing(input_bytes: int, cores: int, partition_bytes: int = PARTITION_BYTES) -> dict[str, str]:
    """Shuffle and split settings for an input size: about ``partition_bytes`` per map and reduce task, one wave at least.

    A shuffle keeps track of map tasks times reduce tasks, so for hundreds of terabytes the submitter names larger partitions;
    adaptive execution joins small partitions and splits skewed ones from there.
    """
    return {
        "spark.sql.shuffle.partitions": str(max(cores, -(-input_bytes // partition_bytes))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def prepare(spark: SparkSession) -> None:
    """The settings that results depend on, for a session made elsewhere."""
    for key in ("spark.sql.variant.allowDuplicateKeys",):
        spark.conf.set(key, SETTINGS[key])


def build(app: str = "parselab", **overrides: str) -> SparkSession:
    """A session with the library's settings; master and sizing stay with the submitter."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession, *packages: str) -> None:
    """Send package folders to the Python workers, once per application.

    Not needed where the job was submitted with ``--py-files`` or the library is installed.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    for package in packages:
        folder = Path(package).resolve()
        target = f"{tempfile.mkdtemp(prefix='parselab-')}/{folder.name}"
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", folder.parent, folder.name))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a local run, with one machine only, gets a temporary folder; on a cluster that is an error, as
    each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="parselab-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def is_local(master: str) -> bool:
    """Driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below the shared folder, read back: later steps read only the columns they need."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a reliable checkpoint, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
