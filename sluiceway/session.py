"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results or the accepted SQL text.
MEANING = {
    "spark.sql.session.timeZone": "UTC",
    # "id" is a column, as in Postgres text, and not a string literal
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}

# Settings that only change how the work is spread: AQE merges small shuffle
# partitions at run time and splits skewed join partitions.
SPREAD = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # do not record the Python call site of every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

CLUSTER_PARTITIONS = 10_000
PART_BYTES = 1 << 30


def shuffle_settings(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    largest_shuffle: int | None = None,
) -> dict[str, str]:
    """How many parts shuffles start with. AQE merges parts that turn out small, but does not
    split all of them when there are too few.

    A fixed number goes before the bytes of the largest shuffle, which get a part for every
    PART_BYTES. Without either a cluster starts with CLUSTER_PARTITIONS.
    """
    if shuffle_partitions:
        return {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    start = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if largest_shuffle:
        return {start: str(max(200, -(-largest_shuffle // PART_BYTES)))}
    return {} if (master or "").startswith("local") else {start: str(CLUSTER_PARTITIONS)}


def build_session(
    app_name: str = "sluiceway",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    largest_shuffle: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots.

    Tell the bytes of the largest shuffle (about the input of the widest join or sort) where
    it is beyond CLUSTER_PARTITIONS times PART_BYTES, 10 TB.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**MEANING, **SPREAD, **shuffle_settings(master, shuffle_partitions, largest_shuffle)}
    settings.update({key.replace("__", "."): str(value) for key, value in extra.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir`` or set on the context.

    A machine-local folder is made only on a local master, where the driver and
    the executors are one process.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="sluiceway-")
    return _local_scratch[context.applicationId]


def new_scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared scratch folder."""
    return f"{scratch_root(spark)}/sluiceway/{label}-{uuid.uuid4().hex}"
