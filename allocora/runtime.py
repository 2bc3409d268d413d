"""Session, shared scratch folder, stage tables and size-checked small tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 10_000
SMALL_TABLE_BYTES = 32 << 20

_local_scratch: dict[str, str] = {}
_stage_tables: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("allocora")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="allocora-")
        spark.sparkContext.setCheckpointDir(_local_scratch[app])
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return os.path.join(shared_dir(spark), "allocora", f"{label}-{uuid.uuid4().hex}")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_unit(df: DataFrame, unit: str) -> DataFrame:
    """Hash-partition by a key that is not hot, as wide as the stage tables' buckets."""
    return df.repartition(shuffle_width(df.sparkSession), unit)


def stage(
    df: DataFrame, label: str, bucket_by: str | None = None, sort_by: Sequence[str] = (), partitioned: bool = False
) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, keeps column pruning
    and filter pushdown for later readers, and with ``bucket_by`` saves them the
    shuffle on that key. The bucket key must not be hot: panels have one row per
    unit and period, so a unit is bounded by the number of periods. Rows already
    partitioned as by :func:`by_unit` (``partitioned``) are written as they lie.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if bucket_by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"allocora_{label}_{uuid.uuid4().hex}"
    (
        (df if partitioned else by_unit(df, bucket_by))
        .write.bucketBy(shuffle_width(spark), bucket_by)
        .sortBy(*(sort_by or (bucket_by,)))
        .option("path", path)
        .format("parquet")
        .saveAsTable(table)
    )
    _stage_tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def drop_stage_tables(spark: SparkSession) -> None:
    """Take this application's bucketed stage tables out of the catalog; the files stay."""
    for table in _stage_tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def small_table(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Broadcast ``df`` if it is proven to have at most ``max_rows`` rows and ``SMALL_TABLE_BYTES`` bytes.

    One bounded fetch both proves the size and keeps the rows. Beyond the bound
    the frame comes back as it was and the join stays a shuffle join, which
    adaptive execution splits where a key is hot.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > SMALL_TABLE_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of an aggregate that must stay small enough for the driver."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
