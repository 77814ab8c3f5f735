"""Session and shared-storage helpers used by every operator that needs them."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans here expect; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of this process, removed at its end;
    on a cluster that is an error, as no machine's own folder is shared.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="loomgrain-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def written(df: DataFrame, name: str, codec: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet under the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor, and unlike a cached
    table they are never recomputed. The folder name is unique for each call; the files
    stay until the owner of the shared folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**(options or {})).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


SPREAD_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables by Spark's own reader (the store may be one only Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """table(), spread over all cores where it is small."""
    return spread(table(spark, sf_dir, name))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where their files make fewer tasks, as one row group does whatever it holds; larger inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SPREAD_BYTES or size > cores * (128 << 20) or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)
