"""Session settings, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows and bytes a table may have before a join stops broadcasting it.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def build_session(app_name: str = "dietlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and AQE; give `master` for local runs only."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application; they then need no installed copy of it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="dietlens-package-"), "dietlens.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.join("dietlens", os.path.relpath(path, package)))
        context.addPyFile(target)
        _SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir`.

    Only a local-mode session may go without that setting; it then gets one temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="dietlens-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once to the shared folder and read it back, so that later plans start there.

    The copy survives lost executors, and readers prune its columns.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(df: DataFrame) -> None:
    """Delete the tables written below the shared folder that `df` reads. Nothing may read them any more."""
    spark = df.sparkSession
    top = urlparse(shared_dir(spark)).path.rstrip("/") + "/"
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if unquote(urlparse(folder).path).startswith(top):
            remove(spark, folder)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if it comes in fewer partitions than there are cores, else as it is.

    One small file is one task, however much work its rows are. Large inputs are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_or_none(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """`df` as a local table if it is within both bounds, else None. Reads no more than the bound."""
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows or head.nbytes > max_bytes:
        return None
    return df.sparkSession.createDataFrame(head, df.schema)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    row_key: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = 32,
) -> DataFrame:
    """Join many rows to a lookup table holding each `on` value once.

    A table of checked size is broadcast. A larger one is joined on (value, salt): the lookup side
    is repeated `salts` times and each left row picks a salt from its `row_key`, so the rows of one
    hot value spread over `salts` tasks.
    """
    small = small_or_none(right, max_rows)
    if small is not None:
        return left.join(F.broadcast(small), on, how)
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [on, "_salt"], how).drop("_salt")
