"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the library to the executors, once per application: their Python need not have it installed."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(context.applicationId)
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, f"tidemark/{source.relative_to(package)}")
    context.addPyFile(str(path))

#: Settings of a session that this library builds itself; a session handed in is never reconfigured.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("tidemark")
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory (a file or a folder of part files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset on one machine (tests)
    a temporary folder is used. On a cluster no such folder would be shared: ValueError.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    wanted = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not wanted and not re.match(r"local($|\[)", context.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder.

    Unlike a local checkpoint this survives the loss of any executor.
    """
    ship(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table into the shared checkpoint folder and read back.

    Survives the loss of any executor like :func:`cut`, takes less disk, and can be dropped; the
    partitioning of ``df`` is not kept.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def store_buckets(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Like :func:`store`, in ``buckets`` by the hash of ``column``: groupings and joins by it read the table
    without a shuffle, as often as they like. Each bucket is one file, sorted by ``column``."""
    spark = df.sparkSession
    ship(spark)
    name = f"table_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name.replace('_', '-')}"
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).sortBy(column).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def delete_file(spark: SparkSession, name: str) -> None:
    """Deletes a file or folder of any shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`store` wrote; nothing may read it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if not folder.rsplit("/", 1)[-1].startswith("table-"):
            raise ValueError(f"{folder} is no stored table")
        delete_file(df.sparkSession, folder)
