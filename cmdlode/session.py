"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from cmdlode.store import delete

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tasks that list folders, each of which loads the settings of the store first.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    # Listings that nobody reads again; without this the driver keeps up to 250 MB of them.
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
}
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Set the options results depend on: UTC, adaptive plans, keyed state store."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run below the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is used only when that is unset and Spark runs in
    local mode; elsewhere executors could not share it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="cmdlode-")
    return f"{shared.rstrip('/')}/cmdlode-{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For a derived input that several branches of a job scan: each branch then
    reads only its columns instead of deriving the rows again.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` which nothing reads any more; other frames are left alone.

    For use when what was derived from them is stored itself.
    """
    for table in tables:
        path = vars(table).pop("_stored_at", None)
        if path is not None:
            delete(table.sparkSession, path)
