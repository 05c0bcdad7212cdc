"""Session helper, scratch folder and the missing-value policy."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def session(app: str = "runweave", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, adaptive execution, Arrow, RocksDB state."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only a local session without it uses this machine's temporary folder."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own is None:
            _own = "file://" + tempfile.mkdtemp(prefix="runweave-")
        root = _own
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the scratch folder, which cuts its lineage and survives lost executors."""
    folder = scratch(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def deleted(*folders: str) -> None:
    """Deletes scratch folders that nothing reads any more; one that was never written is none."""
    from pyarrow import fs

    for folder in folders:
        store, root = fs.FileSystem.from_uri(folder)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null inside the library, so that aggregates skip them."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
