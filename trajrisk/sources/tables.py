"""Stored intermediate tables: cut lineage where several steps read the same rows, and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder in which tables are stored just now, if not directly below the shared one.
_WITHIN: ContextVar[str | None] = ContextVar("within", default=None)


@contextlib.contextmanager
def within(folder: str) -> Iterator[None]:
    """What is stored inside, by whichever operator, lies below ``folder``, so that it can be deleted as a whole."""
    token = _WITHIN.set(folder)
    try:
        yield
    finally:
        _WITHIN.reset(token)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is unset a temporary folder takes its place in local mode; elsewhere that is an error.
    """
    if _WITHIN.get():
        return f"{_WITHIN.get()}/{name}-{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is to name a folder that driver and executors share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='trajrisk-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Delete the files of a table that was stored here; of others nothing."""
    spark = df.sparkSession
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").split(":", 1)[-1].lstrip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root and root in path:
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
