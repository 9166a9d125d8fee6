"""What the operators of this subpackage share: tables, work folders, tokens and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered

#: ASCII letters to lower case, everything that is not a digit, a letter or a byte above 0x7F to a blank.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


#: Values of a key that are sent to every executor, at most.
BROADCAST_IDS = 4_000_000
#: Tasks that rows of one key are dealt to where that key may be very frequent.
SALTS = 32
#: First letters of the names of bucketed tables.
BUCKETED = "bucketed_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = f"file://{tempfile.mkdtemp(prefix='spark-work-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("spark.checkpoint.dir is to name a folder that driver and executors share")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes for what is run inside; the setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffles behind a written table are no longer needed, but Spark only deletes their files when the driver
    collects its garbage; ``free`` asks for that, after large shuffles.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if free:
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str, free: bool = False) -> DataFrame:
    """Like ``materialize``, with the files bucketed by ``key``: later joins on it need no shuffle of this side."""
    spark = df.sparkSession
    name = f"{BUCKETED}{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{work_dir(spark)}/{name}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    if free:
        spark._jvm.System.gc()
    return spark.table(name)


def salted_left_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Left join on ``key`` of which one value may be in very many rows of ``left``: these are dealt to ``SALTS`` tasks by
    ``by``. ``right`` has one row a value, and only values that are worth it, as each row is sent ``SALTS`` times."""
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], "left").drop("__salt")


def id_numbers(docs: DataFrame, id_col: str) -> DataFrame | None:
    """``__id, __number`` for the ids of a table: numbers in their order; none where ids are whole numbers themselves."""
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return None
    ids = docs.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    return materialize(numbered(ids, ["__id"], "__number"), "ids")


def leave_out(docs: DataFrame, gone: DataFrame, key, gone_key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` (a column) is not among the distinct values of ``gone_key``, with all their columns.

    Up to ``BROADCAST_IDS`` values go to every executor, so that the texts stay where they are; more are joined by shuffle.
    """
    gone = materialize(gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, key == F.col(gone_key), "left_anti").select(*docs.columns)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    root = work_dir(spark).split(":", 1)[-1].lstrip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in path:
            name = path.rsplit("/", 1)[-1]
            if name.startswith(BUCKETED):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_folder(spark, path)


def fold(key: str, folds: int) -> int:
    """Python's twin of ``crc32(cast(key as string)) % folds``."""
    return zlib.crc32(key.encode()) % folds


def fold_column(column, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def text_bytes(value: str | None) -> bytes:
    """UTF-8 of a text; a null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def texts_of(column) -> list[bytes | None]:
    """UTF-8 of an Arrow string column without a detour over ``str``."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; the component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al., each a group-by, until the edge list stays as
    it is. A node's neighbours are never gathered in a row: each step is a minimum joined back to the edges.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    current = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    current = materialize(current, "cc")
    before = None
    for _ in range(rounds):
        both = current.select("u", "v").unionByName(current.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(v.alias("u"), m.alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(v.alias("u"), m.alias("v"))
        small = materialize(small.unionByName(low.select("u", m.alias("v"))).where("u <> v").distinct(), "cc")
        state = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(current)
        current = small
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    else:
        raise RuntimeError("connected components did not settle")
    low = current.groupBy(u.alias("node")).agg(F.min("v").alias("component"))
    roots = current.select(v.alias("node")).distinct().join(low, "node", "left_anti")
    out = materialize(low.unionByName(roots.withColumn("component", F.col("node"))), "components")
    discard(current)
    return out


def pack(data: np.ndarray | bytes) -> bytes:
    """Bytes, or those of an array, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else data.tobytes())


def unpack(data: bytes, kind=None) -> np.ndarray | bytes:
    """What ``pack`` took: bytes, or an array of ``kind``."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)
