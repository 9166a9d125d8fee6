"""A log of finished work. A version's row is written after all its files, and readers go by the log: what is unfinished
does not exist for them, and a job that is run again leaves out what is finished and writes the rest anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key, time and further columns of the rows by kind of work.
KINDS = {
    "batch": "batch_id string, created_at timestamp, status string, source_name string, rows_total long, rows_isolated long, ratio double, n_vehicles long, n_segments long, "
    "time_min timestamp_ntz, time_max timestamp_ntz, lon_min double, lon_max double, lat_min double, lat_max double, speed_checked long, median_rel double",
    "network": "net_id string, built_at timestamp, status string, source_name string, n_edges long, n_nodes long, total_km double, n_matchable long",
    "analysis": "analysis_version string, generated_at timestamp, status string, batch_id string, net_id string, n_points long, match_rate double, grid_count long, cri_mean double, moran_i double, moran_p double",
    "v1": "batch_id string, generated_at timestamp, status string, grid_count long, hotspot_count long, moran_i double, moran_p double, trend string",
}


def _folder(root: str, kind: str) -> str:
    return f"{root}/log/{kind}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def rows(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The finished versions of a kind, a row each."""
    schema = KINDS[kind]
    path = _folder(root, kind)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def is_finished(spark: SparkSession, root: str, kind: str, key: str) -> bool:
    return _exists(spark, f"{_folder(root, kind)}/{key}/_SUCCESS")


def finish(root: str, kind: str, key: str, facts: DataFrame) -> None:
    """Write the row of a version: ``facts`` is one row; its key, time and status are set here. Written in one file, which
    appears as a whole."""
    names = [c.split()[0] for c in KINDS[kind].split(", ")]
    made = {names[0]: F.lit(key), names[1]: F.current_timestamp(), "status": F.lit("completed")}
    kinds = dict(c.split() for c in KINDS[kind].split(", "))
    row = facts.select(*((made[n] if n in made else F.col(n) if n in facts.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names))
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{_folder(root, kind)}/{key}")


def publish(spark: SparkSession, root: str, kind: str, key: str, write: Callable[[], None], facts: Callable[[], DataFrame]) -> bool:
    """Writes the files of a version, then its row; nothing, if it is finished. Whether it was written."""
    if is_finished(spark, root, kind, key):
        return False
    write()
    finish(root, kind, key, facts())
    return True
