"""Whether stored tables can be used: states as rows, found from paths and schemas without reading data."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

READY, MISSING, UNAVAILABLE = "ready", "missing", "unavailable"


def table_state(spark: SparkSession, path: str, needed: list[str]) -> tuple[str, str | None]:
    """ready; missing: nothing is there; unavailable: it can't be read, or lacks a needed column. The reason is null where ready.
    Nothing is raised."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    try:
        if not hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(path)):
            return MISSING, f"{path} does not exist"
        columns = spark.read.parquet(path).columns
    except PySparkException as e:
        return UNAVAILABLE, f"{path} can't be read: {e.getCondition() or type(e).__name__}"
    except Exception as e:  # noqa: BLE001 - a state, not a failure: the file system's own errors come as those of the bridge
        return UNAVAILABLE, f"{path} can't be reached: {type(e).__name__}"
    lacking = [c for c in needed if c not in columns]
    return (UNAVAILABLE, f"{path} lacks {', '.join(lacking)}") if lacking else (READY, None)


def store_states(spark: SparkSession, tables: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """name, state, reason of each table; tables: name to path and needed columns."""
    return spark.createDataFrame([(name, *table_state(spark, path, needed)) for name, (path, needed) in tables.items()], "name string, state string, reason string")
