"""Writes as functions of old and new rows: the result is what the table holds afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.validate import raise_if_any


def upsert(old: DataFrame, new: DataFrame, keys: list[str], preserve: tuple[str, ...] = ()) -> DataFrame:
    """New rows win, but keep the old values of the columns in preserve (first_seen_at)."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    there = F.col(f"n.{keys[0]}").isNotNull()
    cols = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in preserve or c in keys else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return o.join(n, on, "full_outer").select(*cols)


def last_writer(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of each key with the highest sequence."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new)


def to_reindex(documents: DataFrame, stored: DataFrame, key: str = "handle") -> DataFrame:
    """Documents that are new, have changed (sha) or lack their vector."""
    s = stored.select(key, F.col("sha").alias("_sha"), "has_vector")
    return documents.join(s, key, "left").where("_sha is null or _sha != sha or not has_vector").select(*documents.columns)


def sync_report(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key, status: new, updated, unchanged or absent."""
    o, n = old.select(key, F.struct(*compare).alias("_o")), new.select(key, F.struct(*compare).alias("_n"))
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "absent").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def target_status(events: DataFrame, key: str = "target_id", sequence: str = "seq") -> DataFrame:
    """The latest status of each target of an append-only run log."""
    return events.groupBy(key).agg(F.max_by("status", sequence).alias("status"))


def scrape_outcome(rows: DataFrame) -> DataFrame:
    """url, http_status to a status: no detail url, ok, failed or pending."""
    status = F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "no_detail_url").when(F.col("http_status").isNull(), "pending").when(F.col("http_status") == 200, "ok").otherwise("failed")
    return rows.withColumn("status", status)


def fill_vectors(stored: DataFrame, found: DataFrame, key: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """Rows that lack their vector get the one found for them; vectors that are there stay."""
    f = found.select(key, F.col(vector).alias("_found")).dropDuplicates([key])
    return stored.join(f, key, "left").withColumn(vector, F.coalesce(vector, "_found")).select(*stored.columns)


def backfill_children(parents: DataFrame, raw: str, split, key: str) -> DataFrame:
    """key, ordinal, value: a child table derived anew from a raw column; split gives the parts of a raw value."""
    return parents.where(F.col(raw).isNotNull()).select(key, F.posexplode(split(raw)).alias("ordinal", "value"))


def harvest_plan(manifest: DataFrame, population: DataFrame, key: str = "handle") -> DataFrame:
    """What a harvest does with each key: fetch (new), refresh (known: its entry is carried, the header rewritten) or warn
    (vanished: its entry is carried, nothing is dropped)."""
    m = manifest.withColumn("_old", F.lit(True))
    p = population.select(key).distinct().withColumn("_new", F.lit(True))
    action = F.when(F.col("_old").isNull(), "fetch").when(F.col("_new").isNull(), "warn").otherwise("refresh")
    return m.join(p, key, "full_outer").withColumn("action", action).select(*manifest.columns, "action")


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside, then rename. A run that ended between the renames left the table under its old name; the next one
    puts it back first, and so does ``recover``, which readers can call."""
    spark = df.sparkSession
    staging, old = f"{path}.staging", f"{path}.old"
    recover(spark, path)
    df.write.mode("overwrite").parquet(staging)
    fs, at = _files(spark, path)
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"could not rename {path}")
    if not fs.rename(at(staging), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"could not rename {staging}")
    fs.delete(at(old), True)


def recover(spark: SparkSession, path: str) -> bool:
    """The old table back under its name, if a replacement ended between its renames."""
    fs, at = _files(spark, path)
    return not fs.exists(at(path)) and fs.exists(at(f"{path}.old")) and fs.rename(at(f"{path}.old"), at(path))


def replace_curated(df: DataFrame, problems: DataFrame, path: str) -> None:
    """A curated table is replaced as a whole, and only if its validation finds nothing."""
    raise_if_any(problems)
    replace_table(df, path)


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path
