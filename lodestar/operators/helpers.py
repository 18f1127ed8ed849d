"""Shapes that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; a local one only where unset)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lodestar-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: for a frame that several branches of a plan read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def canonicalize(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """column mapped through the one-hop alias table."""
    a = aliases.select(F.col("from_slug").alias("_from"), F.col("to_slug").alias("_to"))
    return df.join(a, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def canonical_people(people: DataFrame, aliases: DataFrame) -> DataFrame:
    return people.join(aliases.select(F.col("from_slug").alias("slug")), "slug", "left_anti")


def top_n_with_other(counted: DataFrame, name: str, count: str, n: int, other: Column | None = None) -> DataFrame:
    """The n rows with the highest counts (ties by name); the rest summed into rows named by other.

    One ranked frame with a total order, read once. The candidates for the top come from a bounded top-k, not a global
    sort; everything else is pre-aggregated before it moves.
    """
    other = F.lit("Other") if other is None else other
    keys = [c for c in counted.columns if c not in (name, count)]
    top = counted.orderBy(F.desc(count), F.asc(name)).limit(n).select(name).withColumn("_top", F.lit(True))
    marked = counted.join(F.broadcast(top), name, "left")  # n rows
    label = F.when(F.col("_top"), F.col(name)).otherwise(other)
    return marked.withColumn(name, label).groupBy(name, *keys).agg(F.sum(count).alias(count)).select(*counted.columns)


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[float]) -> DataFrame:
    """Percentiles by nearest rank: the row numbered bround(p / 100 * n), from 1 and at most n, in order of value.

    Exact without sorting a key's rows in one task: a sketch brackets each percentile, rows below the bracket are counted,
    and only the few in it are ranked. Keys of under 2000 rows are bracketed by all of theirs.
    """
    near, ps = 0.001, [p / 100 for p in percents]
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = [q for p in ps for q in (max(0.0, p - near), min(1.0, p + near))]
    stats = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_v").alias("_max"), F.min("_v").alias("_min"), F.percentile_approx("_v", ends, 20_000).alias("_q"))
    small = F.col("_n") < 2000
    for i, p in enumerate(ps):
        stats = stats.withColumn(f"_lo{i}", F.when(small, F.col("_min")).otherwise(F.get("_q", F.lit(2 * i)))).withColumn(f"_hi{i}", F.when(small, F.col("_max")).otherwise(F.get("_q", F.lit(2 * i + 1))))
        stats = stats.withColumn(f"_at{i}", F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.lit(p) * F.col("_n"), 0).cast("bigint"))))
    rows = base.join(stats.drop("_q", "_min"), keys)
    n = range(len(ps))
    below = rows.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_b{i}") for i in n])
    hits = F.filter(F.array(*[F.when((F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}")), F.struct(F.lit(i).alias("i"), F.col(f"_at{i}").alias("at"))) for i in n]), lambda x: x.isNotNull())
    inside = rows.select(*keys, "_v", F.explode(hits).alias("x")).select(*keys, "_v", "x.i", "x.at")
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "i").orderBy("_v"))).join(below, keys)
    place = F.element_at(F.array(*[F.col(f"_b{i}") for i in n]), F.col("i") + 1) + F.col("_r")
    found = ranked.groupBy(*keys).agg(*[F.max(F.when((F.col("i") == i) & (place == F.col("at")), F.col("_v"))).alias(f"p{p:g}") for i, p in enumerate(percents)])
    return found.join(stats.select(*keys, F.col("_max").alias("max_value"), F.col("_n").alias("n")), keys)


def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_term(column: str, term: str) -> Column:
    """Case-insensitive substring, the term's own % and _ meaning themselves."""
    return F.col(column).ilike(f"%{escape_like(term)}%")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_and_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[list[Row], int]:
    """The rows of a page and the number of all rows, in one job: they are counted on their way to the top-k."""
    seen = Observation()
    rows = page(df.observe(seen, F.count(F.lit(1)).alias("n")), order, limit, offset).collect()
    return rows, seen.get["n"]


def paged(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the column total; a page holds at most limit rows, whatever df does."""
    rows, total = page_and_total(df, order, limit, offset)
    return df.sparkSession.createDataFrame(rows, df.schema).withColumn("total", F.lit(total).cast("long"))


def cross_group(a: str, b: str) -> Column:
    """Null if either has no group, else whether the two share none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), ~F.arrays_overlap(a, b))
