"""Shared helpers: tables, the shared scratch folder, Arrow batches, word and n-gram hashes, bounded bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch carries to Python: long texts stay a few MB a batch.
ARROW_ROWS = 256
#: Entries of a Python worker's memo of words; it is emptied when full.
MEMO_WORDS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
    """Keep the Arrow batches that reach Python small, so that a batch of very long texts fits a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return small_batches(df).mapInArrow(f, schema)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; a local one only where unset)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lodestar-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place_of(df: DataFrame, name: str) -> int:
    exact = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact:
        raise ValueError(f"no column {name}")
    return exact[0]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else df carries and whatever the case of clashing extra names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{place_of(df, n)}").alias(n) for n in names])


def carried(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row as the struct _row: no name of df can clash with an operator's own."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{place_of(df, n)}").alias(n) for n in names], F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]).alias("_row"))


def restored(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


#: Keys that ``meet`` sends to every task at most.
HOT_KEYS = 2000


def meet(big: DataFrame, small: DataFrame, on: str, many: str, total: int) -> DataFrame:
    """big joined with small, which has a key once and, in many, the number of big's rows with it; total: all rows of big.

    Keys with more than 1/HOT_KEYS of the rows, HOT_KEYS of them at most, are broadcast and meet their rows where these lie."""
    hot, rest = (small.where(F.col(many) * HOT_KEYS > total), small.where(F.col(many) * HOT_KEYS <= total))
    there = big.join(F.broadcast(hot.drop(many)), on)
    return there.unionByName(big.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest.drop(many), on).select(*there.columns))


def raw_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each text, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit xxh3 of each word. Words are runs of anything but \x20 and \x09-\x0D; bytes.split() splits at exactly these."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash pairs of 64-bit hashes, order kept, bits well spread."""
    x = a * _M1 + (b ^ np.uint64(seed * 0x9E3779B1 + 0x7F4A7C15)) * _M2
    x ^= x >> np.uint64(29)
    x *= _M3
    x ^= x >> np.uint64(32)
    return x


def ngrams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n word hashes, by doubling; seed gives an independent lane."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, have, at, out = h, 1, 0, None
    while True:
        if n & have:
            m = len(h) - (at + have) + 1
            piece = power[at : at + m]
            out = piece if out is None else mix(out[:m], piece, seed + have)
            at += have
        if at == n:
            return mix(out, np.full(len(out), n, np.uint64), seed)
        power = mix(power[: len(power) - have], power[have:], seed + 1)
        have *= 2


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bit_words(df: DataFrame, bit: Column, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with those set that occur in df; what reaches the driver is bounded by its size."""
    rows = df.select(bit.alias("b")).where("b is not null").groupBy(F.expr("cast(b div 32 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 as int)))").alias("v"))
    got = rows.toArrow()
    out = np.zeros(max(1, 2**bits // 32), np.uint32)
    out[got["w"].to_numpy()] = got["v"].to_numpy().astype(np.uint32)
    return out


def bit_set(words: np.ndarray, cells: np.ndarray) -> np.ndarray:
    cells = cells.astype(np.int64)
    return (words[cells >> 5] >> (cells & 31).astype(np.uint32)) & np.uint32(1) > 0


def id_bit(column: str, bits: int) -> Column:
    """The bit of an id in a bitmap; null counts as a value."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit(-1).cast("long"))), F.lit(2**bits)).cast("int")


def in_bitmap(df: DataFrame, column: str, words: np.ndarray, bits: int, also: list[str]) -> DataFrame:
    """Rows of df whose id may be in the bitmap (all that are, and a few more): cheaper than a shuffle of every text."""
    sent = df.sparkSession.sparkContext.broadcast(words)
    schema = df.select(*also).schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = bit_set(sent.value, b.column(b.schema.get_field_index("_bit")).to_numpy())
            if mask.any():
                yield b.filter(pa.array(mask)).select(also)

    return small_batches(df).withColumn("_bit", id_bit(column, bits)).select("_bit", *also).mapInArrow(keep, schema)
