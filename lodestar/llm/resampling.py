"""Operator 11, target-distribution importance resampling over collapsed texts.

Documents are drawn with odds that follow the ratio of two bags of hashed 1- and 2-grams: the target's and the corpus's.

Identical texts are collapsed first: a group by the whole text gives each distinct text once, with its multiplicity (copies
are added up in the tasks that read them, so a text that a third of all rows share moves once a task). Its features are
worked out once and written as bucket numbers; corpus counts are these times the multiplicity; its weight, too, is worked out
once. Weights go back to the documents by the text's 256-bit hash, texts with a large part of the rows by broadcast (at most
HOT_KEYS of them). Only then comes what is each document's own, the noise of its id: of copies, each has its own luck.

The draw needs no sort of all rows: scores are whole numbers, so a count by score (a bounded table, whatever the corpus) says
how many documents lie above each; ranks are that number plus the place by id among equal scores.

What is bounded: counts, ``buckets`` numbers a task; gains, one array of ``buckets``; scores, some 10**5 at the most, since
gains are logarithms of ratios of counts and the noise comes from 32 bits.

Defined cases: null, empty and wordless texts have no features, weight 0, and are never drawn; a null id draws the noise of an
empty string and is the first of equal scores; rows that repeat are ranked next to each other; without a benchmark the target
is empty and the smoothing decides; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import cut, map_arrow, meet, only, raw_bytes
from lodestar.llm.mixing import running

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 7, 25, 20
#: Bytes of features that an output batch carries before it is closed.
OUT_BYTES = 4 << 20
#: A-Z become a-z, other ASCII that is no letter or digit a blank; bytes from 0x80 on stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def features_of(words: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of all words, then of all pairs of neighbours: the crc32 of 'a b' goes on from that of 'a '."""
    n = len(words)
    ones = list(map(zlib.crc32, words))
    twos = map(zlib.crc32, words[1:], map(zlib.crc32, repeat(b" ", max(n - 1, 0)), ones))
    out = np.empty(max(2 * n - 1, 0), np.uint32)
    out[:n] = ones
    out[n:] = np.fromiter(twos, np.uint32, max(n - 1, 0))
    return (out % np.uint32(buckets)).astype(np.uint32)


def collapsed(rows: DataFrame) -> DataFrame:
    """text and copies: each distinct text once."""
    return rows.groupBy("text").agg(F.count("*").alias("copies"))


def featured(classes: DataFrame, buckets: int) -> DataFrame:
    """key, copies, n_words, n_features, cells (bucket numbers, four bytes each) of text, copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = size = 0
            n_words, cells = [], []
            for at, text in enumerate(raw_bytes(b.column(1))):
                words = words_of(text)
                n_words.append(len(words))
                cells.append(features_of(words, buckets).tobytes())
                size += len(cells[-1])
                if size >= OUT_BYTES or at + 1 == b.num_rows:
                    done = b.slice(start, at + 1 - start)
                    n = np.array(n_words, np.int64)
                    yield pa.RecordBatch.from_arrays([done.column(0), done.column(2), pa.array(n), pa.array(np.maximum(2 * n - 1, 0)), pa.array(cells, pa.binary())], ["key", "copies", "n_words", "n_features", "cells"])
                    start, size, n_words, cells = at + 1, 0, [], []

    return map_arrow(classes.select(F.sha2("text", 256).alias("key"), "text", "copies"), work, "key string, copies long, n_words long, n_features long, cells binary")


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket and n, the features in it over all documents: cells times copies, added up in each task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for copies, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += np.bincount(np.frombuffer(cells, np.uint32), minlength=buckets) * copies if len(cells) > 4 * buckets else 0
                if len(cells) <= 4 * buckets:
                    np.add.at(total, np.frombuffer(cells, np.uint32), copies)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    return map_arrow(rows.select("copies", "cells"), work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """1000 times the log ratio of target to corpus of every bucket, both smoothed by one, rounded down: one array of buckets."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = cut(every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0))
    sums = both.agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).first()
    ratio = ((F.col("t") + 1.0) * (sums["s"] + buckets)) / ((F.col("s") + 1.0) * (sums["t"] + buckets))
    got = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["gain"].to_numpy()
    return out


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, copies, n_words, n_features, weight: the mean gain of a text's features, rounded down; 0 without any."""
    sent = rows.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = (np.frombuffer(x, np.uint32) for x in b.column(4).to_pylist())
            weights = [int(sent.value[x].sum()) // len(x) if len(x) else 0 for x in cells]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(weights, pa.int64())], ["key", "copies", "n_words", "n_features", "weight"])

    return map_arrow(rows.select("key", "copies", "n_words", "n_features", "cells"), work, "key string, copies long, n_words long, n_features long, weight long")


def text_weights(docs: DataFrame, benchmark: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A row for each distinct text: key, copies, n_words, n_features, weight."""
    classes = cut(featured(collapsed(_texts(docs)), buckets))
    target = featured(collapsed(_texts(benchmark)), buckets)
    gain = gains(bucket_counts(classes, buckets), bucket_counts(target, buckets), buckets)
    return cut(weighed(classes, gain))


def _texts(rows: DataFrame) -> DataFrame:
    return only(rows, "text").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """scored (doc_id, n_words, n_features, weight, score) with rank: 1, 2, 3 ... for the drawn, null for the others."""
    fit = scored.where(F.col("n_words") >= min_words)
    counts = fit.groupBy("score").agg(F.count("*").alias("n"))
    steps = cut(running(counts.select(F.lit(0).alias("_all"), (-F.col("score")).alias("down"), "n"), ["_all"], "down", "n").select((-F.col("down")).alias("score"), "before", "n"))
    most = (steps.agg(F.sum("n")).first()[0] or 0) * percent // 100
    # one row a score: bounded, see above
    above = scored.join(F.broadcast(steps.where(F.col("before") < most).select("score", "before")), "score", "left")
    near = F.col("before").isNotNull() & (F.col("n_words") >= min_words)
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "weight", "n_features"))
    drawn = above.where(near).withColumn("rank", F.col("before") + place).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(above.where(~near).withColumn("rank", F.lit(None).cast("long"))).drop("before")


def resample(docs: DataFrame, benchmark: DataFrame, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank (null where it isn't drawn)."""
    weights = text_weights(docs, benchmark, buckets)
    total = weights.agg(F.sum("copies")).first()[0] or 0
    own = cut(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("key")))
    back = meet(own, weights, "key", "copies", total)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(back.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score")))
    return ranked(scored, percent, min_words)
