"""Operator 9, token counts by separator scan.

A token file here is flat and unindexed: ids one after the other, each document closed by an end-of-document id, stored as
slabs of equal size that Spark can read from any store. Documents begin and end wherever they fall.

Each slab is searched for the end id in one vectorised comparison. What a slab needs to know of those before it is how many
documents they closed and where the last one ended: a sum and a maximum, found by a prefix scan in two levels (slabs within
chunks, chunks within files), so that no task gathers a file. Slab sizes being equal, absolute places need no scan.

Defined cases: an empty file gives no rows; end ids in a row are empty documents; ids after the last end id are one
document that is not closed; null text counts as empty; rows that repeat are written each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import tokens
from lodestar.llm.common import cut, map_arrow, only, small_batches

SLAB, CHUNK, END = 1 << 16, 1024, 50256


def write_slabs(docs: DataFrame, end_id: int = END, slab: int = SLAB, paths: tuple[str, str] | None = None) -> DataFrame:
    """file, slab, ids (binary, little-endian uint16; the last slab of a file is shorter), names (ids of the documents closed there)."""
    json_path, ranks_path = paths or tokens.default_paths()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, held, size, names, closed = TaskContext.get().partitionId(), 0, [], 0, [], []

        def row(ids: np.ndarray, who: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([at], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([who], pa.list_(pa.int64()))], ["file", "slab", "ids", "names"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(tokens.encode(text or "", json_path, ranks_path, special=False), end_id).astype("<u2")
                held.append(ids)
                size += len(ids)
                names.append(doc)
                closed.append(size)
                if size >= slab:
                    flat = np.concatenate(held)
                    for s in range(0, size - slab + 1, slab):
                        k = sum(c <= s + slab for c in closed) if len(closed) < 64 else int(np.searchsorted(closed, s + slab, "right"))
                        yield row(flat[s : s + slab], names[:k])
                        names, closed = names[k:], closed[k:]
                        at += 1
                    done = size - size % slab
                    held, size, closed = [flat[done:]], size - done, [c - done for c in closed]
        if size:
            yield row(np.concatenate(held), names)

    return map_arrow(only(docs, "doc_id", "text"), write, "file int, slab long, ids binary, names array<long>")


def count_tokens(slabs: DataFrame, end_id: int = END, slab: int = SLAB) -> DataFrame:
    """file, ordinal, start, n_tokens (without the end id), closed, and name where slabs carry names."""
    named = "names" in slabs.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, n = [], []
            for raw in b.column(2).to_pylist():
                ids = np.frombuffer(raw or b"", "<u2")
                ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
                n.append(len(ids))
            cols = [b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols + ([b.column(3)] if named else []), ["file", "slab", "n", "ends"] + ["names"] * named)

    columns = ["file", "slab", "ids"] + ["names"] * named
    found = small_batches(slabs.select(*columns), 64).mapInArrow(search, "file int, slab long, n int, ends array<int>" + ", names array<long>" * named)
    base = F.col("slab") * slab
    found = cut(found.withColumn("base", base).withColumn("last", F.when(F.size("ends") > 0, base + F.element_at("ends", -1))).withColumn("k", F.size("ends").cast("long")).withColumn("chunk", F.floor(F.col("slab") / CHUNK)))
    chunks = found.groupBy("file", "chunk").agg(F.sum("k").alias("ck"), F.max("last").alias("cl"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("file", "chunk", F.coalesce(F.sum("ck").over(before), F.lit(0)).alias("k0"), F.max("cl").over(before).alias("l0"))
    inner = Window.partitionBy("file", "chunk").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.join(chunks, ["file", "chunk"])
    scanned = scanned.withColumn("first", F.col("k0") + F.coalesce(F.sum("k").over(inner), F.lit(0))).withColumn("prev", F.coalesce(F.greatest("l0", F.max("last").over(inner)), F.lit(-1)))
    each = F.posexplode("ends").alias("i", "end")
    keep = ["file", "base", "first", "prev", "ends"] + ["names"] * named
    docs = scanned.select(*keep, each)
    start = F.when(F.col("i") == 0, F.col("prev") + 1).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1)
    who = [F.get("names", F.col("i")).alias("name")] if named else []
    closed = docs.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"), *who)
    tails = scanned.groupBy("file").agg(F.max(F.col("base") + F.col("n")).alias("size"), F.sum("k").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last")).where("size > last + 1")
    open_ = tails.select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"), *([F.lit(None).cast("long").alias("name")] if named else []))
    return closed.unionByName(open_)


def document_counts(docs: DataFrame, end_id: int = END, slab: int = SLAB, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, file, ordinal, start of each document, from token files written for the purpose."""
    slabs = cut(write_slabs(docs, end_id, slab, paths))
    return count_tokens(slabs, end_id, slab).select(F.col("name").alias("doc_id"), "n_tokens", "file", "ordinal", "start")
