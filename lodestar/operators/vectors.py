"""Exact vector search: cosine distance, facets fused by the least distance, evidence passages.

Distances are numpy products over Arrow batches; each task keeps only its k best for each query, so what is sorted is
bounded by tasks x queries x k. Few queries, given by the caller, are sent to the passages; a table of queries meets them in
blocks (``nearest_all``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(passages: DataFrame, queries: list[list[float]], k: int, key: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """query, key, distance, rank: the k nearest passages of each query; rows without a vector don't rank."""
    q = _unit(np.asarray(queries, np.float64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, dist = np.zeros(0, np.int64), np.zeros((0, len(q)))
        rows: list[tuple[int, int, float]] = []
        kept: list[list[tuple[float, int]]] = [[] for _ in q]
        for b in batches:
            if not b.num_rows:
                continue
            ids, dist = b.column(0).to_numpy(), np.round(1 - _unit(_matrix(b.column(1))) @ q.T, 12)
            for i in range(len(q)):
                d = dist[:, i]
                # all that tie with the k-th, so that ties can go by key
                edge = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                near = np.flatnonzero(d <= min(edge, kept[i][-1][0] if len(kept[i]) == k else np.inf))
                if len(near):
                    kept[i] = sorted([*kept[i], *zip(d[near].tolist(), ids[near].tolist())])[:k]
        for i, best in enumerate(kept):
            rows += [(i, n, d) for d, n in best]
        if rows:
            a, c, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["query", key, "distance"])

    found = passages.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(scan, f"query int, {key} long, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", key)))
    return ranked.where(F.col("rank") <= k).select("query", key, F.round("distance", 6).alias("distance"), "rank")


def nearest_all(passages: DataFrame, queries: DataFrame, k: int, key: str = "ordinal", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """As nearest, for a table of queries (key, vector), which stay in Spark: blocks of about block queries meet slabs of
    about 16 * block passages, and each meeting gives out its k best of a query."""
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("_v"))
    there = passages.where(F.col(vector).isNotNull()).select(key, vector)
    blocks, slabs = max(1, -(-asked.count() // block)), max(1, -(-there.count() // (16 * block)))
    left = there.select(F.pmod(F.xxhash64(key), F.lit(slabs)).alias("slab"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), key, vector)
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), "query", "_v")

    def best(p: pa.Table, q: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if p.num_rows and q.num_rows:
            ids, d = p[key].to_numpy(), np.round(1 - _unit(_matrix(p[vector])) @ _unit(_matrix(q["_v"])).T, 12)
            for i, asker in enumerate(q["query"].to_pylist()):
                # all that tie with the k-th, so that ties can go by key
                near = np.flatnonzero(d[:, i] <= np.partition(d[:, i], k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                found += [(asker, n, x) for x, n in sorted(zip(d[near, i].tolist(), ids[near].tolist()))[:k]]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query": pa.array(a, pa.int64()), key: pa.array(b, pa.int64()), "distance": pa.array(c, pa.float64())})

    near = left.groupBy("slab", "block").cogroup(right.groupBy("slab", "block")).applyInArrow(best, f"query long, {key} long, distance double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", key)))
    return ranked.where(F.col("rank") <= k).select("query", key, F.round("distance", 6).alias("distance"), "rank")


def relevant(found: DataFrame, floor: float = 0.6) -> DataFrame:
    """Similarity, clamped to 0 to 1, at the floor or over."""
    return found.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance")))).where(F.col("similarity") >= floor)


def multi_facet(items: DataFrame, facets: list[list[float]], k: int, key: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """key, distance to the nearest facet, that facet (the first on ties), rank; k is held to 1 to 18."""
    k = max(1, min(18, k))
    q = _unit(np.asarray(facets, np.float64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = 1 - _unit(_matrix(b.column(1))) @ q.T
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(d.min(axis=1), 12)), pa.array(np.round(d, 12).argmin(axis=1).astype(np.int32))], [key, "distance", "facet"])

    d = items.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(scan, f"{key} long, distance double, facet int")
    best = d.orderBy("distance", key).limit(k)  # a bounded top-k
    return best.select(key, F.round("distance", 6).alias("distance"), "facet", F.row_number().over(Window.orderBy("distance", key)).alias("rank"))


def evidence(passages: DataFrame, winners: DataFrame, facets: list[list[float]], handle: str = "handle", ordinal: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """The best passage of each (handle, facet) of winners; a handle without passages keeps its row."""
    q = _unit(np.asarray(facets, np.float64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = 1 - np.einsum("ij,ij->i", _unit(_matrix(b.column(2))), q[b.column(3).to_numpy()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(d)], [handle, ordinal, "facet", "d"])

    wanted = winners.select(handle, "facet").distinct()
    near = passages.where(F.col(vector).isNotNull()).select(handle, ordinal, vector).join(wanted, handle)
    d = near.select(F.col(handle).cast("long").alias(handle), F.col(ordinal).cast("long").alias(ordinal), vector, "facet").mapInArrow(scan, f"{handle} long, {ordinal} long, facet int, d double")
    best = d.groupBy(handle, "facet").agg(F.min_by(ordinal, F.struct(F.round("d", 12), F.col(ordinal))).alias("passage"), F.round(F.min("d"), 6).alias("passage_distance"))
    return winners.join(best, [handle, "facet"], "left")


def vector_coverage(items: DataFrame, vector: str = "embedding") -> DataFrame:
    return items.agg(F.count("*").alias("total"), F.count(vector).alias("with_vector"))


def over_fetch(found: DataFrame, limit: int, keep) -> DataFrame:
    """Compatibility: filter after fetching five times as many (25 to 100)."""
    fetch = max(25, min(100, limit * 5))
    return found.where(F.col("rank") <= fetch).where(keep).orderBy("rank").limit(limit)
