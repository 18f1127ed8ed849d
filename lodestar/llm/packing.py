"""Operator 1, packing by power-of-two decomposition.

Each document's ids (its tokens, then an end id) are cut into pieces whose lengths are powers of two: as many of
``max_len`` as fit, then the binary digits of what remains, longest first. Every piece is a sequence by itself, pieces of
equal length form a bucket, so no sequence crosses documents and none is padded.

Sequences are numbered bucket by bucket, without gaps. The numbering is a two-level prefix sum: pieces are ranked within
small (bucket, salt) groups, whose sizes alone are summed; no group or task gathers a bucket.

Defined cases: a null or empty text has only its end id; rows that repeat are packed each; null doc_ids are kept; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import tokens
from lodestar.llm.common import cut, map_arrow, only

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def binary_lengths(n: int, max_len: int) -> list[int]:
    """Powers of two that add up to n, none over max_len (itself a power of two), longest first."""
    out = [max_len] * (n // max_len)
    rest, p = n % max_len, max_len // 2
    while rest:
        if rest >= p:
            out.append(p)
            rest -= p
        p //= 2
    return out


def pieces(docs: DataFrame, max_len: int = 2048, end_id: int = 1, with_ids: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece; with_ids adds the ids themselves (array<int>)."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    json_path, ranks_path = paths or tokens.default_paths()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.list_(pa.int32())] * with_ids

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(tokens.encode(text or "", json_path, ranks_path), np.uint32(end_id)).astype("<u4")
                start = 0
                for n in binary_lengths(len(ids), max_len):
                    piece = ids[start : start + n]
                    row = [doc, start, n, zlib.crc32(piece.tobytes()), len(ids), n.bit_length() - 1]
                    for c, v in zip(cols, row + [piece.astype(np.int32)] * with_ids):
                        c.append(v)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return map_arrow(only(docs, "doc_id", "text"), split, SCHEMA + ", ids array<int>" * with_ids)


def number(found: DataFrame, salts: int = 512) -> DataFrame:
    """Adds sequence_id (gapless from 0, bucket by bucket) and offset (0: a piece fills its sequence)."""
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("bucket", "_salt").agg(F.count("*").alias("_n"))
    # at most buckets x salts rows, whatever the input
    before = Window.orderBy("bucket", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("bucket", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1)
    return (
        ranked.join(F.broadcast(offsets), ["bucket", "_salt"])
        .withColumn("sequence_id", (F.col("_before") + F.col("_rank")).cast("long"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("_salt", "_before", "_rank")
    )


def pack(docs: DataFrame, max_len: int = 2048, end_id: int = 1, with_ids: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces with their sequences. The pieces are written once, so that texts are tokenised once."""
    return number(cut(pieces(docs, max_len, end_id, with_ids, paths)))
