"""Operator 3, document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven UTF-8 bytes decides where a text is cut: at block size 2**k a position is a boundary
where the hash's low k bits are ones, so the boundaries of a block size are among those of the next smaller one. Each chunk
gives one of 64 characters. The block size is the text's length over 64, rounded up to a power of two, and halved while
that gives fewer than 24 chunks; the 64th character of a signature covers all that is left. The fingerprint is
``k:signature at 2**k:signature at 2**(k+1)``.

Two fingerprints compare at a block size that both have: likeness is ``2 * LCS / (length1 + length2)``, that is one minus
the insert/delete edit distance over the total length, if the signatures also share a run of characters (7, fewer for short
signatures), else 0. The distance is computed bit-parallel in 64-bit words for a whole batch of pairs at once.

The next document (by descending doc_id, nulls last, then text; after the last comes the first) meets its neighbour after
one range shuffle of the texts: doc_id ranges become blocks, and the first document of each block is also sent to the
block before.

Defined cases: a null text is empty; an empty text has the fingerprint of no chunks and likeness 1 to another empty text;
one document is its own next; rows that repeat follow each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, only

WINDOW, LEAST_K, LEAST, MOST, STEP = 7, 2, 24, 64, 1 << 22
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_P = [np.uint32(p) for p in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x9E3779B1, 0xD3A2646D, 0xFD7046C5)]
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the seven bytes that end at each position; before the start there are zeros."""
    d = data.astype(np.uint32) + np.uint32(1)
    h = d * _P[0]
    for i in range(1, WINDOW):
        h[i:] += d[:-i] * _P[i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _cuts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """For each position that could be a boundary: its count of low ones and the running sum of mixed hashes there; the last sum."""
    ones, sums, total = [], [], np.uint64(0)
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole), STEP):
        back = min(at, WINDOW - 1)
        h = _rolling(whole[at - back : at + STEP])[back:]
        m = h.astype(np.uint64) * _A
        m ^= m >> np.uint64(32)
        s = np.cumsum(m * _B, dtype=np.uint64) + total
        total = s[-1]
        low = np.uint32((1 << LEAST_K) - 1)
        pick = np.flatnonzero((h & low) == low)
        inv = ~h[pick]
        low_bit = inv & (np.uint32(0) - inv)
        ones.append(np.where(inv == 0, 32, np.log2(np.maximum(low_bit, 1)).astype(np.int64)))
        sums.append(s[pick])
    if not ones:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), total
    return np.concatenate(ones), np.concatenate(sums), total


def fingerprint(data: bytes) -> str:
    ones, sums, total = _cuts(data)
    k = LEAST_K
    if len(data):
        at_least = np.cumsum(np.bincount(ones, minlength=64)[::-1])[::-1]
        k = max(k, (len(data) // MOST).bit_length())
        while k > LEAST_K and at_least[k] < LEAST:
            k -= 1
    out = []
    for j in (k, k + 1):
        ends = sums[ones >= j]
        if len(data) and (not len(ends) or ends[-1] != total):
            ends = np.append(ends, total)
        if len(ends) > MOST:
            ends = np.append(ends[: MOST - 1], total)
        chunk = np.diff(ends, prepend=np.uint64(0))
        chunk = (chunk ^ (chunk >> np.uint64(33))) * _A
        out.append(ALPHABET[(chunk >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return f"{k}:{out[0]}:{out[1]}"


def lcs(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Length of the longest common subsequence of each pair; strings of at most 64 characters."""
    n = len(pairs)
    if not n:
        return np.zeros(0, np.int64)
    width = max(max(len(a), len(b)) for a, b in pairs) or 1
    a = np.frombuffer(b"".join(x.encode().ljust(width, b"\x00") for x, _ in pairs), np.uint8).reshape(n, width)
    b = np.frombuffer(b"".join(y.encode().ljust(width, b"\x01") for _, y in pairs), np.uint8).reshape(n, width)
    masks = np.zeros((n, 128), np.uint64)
    rows = np.arange(n)
    for i in range(width):
        masks[rows, a[:, i]] |= np.uint64(1) << np.uint64(i)
    masks[:, 0] = 0
    v = np.full(n, 2**64 - 1, np.uint64)
    for j in range(width):
        u = v & masks[rows, b[:, j]]
        v = (v + u) | (v - u)
    return np.array([64 - int(x).bit_count() for x in v], np.int64)


def _share(a: str, b: str) -> bool:
    n = max(1, min(WINDOW, min(len(a), len(b)) // 3))
    runs = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in runs for i in range(len(b) - n + 1))


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.zeros(len(pairs))
    asked: list[tuple[str, str]] = []
    whose: list[int] = []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (kx, x1, x2), (ky, y1, y2) = x.split(":"), y.split(":")
        kx, ky = int(kx), int(ky)
        same = [(x1, y1), (x2, y2)] if kx == ky else [(x1, y2)] if kx == ky + 1 else [(x2, y1)] if ky == kx + 1 else []
        for a, b in same:
            if a and b and _share(a, b):
                asked.append((a, b))
                whose.append(i)
    for i, (a, b), n in zip(whose, asked, lcs(asked)):
        # equal signatures of unequal texts: chunks differ only where their characters collide
        out[i] = max(out[i], 2 * n / (len(a) + len(b)))
    return out


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, text, and tail flag, dealt so that each block is one run of the descending order, followed by the next block's first."""
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions")) * 8
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    rows = rows.withColumn("k", key)
    # n quantiles and one row a block, whatever the input
    edges = sorted(set(rows.where("doc_id is not null").agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or [])) if n > 1 else []
    block = F.lit(0)
    if edges:
        # a coarse step over every step-th edge, then the edges within; high ids come first
        step = int(len(edges) ** 0.5) + 1
        rows = rows.withColumn("e", F.lit(edges).cast("array<bigint>")).withColumn("c", F.lit(edges[step - 1 :: step]).cast("array<bigint>"))
        rows = rows.withColumn("at", F.expr(f"size(filter(c, x -> x < k)) * {step}"))
        block = F.expr(f"{len(edges)} - at - size(filter(slice(e, at + 1, {step}), x -> x < k))")
    rows = rows.withColumn("b", block.cast("int")).select("doc_id", "text", "k", "b")
    firsts = sorted((r["b"], r["k"]) for r in rows.groupBy("b").agg(F.max("k").alias("k")).collect())
    tail = F.lit(None).cast("int")
    if firsts:
        to = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}  # the first block's first closes the circle
        tail = F.element_at(F.create_map([F.lit(x) for pair in to.items() for x in pair]), F.col("k"))
        tail = F.when(F.col("k").isin(list(to)), tail)
    both = rows.withColumn("z", F.explode(F.filter(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("tail")), F.struct(tail.alias("b"), F.lit(1).alias("tail"))), lambda s: s["b"].isNotNull())))
    return both.select(F.col("z.b").alias("b"), F.col("z.tail").alias("tail"), "k", "doc_id", "text").repartition(max(1, len(firsts) // 8), "b").sortWithinPartitions("b", "tail", F.desc("k"), "text")


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by the first as many code points of what follows, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document, with its likeness to its edited text and to the next document."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for its next
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for r in rows:
                r["f"] = fingerprint(r["text"].encode())
                if held is not None and held["b"] == r["b"] and not held["tail"]:
                    out.append((held, r))
                held = r
            cols: list[list] = [[] for _ in names]
            if out:
                made = []
                for r, nxt in out:
                    e = edited(r["text"], nxt["text"]).encode()
                    made.append((r, nxt, hashlib.sha256(e).hexdigest(), r["f"] if e == r["text"].encode() else fingerprint(e)))
                to_edited = likeness([(r["f"], f) for r, _, _, f in made])
                to_next = likeness([(r["f"], nxt["f"]) for r, nxt, _, _ in made])
                for (r, _, sha, f), x, y in zip(made, to_edited, to_next):
                    for c, v in zip(cols, (r["doc_id"], len(r["text"]), sha, r["f"], f, float(x), float(y))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return map_arrow(with_next(docs), scan, SCHEMA)
