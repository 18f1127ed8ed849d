"""Operator 4, LM scoring by cross-entropy difference.

Two bigram models with one order, vocabulary and smoothing: the target's counts come from the documents labelled good, the
background's from every document, then thinned token by token (binomially, fixed seed) to the target's size, so that
neither model knows more words for being larger. Every word and every pair of words has its own count: they are told apart
by 64-bit hashes, and what is counted grows with the corpus. The vocabulary's size V is the number of different words.
Pairs back off to words, words to a uniform floor:

    p1(w) = (c(w) + FLOOR) / (n + FLOOR V),  p2(w | v) = (min(c(v, w), c(v)) + BACK p1(w)) / (c(v) + BACK)

A document's own share of each count is taken out of the models that hold it before it is scored, so that having been
counted is no advantage. score is the mean over its words of target loss minus background loss; the lower, the nearer the target, and up to THRESHOLD
a document is selected (copies of a document raise its score: they stay in the background).

Documents are dealt by a hash of their ids into blocks of about BLOCK_BYTES of text, as many as the input asks for. A block
adds up its words and pairs before anything moves, so that a very common one moves once a block; it sends their sorted
hashes and counts to buckets of the hash space, again as many as the input asks for. A bucket totals them over all blocks
and sends the totals back to each block, in the block's own order, so no hash travels twice. Blocks and buckets follow from
the rows alone: a lost task is done again with the same result. Nothing but three sums comes to the driver.

Defined cases: null or empty text: no words, losses and score 0, not selected; without labels both models are the
background's share of nothing and scores depend on the floor alone; rows that repeat are counted and scored each, and a
document that is labelled twice counts once; a null id is never labelled; an empty table gives no rows; extra columns are
ignored. All rows of one id are in one block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, mix, only, raw_bytes, small_batches, word_hashes

FLOOR, BACK, SEED, THRESHOLD = 0.1, 4.0, 20_240_601, 1.5
#: Text in a block, and the text whose words and pairs a bucket totals.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
LARGE = 40
_START = np.array([0x243F6A8885A308D3], np.uint64)
_ONE = np.uint64(1)


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers as compressed bytes: all first bytes, then all second ones, and so on."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(raw: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1).T).view(kind).ravel()


def grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the texts in turn: its hash (an even number), that of the pair with the word before it (odd; the
    first word's is with the start of the text), and the place of its text."""
    split = [(t or b"").split() for t in texts]
    length = np.array([len(x) for x in split], np.int64)
    w = word_hashes([x for words in split for x in words])
    v = np.concatenate([_START, w[:-1]]) if len(w) else w
    v[(np.cumsum(length) - length)[length > 0]] = _START[0]
    return w & ~_ONE, mix(v, w, 61) | _ONE, np.repeat(np.arange(len(texts)), length)


def thin(g: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """A binomial share of each n, which depends on g, n and the seed alone: the inverse of the distribution at a uniform
    number, or, where both shares are over LARGE on average, the normal distribution's."""
    if rate >= 1 or rate <= 0:
        return (n if rate >= 1 else n * 0).astype(np.int64)
    u = ((mix(g, g, SEED) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    q = min(rate, 1 - rate)  # the smaller share is drawn
    m = np.zeros(len(n), np.int64)
    large = n * q > LARGE
    if large.any():
        k, turn = n[large].astype(np.float64), 2 * math.pi * (mix(g[large], g[large], SEED + 1) >> np.uint64(11)).astype(np.float64) / 2.0**53
        m[large] = np.clip(np.rint(k * q + np.sqrt(k * q * (1 - q)) * np.sqrt(-2 * np.log(u[large])) * np.cos(turn)), 0, k)
    left = np.flatnonzero(~large)
    k, u = n[left].astype(np.float64), u[left]
    mass, i = (1 - q) ** k, 0
    while len(left):
        u = u - mass
        up = (u >= 0) & (i < k)
        left, k, u = left[up], k[up], u[up]
        mass = mass[up] * (k - i) / (i + 1) * (q / (1 - q))
        i += 1
        m[left] = i
    return m if q == rate else n - m


def _good(ids: pa.ChunkedArray, labelled: pa.Table) -> np.ndarray:
    """Which ids are in labelled (doc_id), a null never."""
    known = labelled["doc_id"].drop_null().to_numpy() if labelled.num_rows else np.zeros(0, np.int64)
    return ids.is_valid().to_numpy() & np.isin(ids.fill_null(0).to_numpy(), known)


def counts(placed: DataFrame, good: DataFrame, bits: int) -> DataFrame:
    """bucket, block, g (sorted differences of hashes), n, t: a block's words and pairs of one bucket with their counts over
    all of its documents (n) and over the good ones (t). placed: block, doc_id, text; good: block, doc_id."""

    def count(docs: pa.Table, labelled: pa.Table) -> pa.Table:
        if not docs.num_rows:  # a side without rows comes without columns
            return schema.empty_table()
        w, p, owner = grams(raw_bytes(docs["text"]))
        own = _good(docs["doc_id"], labelled)[owner].astype(np.float64)
        g, at = np.unique(np.concatenate([w, p]), return_inverse=True)
        n, t = np.bincount(at, minlength=len(g)), np.bincount(at, weights=np.concatenate([own, own]), minlength=len(g)).astype(np.int64)
        bucket = (g >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(g), np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits)) if len(g) else np.zeros(1, np.int64)
        block = docs["block"][0].as_py()
        rows = [(int(bucket[a]), block, packed(np.diff(g[a:b], prepend=np.uint64(0))), packed(n[a:b]), packed(t[a:b])) for a, b in zip(edges[:-1], edges[1:])]
        return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("g", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])
    return placed.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(count, "bucket long, block long, g binary, n binary, t binary")


def totals(counted: DataFrame) -> DataFrame:
    """block, bucket, n, t: the counts over all blocks of a block's words and pairs; and, where block is null, words (how
    many different ones there are), n_words and t_words of the bucket."""

    def total(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        every = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in rows["g"].to_pylist()]
        g, at = np.unique(np.concatenate(every), return_inverse=True)
        n, t = (np.bincount(at, weights=np.concatenate([unpacked(x) for x in rows[c].to_pylist()]), minlength=len(g)).astype(np.int64) for c in "nt")
        word = (g & _ONE) == 0
        out, a = [{"bucket": key[0].as_py(), "words": int(word.sum()), "n_words": int(n[word].sum()), "t_words": int(t[word].sum())}], 0
        for block, x in zip(rows["block"].to_pylist(), every):
            mine = at[a : a + len(x)]
            out.append({"block": block, "bucket": key[0].as_py(), "n": packed(n[mine]), "t": packed(t[mine])})
            a += len(x)
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.binary()), ("t", pa.binary()), ("words", pa.int64()), ("n_words", pa.int64()), ("t_words", pa.int64())])
    return counted.groupBy("bucket").applyInArrow(total, "block long, bucket long, n binary, t binary, words long, n_words long, t_words long")


def losses(texts: list, good: np.ndarray, n: np.ndarray, t: np.ndarray, vocabulary: int, n_full: int, n_aim: int) -> list[np.ndarray]:
    """Of each text: its words, and the sums of its target and background losses. n, t: totals of the texts' different words
    and pairs, in the order of their hashes."""
    w, p, owner = grams(texts)
    g, at = np.unique(np.concatenate([w, p]), return_inverse=True)
    if len(g) != len(n):
        raise ValueError("a block's totals are not those of its words and pairs")
    rate = min(1.0, n_aim / max(1, n_full))
    m, start = thin(g, n, rate), np.diff(owner, prepend=-1) > 0
    size = np.bincount(owner, minlength=len(texts))

    def own(places: np.ndarray) -> np.ndarray:
        """How often each word's own text has it."""
        _, i, k = np.unique(owner * len(g) + places, return_inverse=True, return_counts=True)
        return k[i].astype(np.float64)

    def before(x: np.ndarray) -> np.ndarray:
        return np.where(start, 0, np.concatenate([[0], x[:-1]])) if len(x) else x

    one, two = at[: len(w)], at[len(w) :]
    own_w, own_p = own(one), own(two)
    inside, out = good[owner].astype(np.float64), [size]
    for model, whole, part, total, all_words in ((t, t, inside, n_aim, n_aim), (m, n, np.ones(len(w)), rate * n_full, n_full)):
        left_w = model[one] * (1 - part * own_w / np.maximum(np.maximum(whole[one], own_w), 1))
        left_p = model[two] * (1 - part * own_p / np.maximum(np.maximum(whole[two], own_p), 1))
        left_v, mine = before(left_w), size[owner]
        p1 = (left_w + FLOOR) / (total * (1 - part * mine / np.maximum(np.maximum(mine, all_words), 1)) + FLOOR * vocabulary)
        out.append(np.bincount(owner, weights=-np.log((np.minimum(left_p, left_v) + BACK * p1) / (left_v + BACK)), minlength=len(texts)))
    return out


SCHEMA = "doc_id long, n_words long, target_loss double, background_loss double, score double, selected boolean"


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row for each document."""
    docs = small_batches(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, bits = max(1, math.ceil(size / block_bytes)), max(0, math.ceil(math.log2(max(1, size / bucket_bytes))))
    block = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(blocks)).alias("block")
    placed = docs.select(block, "doc_id", "text")
    good = only(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # written once: no column of it is one of docs', whatever table both were taken from
    good = cut(good.withColumn("text", F.lit(None).cast("string")).select(block, "doc_id"))
    found = cut(totals(counts(placed, good, bits)))
    vocabulary, n_full, n_aim = found.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n_words", "t_words"))).first()
    known = found.where("block is not null").select("block", "bucket", "n", "t", F.lit(None).cast("long").alias("doc_id"))
    known = known.unionByName(good, allowMissingColumns=True)

    def rate(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        order = known.filter(known["bucket"].is_valid()).sort_by("bucket").select(["n", "t"]) if known.num_rows else pa.table({"n": [], "t": []})
        n, t = (np.concatenate([np.zeros(0, np.int64), *map(unpacked, order[c].to_pylist())]) for c in "nt")
        words, a, b = losses(raw_bytes(docs["text"]), _good(docs["doc_id"], known), n, t, vocabulary, n_full, n_aim)
        each = np.maximum(words, 1)
        s = (a - b) / each
        return pa.table([docs["doc_id"], pa.array(words.astype(np.int64)), pa.array(a / each), pa.array(b / each), pa.array(s), pa.array((words > 0) & (s <= threshold))], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), *((c, pa.float64()) for c in ("target_loss", "background_loss", "score")), ("selected", pa.bool_())])
    return placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(rate, SCHEMA)
