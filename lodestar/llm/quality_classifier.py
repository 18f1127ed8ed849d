"""Operator 6, quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is drawn from all documents, labelled or not, without
looking at labels. A logistic
model over counts of word shapes and a few shares of the text minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the class prior estimated from the data: over the upper score sets of a positive-versus-unlabelled model on rows kept
apart, the least ratio of unlabelled to positive shares.

Training reads at most TRAIN_ROWS documents, half of them trusted positives and half from the whole table: of each kind those
with the smallest hash of their id, outside the held-out quarter (crc32 of the id as text, mod 4, is 2). Every document is
scored where it lies.

Defined cases: null or empty text has the features of no words and a score; a null id counts as the text ''; without a
positive label every score is the prior 0.5; rows that repeat are scored each; documents labelled twice count as good if
any label says so; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import MEMO_WORDS, map_arrow, only, raw_bytes

TRAIN_ROWS, SHAPES, EXTRA = 12_000, 1024, 12
DIM = SHAPES + EXTRA
PREDICT = 0.7

#: Byte classes: small letters (and all beyond ASCII), capitals, figures; white space and signs stand for themselves.
_CLASS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_SIGN = np.array([33 <= c < 127 and c not in (48, 65, 97) for c in range(256)])


class Places(dict):
    """Place of a shape, remembered."""

    def __missing__(self, shape: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[shape] = zlib.crc32(shape) % SHAPES
        return got


def features(text: bytes | None, places: Places) -> np.ndarray:
    """Shares of word shapes (runs of one class are one character, runs of one sign two at most), and shares of the whole text."""
    text = text or b""
    words = text.split()
    n = len(words)
    out = np.zeros(DIM, np.float32)
    if n:
        c = np.frombuffer(text.translate(_CLASS), np.uint8)
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        second = new.copy()
        second[1:] |= new[:-1]
        shapes = c[new | second & _SIGN[c]].tobytes().split()
        out[:SHAPES] = np.sqrt(np.bincount(np.fromiter(map(places.__getitem__, shapes), np.int64, len(shapes)), minlength=SHAPES) / n)
        count = np.bincount(c, minlength=128)
        size = sum(map(len, words))
        lines = [x for x in text.split(b"\n") if x.strip()]
        lower, upper, digits = float(count[97]), float(count[65]), float(count[48])
        out[SHAPES:] = [
            1.0, math.log1p(n) / 10, size / n / 10, 1 - (lower + upper) / size, upper / size, digits / size, 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / n,
            float(count[44]) / n, sum(float(count[x]) for x in b"#*$%&|<>") / size, math.log1p(n / max(1, len(lines))) / 5, float(count[33] + count[46] + count[63]) / n,
        ]
    else:
        out[SHAPES] = 1.0
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(grad, dim: int, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for t in range(1, steps + 1):
        g = grad(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The least ratio of unlabelled to positive shares above a score, over scores that a fifth of the positives reach."""
    a, b = slice(0, None, 2), slice(1, None, 2)
    p, u = pos[a], unl[a]

    def grad(w):
        return -((1 - _sigmoid(p @ w)) @ p) / len(p) + (_sigmoid(u @ w) @ u) / len(u)

    w = _adam(grad, pos.shape[1], steps=150)
    sp, su = np.sort(pos[b] @ w), np.sort(unl[b] @ w)
    if not len(sp) or not len(su):
        return 0.5
    t = np.quantile(sp, np.linspace(0.0, 0.8, 41))
    share_p, share_u = 1 - np.searchsorted(sp, t) / len(sp), 1 - np.searchsorted(su, t) / len(su)
    return float(np.clip((share_u / share_p).min(), 0.05, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative risk of the logistic loss."""

    def grad(w):
        zp, zu = pos @ w, unl @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        gain = -((1 - sp) @ pos) / len(pos)
        neg_u, neg_p = (su @ unl) / len(unl), (sp @ pos) / len(pos)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # below zero the unlabelled part has been overfitted: step back from it
        return prior * gain + (neg_u - prior * neg_p) if risk >= 0 else -(neg_u - prior * neg_p)

    return _adam(grad, pos.shape[1])


def _held(ids) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i in ids], bool)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights and class prior."""

    def drawn(ids: DataFrame) -> DataFrame:
        """The half of rows with the smallest hashes, outside the held-out quarter."""
        seen = ids.where("doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
        return seen.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)

    good = drawn(only(labels, "doc_id", "quality").where("quality = 1"))
    web = drawn(only(docs, "doc_id"))
    # at most rows ids
    sample = good.withColumn("p", F.lit(1)).unionByName(web.withColumn("p", F.lit(0))).groupBy("doc_id").agg(F.max("p").alias("trusted"), F.min("p").alias("web"))
    sample = sample.select("doc_id", (F.col("trusted") == 1).alias("trusted"), (F.col("web") == 0).alias("web"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for b in batches:
            vectors = [features(t, places).astype(np.float16).tobytes() for t in raw_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), *b.columns[1:]], ["x", "trusted", "web", "doc_id"])

    # one row an id, the one with the smallest hash: an id that repeats neither outweighs others nor fills the driver
    each = only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text")))
    picked = each.groupBy("doc_id", "trusted", "web").agg(one.alias("text")).select("text", "trusted", "web", "doc_id")
    got = map_arrow(picked, read, "x binary, trusted boolean, web boolean, doc_id long").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    if not got.num_rows:
        return np.zeros(DIM), 0.5
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)
    trusted, unlabelled = (np.array(got[c].to_pylist(), bool) for c in ("trusted", "web"))
    if not trusted.any():
        return np.zeros(DIM), 0.5
    pos, unl = x[trusted], x[unlabelled] if unlabelled.any() else x
    prior = class_prior(pos, unl)
    return fit(pos, unl, prior), prior


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    weights, _ = train(docs, labels, rows)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            s = _sigmoid(np.array([features(t, places) @ sent.value for t in raw_bytes(b.column(1))], np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_held(ids)), pa.array(s), pa.array((s >= PREDICT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, SCHEMA)
