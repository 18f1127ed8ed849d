"""Operator 8, substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words of one document. A word goes if a window that covers it also starts in a document
with a smaller id. A row's text is known by its id and the 128-bit hash of its sequence of words: windows, places and joins
go by that key, and ids alone decide which document comes first. Windows carry the hash only where an id may have several
texts (a bitmap, which misses none); their places get it back from the table of hashes.

Copies first: of documents with one sequence of words only the one with the smallest id takes part below; in the others
every window also starts in it. They are found by grouping 128-bit hashes of whole sequences.

First pass: a window's estimate is that of its anchor, the smallest hash among its GRAM-word grams; equal windows have equal
anchors, so an anchor occurs at least as often as any of its windows. Each task sketches the distinct anchors of each of
its documents (two rows of ``2**bits`` cells, eight times the anchors expected); the merged sketches overestimate, so every
window in two documents has an anchor whose cells all reach two. The merged sketch stays in Spark, whatever its size: anchors
meet their cells by joins, and each document gets the places of those that may repeat among its own.

Second pass: only windows with such an anchor leave the scan, as 128-bit hashes with their places. A task holds about HELD
of them at a time: of a window that several of those documents have, only the smallest id's moves, and the others are marked
at once, as runs of places. So a very common window moves once for each HELD windows. What moved is dealt by window, once,
and windows whose smallest id is below their own document's are marked. Marks come back to their documents;
documents that a bitmap of marked ids excludes never move.

Defined cases: null text: no words, hash of the empty string; fewer than ``width`` words: nothing to remove; rows that
repeat are one document (equal id), so neither removes the other, and so are several texts of one id; a null id is smaller than none: it loses to every id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import bit_set, bit_words, cut, distinct, id_bit, in_bitmap, map_arrow, meet, mix, ngrams, only, raw_bytes, signed, word_hashes

GRAM = 24
ID_BITS = 23
#: Windows that a task holds before it moves them.
HELD = 1 << 19
LAST = 2**63 - 1
#: The columns that tell one text from another.
TEXT = ["doc_id", "t_hi", "t_lo"]


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values, in linear time (prefix and suffix minima of blocks of k)."""
    n = len(x) - k + 1
    if k == 1:
        return x
    pad = -len(x) % k
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, k)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[k - 1 : k - 1 + n])


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window of width words."""
    gram = min(GRAM, width)
    return _sliding_min(ngrams(h, gram, 11), width - gram + 1) if len(h) >= width else np.zeros(0, np.uint64)


def cells(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's cell in each row of the sketch."""
    spread = mix(anchor, anchor, 23)
    mask = np.uint64((1 << bits) - 1)
    return (spread & mask).astype(np.int64), ((spread >> np.uint64(32)) & mask).astype(np.int64) + (1 << bits)


def sketch_bits(docs: DataFrame, width: int) -> int:
    """Cells for about eight times the anchors expected, 2**16 a row at least."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = chars / 6 * 2 / max(2, width - min(GRAM, width) + 2)
    return max(16, math.ceil(math.log2(8 * max(1, expected))))


def sketched(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """cell, n: the merged sketch where it reaches two."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            cell, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.minimum(count, 2), pa.int64())], ["cell", "n"])

        for b in batches:
            for text in raw_bytes(b.column(0)):
                a = anchors(word_hashes((text or b"").split()), width)
                if len(a):
                    # one count a document and cell: repeats within a document are no repeats
                    a = distinct(np.concatenate(cells(distinct(a), bits)))
                    held.append(a)
                    n += len(a)
            if n > 1 << 20:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return map_arrow(docs.select("text"), sketch, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 2")


def text_key(doc: int | None, words: list[bytes]) -> int:
    """64 bits for a row's text. Two texts that share them share their repeated anchors: more windows move, none is lost."""
    return xxhash.xxh3_64_intdigest(sequence(words), (0 if doc is None else doc) & (2**64 - 1)) - 2**63


def with_anchors(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """doc_id, text and anchors (places among the text's distinct anchors, in order) of the texts with anchors whose cells both reach two."""

    def list_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for doc, text in zip(b.column(0).to_pylist(), raw_bytes(b.column(1))):
                words = (text or b"").split()
                a = distinct(anchors(word_hashes(words), width))
                if len(a):
                    held.append((np.full(len(a), text_key(doc, words)), np.arange(len(a), dtype=np.int32), *cells(a, bits)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["key", "place", "one", "two"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [text_key(doc, (t or b"").split()) for doc, t in zip(b.column(0).to_pylist(), raw_bytes(b.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *b.columns], ["key", "doc_id", "text"])

    listed = map_arrow(docs, list_cells, "key long, place int, one long, two long")
    found = cut(sketched(docs, width, bits).select("cell"))
    for c in ("one", "two"):
        listed = listed.join(found.withColumnRenamed("cell", c), c).drop(c)
    each = listed.groupBy("key").agg(F.collect_set("place").alias("anchors"))
    return map_arrow(docs, keyed, "key long, doc_id long, text string").join(each, "key").drop("key")


def sequence(words: list[bytes]) -> bytes:
    """128-bit hash of a sequence of words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def signed_texts(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs with t_hi and t_lo, the hash of the words; without the text if asked so."""
    keep = [c for c in docs.columns if with_text or c != "text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(sequence((t or b"").split()) for t in raw_bytes(b.column(b.schema.get_field_index("text"))))
            two = np.frombuffer(raw, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], [*keep, "t_hi", "t_lo"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_arrow(docs, sign, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", t_hi long, t_lo long")


def _runs(key: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that start a run of consecutive places of one text (rows are in order), and the lengths of the runs."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(at))


def candidate_windows(docs: DataFrame, width: int, several: np.ndarray) -> DataFrame:
    """hi, lo, the text's key, at (all of a window's places in the text), run: windows whose anchors may repeat (run 0), and
    runs of windows that are marked already.

    The key has zeros for the hash where the id has one text. docs: doc_id, text, anchors."""
    sent = docs.sparkSession.sparkContext.broadcast(several)
    names = ["hi", "lo", *TEXT, "at", "run"]

    def out(held: list) -> Iterator[pa.RecordBatch]:
        hi, lo, doc, t_hi, t_lo, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, t_lo, t_hi, doc, lo, hi))
        hi, lo, doc, t_hi, t_lo, at = (x[order] for x in (hi, lo, doc, t_hi, t_lo, at))
        new, text = np.ones(len(at), bool), np.ones(len(at), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        text[1:] = new[1:] | (doc[1:] != doc[:-1]) | (t_hi[1:] != t_hi[:-1]) | (t_lo[1:] != t_lo[:-1])
        moves = doc == doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        # one row for each window and text, with all of its places
        first = np.flatnonzero(text & moves)
        yield from batches_of([x[first] for x in (hi, lo, doc, t_hi, t_lo)], at[moves], np.flatnonzero(text[moves]), np.zeros(len(first), np.int32))
        doc, t_hi, t_lo, at = (x[~moves] for x in (doc, t_hi, t_lo, at))
        order = np.lexsort((at, t_lo, t_hi, doc))
        doc, t_hi, t_lo, at = (x[order] for x in (doc, t_hi, t_lo, at))
        first, run = _runs([doc, t_hi, t_lo], at)
        yield from batches_of([doc[first], at[first].astype(np.int64), doc[first], t_hi[first], t_lo[first]], at[first], np.arange(len(first)), run.astype(np.int32))

    def batches_of(cols: list, places: np.ndarray, starts: np.ndarray, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.append(starts, len(places)).astype(np.int32)
        for a in range(0, len(run), 1 << 16):
            part = slice(a, a + (1 << 16))
            edge = edges[a : a + (1 << 16) + 1]
            at = pa.ListArray.from_arrays(pa.array(edge - edge[0]), pa.array(places[edge[0] : edge[-1]]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in cols), at, pa.array(run[part])], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for doc, text, full, places in zip(b.column(0).to_pylist(), raw_bytes(b.column(1)), bit_set(sent.value, b.column(2).to_numpy()), b.column(3).to_pylist()):
                words = (text or b"").split()
                h = word_hashes(words)
                a = anchors(h, width)
                each = distinct(a)
                repeated = np.zeros(len(each), bool)
                repeated[[x for x in places if x < len(each)]] = True
                at = np.flatnonzero(repeated[np.searchsorted(each, a)])
                if len(at):
                    key = np.frombuffer(sequence(words) if full else bytes(16), np.int64)
                    held.append((signed(ngrams(h, width, 31)[at]), signed(ngrams(h, width, 47)[at]), *(np.full(len(at), x, np.int64) for x in (LAST if doc is None else doc, *key)), at.astype(np.int32)))
                    n += len(at)
                if n > HELD:
                    yield from out(held)
                    held, n = [], 0
        if n:
            yield from out(held)

    asked = docs.select("doc_id", "text", id_bit("doc_id", ID_BITS).alias("_bit"), "anchors")
    return map_arrow(asked, scan, "hi long, lo long, doc_id long, t_hi long, t_lo long, at array<int>, run int")


def copies(texts: DataFrame) -> DataFrame:
    """The keys of the texts whose whole sequence of words is that of a document with a smaller id. A class may hold a
    third of all rows: these stay where they are, and its smallest id is sent to them."""
    texts = texts.withColumn("t", F.struct("t_hi", "t_lo"))
    least = texts.groupBy("t").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("many")).where("least < most").drop("most")
    return cut(meet(texts, cut(least), "t", "many", texts.count()).where("doc_id > least").select(*TEXT).distinct())


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs (doc_id, text) less the texts in keys; only what a bitmap of ids lets through is joined."""
    bits = bit_words(keys, id_bit("doc_id", ID_BITS), ID_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~bit_set(sent.value, b.column(0).to_numpy()))).select(["doc_id", "text"])

    clear = map_arrow(docs.select(id_bit("doc_id", ID_BITS).alias("_bit"), "doc_id", "text"), outside, "doc_id long, text string")
    asked = signed_texts(in_bitmap(docs, "doc_id", bits, ID_BITS, ["doc_id", "text"]))
    return clear.unionByName(asked.join(keys, TEXT, "left_anti").select("doc_id", "text"))


def removed_places(docs: DataFrame, texts: DataFrame, width: int = 50, bits: int | None = None) -> DataFrame:
    """A text's key, at, run (arrays): starts of the windows that also start in a document with a smaller id, and how many
    places from there on start one too."""
    bits = bits or sketch_bits(docs, width)
    several = texts.groupBy("doc_id").agg(F.min(F.struct("t_hi", "t_lo")).alias("x"), F.max(F.struct("t_hi", "t_lo")).alias("y")).where("x != y")
    several = bit_words(several, id_bit("doc_id", ID_BITS), ID_BITS)
    windows = candidate_windows(with_anchors(docs, width, bits), width, several)
    # a window and its smallest id side by side: dealt once, and a window has one row for each HELD windows of a task
    least = F.min("doc_id").over(Window.partitionBy("hi", "lo"))
    gone = windows.withColumn("least", least).where("run > 0 or doc_id > least").select(*TEXT, F.explode("at").alias("at"), "run")
    gone = gone.groupBy(*TEXT).agg(F.collect_list(F.struct("at", F.greatest("run", F.lit(1)).alias("run"))).alias("r"))
    gone = cut(gone.select(*TEXT, F.col("r.at").alias("at"), F.col("r.run").alias("run")))
    plain = gone.where("t_hi = 0 and t_lo = 0").select("doc_id", "at", "run").join(texts.distinct(), "doc_id").select(*TEXT, "at", "run")
    return gone.where("t_hi != 0 or t_lo != 0").unionByName(plain)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def strip(docs: DataFrame, width: int = 50, with_text: bool = False, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a space; with_text adds them as kept_text."""
    docs = only(docs, "doc_id", "text")
    key = F.coalesce("doc_id", F.lit(LAST).cast("long"))
    keyed = docs.select(key.alias("doc_id"), "text")
    hashes = cut(signed_texts(keyed, with_text=False))
    whole = copies(hashes)
    places = removed_places(without(keyed, whole), hashes, width, bits)
    # an empty array of places stands for every window
    none = F.array().cast("array<int>")
    places = cut(places.unionByName(whole.select(*TEXT, none.alias("at"), none.alias("run"))))
    marked = bit_words(places, id_bit("doc_id", ID_BITS), ID_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(marked)
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["kept_text"] * with_text
    kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)

    def kept(ids, texts, starts, runs) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names]
        for doc, text, at, run in zip(ids, texts, starts, runs):
            words = (text or b"").split()
            n = len(words)
            if at is not None and len(at) == 0 and n >= width:
                words = []
            elif at is not None and len(at):
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, np.asarray(at), 1)
                np.add.at(edge, np.asarray(at) + np.asarray(run) - 1 + width, -1)
                words = [w for w, c in zip(words, np.cumsum(edge[:n])) if not c]
            joined = b" ".join(words)
            row = [doc, n, n - len(words), hashlib.sha256(joined).hexdigest()] + [joined.decode()] * with_text
            for c, v in zip(cols, row):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~bit_set(sent.value, b.column(0).to_numpy())))
            yield kept(b.column(1).to_pylist(), raw_bytes(b.column(2)), [None] * b.num_rows, [None] * b.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield kept(b.column(0).to_pylist(), raw_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist())

    schema = SCHEMA + ", kept_text string" * with_text
    keyed = docs.withColumn("key", key)
    rest = map_arrow(keyed.select(id_bit("key", ID_BITS).alias("_bit"), "doc_id", "text"), untouched, schema)
    some = signed_texts(in_bitmap(keyed, "key", marked, ID_BITS, ["key", "doc_id", "text"]))
    some = some.join(places.withColumnRenamed("doc_id", "key"), ["key", "t_hi", "t_lo"], "left")
    return rest.unionByName(map_arrow(some.select("doc_id", "text", "at", "run"), touched, schema))
