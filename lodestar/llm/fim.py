"""Operator 12, fill-in-the-middle transformation: a streaming matcher in two passes.

A text's units are runs of blanks with the word behind them. The first pass runs the matcher over the text and only counts
units; the second runs it again, lazily, and stops at the larger of two drawn ranks, noting where the smaller one ends. What
is held beside the text are two counters and two places: no array of units is ever made, whatever the text's length.

The draws are hashes of seed and id, so a retried or repeated task makes the same cut. Texts are cut where they lie: the plan
is a scan and a map, without a shuffle. Output batches are closed after OUT_BYTES, so that many long texts in one input batch
don't pile up.

Defined cases: a null text is empty; empty texts and texts that hold a marker stay plain; a null id is drawn as an empty
string; rows that repeat are each transformed alike; a prefix, middle or suffix may be empty; an empty table gives no rows;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, only

#: A unit: blanks and the word behind them, or the blanks at the end.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Prefix, suffix, middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 42, 50, 80
OUT_BYTES = 4 << 20

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four groups of eight hex digits of the hash of seed and id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def unit_ends(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the unit of rank first and that of rank second (first <= second) end; 0 for rank 0."""
    units, a, b = UNIT.finditer(text), 0, 0
    for m in islice(units, first - 1, first) if first else ():
        a = m.end()
    b = a
    for m in islice(units, second - first - 1, second - first) if second > first else ():
        b = m.end()
    return a, b


def cut_text(text: str, doc_id: int | None, seed: int, rate: int, spm: int, markers: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    n, (h1, h2, h3, h4) = count_units(text), draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in markers):
        return n, "plain", None, None, text
    a, b = unit_ends(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = markers
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output, the text that
    is trained on. rate: percent of documents that are cut; spm: percent of these that have their suffix first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for at in range(batch.num_rows):
                doc_id, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py() or ""
                rows.append((doc_id, *cut_text(text, doc_id, seed, rate, spm, markers)))
                size += len(text)
                if size >= OUT_BYTES or at + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, _SCHEMA.replace(" long", "").replace(" string", "").split(", "))
                    rows, size = [], 0

    return map_arrow(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, _SCHEMA)


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from: a cut text holds no marker of its own, so the markers part it."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers))
    # psm: '', prefix, suffix, middle; spm: '', suffix, prefix, middle
    return F.when(F.col(form) == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))).when(F.col(form) == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(F.col(output))


def digests(rows: DataFrame) -> DataFrame:
    """rows of transform with the hashes of the output and of the text restored from it, in place of the output."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
