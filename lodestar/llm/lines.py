"""Operator 13, line deduplication: levelled sorted runs of line hashes. SQL functions only.

Documents come in batches. A batch's lines become keys (blanks at both ends stripped, A-Z lower-cased), the keys 128-bit
hashes with the number of the batch's documents that hold them; equal keys are added up in the tasks that read them. A batch
then merge-anti-joins the runs: keys that a run has found often enough are settled and leave the batch; what is left is
written as a run of its own, sorted and bucketed by hash, at level 0. When a level has FANOUT runs, they are merged, counts
added, into one run of the next level; so the runs a batch meets stay few and each key is rewritten once a level. Runs share
one bucketing, so a batch that meets them moves alone, and only a merge shuffles runs. With ``least=1`` the anti-join is the
usual incremental one: what comes through are the lines that no earlier batch had.

The keys found in ``least`` documents or more, over all runs, then go back: lines whose bit is set in a bitmap of fixed size
built from them are candidates (others stay in place), an exact join settles these (keys with much of the rows meet them where
they lie, see ``meet``), and each document gets the places of its lines to drop.

Defined cases: null and empty texts are one empty line; empty keys are never dropped; a text of nothing but dropped lines
becomes empty; a line that repeats within a document counts once; rows that repeat, or share an id, are documents of their own;
null ids are kept; an empty table gives no rows; ``cleaned`` keeps extra columns, whatever their names, ``drop`` ignores them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import place_of, cut, meet, only, scratch

BLANKS = " \t\n\x0b\x0c\r"
LEAST, MIN_CHARS, FANOUT, BATCHES = 10, 1, 3, 6
#: Bits of the map of frequent keys, as a power of two: a fuller map lets more lines through to the join, which is exact.
BITS = 23
_HASH = ["hi", "lo"]


def keys_of(text: Column) -> Column:
    """The key of each line."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # lower() is the quick way where all letters are ASCII
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.transform(F.split(low, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def hashed(key: str) -> list[Column]:
    return [F.xxhash64(F.lit(1), key).alias("hi"), F.xxhash64(F.lit(2), key).alias("lo")]


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def document_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """hi, lo and n, the number of documents with a line of that key; docs: text."""
    keys = F.array_distinct(F.filter(keys_of(_text()), lambda k: F.char_length(k) >= max(min_chars, 1)))
    return docs.select(F.explode(keys).alias("key")).select(*hashed("key")).groupBy(*_HASH).agg(F.count("*").alias("n"))


@dataclass
class Runs:
    """Levelled sorted runs in the shared folder; levels[i] has the (table, path) of the runs of level i."""

    spark: SparkSession
    least: int = LEAST
    fanout: int = FANOUT
    levels: list[list[tuple[str, str]]] = field(default_factory=list)
    buckets: int = 0

    def __post_init__(self) -> None:
        # the number of partitions of the batches' own exchange: a run is written and met without another one
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """batch (hi, lo, n) without the keys that some run has found least times."""
        return reduce(lambda rows, run: rows.join(run.where(F.col("n") >= self.least).select(*_HASH), _HASH, "left_anti"), self.tables(), batch)

    def add(self, batch: DataFrame) -> None:
        """The batch's unsettled keys become a run; full levels are merged into the next ones."""
        self._put(self.unsettled(batch), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._put(self._sum(merged), level + 1)
            self._forget(merged)
            level += 1

    def totals(self) -> DataFrame:
        """hi, lo and n over all runs; n is exact below least."""
        return self._sum([x for level in self.levels for x in level])

    def close(self) -> None:
        """The names leave the catalog; files stay in the shared folder, since results may still read them."""
        self._forget([x for level in self.levels for x in level])
        self.levels = []

    def _put(self, rows: DataFrame, level: int) -> None:
        name, path = f"lodestar_run_{uuid.uuid4().hex}", scratch(self.spark)
        rows.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", path).option("compression", "zstd").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _sum(self, runs: list[tuple[str, str]]) -> DataFrame:
        # read by path as one scan: a union of bucketed tables claims their bucketing but doesn't put equal buckets together
        rows = self.spark.read.schema("hi long, lo long, n long").parquet(*[path for _, path in runs])
        return rows.groupBy(*_HASH).agg(F.sum("n").alias("n"))


def frequent(batches: Iterable[DataFrame], least: int = LEAST, min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> DataFrame:
    """hi, lo: the keys found in least documents or more over all batches (each with the column text)."""
    runs: Runs | None = None
    for batch in batches:
        runs = runs or Runs(batch.sparkSession, least, fanout)
        runs.add(document_keys(batch, min_chars))
    found = cut(runs.totals().where(F.col("n") >= least).select(*_HASH))
    runs.close()
    return found


def _candidates(rows: DataFrame, often: DataFrame, bits: int) -> DataFrame:
    """id, th, place, hi, lo of the lines whose bit is set by a frequent key."""

    def cell() -> Column:
        return F.pmod(F.col("hi"), F.lit(2**bits))

    words = often.groupBy(F.floor(cell() / 64).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell() % 64).cast("int"))).alias("v"))
    every = often.sparkSession.range(2**bits // 64).join(words, "id", "left").na.fill(0)
    sent = every.agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("s")).select(F.transform("s", lambda x: x["v"]).alias("s")).scalar()
    lines = rows.select("id", "th", F.posexplode(keys_of(F.col("text"))).alias("place", "key")).select("id", "th", "place", *hashed("key"))
    return lines.where(F.getbit(F.get(sent, F.floor(cell() / 64).cast("int")), (cell() % 64).cast("int")) == 1)


def _identified(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, text, and what names a row: its id and its text's hash. Rows that are equal in both drop the same lines."""
    return docs.select(*keep, _text().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(_text()).alias("th"))


def _dropped(docs: DataFrame, often: DataFrame, keep: list[str], bits: int) -> DataFrame:
    """keep, n_lines, n_dropped, kept of docs (keep, doc_id, text)."""
    near = cut(_candidates(_identified(docs), often, bits))
    counts = cut(near.groupBy(*_HASH).agg(F.count("*").alias("n")).join(often, _HASH))
    total = counts.agg(F.sum("n")).first()[0] or 0
    drops = meet(near, counts, _HASH, "n", total).groupBy("id", "th").agg(F.collect_set("place").alias("drops"))
    rows = _identified(docs, *keep).join(drops, ["id", "th"], "left")
    lines = F.split("text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drops"), lambda i: F.get(lines, i))
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.select(*keep, (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def drop(docs: DataFrame, batches: Iterable[DataFrame] | None = None, least: int = LEAST, min_chars: int = MIN_CHARS, fanout: int = FANOUT, bits: int = BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text without its frequent lines) of every document. batches: the parts of
    docs in the order in which they came (each with text); docs at once where none are given."""
    often = frequent(batches or [docs], least, min_chars, fanout)
    return _dropped(only(docs, "doc_id", "text"), often, ["doc_id"], bits)


def cleaned(docs: DataFrame, batches: Iterable[DataFrame] | None = None, least: int = LEAST, min_chars: int = MIN_CHARS, fanout: int = FANOUT, bits: int = BITS) -> DataFrame:
    """docs with their frequent lines dropped from text; the columns stay."""
    often = frequent(batches or [docs], least, min_chars, fanout)
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, doc_id = (F.col(f"c{place_of(docs, n)}").alias(n) for n in ("text", "doc_id"))
    out = _dropped(flat.select("*", text, doc_id), often, flat.columns, bits)
    return out.select(*[(F.col("kept") if i == place_of(docs, "text") else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def by_files(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """A table's files dealt in order to so many batches (fewer where it has fewer files): each file is read for one batch."""
    files = sorted(docs.inputFiles())
    size = max(1, -(-len(files) // batches))
    return [docs.sparkSession.read.schema(docs.schema).parquet(*files[i : i + size]) for i in range(0, len(files), size)] or [docs]
