"""Operator 2, quality rules: counts that any text has, and a hashed n-gram log-likelihood ratio. SQL functions only.

Words and pairs of words are hashed to a fixed number of buckets. Two multinomials over the buckets are counted: the raw
corpus (every document) and the trusted target (documents labelled good). A document's score is the mean over its n-grams
of log(p_target / p_raw), so length cancels; it is kept if the base rules pass and the score is at least a fixed
threshold. Both are counted over all of their documents, whatever the size of the input. Labelled documents are found
exactly, by a join of those that a bitmap of labelled ids lets through; the other texts never move.

One pass counts (rows are pre-aggregated to at most ``2**bits`` buckets a task before they move), the next one scores
where the texts lie; the weights are one array of fixed length. Repeated three-word windows are found inside each row by
sorting (hash, position) pairs, so the cost is n log n whatever repeats.

Defined cases: a null or wordless text has zero counts and fails the base rules; rows that repeat are scored each;
without labels the ratio is zero and only the base rules decide; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import carried, cut, only, restored

BITS = 16
#: Bits of the map of labelled ids, as a power of two: a fuller map lets more through to the join, which is exact.
ID_BITS = 23
THRESHOLD = -0.1
SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def with_words(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, words (array), h (the words' 64-bit hashes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(*keep, text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    return words.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def buckets(h: str, bits: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    low = F.lit(2**bits - 1).cast("long")
    ones = F.transform(h, lambda a: a.bitwiseAND(low).cast("int"))
    twos = F.transform(
        F.arrays_zip(F.col(h).alias("a"), F.slice(F.col(h), 2, F.greatest(F.size(h) - 1, F.lit(0))).alias("b")),
        lambda s: F.when(s["b"].isNotNull(), s["a"].bitwiseXOR(F.shiftrightunsigned(s["b"], 19)).bitwiseAND(low).cast("int")),
    )
    return F.concat(ones, F.filter(twos, lambda x: x.isNotNull()))


def labelled(docs: DataFrame, good: DataFrame, bits: int = ID_BITS) -> DataFrame:
    """text and good: 1 where doc_id is in good (distinct, no nulls), null elsewhere; every row of docs once."""

    def cell() -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2**bits))

    words = good.groupBy(F.floor(cell() / 64).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell() % 64).cast("int"))).alias("v"))
    every = docs.sparkSession.range(2**bits // 64).join(words, "id", "left").na.fill(0)
    sent = every.agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("s")).select(F.transform("s", lambda x: x["v"]).alias("s")).scalar()
    maybe = F.coalesce(F.getbit(F.get(sent, F.floor(cell() / 64).cast("int")), (cell() % 64).cast("int")) == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    inside = docs.where(maybe).join(good.withColumn("good", F.lit(1)), "doc_id", "left").select("text", "good")
    return docs.where(~maybe).select("text", F.lit(None).cast("int").alias("good")).unionByName(inside)


def weights_rows(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """bucket, raw and target counts for every bucket, zeros included: 2**bits rows."""
    good = cut(only(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    rows = labelled(only(docs, "doc_id", "text"), good)
    parts = with_words(rows, "good").select("good", F.explode(buckets("h", bits)).alias("bucket"))
    counts = parts.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    every = docs.sparkSession.range(2**bits).select(F.col("id").cast("int").alias("bucket"))
    return cut(every.join(counts, "bucket", "left").na.fill(0))


def array_of(counts: DataFrame, bits: int = BITS) -> DataFrame:
    """One row, one array: log(p_target / p_raw) of each bucket, both smoothed by one; zeros without a target."""
    size = float(2**bits)
    t = counts.agg(F.sum("raw").alias("r"), F.sum("target").alias("t"), F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"))
    log = F.transform("cells", lambda s: F.when(F.col("t") > 0, F.log((s["target"] + 1.0) / (F.col("t") + size)) - F.log((s["raw"] + 1.0) / (F.col("r") + size))).otherwise(F.lit(0.0)))
    return t.select(log.alias("w"))


def repeated_words(h: str) -> Column:
    """Words inside three-word windows that occur twice or more in the row, the first occurrence included."""
    n = F.size(h)
    windows = F.transform(F.slice(F.col(h), 1, F.greatest(n - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(F.col(h), i + 1), F.get(F.col(h), i + 2)))

    def covered(t: Column) -> Column:
        pairs = F.sort_array(F.arrays_zip(t.alias("t"), F.sequence(F.lit(0), F.size(t) - 1).alias("i")))

        def places(p: Column) -> Column:
            hit = F.filter(p, lambda s, k: (s["t"] == F.get(p, k + 1)["t"]) | (s["t"] == F.get(p, k - 1)["t"]))
            return F.sort_array(F.transform(hit, lambda s: s["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return _let(_let(pairs, places), total)

    return _let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))


def score_rules(docs: DataFrame, labels: DataFrame, bits: int = BITS, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns keep), the base counts, base_failed, llr and kept."""
    keep = keep or ["doc_id"]
    log = array_of(weights_rows(docs, labels, bits), bits).scalar()
    rows = with_words(only(docs, *keep, "text"), *keep).select("*", buckets("h", bits).alias("grams"), log.alias("log"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    llr = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(F.col("log"), b)) / F.greatest(F.size("grams"), F.lit(1))
    counted = rows.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words("h").cast("long").alias("n_repeat_words"),
        llr.alias("llr"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def kept(docs: DataFrame, labels: DataFrame, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep; the columns stay."""
    scored = score_rules(carried(docs, "doc_id", "text"), labels, bits, threshold, keep=["_row"])
    # not a filter: Catalyst would push it down and work out the word hashes anew for every word
    return restored(scored.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")))
