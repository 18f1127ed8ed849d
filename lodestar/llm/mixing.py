"""Operator 7, mixing sources to target weights: temperature mixing. SQL functions only.

A source's share p of the tokens becomes the weight ``p**a / sum(p**a)``. The exponent a lies between 0 (all sources
equal) and 1 (as they come) and is bisected, sixteen sections at a time, over the table of sources: to a target entropy (in
nats, or as a share of the way from the natural entropy to the most there can be), or to the flattest mix in which no source
is repeated more than ``max_repeat`` times, or to what meets both. It is reported with the entropy that it gives.

The weights are realised against a token budget; without one, the smallest budget at which every document is used at least
once. A source is read in epochs, each a permutation of its documents by a hash of seed, epoch and id: whole ones first,
then the part of one that the rest of its quota pays for. The copy that would cross the quota's end is passed over, and of the
later ones the longest that fits the gap is taken. Where none fits, or a gap of more than a block's part would stay (few, long
documents), the copy that crosses is used after all, unless a budget is given, which is a ceiling. The mix is cut into ``blocks``, each a budget
of tokens by source: going through its source's epochs, a copy falls into the block in which its first token lies, so every
block holds each source's part of the block's budget to within one document. A document longer than that part fills the blocks
up to ``last_block``, where its last token lies.

No source is gathered: running sums are those of small hash ranges, summed up in two levels, then of one range's documents.

Defined cases: null or empty texts and sources without a token have no share, and their documents are used once if no
budget is given; a null source is a source; ties in the permutation go by id and repeated rows share their fate; an empty
table gives no rows; extra columns are kept by ``mixed`` and ignored by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import carried, cut, only, restored

SEED, BLOCKS, RANGE_DOCS, SPAN, SECTIONS, ROUNDS = 20_240_601, 64, 2000, 1000, 16, 6


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, target_entropy: float | None, max_repeat: float | None, budget: float | None) -> float:
    """The a that meets the entropy and the repetition limit; sources: source, n_tokens (some over 0)."""
    total = sources.agg(F.sum("n_tokens")).first()[0]
    shares = sources.where("n_tokens > 0").select((F.col("n_tokens") / F.lit(float(total))).alias("p"))

    def measures(a: float, i: int) -> list[Column]:
        w = F.pow("p", F.lit(a))
        return [F.sum(w).alias(f"z{i}"), F.sum(w * F.log("p")).alias(f"l{i}"), F.max(F.pow("p", F.lit(a - 1.0))).alias(f"m{i}"), F.min(F.pow("p", F.lit(a - 1.0))).alias(f"n{i}")]

    def fits(r, i: int, a: float) -> tuple[bool, bool]:
        """Whether the mix at a has the entropy at least, and whether it keeps to the repetition limit."""
        z, entropy = r[f"z{i}"], math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"]
        repeat = r[f"m{i}"] / r[f"n{i}"] if budget is None else r[f"m{i}"] / z * budget / total
        return target_entropy is None or entropy >= target_entropy, max_repeat is None or repeat <= max_repeat

    def bisect(good) -> tuple[float, float]:
        """The last a where good() holds and the first where it does not; good holds at low ends."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            row = shares.agg(*[c for i, a in enumerate(grid) for c in measures(a, i)]).first()
            ok = [good(row, i, a) for i, a in enumerate(grid)]
            last = max((i for i, x in enumerate(ok) if x), default=0)
            if last == SECTIONS or not ok[0]:
                return grid[last], grid[last]
            low, high = grid[last], grid[last + 1]
        return low, high

    # entropy falls with a; so does the highest repetition
    by_entropy = 0.0 if target_entropy is None else bisect(lambda r, i, a: fits(r, i, a)[0])[0]
    by_repeat = 0.0 if max_repeat is None else bisect(lambda r, i, a: a < 1.0 and not fits(r, i, a)[1])[1]
    return max(by_entropy, by_repeat)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_s", F.coalesce(F.col("source"), F.lit("\x00null")))


def _place(epoch: Column) -> Column:
    """Place in an epoch's permutation, 0 to 2**32 - 1."""
    return F.pmod(F.xxhash64(F.lit(SEED), epoch.cast("int"), F.coalesce(F.col("doc_id"), F.lit(-1).cast("long"))), F.lit(2**32)).cast("long")


def _me(place: str | Column) -> Column:
    """What tells a copy from the others of its epoch, in the epoch's order."""
    return F.struct((F.col(place) if isinstance(place, str) else place).alias("place"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("id"))


def _range(place: Column, ranges: Column) -> Column:
    return F.floor(place * ranges / F.lit(2**32)).cast("long")


def running(sums: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """sums (a row for each keys and at) with before: the sum of value over smaller places at. In two levels: no task holds
    more than SPAN places of a key, or a SPAN-th of them."""
    high = sums.withColumn("_high", F.col(at) / F.lit(SPAN)).withColumn("_high", F.floor("_high"))
    tops = high.groupBy(*keys, "_high").agg(F.sum(value).alias("_t"))
    tops = tops.select(*keys, "_high", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_high").rowsBetween(Window.unboundedPreceding, -1)).alias("_top"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_high").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    out = high.withColumn("_in", inside).join(tops, [*keys, "_high"])
    return out.withColumn("before", F.coalesce("_top", F.lit(0)) + F.coalesce("_in", F.lit(0))).drop("_high", "_top", "_in")


def entropy_of(sources: DataFrame, a: float) -> tuple[float, float]:
    """Entropy of the mix at a, and the most that so many sources allow."""
    w = F.pow(F.col("n_tokens").cast("double"), F.lit(a))
    r = sources.where("n_tokens > 0").agg(F.sum(w).alias("z"), F.sum(w * F.log(F.col("n_tokens").cast("double"))).alias("l"), F.count("*").alias("n")).first()
    return math.log(r["z"]) - a * r["l"] / r["z"], math.log(r["n"])


def plan(slim: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 4.0, budget: float | None = None, entropy_share: float | None = None, blocks: int = BLOCKS) -> DataFrame:
    """A row for each source: weight, quota, whole epochs, ranges, and where the last epoch ends and what fills its gap; exponent and entropy of the
    mix. slim: doc_id, source, n_tokens. entropy_share: the target entropy as a share of the way from natural to most."""
    slim, ceiling = _keyed(slim), budget is not None
    sources = cut(slim.groupBy("_s").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")))
    head = sources.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    total = float(head["t"] or 0)
    a = entropy = 1.0
    if total:
        if entropy_share is not None:
            natural, most = entropy_of(sources, 1.0)
            target_entropy = natural + entropy_share * (most - natural)
        a = exponent(sources, target_entropy, max_repeat, budget)
        entropy = round(entropy_of(sources, a)[0], 9)
        power = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / F.lit(total), F.lit(a))).otherwise(F.lit(0.0))
        z = sources.agg(F.sum(power)).first()[0]
        weighed = sources.withColumn("weight", power / F.lit(z))
        if budget is None:
            budget = weighed.where("n_tokens > 0").agg(F.max(F.col("n_tokens") / F.col("weight"))).first()[0]
    else:
        weighed, budget, entropy = sources.withColumn("weight", F.lit(0.0)), budget or 0.0, 0.0
    # a whole number of epochs stays whole whatever the last bits of the exponent and the division
    repeats = F.when(F.col("n_tokens") > 0, F.round(F.col("weight") * F.lit(float(budget)) / F.col("n_tokens"), 6)).otherwise(F.lit(1.0))
    weighed = weighed.withColumn("repeats", repeats).withColumn("whole", F.floor("repeats").cast("int"))
    weighed = weighed.withColumn("rest", (F.col("repeats") - F.col("whole")) * F.col("n_tokens")).withColumn("ranges", F.ceil(F.col("n_docs") / F.lit(RANGE_DOCS)).cast("long"))
    weighed = cut(weighed.withColumn("exponent", F.lit(a)).withColumn("entropy", F.lit(entropy)))
    # the last epoch's token sums by hash range, then the range in which the quota ends
    dealt = slim.join(weighed.where("rest > 0").select("_s", "whole", "ranges", "rest"), "_s").withColumn("place", _place(F.col("whole"))).withColumn("range", _range(F.col("place"), F.col("ranges")))
    sums = dealt.groupBy("_s", "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = running(sums, ["_s"], "range", "n").withColumn("upto", F.col("before") + F.col("n")).drop("before")
    ends = upto.where("upto > rest").groupBy("_s").agg(F.min("range").alias("end_range"), F.min_by(F.col("upto") - F.col("n"), "range").alias("before"))
    inside = dealt.join(ends, (dealt["_s"] == ends["_s"]) & (dealt["range"] == ends["end_range"])).drop(ends["_s"])
    so_far = F.sum("n_tokens").over(Window.partitionBy("_s").orderBy("place", "doc_id"))
    upto = inside.select("*", _me("place").alias("me"), (so_far + F.col("before")).alias("c"))
    inner = F.col("c") <= F.col("rest")
    last = upto.groupBy("_s", "end_range", "rest").agg(F.max(F.when(inner, F.col("me"))).alias("end"), F.min(F.when(~inner, F.col("me"))).alias("cross"), F.coalesce(F.max(F.when(inner, F.col("c"))), F.min("before")).alias("used"))
    gaps = cut(last.select("_s", "end_range", "end", "cross", (F.col("rest") - F.col("used")).alias("gap")))
    # the longest later copy that fits the gap; rows with one id are one copy
    later = dealt.drop("rest").join(F.broadcast(gaps.where("gap >= 1")), "_s").where("n_tokens > 0 and n_tokens <= gap").withColumn("me", _me("place"))
    later = later.where((F.col("range") > F.col("end_range")) | ((F.col("range") == F.col("end_range")) & F.coalesce(F.col("me") > F.col("end"), F.lit(True))))
    fill = later.groupBy("_s", "me").agg(F.sum("n_tokens").alias("n"), F.first("gap").alias("gap")).where("n <= gap").groupBy("_s").agg(F.max(F.struct("n", "me")).alias("f")).select("_s", F.col("f.n").alias("n"), F.col("f.me").alias("fill"))
    out = weighed.join(gaps, "_s", "left").join(fill, "_s", "left")
    gapes = (F.col("gap") >= 1) & F.col("n").isNull() | (F.col("gap") - F.coalesce("n", F.lit(0)) > F.col("repeats") * F.col("n_tokens") / blocks)
    crosses = F.coalesce(F.lit(not ceiling) & gapes & F.col("cross").isNotNull(), F.lit(False))
    out = out.withColumn("end", F.when(crosses, F.col("cross")).otherwise(F.col("end"))).withColumn("fill", F.when(~crosses, F.col("fill")))
    return cut(out.drop("cross", "gap", "n"))


def copies(docs: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """docs (doc_id, source and whatever else) with a row for each copy: its epoch, and the plan's columns."""
    d = _keyed(docs).join(plan_rows.select("_s", F.col("n_tokens").alias("_total"), "exponent", "entropy", "weight", "repeats", "whole", "ranges", "rest", "end_range", "end", "fill"), "_s")
    place = _place(F.col("whole"))
    at = _range(place, F.col("ranges"))
    me = _me(place)
    part = F.when(F.col("rest") <= 0, False).when(F.col("end_range").isNull(), True).otherwise((at < F.col("end_range")) | ((at == F.col("end_range")) & F.coalesce(me <= F.col("end"), F.lit(False))) | F.coalesce(me == F.col("fill"), F.lit(False)))
    n = F.col("whole") + part.cast("int")
    return d.withColumn("_n", n).where("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n", "whole", "rest", "end_range", "end", "fill")


def placed(rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """copies with start (tokens of the source's mix before it), position (0 to 1, of its quota), block and last_block."""
    rows = cut(rows.withColumn("_place", _place(F.col("epoch"))).withColumn("_range", _range(F.col("_place"), F.col("ranges"))))
    sums = running(rows.groupBy("_s", "epoch", "_range").agg(F.sum("n_tokens").alias("_n")), ["_s", "epoch"], "_range", "_n").drop("_n")
    inside = F.sum("n_tokens").over(Window.partitionBy("_s", "epoch", "_range").orderBy("_place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(sums, ["_s", "epoch", "_range"]).withColumn("start", F.col("epoch") * F.col("_total") + F.col("before") + F.coalesce(inside, F.lit(0)))
    position = F.when(F.col("_total") > 0, F.col("start") / (F.col("repeats") * F.col("_total"))).otherwise(F.lit(0.0))
    end = F.when(F.col("_total") > 0, (F.col("start") + F.greatest(F.col("n_tokens") - 1, F.lit(0))) / (F.col("repeats") * F.col("_total"))).otherwise(F.lit(0.0))

    def block(at: Column) -> Column:
        return F.floor(F.least(at, F.lit(1.0 - 1e-12)) * blocks).cast("int")

    return rows.withColumn("position", F.least(position, F.lit(1.0 - 1e-12))).withColumn("block", block(position)).withColumn("last_block", F.greatest(block(position), block(end)))


def _slim(docs: DataFrame) -> DataFrame:
    return cut(only(docs, "doc_id", "source", "text").select("doc_id", "source", n_tokens().alias("n_tokens")))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 4.0, budget: float | None = None, entropy_share: float | None = None) -> DataFrame:
    """A row for each copy of a document: doc_id, source, n_tokens, exponent, entropy, weight, repeats, epoch, start, position (0 to 1), block,
    last_block."""
    slim = _slim(docs)
    rows = placed(copies(slim, plan(slim, target_entropy, max_repeat, budget, entropy_share)))
    return rows.select("doc_id", "source", "n_tokens", "exponent", "entropy", "weight", "repeats", "epoch", "start", "position", "block", "last_block")


def mixed(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 4.0, budget: float | None = None, entropy_share: float | None = None) -> DataFrame:
    """docs with each document as often as the mix uses it; the columns stay."""
    return restored(copies(carried(docs, "doc_id", "source"), plan(_slim(docs), target_entropy, max_repeat, budget, entropy_share)))
