"""Operator 5, n-gram Jaccard join: grouped prefix join, reported as connected components.

1. Classes: documents with the same set of shingles are one class, named by its smallest id. Copies cost nothing more.
2. Order: shingles are sorted by an estimated document frequency (a sketch of ``2**SKETCH_BITS`` counters, merged over
   all tasks), rarest first, ties by hash. Any total order is right; this one keeps common passages out of prefixes.
3. Groups: classes with the same prefix and size are one group, named by its smallest class. A set's prefix is so long that
   two sets that link share DEPTH of its shingles at least.
4. Group pairs: groups that share prefix shingles, filtered by size, by position and by the number they share.
5. Members: pairs of groups are expanded to pairs of classes and verified on the whole sets, exactly.

So that thousands of near copies don't make millions of pairs, the join runs twice. The first run only links each group
with its lists' pivots, the groups whose prefixes are the least their own; what it verifies becomes components. The second,
complete run then looks only at pairs whose components differ. Pairs inside one need no look, and no link between two is
lost. Groups that share several long lists with a pivot have a home, the most central such pivot: two of one home are
compared in blocks of sets, which give out links and no pairs; each block is of bounded size, and only those outside the
home's own component meet all blocks. All other pairs are joined.

Sets move only for documents in some candidate pair; a bitmap of bounded size keeps the rest where they lie.

Defined cases: null, empty or wordless text: an empty set, linked with nothing; fewer words than a shingle: the whole
sequence is the one shingle; rows with the same id are one node, linked by any of its sets; any 64-bit number can be an id;
rows with a null id are a node for each set, whose key is no row's id, and come back null unless they reach an id; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import bit_set, bit_words, carried, cut, distinct, id_bit, in_bitmap, map_arrow, meet, mix, ngrams, only, raw_bytes, restored, signed, small_batches, word_hashes
from lodestar.llm.components import components

SKETCH_BITS, DEPTH, LONG, BLOCK, ID_BITS, TRIES = 18, 3, 16, 1 << 20, 22, 8
_SEED = np.uint64(0x51ED270B7F4A7C15)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Distinct hashes of the runs of n words (A-Z lowered), sorted; the whole sequence if it is shorter."""
    h = word_hashes((text or b"").lower().split())
    return distinct(ngrams(h, min(n, len(h)))) if len(h) else h


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Documents a sketch cell, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(1 << SKETCH_BITS, np.int64), False
        held: list[np.ndarray] = []
        for b in batches:
            for text in raw_bytes(b.column(0)):
                held.append((shingles(text, n) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
            some = True
            if sum(map(len, held)) > 1 << 20:
                total += np.bincount(np.concatenate(held), minlength=1 << SKETCH_BITS)
                held = []
        if some:
            total += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=1 << SKETCH_BITS)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    rows = map_arrow(docs.select("text"), count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)  # at most 2**SKETCH_BITS rows
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return np.round(1000 * np.log1p(out)).astype(np.uint16)


def ordered(s: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Rarest first; s is sorted and the sort is stable, so ties go by hash in every document."""
    return s[np.argsort(frequency[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def need(x: int, y: int, percent: int) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """A linked set holds at least ceil(percent n / 100) of these: all but so many places hold DEPTH of them."""
    return min(n, n - -(-percent * n // 100) + DEPTH)


def _lanes(s: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set as two signed numbers."""
    with np.errstate(over="ignore"):
        return tuple(int(signed(np.array([mix(x, s, seed).sum(dtype=np.uint64)]))[0]) for x, seed in ((s, 3), (s ^ _SEED, 5)))


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, hi, lo (128-bit hash of the set), prefix, in the order of the rows."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, n))
    names = ["doc_id", "n_shingles", "hi", "lo", "prefix"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), raw_bytes(b.column(1))):
                s = shingles(text, n)
                size = len(s)
                for col, v in zip(cols, (doc, size, *_lanes(s), signed(ordered(s, sent.value)[: prefix_length(size, percent)]))):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return map_arrow(docs.select("doc_id", "text"), sign, "doc_id long, n_shingles long, hi long, lo long, prefix array<long>")


def unnamed(rows: DataFrame) -> DataFrame:
    """hi, lo, ghost: a key for each set that a row with a null id has, TRIES hashes of it tried until one is no row's id."""
    sets = rows.where("doc_id is null and n_shingles > 0").select("hi", "lo").distinct()
    tried = sets.select("hi", "lo", F.explode(F.sequence(F.lit(1), F.lit(TRIES))).alias("i")).withColumn("ghost", F.xxhash64("hi", "lo", "i"))
    free = tried.join(rows.select(F.col("doc_id").alias("ghost")).distinct(), "ghost", "left_anti")
    return cut(free.groupBy("hi", "lo").agg(F.min_by("ghost", "i").alias("ghost")))


def sets_of(docs: DataFrame, nodes: DataFrame, ghosts: DataFrame, n: int) -> DataFrame:
    """key, s (the sorted set as bytes) of the documents in nodes (key)."""
    nodes = nodes.select("key").distinct()
    bits = bit_words(nodes, id_bit("key", ID_BITS), ID_BITS)
    names = ["key", "hi", "lo", "s"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t, n) for t in raw_bytes(b.column(1))]
            lanes = [(None, None) if doc is not None else _lanes(s) for doc, s in zip(b.column(0).to_pylist(), got)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in zip(*lanes)), pa.array([s.tobytes() for s in got], pa.binary())], names)

    def of(some: DataFrame) -> DataFrame:
        return map_arrow(some, sets, "key long, hi long, lo long, s binary")

    plain = of(in_bitmap(docs.where("doc_id is not null"), "doc_id", bits, ID_BITS, ["doc_id", "text"])).select("key", "s")
    null = of(docs.where("doc_id is null")).join(ghosts, ["hi", "lo"]).select(F.col("ghost").alias("key"), "s")
    return plain.unionByName(null).join(nodes, "key").distinct()


def verified(docs: DataFrame, pairs: DataFrame, ghosts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b: keys) whose sets link."""
    found = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("key")), ghosts, n)
    both = pairs.join(found.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(found.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(u) + len(v) - len(distinct(np.concatenate([u, v])))
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("a", "b", "x", "y"), check, "a long, b long").distinct()


def at_home(docs: DataFrame, where: DataFrame, ghosts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between components, of sets with one home. where: rep, n_shingles, c
    (component), home. A block holds about BLOCK shingles, so a cell is bounded whatever its sets; a home that many sets
    share has its own row sent to them."""
    placed = cut(where.where("home is not null").select("rep", "c", "home", "n_shingles").distinct())
    total = placed.count()
    own = placed.where("rep = home").groupBy("home").agg(F.min("c").alias("hc"))
    many = placed.groupBy("home").agg(F.count("*").alias("many"))
    sides = meet(placed, many.join(own, "home", "left"), "home", "many", total).withColumn("few", F.coalesce(F.col("c") != F.col("hc"), F.lit(True)))
    size = F.sum("n_shingles")
    sizes = sides.groupBy("home").agg(F.count("*").alias("many"), F.ceil(size / BLOCK).cast("int").alias("nb"), F.ceil(F.sum(F.when(F.col("few"), F.col("n_shingles"))) / BLOCK).cast("int").alias("ns")).where("ns > 0")
    sides = cut(meet(cut(sides), cut(sizes), "home", "many", total))
    mine = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"), F.pmod(F.xxhash64("rep"), F.col("ns")).cast("int")
    # a set is offered in its own row of cells, and asks in its own column if it is one of the few
    offered = F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda j: F.struct(mine[0].alias("i"), j.alias("j"), (F.col("few") & (j == mine[1])).alias("asks"), F.lit(True).alias("offered")))
    asking = F.transform(F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.col("few") & (i != mine[0])), lambda i: F.struct(i.alias("i"), mine[1].alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("offered")))
    rows = sides.select("home", "rep", "c", F.explode(F.concat(offered, asking)).alias("x")).select("home", "x.i", "x.j", "x.asks", "x.offered", F.col("rep").alias("key"), "c")
    rows = rows.join(sets_of(docs, sides.select(F.col("rep").alias("key")), ghosts, n), "key")

    def compare(t: pa.Table) -> pa.Table:
        asks = np.array(t["asks"].to_pylist(), bool)
        keys, c = t["key"].to_numpy(), t["c"].to_numpy()
        raw = t["s"].to_pylist()
        theirs = np.flatnonzero(np.array(t["offered"].to_pylist(), bool))
        out_a, out_b = [], []
        if len(theirs):
            sets = [np.frombuffer(raw[k], np.uint64) for k in theirs]
            length = np.array([len(x) for x in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), length)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for k in np.flatnonzero(asks):
                x = np.frombuffer(raw[k], np.uint64)
                lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                span = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
                common = np.bincount(owner[at], minlength=len(sets))
                hit = np.flatnonzero((100 * common >= percent * (len(x) + length - common)) & (c[theirs] != c[k]))
                for m in dict(zip(c[theirs][hit].tolist(), hit.tolist())).values():  # one link a component is enough
                    out_a.append(keys[k])
                    out_b.append(keys[theirs[m]])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return small_batches(rows).groupBy("home", "i", "j").applyInArrow(compare, "a long, b long")


def _close(x: str, y: str, percent: int) -> str:
    """The size filter, in integers."""
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id; documents link when 100 * intersection >= percent * union of their shingle sets."""
    docs = only(docs, "doc_id", "text")
    signed_rows = cut(signatures(docs, n, percent))
    ghosts = unnamed(signed_rows)
    rows = signed_rows.where("doc_id is not null").withColumn("key", F.col("doc_id"))
    rows = rows.unionByName(signed_rows.where("doc_id is null").join(ghosts, ["hi", "lo"], "left").withColumnRenamed("ghost", "key"))
    classes = cut(rows.where("n_shingles > 0").groupBy("hi", "lo", "n_shingles").agg(F.min("key").alias("rep")))
    # one row a class: its representative's own; sets that can't reach the threshold with another need no place
    least = -(-percent // (100 - percent))
    one = rows.where(F.col("n_shingles") >= least).join(classes, ["hi", "lo", "n_shingles"]).where("key = rep").select("rep", "n_shingles", "prefix", "hi", "lo").dropDuplicates(["rep", "hi", "lo"])
    members = cut(one.select("rep", "n_shingles", F.xxhash64("prefix", "n_shingles").alias("g1"), F.hash("prefix", F.lit(7)).alias("g2"), "prefix"))
    groups = members.groupBy("g1", "g2", "n_shingles").agg(F.min("rep").alias("leader"), F.count("*").alias("size"))
    member = cut(members.join(groups, ["g1", "g2", "n_shingles"]).select("rep", "leader", "size", "n_shingles", "prefix"))
    posted = member.where("rep = leader").select("leader", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("at", "token"))
    lists = posted.groupBy("token").agg(F.count("*").alias("many")).where("many > 1")
    # how little of a group's prefix is its own; a group's postings are as many as its prefix is long
    weight = F.sum(F.log("many")).over(Window.partitionBy("leader")) / (F.col("n") - F.ceil(F.col("n") * percent / 100) + DEPTH)
    postings = cut(posted.join(lists, "token").withColumn("central", weight))

    # first run: a group and its lists' pivots, a group's members and its leader
    pivots = postings.groupBy("token").agg(F.max_by(F.struct(F.col("leader").alias("p"), F.col("n").alias("m"), F.col("central").alias("pc")), F.struct("central", F.bitwise_not("leader"))).alias("v")).select("token", "v.*")
    led = cut(postings.select("token", "leader", "n", "many").join(pivots, "token"))
    star = led.where("leader != p").where(_close("n", "m", percent))
    star = star.groupBy(F.least("leader", "p").alias("a"), F.greatest("leader", "p").alias("b")).agg(F.count("*").alias("shared")).where(f"shared >= {DEPTH}").select("a", "b")
    inside = member.where("size > 1 and rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    first = cut(verified(docs, cut(star.unionByName(inside).distinct()), ghosts, n, percent))
    part = components(first)

    # second run, over what the first leaves apart
    near = led.where(f"many >= {LONG}").groupBy("leader", "p").agg(F.count("*").alias("shared"), F.first("pc").alias("pc")).where(f"shared > {DEPTH}")
    home = near.groupBy("leader").agg(F.max_by("p", F.struct("pc", F.bitwise_not("p"))).alias("home"))
    where = member.select("rep", "leader", "n_shingles").join(part.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "leader", "n_shingles", F.coalesce("component", "rep").alias("c"))
    where = cut(where.join(home, "leader", "left"))
    whole = where.groupBy("leader").agg(F.min("c").alias("c"), (F.min("c") == F.max("c")).alias("one"), F.first("home").alias("home"))
    side = cut(postings.select("token", "leader", "n", "at").join(whole, "leader"))
    apart = "(min(c) < max(c) or not bool_and(one)) and not (count(home) = count(*) and min(home) = max(home))"
    side = cut(side.join(side.groupBy("token").agg(F.expr(apart).alias("apart")).where("apart").select("token"), "token"))
    left, right = side.toDF(*[f"{c}1" if c != "token" else c for c in side.columns]), side.toDF(*[f"{c}2" if c != "token" else c for c in side.columns])
    room = "least(at1, at2) + 1 + least(n1 - at1, n2 - at2) - 1"
    differ = "leader1 < leader2 and (c1 != c2 or not one1 or not one2) and not coalesce(home1 = home2, false)"
    found = left.join(right, "token").where(differ).where(_close("n1", "n2", percent)).where(f"({room}) * {100 + percent} >= {percent} * (n1 + n2)")
    pairs = found.groupBy("leader1", "leader2").agg(F.count("*").alias("shared")).where(f"shared >= {DEPTH}")
    a, b = where.select("rep", "leader", "c").toDF("a", "leader1", "ca"), where.select("rep", "leader", "c").toDF("b", "leader2", "cb")
    across = pairs.join(a, "leader1").join(b, "leader2").where("ca != cb").select("a", "b")
    loose = where.where("home is null").join(whole.where("not one").select("leader"), "leader").select("rep", "leader", "c")
    within = loose.toDF("a", "leader", "ca").join(loose.toDF("b", "leader", "cb"), "leader").where("a < b and ca != cb").select("a", "b")
    wanted = across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = verified(docs, cut(wanted), ghosts, n, percent).unionByName(at_home(docs, where, ghosts, n, percent))

    # rows with one id but several sets are one node: each of its classes is linked with it
    own = rows.where("n_shingles > 0").join(classes, ["hi", "lo", "n_shingles"]).select("doc_id", "key", "n_shingles", "rep")
    links = first.unionByName(second)
    twice = own.where("key != rep").groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b")
    if twice.limit(1).count():
        links = links.unionByName(own.select(F.col("key").alias("a"), F.col("rep").alias("b")))
    final = cut(components(links))
    reached = own.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", "rep", F.coalesce("component", "rep").alias("component_id"))
    # a component named by a ghost is named anew by its smallest id; there are as many at most as ghosts
    named = ghosts.select(F.col("ghost").alias("component_id"))
    odd = reached.join(named, "component_id", "left_semi").groupBy("component_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("many")).withColumn("odd", F.lit(True))
    if ghosts.limit(1).count():
        reached = reached.join(odd, "component_id", "left").withColumn("component_id", F.when(F.col("odd"), F.col("id")).otherwise(F.col("component_id")))
    empty = signed_rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return reached.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component the document with the smallest id, once; the columns stay.

    Documents that lose are few, so only those (and what a bitmap of their ids lets through) move.
    """
    found = cut(join(docs, n, percent))
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_gone"))
    bits = bit_words(gone.unionByName(repeated), id_bit("_gone", ID_BITS), ID_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    docs, columns = carried(docs, "doc_id"), ["doc_id", "_row"]
    kept = found.where("doc_id = component_id").select("doc_id").distinct()

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~bit_set(sent.value, b.column(len(columns)).to_numpy()))).select(columns)

    clear = map_arrow(docs.withColumn("_bit", id_bit("doc_id", ID_BITS)), untouched, docs.schema)
    asked = in_bitmap(docs, "doc_id", bits, ID_BITS, columns)
    # a null id stays: nothing says which of its rows another repeats
    first = asked.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*columns)
    once = first.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("_row")))).where("_r = 1").drop("_r")
    return restored(clear.unionByName(asked.where("doc_id is null")).unionByName(once))
