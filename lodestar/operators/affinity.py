"""TF-IDF affinity of documents to groups, and its agreement with who worked on them. Long form throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import fold_prose
from lodestar.operators.helpers import written

ROLE_WEIGHTS = {"supervisor": 1.0, "author": 0.5}
CONFIDENCE = {"exact": 1.0, "confident": 0.8, "ambiguous": 0.4, "unmatched": 0.0}
#: Terms whose weights go to every task (the others meet documents in a shuffled join), and groups that are columns at once.
COMMON_TERMS, GROUPS_AT_ONCE = 1 << 16, 64


#: Words that no bag of prose holds (English, Portuguese, then words of every abstract).
STOP_WORDS = tuple(
    """
    the and for are but not with that this from was were has have had its
    which whose where when what who how all any can could should would may
    might must into onto over under than then them they their there these
    those such been being does did done also more most other some only very
    each both about after before between during through while because
    against among within without upon here also thus hence
    que uma umas uns dos das nas nos por para com como mais mas nao sao foi
    seu sua seus suas pelo pela pelos pelas este esta estes estas esse essa
    isso aquele aquela sobre entre desde ate quando onde qual quais cujo
    cuja tambem ser ter sido tem tinha muito pouco todos todas cada outro
    outra outros outras seja sendo nesta neste nessa nesse deste desta
    forma modo caso vez vezes parte partes
    abstract resumo tese thesis doutoramento phd universidade coimbra
    trabalho work study estudo research pesquisa project projeto projecto
    results resultados objetivo objectivo proposed proposta approach
    abordagem based baseado paper artigo new novo nova
    """.split()
)


def prose_tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of letters and figures without accents, three or longer, no stop-words."""
    found = F.regexp_extract_all(fold_prose(text), F.lit(r"[a-z0-9]{3,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(list(stop))) if stop else found


def term_counts(docs: DataFrame, key: str | list[str], weighted: list[tuple[Column, int]], stop: tuple[str, ...] = STOP_WORDS, needed: tuple[Column, ...] = (), once: bool = False) -> DataFrame:
    """key (one column or several), term, tf: token counts, each text counted as often as its weight. A row whose needed
    texts are all empty has an empty bag. once: no key comes twice, so a row is counted where it lies."""
    keys = [key] if isinstance(key, str) else key
    if needed:
        docs = docs.where(F.trim(F.concat(*[F.coalesce(c, F.lit("")) for c in needed])) != "")

    def each(c: Column, w: int) -> Column:
        return F.transform(prose_tokens(F.coalesce(c, F.lit("")), stop), lambda t: F.struct(t.alias("term"), F.lit(w).cast("long").alias("w")))

    arrays = F.flatten(F.array(*[each(c, w) for c, w in weighted]))
    if not once:
        return docs.select(*keys, F.explode(arrays).alias("x")).groupBy(*keys, F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))
    # runs of equal terms in the sorted array
    held = docs.select(*keys, F.sort_array(arrays).alias("_x"))
    starts = lambda i: (i < F.size("_x")) & ((i == 0) | (F.get("_x", i)["term"] != F.get("_x", i - 1)["term"]))
    held = held.withColumn("_at", F.filter(F.sequence(F.lit(0), F.greatest(F.size("_x") - 1, F.lit(0))), starts))
    until = lambda k: F.coalesce(F.get("_at", k + 1), F.size("_x"))
    tf = lambda i, k: F.aggregate(F.slice("_x", i + 1, until(k) - i), F.lit(0).cast("long"), lambda n, x: n + x["w"])
    return held.select(*keys, F.explode(F.transform("_at", lambda i, k: F.struct(F.get("_x", i)["term"].alias("term"), tf(i, k).alias("tf")))).alias("x")).select(*keys, "x.term", "x.tf")


def bag_terms(docs: DataFrame, key: str, *texts: Column, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """key, term, each once, for counts of bags: what comes twice within a row goes before the row is dealt out, and rows meet
    by key only where a key comes twice."""
    arrays = F.flatten(F.array(*[prose_tokens(F.coalesce(c, F.lit(""))) for c in texts]))
    terms = docs.select(key, F.explode(F.array_distinct(arrays)).alias("term"))
    terms = terms.where(~F.col("term").isin(list(stop))) if stop else terms
    return terms if unique(docs, key) else terms.distinct()


def unique(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def bags_of(counts: DataFrame, key: str) -> DataFrame:
    """key, term, tf: counts added up over another of their keys; the texts are not read again."""
    return counts.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def group_bags(project_counts: DataFrame, project_groups: DataFrame, project: str = "project_id", group: str = "group_code") -> DataFrame:
    """group, term, tf: the bags of a group's projects added up; a project of several groups counts in each."""
    return bags_of(project_counts.join(project_groups.select(project, group).distinct(), project), group)


def inverse_frequencies(counts: DataFrame, n_docs: int | Column, df: bool = False) -> DataFrame:
    """ln((1 + N) / (1 + df)) + 1; N counts documents without a term too. df: with that count."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return counts.groupBy("term").agg(F.count("*").alias("df")).select("term", *["df"] * df, (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def document_frequencies(*corpora: DataFrame) -> DataFrame:
    """term, df over the bags of all corpora (term and whatever names a bag; a bag has a term once), however their texts are
    weighted. Each corpus is added up before the sums meet."""
    parts = [c.groupBy("term").agg(F.count("*").alias("df")) for c in corpora]
    return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df"))


def added_frequencies(known: DataFrame, *new: DataFrame) -> DataFrame:
    """term, df after new bags: only their texts are read."""
    return known.unionByName(document_frequencies(*new)).groupBy("term").agg(F.sum("df").alias("df"))


def idf_of(frequencies: DataFrame, n_bags: int | Column) -> DataFrame:
    """term, idf; n_bags: all bags of all corpora, empty ones included."""
    n = F.lit(n_bags) if isinstance(n_bags, int) else n_bags
    return frequencies.select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def vectors(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """key, term, w: sublinear tf times idf, length one."""
    raw = counts.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).where("norm > 0").select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def affinity(doc_counts: DataFrame, group_counts: DataFrame, n_docs: int, doc: str = "handle", group: str = "group_code") -> DataFrame:
    """doc, group, score, affinity_rank: cosines over 0, ranked before they are rounded.

    A term's weights in all groups are one array. The most common terms, a fixed number, go to every task and meet a document's
    terms where those lie; only terms that few documents have are shuffled. Products and squares are added up together, a
    row a document, and lengths divide the sums at the end."""
    idf = inverse_frequencies(doc_counts, n_docs, df=True)
    weight = (1 + F.log("tf")) * F.col("idf")
    groups = written(group_counts.join(idf, "term").select("term", group, weight.alias("wg")))
    lengths = [(x[0], x[1]) for x in groups.groupBy(group).agg(F.sqrt(F.sum(F.col("wg") * F.col("wg")))).collect()]  # a row a group
    found = [_products(doc_counts, idf, groups, lengths[at : at + GROUPS_AT_ONCE], weight, doc, group) for at in range(0, max(len(lengths), 1), GROUPS_AT_ONCE)]
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(F.round("s", 12)), F.asc(group)))
    return reduce(DataFrame.unionByName, found).withColumn("affinity_rank", rank).select(doc, group, F.round("s", 6).alias("score"), "affinity_rank")


def _products(doc_counts: DataFrame, idf: DataFrame, groups: DataFrame, lengths: list[tuple], weight: Column, doc: str, group: str) -> DataFrame:
    """doc, group, s: cosines with the groups of lengths (name, length)."""
    of = lambda name: F.col(group).eqNullSafe(F.lit(name))
    dense = groups.groupBy("term").agg(F.array(*[F.coalesce(F.sum(F.when(of(name), F.col("wg"))), F.lit(0.0)) for name, _ in lengths]).alias("gs"))
    terms = written(idf.join(dense, "term", "left"))
    common = written(terms.select("term", "df").orderBy(F.desc("df"), F.asc("term")).limit(COMMON_TERMS).select("term"))
    near = doc_counts.join(F.broadcast(terms.join(F.broadcast(common), "term", "left_semi")), "term")
    far = doc_counts.join(F.broadcast(common), "term", "left_anti").join(terms.join(F.broadcast(common), "term", "left_anti"), "term")
    places = range(len(lengths))
    w = F.col("w")
    met = near.unionByName(far).withColumn("w", weight).select(doc, (w * w).alias("_own"), *[(w * F.get("gs", F.lit(i))).alias(f"_s{i}") for i in places])
    sums = met.groupBy(doc).agg(F.sqrt(F.sum("_own")).alias("_own"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in places])
    kind = groups.schema[group].dataType
    every = F.array(*[F.struct(F.lit(lengths[i][0]).cast(kind).alias(group), (F.col(f"_s{i}") / F.col("_own") / F.lit(lengths[i][1])).alias("s")) for i in places]) if lengths else F.array().cast(f"array<struct<{group}:{kind.simpleString()},s:double>>")
    return sums.select(doc, F.explode(every).alias("x")).select(doc, f"x.{group}", "x.s").where("s > 0")


def margins(scored: DataFrame, doc: str = "handle") -> DataFrame:
    """(first - second) / first of each document that has two scores; percentiles at index int(n p / 100)."""
    top = scored.where("affinity_rank <= 2").groupBy(doc).agg(F.max(F.when(F.col("affinity_rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("affinity_rank") == 2, F.col("score"))).alias("s2"))
    m = top.where("s1 > 0 and s2 is not null").select(((F.col("s1") - F.col("s2")) / F.col("s1")).alias("margin")).persist()
    # margins lie between 0 and 1: counts of narrow ranges find the range of each place, and only those are ranked
    ranges = 10_000
    m = m.withColumn("r", F.floor(F.col("margin") * ranges))
    counts = m.groupBy("r").agg(F.count("*").alias("k"))  # at most ranges + 1 rows
    upto = counts.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    percents = (10, 50, 90)
    places = n.select("n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)).alias("at")) for p in percents])).alias("x")).select("x.p", "x.at")
    wanted = upto.join(F.broadcast(places), (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("k"))).select("r", "before", "p", "at")
    ranked = m.join(F.broadcast(wanted), "r").withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("margin")) - 1 + F.col("before"))
    found = ranked.where("i = at").agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("margin"))), 6).alias(f"p{p}") for p in percents])
    return found.crossJoin(n.select(F.col("n").alias("documents")))


def people_signal(thesis_people: DataFrame, shares: DataFrame) -> DataFrame:
    """handle, group_code, people_share: each resolved name spreads its role's weight over its own groups."""
    role, conf = F.create_map(*[F.lit(x) for p in ROLE_WEIGHTS.items() for x in p]), F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p])
    named = thesis_people.where("person_slug is not null").join(shares, "person_slug")
    each = named.groupBy("handle", "name_raw", "role", "match_status", "group_code").agg(F.sum("weight").alias("g"))
    total = each.groupBy("handle", "name_raw", "role", "match_status").agg(F.sum("g").alias("t"))
    signal = each.join(total, ["handle", "name_raw", "role", "match_status"]).groupBy("handle", "group_code").agg(F.sum(role[F.col("role")] * conf[F.col("match_status")] * F.col("g") / F.col("t")).alias("x"))
    return normalised(signal.where("x > 0"), "handle", "x", "people_share")


def normalised(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    total = df.groupBy(key).agg(F.sum(value).alias("_t"))
    return df.join(total, key).withColumn(name, F.col(value) / F.col("_t")).drop("_t", value)


def agreement(theses: DataFrame, people: DataFrame, content: DataFrame) -> DataFrame:
    """handle, tier, code and share of each signal's best group: corroborated, contested, people-only, content-only, unattributed."""

    def best(df: DataFrame, share: str, to: str) -> DataFrame:
        pick = F.min_by(F.struct("group_code", F.col(share).alias("s")), F.struct(-F.round(share, 9), F.col("group_code")))
        return df.groupBy("handle").agg(pick.alias("b")).select("handle", F.col("b.group_code").alias(f"{to}_code"), F.round("b.s", 4).alias(f"{to}_share"))

    both = theses.select("handle").join(best(people, "people_share", "people"), "handle", "left").join(best(content, "content_share", "content"), "handle", "left")
    p, c = F.col("people_code"), F.col("content_code")
    tier = F.when(p.isNotNull() & c.isNotNull(), F.when(p == c, "corroborated").otherwise("contested")).when(p.isNotNull(), "people-only").when(c.isNotNull(), "content-only").otherwise("unattributed")
    return both.withColumn("tier", tier)


def tier_counts(agreed: DataFrame) -> DataFrame:
    """All five tiers, zeros included."""
    tiers = agreed.sparkSession.createDataFrame([(t,) for t in ("corroborated", "contested", "people-only", "content-only", "unattributed")], "tier string")
    return tiers.join(agreed.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("theses"))
