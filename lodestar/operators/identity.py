"""Entity resolution that never guesses: names to people in tiers, by token rules, without edit distance.

Names meet people over shared surname tokens (an equi-join), not all against all. The rules are array predicates; a name
that fits several people is resolved only if they are one person or a given name decides, else it stays ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import fold, name_parts, name_token_list
from lodestar.operators.helpers import written

CONFIDENCE = {"exact": 1.0, "confident": 0.8, "ambiguous": 0.4, "unmatched": 0.0}
#: People of a block, blocks of a cell, and pairs of a task (about), in the search for duplicates.
BLOCK, CELL, PAIRS_OF_A_TASK = 300, 1000, 2_000_000


def _initial_of(t: Column, names: Column) -> Column:
    return (F.length(t) == 1) & F.exists(names, lambda g: g.startswith(t))


def fits(surname: Column, given: Column, candidate: Column) -> Column:
    """Every surname token is the candidate's; every candidate token is the name's or the initial of a given one."""
    every = F.concat(surname, given)
    return (F.size(surname) > 0) & F.forall(surname, lambda t: F.array_contains(candidate, t)) & F.forall(candidate, lambda t: F.array_contains(every, t) | _initial_of(t, given))


def fits_full(surname: Column, given: Column, full: Column) -> Column:
    """Against a reviewed full name: every surname token is in it, and every given token or its initial."""
    return (F.size(surname) > 0) & F.forall(surname, lambda t: F.array_contains(full, t)) & F.forall(given, lambda t: F.array_contains(full, t) | _initial_of(t, full))


def match_names(names: DataFrame, people: DataFrame, distinct_pairs: DataFrame | None = None, full_names: DataFrame | None = None) -> DataFrame:
    """name_raw, status, slugs, used_initial.

    names: name_raw. people: slug, name, source, canonical (slug itself where no alias). distinct_pairs: a, b reviewed as
    different people. full_names: slug, full_name (reviewed).
    """
    parts = names.select("name_raw").distinct().withColumn("p", name_parts("name_raw")).select("name_raw", "p.surname", "p.given")
    pool = people.select("slug", "source", "canonical", fold("name").alias("folded"), name_token_list("name").alias("tokens"))
    if full_names is not None:
        pool = pool.join(full_names.select("slug", name_token_list("full_name").alias("full")), "slug", "left")
    else:
        pool = pool.withColumn("full", F.lit(None).cast("array<string>"))
    keyed = pool.withColumn("block", F.explode(F.array_distinct(F.concat("tokens", F.coalesce("full", F.array().cast("array<string>"))))))
    # any surname token must be the candidate's: the first one is enough to meet on
    asked = parts.where(F.size("surname") > 0).withColumn("block", F.element_at("surname", 1))
    met = asked.join(keyed, "block").dropDuplicates(["name_raw", "slug"])
    rule1 = fits(F.col("surname"), F.col("given"), F.col("tokens"))
    rule2 = F.coalesce(F.col("full").isNotNull() & ~rule1 & fits_full(F.col("surname"), F.col("given"), F.col("full")), F.lit(False))
    every = F.concat("surname", "given")
    primary = F.when(F.size("given") > 0, F.array_contains("tokens", F.element_at("given", 1)) | F.exists("tokens", lambda t: (F.length(t) == 1) & F.element_at("given", 1).startswith(t))).otherwise(False)
    cand = met.where(rule1 | rule2).select(
        "name_raw", "slug", "source", "canonical", "folded",
        (rule2 & ~rule1).alias("by_full"),
        (rule1 & ~F.forall("tokens", lambda t: F.array_contains(every, t))).alias("initial"),
        (F.array_sort(F.array_distinct("tokens")) == F.array_sort(F.array_distinct(every))).alias("equal"),
        primary.alias("primary"),
    )
    if distinct_pairs is not None:
        cand = written(cand)  # both sides of the pairs and the sums read it
        d = distinct_pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        two = cand.select("name_raw", F.col("slug").alias("x")).join(cand.select("name_raw", F.col("slug").alias("y")), "name_raw").where("x < y")
        vetoed = two.join(d, ["x", "y"], "left_semi").select("name_raw").distinct().withColumn("veto", F.lit(True))
    else:
        vetoed = None
    n = cand.groupBy("name_raw").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set("slug")).alias("all"),
        F.array_sort(F.collect_set(F.when(F.col("primary"), F.col("slug")))).alias("preferred"),
        F.countDistinct("folded").alias("names"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct("canonical").alias("people"),
        F.bool_or("equal").alias("equal"),
        F.bool_or("by_full").alias("by_full"),
        F.bool_or("initial").alias("used_initial"),
    )
    n = n.join(vetoed, "name_raw", "left") if vetoed is not None else n.withColumn("veto", F.lit(None).cast("boolean"))
    same = ((F.col("names") == 1) & (F.col("sources") == 1) | (F.col("people") == 1)) & F.col("veto").isNull()
    one = F.col("n") == 1
    status = (
        F.when(one, F.when(F.col("by_full") | F.col("used_initial") | ~F.col("equal"), "confident").otherwise("exact"))
        .when(same, "confident")
        .when(F.size("preferred") == 1, "confident")
        .otherwise("ambiguous")
    )
    slugs = F.when(one | same, F.col("all")).when(F.size("preferred") == 1, F.col("preferred")).otherwise(F.array().cast("array<string>"))
    found = n.select("name_raw", status.alias("status"), slugs.alias("slugs"), "used_initial")
    return names.select("name_raw").distinct().join(found, "name_raw", "left").select(
        "name_raw", F.coalesce("status", F.lit("unmatched")).alias("status"), F.coalesce("slugs", F.array().cast("array<string>")).alias("slugs"), F.coalesce("used_initial", F.lit(False)).alias("used_initial")
    )


def pool_of(listings: DataFrame, people: DataFrame, aliases: DataFrame) -> DataFrame:
    """The pool that match_names takes, of listed people: one row a person, the first of its sources by name."""
    first = listings.groupBy(F.col("person_slug").alias("slug")).agg(F.min("source").alias("source"))
    a = aliases.select(F.col("from_slug").alias("slug"), F.col("to_slug").alias("canonical"))
    return first.join(people.select("slug", "name"), "slug").join(a, "slug", "left").select("slug", "name", "source", F.coalesce("canonical", "slug").alias("canonical"))


def two_pass(mentions: DataFrame, own: DataFrame, wider: DataFrame, listed: DataFrame | None = None, **reviewed: DataFrame) -> DataFrame:
    """mentions (handle, name_raw, role) to rows: own pool first, the wider one only for supervisors it leaves unmatched.

    listed: slug, name (every form of the wider pool's names that some list gives); matches of the second pass that none
    of them supports are demoted by the floor guard."""
    first = match_names(mentions.select("name_raw"), own, **reviewed)
    unmatched = mentions.where("role = 'supervisor'").select("name_raw").distinct().join(first.where("status = 'unmatched'"), "name_raw", "left_semi")
    second = match_names(unmatched, wider, **reviewed)
    second = second if listed is None else guarded(second, wider, listed)
    second = second.where("status != 'unmatched'").select("name_raw", F.col("status").alias("s2"), F.col("slugs").alias("g2")).withColumn("role", F.lit("supervisor"))
    out = mentions.join(first, "name_raw").join(second, ["name_raw", "role"], "left")
    return out.select("handle", "name_raw", "role", F.coalesce("s2", "status").alias("match_status"), F.coalesce("g2", "slugs").alias("slugs"), F.col("s2").isNotNull().alias("second_pass"))


def emit_rows(matched: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row for each person of a mention, by canonical slug; one row without a slug where there is none."""
    flat = matched.select("handle", "name_raw", "role", "match_status", F.explode_outer("slugs").alias("slug"))
    a = aliases.select(F.col("from_slug").alias("slug"), "to_slug")
    rows = flat.join(a, "slug", "left").select("handle", "name_raw", "role", "match_status", F.coalesce("to_slug", "slug").alias("person_slug"))
    conf = F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p])
    return rows.distinct().withColumn("match_confidence", conf[F.col("match_status")])


def author_conflicts(rows: DataFrame, names_equal: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """person_slug, handle, name_raw, keep: a person authors one thesis; of several claims only a single equal one stands.

    rows: handle, name_raw, person_slug (resolved authors). names_equal: name_raw, person_slug whose tokens are the same
    set. exempt: person_slug, handle reviewed as true.
    """
    eq = names_equal.select("name_raw", "person_slug").distinct().withColumn("equal", F.lit(1))
    claims = rows.join(eq, ["name_raw", "person_slug"], "left").select("person_slug", "handle", "name_raw", F.coalesce("equal", F.lit(0)).alias("equal"))
    if exempt is not None:
        claims = claims.join(exempt.select("person_slug", "handle").withColumn("ok", F.lit(True)), ["person_slug", "handle"], "left")
    else:
        claims = claims.withColumn("ok", F.lit(None).cast("boolean"))
    per = claims.groupBy("person_slug").agg(F.countDistinct("handle").alias("n"), F.sum("equal").alias("e"), F.count_if(F.col("ok").isNull()).alias("plain"))
    keep = (F.col("n") == 1) | F.col("ok").isNotNull() | (F.col("e") == 1) & (F.col("equal") == 1)
    return claims.join(per, "person_slug").select("person_slug", "handle", "name_raw", F.coalesce(keep, F.lit(False)).alias("keep"))


def floor_guard(matches: DataFrame, listing_names: DataFrame) -> DataFrame:
    """Second-pass confident matches that rest on surname and first given name alone, and that no richer listed form of the
    person supports, become ambiguous. matches: name_raw, slug, tokens, surname, given, status. listing_names: slug, tokens."""
    minimal = F.array_union("surname", F.slice("given", 1, 1))
    thin = (F.size(F.array_except("tokens", minimal)) == 0) & (F.size(F.array_distinct("tokens")) < F.size(F.array_distinct(F.concat("surname", "given"))))
    richer = listing_names.select(F.col("slug"), F.col("tokens").alias("listed"))
    support = matches.join(richer, "slug").where((F.size(F.array_distinct("listed")) > F.size(F.array_distinct("tokens"))) & (F.size(F.array_except("listed", F.concat("surname", "given"))) == 0))
    return matches.join(support.select("name_raw", "slug").distinct().withColumn("supported", F.lit(True)), ["name_raw", "slug"], "left").withColumn(
        "status", F.when((F.col("status") == "confident") & thin & F.col("supported").isNull(), "ambiguous").otherwise(F.col("status"))
    )


def guarded(matched: DataFrame, pool: DataFrame, listed: DataFrame) -> DataFrame:
    """matched (from match_names) with names that the floor guard demotes: ambiguous, without people."""
    each = matched.where("status = 'confident'").select("name_raw", "status", F.explode("slugs").alias("slug"), name_parts("name_raw").alias("p"))
    each = each.join(pool.select("slug", name_token_list("name").alias("tokens")), "slug").select("name_raw", "slug", "tokens", "p.surname", "p.given", "status")
    thin = floor_guard(each, listed.select("slug", name_token_list("name").alias("tokens"))).where("status = 'ambiguous'").select("name_raw").distinct().withColumn("thin", F.lit(True))
    status, slugs = F.when(F.col("thin"), "ambiguous").otherwise(F.col("status")), F.when(F.col("thin"), F.array().cast("array<string>")).otherwise(F.col("slugs"))
    return matched.join(thin, "name_raw", "left").select("name_raw", status.alias("status"), slugs.alias("slugs"), "used_initial")


def possible_duplicates(people: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """Pairs to look at: one surname (the last token), one name's tokens within the other's, and first given names that are
    equal or one the other's initial; a name of one token is its own given name. Reviewed pairs are left out.

    Names are compared, not people: those of one name are dealt out to blocks, blocks meet by surname and the initial of the
    given name (a common one is a grid of cells), and two blocks that fit become their pairs in a task of their own. What comes
    out may be quadratic; no task holds more than its share."""
    p = people.select("slug", name_token_list("name").alias("t")).where(F.size("t") > 0)
    blocks = p.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    u = p.join(blocks, "t").groupBy("t", F.expr("pmod(xxhash64(slug), _blocks)").alias("block")).agg(F.collect_list("slug").alias("slugs"))
    u = written(u.select(F.struct("t", "block").alias("u"), "t", F.element_at("t", -1).alias("last"), F.element_at("t", 1).alias("g"), "slugs").withColumn("initial", F.substring("g", 1, 1)))
    cells = u.groupBy("last", "initial").agg(F.ceil(F.count("*") / CELL).cast("int").alias("_cells"))
    u = u.join(cells, ["last", "initial"]).withColumn("at", F.expr("cast(pmod(xxhash64(u), _cells) as int)"))
    a = u.select("last", "initial", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("_cells") - 1)).alias("j"), *[F.col(c).alias(f"{c}a") for c in ("u", "t", "g", "slugs")])
    b = u.select("last", "initial", F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"), *[F.col(c).alias(f"{c}b") for c in ("u", "t", "g", "slugs")])
    within = (F.size(F.array_except("ta", "tb")) == 0) | (F.size(F.array_except("tb", "ta")) == 0)
    agree = (F.col("ga") == F.col("gb")) | (F.length("ga") == 1) | (F.length("gb") == 1)  # the initials are equal
    fit = a.join(b, ["last", "initial", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("ua") <= F.col("ub"))).where(within & agree)
    fit = written(fit.select("slugsa", "slugsb", (F.col("ua") == F.col("ub")).alias("same")))
    n = fit.agg(F.coalesce(F.sum(F.size("slugsa").cast("double") * F.size("slugsb")), F.lit(0.0))).first()[0]
    x = fit.repartition(int(n // PAIRS_OF_A_TASK) + 1).select(F.explode("slugsa").alias("x"), "slugsb", "same")
    # two of one block meet twice, those of two blocks once
    pairs = x.select("x", F.explode("slugsb").alias("y"), "same").where("x < y or (x > y and not same)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if reviewed is not None:
        pairs = pairs.join(reviewed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return pairs


def folded_collisions(own: DataFrame, wider: DataFrame) -> DataFrame:
    """People of two pools whose folded names are equal."""
    return own.select(F.col("slug").alias("own_slug"), fold("name").alias("f")).join(wider.select(F.col("slug").alias("wider_slug"), fold("name").alias("f")), "f").where("own_slug != wider_slug").select("own_slug", "wider_slug")


def mint_slugs(people: DataFrame, base: str = "base", order: str = "seq") -> DataFrame:
    """base, base-2, base-3 by order within a source."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("source", base).orderBy(order))
    return people.withColumn("slug", F.when(r == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), r.cast("string"))))
