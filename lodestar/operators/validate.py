"""Validators of curated verdicts: each returns the offending rows with a rule; raise_if_any turns them into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import name_token_list


def _rule(df: DataFrame, rule: str, what: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), what.cast("string").alias("subject"))


def alias_problems(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """pairs: a, b, verdict, canonical. No self pair, no unknown slug, no pair twice, the canonical one of the two, no slug
    with two targets, no chain."""
    known = people.select("slug").distinct()
    both = F.concat_ws("~", F.least("a", "b"), F.greatest("a", "b"))
    same = pairs.where("verdict = 'same'").select(F.when(F.col("canonical") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("from_slug"), F.col("canonical").alias("to_slug"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("slug"))
    found = [
        _rule(pairs.where("a = b"), "self", F.col("a")),
        _rule(ends.join(known, "slug", "left_anti").distinct(), "unknown", F.col("slug")),
        _rule(pairs.groupBy(both.alias("k")).agg(F.count("*").alias("n")).where("n > 1"), "repeated", F.col("k")),
        _rule(pairs.where("verdict = 'same' and (canonical is null or canonical not in (a, b))"), "canonical", both),
        _rule(same.groupBy("from_slug").agg(F.countDistinct("to_slug").alias("n")).where("n > 1"), "two-targets", F.col("from_slug")),
        _rule(same.join(same.select(F.col("from_slug").alias("to_slug")), "to_slug", "left_semi"), "chain", F.col("from_slug")),
    ]
    return reduce(DataFrame.unionByName, found)


def full_name_problems(full_names: DataFrame, people: DataFrame) -> DataFrame:
    """A reviewed full name holds every token of the display name."""
    t = full_names.join(people.select("slug", "name"), "slug", "left").select("slug", "name", name_token_list("full_name").alias("full"), name_token_list("name").alias("shown"))
    return _rule(t.where("name is null"), "unknown", F.col("slug")).unionByName(_rule(t.where(F.size(F.array_except("shown", "full")) > 0), "not-covered", F.col("slug")))


def exemption_problems(exempt: DataFrame, people: DataFrame, theses: DataFrame, claims: DataFrame) -> DataFrame:
    """exempt: person_slug, handle; each must name a person, a thesis and a live claim."""
    a = exempt.join(people.select(F.col("slug").alias("person_slug")), "person_slug", "left_anti")
    b = exempt.join(theses.select("handle"), "handle", "left_anti")
    c = exempt.join(claims.select("person_slug", "handle"), ["person_slug", "handle"], "left_anti")
    key = F.concat_ws("~", "person_slug", "handle")
    return _rule(a, "unknown-person", key).unionByName(_rule(b, "unknown-thesis", key)).unionByName(_rule(c, "no-claim", key))


def external_problems(external: DataFrame, thesis_people: DataFrame) -> DataFrame:
    """external: handle, name_raw, role; only unmatched mentions, none twice."""
    keys = ["handle", "name_raw", "role"]
    key = F.concat_ws("~", *keys)
    twice = external.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    live = thesis_people.where("match_status = 'unmatched'").select(*keys)
    return _rule(twice, "repeated", key).unionByName(_rule(external.join(live, keys, "left_anti"), "not-unmatched", key))


def duplicate_thesis_problems(pairs: DataFrame, theses: DataFrame, same: list[str]) -> DataFrame:
    """pairs: duplicate_handle, kept_handle; both exist and agree in the fields of same, in every row of theirs. One problem a pair."""
    told = theses.groupBy("handle").agg(F.struct(F.min(F.struct(*same)).alias("least"), F.max(F.struct(*same)).alias("most")).alias("told"))
    d = told.select(F.col("handle").alias("duplicate_handle"), F.col("told").alias("d"))
    k = told.select(F.col("handle").alias("kept_handle"), F.col("told").alias("k"))
    j = pairs.join(d, "duplicate_handle", "left").join(k, "kept_handle", "left")
    key = F.concat_ws("~", "duplicate_handle", "kept_handle")
    agree = F.col("d").eqNullSafe(F.col("k")) & F.col("d.least").eqNullSafe(F.col("d.most"))
    return _rule(j.where("d is null or k is null"), "missing", key).unionByName(_rule(j.where("d is not null and k is not null").where(~agree), "differ", key))


def author_problems(thesis_people: DataFrame, exempt: DataFrame) -> DataFrame:
    """A resolved person who authors two theses, unless all of the claims are reviewed; two author rows of one thesis are never
    excused."""
    claims = thesis_people.where("role = 'author' and person_slug is not null").groupBy("person_slug", "handle").agg(F.count("*").alias("n"))
    reviewed = exempt.select("person_slug", "handle", F.lit(True).alias("_reviewed")).distinct()
    each = claims.join(reviewed, ["person_slug", "handle"], "left").groupBy("person_slug").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count_if(F.col("_reviewed").isNull()).alias("plain"))
    return _rule(each.where("n > 1 and (plain > 0 or most > 1)"), "two-theses", F.col("person_slug"))


def excluded_problems(theses: DataFrame, duplicates: DataFrame) -> DataFrame:
    """A reviewed duplicate (duplicates: duplicate_handle) that is among the theses."""
    d = duplicates.select(F.col("duplicate_handle").alias("handle"))
    return _rule(theses.join(d, "handle", "left_semi").select("handle").distinct(), "excluded-thesis", F.col("handle"))


def shape_problems(rows: DataFrame, required: list[str], enums: dict[str, list[str]] | None = None) -> DataFrame:
    """Blank required fields and values outside an enum."""
    out = [_rule(rows.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""), f"blank-{c}", F.lit(c)) for c in required]
    out += [_rule(rows.where(~F.col(c).isin(v)), f"enum-{c}", F.col(c)) for c, v in (enums or {}).items()]
    return reduce(DataFrame.unionByName, out)


def entry_problems(rows: DataFrame, required: list[str], known: list[str]) -> DataFrame:
    """Entries of curated files, as JSON (name, entry): not an object, keys that nobody knows, required keys that are missing or
    null. subject: the entry's name, and the key."""
    keyed = rows.select(F.col("name").cast("string").alias("name"), F.from_json("entry", "map<string,string>").alias("m"))
    objects = keyed.where("m is not null")

    def keys(found) -> DataFrame:
        return objects.select("name", F.explode(found).alias("key"))

    subject = F.concat_ws("~", "name", "key")
    unknown = F.array_except(F.map_keys("m"), F.array(*[F.lit(k) for k in known]))
    missing = F.filter(F.array(*[F.lit(k) for k in required]), lambda k: F.col("m")[k].isNull())
    return _rule(keyed.where("m is null"), "not-an-object", F.col("name")).unionByName(_rule(keys(unknown), "unknown-key", subject)).unionByName(_rule(keys(missing), "missing-key", subject))


def foreign_key_problems(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    p = parent.select(F.col(parent_key or key).alias(key))
    return _rule(child.where(F.col(key).isNotNull()).join(p, key, "left_anti").select(key).distinct(), "no-parent", F.col(key))


def raise_if_any(problems: DataFrame) -> None:
    rows = problems.limit(20).collect()
    if rows:
        raise ValueError("; ".join(f"{r['rule']}: {r['subject']}" for r in rows))
