"""Co-occurrence graph: pair facts from shared keys, aggregated to edges, enriched to nodes.

Pairs are made per key (team or thesis), whose sizes are small by nature; facts are distinct before the self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.helpers import canonicalize, cross_group, page, paged, written

FLOORS = {"co_project": 2, "co_supervision": 1}
GRAPH_FLOORS = {"co_project": 4, "co_supervision": 1}
PAIRS_OF_A_TASK = 500_000


def pair_facts(membership: DataFrame, key: str, person: str = "person_slug") -> DataFrame:
    """person_a < person_b, key, team_size: one row for each pair that shares a key, all distinct."""
    m = membership.select(key, person).distinct()
    sized = m.join(m.groupBy(key).agg(F.count("*").alias("team_size")), key)
    a = sized.select(key, F.col(person).alias("person_a"), "team_size")
    b = m.select(key, F.col(person).alias("person_b"))
    return a.join(b, key).where("person_a < person_b").select("person_a", "person_b", key, "team_size")


def spread(membership: DataFrame, key: str) -> DataFrame:
    """membership dealt out by key over as many tasks as its pairs need, so a task's pairs don't grow with the table.

    The size of a shuffle says little of what is made of it, so the number of tasks is not left to AQE."""
    team = membership.groupBy(key).agg(F.count("*").cast("double").alias("n"))
    pairs = team.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    return membership.repartition(int(pairs // PAIRS_OF_A_TASK) + 1, key)


def canonical_facts(membership: DataFrame, aliases: DataFrame, key: str, person: str = "person_slug") -> DataFrame:
    """As pair_facts, between canonical people; team_size counts the team as published.

    The membership is mapped, written and dealt out by key before anything else, so all that follows stays where it is."""
    m = canonicalize(membership.select(key, F.col(person).alias("_as"), person), aliases, person)
    m = spread(written(m), key).distinct().withColumn("team_size", F.count("*").over(Window.partitionBy(key)))
    m = m.drop("_as").distinct()
    a = m.select(key, F.col(person).alias("person_a"), "team_size")
    b = m.select(key, F.col(person).alias("person_b"))
    return a.join(b, key).where("person_a < person_b").select("person_a", "person_b", key, "team_size")


def co_project_edges(project_people: DataFrame, aliases: DataFrame) -> DataFrame:
    """weight: shared projects; normalized: sum of 1 / (team - 1), the team as published (before aliases)."""
    facts = canonical_facts(project_people, aliases, "project_id")
    share = F.when(F.col("team_size") > 1, 1.0 / (F.col("team_size") - 1)).otherwise(0.0)
    return facts.groupBy("person_a", "person_b").agg(F.count("*").alias("weight"), F.round(F.sum(share), 3).alias("weight_normalized"))


def shared_ids(project_people: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """The shared project ids of the given edges only."""
    facts = canonical_facts(project_people, aliases, "project_id").select("person_a", "person_b", "project_id")
    return facts.join(edges.select("person_a", "person_b"), ["person_a", "person_b"], "left_semi").groupBy("person_a", "person_b").agg(F.array_sort(F.collect_list("project_id")).alias("shared"))


def labels(shared: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, title of every project that some edge's shared ids name, once."""
    ids = shared.select(F.explode("shared").alias("project_id"))
    return projects.select("project_id", "title").join(ids, "project_id", "left_semi")


def co_supervision_edges(thesis_people: DataFrame, aliases: DataFrame) -> DataFrame:
    sup = thesis_people.where("role = 'supervisor' and person_slug is not null and match_status in ('exact', 'confident')")
    facts = canonical_facts(sup, aliases, "handle")
    return facts.groupBy("person_a", "person_b").agg(F.count("*").alias("weight"), F.lit(None).cast("double").alias("weight_normalized"))


def person_groups(project_people: DataFrame, project_groups: DataFrame, aliases: DataFrame) -> DataFrame:
    """slug, codes: groups of a person in any role, united over an alias group and given under each of its slugs."""
    raw = project_people.select("person_slug", "project_id").join(project_groups, "project_id").select("person_slug", "group_code").distinct()
    canon = canonicalize(raw, aliases, "person_slug").distinct()
    under = canon.select(F.col("person_slug").alias("slug"), "group_code")
    alias = aliases.join(canon, F.col("to_slug") == F.col("person_slug")).select(F.col("from_slug").alias("slug"), "group_code")
    return under.unionByName(alias).groupBy("slug").agg(F.array_sort(F.collect_set("group_code")).alias("codes"))


def enriched(edges: DataFrame, people: DataFrame, groups: DataFrame) -> DataFrame:
    """Names, groups and whether the two ends share no group (null where either has none)."""
    out = edges
    for end in ("a", "b"):
        p = people.select(F.col("slug").alias(f"person_{end}"), F.col("name").alias(f"name_{end}"))
        g = groups.select(F.col("slug").alias(f"person_{end}"), F.col("codes").alias(f"groups_{end}"))
        out = out.join(p, f"person_{end}", "left").join(g, f"person_{end}", "left").withColumn(f"groups_{end}", F.coalesce(f"groups_{end}", F.array().cast("array<string>")))
    return out.withColumn("cross_group", cross_group("groups_a", "groups_b"))


def ranked_pairs(edges: DataFrame, min_weight: int = 2, sort: str = "weight", limit: int = 50, offset: int = 0, total: bool = False) -> DataFrame:
    first: list[Column] = [F.desc("weight")] if sort == "weight" else [F.desc("weight_normalized"), F.desc("weight")]
    return (paged if total else page)(edges.where(F.col("weight") >= min_weight), [*first, F.asc("person_a"), F.asc("person_b")], limit, offset)


def graph_nodes(edges: DataFrame, floor: int) -> DataFrame:
    """Nodes that keep an edge at the floor: degree there, and over all edges."""
    ends = edges.select(F.explode(F.array("person_a", "person_b")).alias("slug"), (F.col("weight") >= floor).alias("kept"))
    return ends.groupBy("slug").agg(F.count_if("kept").alias("degree"), F.count("*").alias("degree_full")).where("degree > 0")


def graph_edges(edges: DataFrame, floor: int) -> DataFrame:
    return edges.where(F.col("weight") >= floor)


def neighbours(edges: DataFrame, other_edges: DataFrame, slug) -> DataFrame:
    """Everyone linked with a person, with the other kind's weight beside."""
    def around(e: DataFrame) -> DataFrame:
        return e.where((F.col("person_a") == slug) | (F.col("person_b") == slug)).withColumn("slug", F.when(F.col("person_a") == slug, F.col("person_b")).otherwise(F.col("person_a")))

    other = around(other_edges).select("slug", F.col("weight").alias("other_weight"))
    return around(edges).select("slug", "weight", "weight_normalized").join(other, "slug", "left")


def summary(edges: DataFrame, floor: int) -> DataFrame:
    return edges.agg(F.count("*").alias("pair_count"), F.count_if(F.col("weight") < floor).alias("below_floor"), F.max("weight").alias("max_weight"))


def exclusions(coverage: DataFrame) -> DataFrame:
    """What unresolved names cost the graph, from the attribution coverage."""
    c = F.col
    return coverage.select(
        (c("supervisor_names") - c("supervisor_names_resolved")).alias("names_excluded"),
        (c("edges") - c("edges_resolved")).alias("edges_excluded"),
        (c("pairs") - c("pairs_resolved")).alias("pairs_excluded"),
    )
