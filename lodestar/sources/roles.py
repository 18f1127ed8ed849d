"""Role views: the portfolio tables that the operators take, bound to the generic star schema.

``Roles(spark, dir)`` gives one DataFrame for each role, read lazily; columns and filters reach the Parquet scans. An
application with tables of its own builds the same namespace from those.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def projects(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("project_id"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
            F.col("o_totalprice").alias("budget"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
            F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("funding_raw"),
            (F.col("o_orderstatus") != "P").alias("detail_fetched"),
            F.when(F.col("o_orderstatus") == "P", F.lit("no detail page")).alias("unavailable_reason"),
            F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("synopsis"),
        )

    @cached_property
    def groups(self) -> DataFrame:
        return self.table("region").select(F.substring("r_name", 1, 3).alias("code"), F.col("r_name").alias("name"))

    @cached_property
    def people(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("slug"), F.col("s_name").alias("name"))

    @cached_property
    def aliases(self) -> DataFrame:
        """One hop: no target is an alias itself."""
        s = self.table("supplier").where("s_suppkey % 10 = 9")
        return s.select(F.col("s_suppkey").alias("from_slug"), (F.col("s_suppkey") - 1).alias("to_slug"))

    @cached_property
    def listings(self) -> DataFrame:
        s = self.table("supplier").where("s_suppkey % 3 = 0")
        return s.select(F.col("s_suppkey").alias("person_slug"), F.concat(F.lit("unit-"), (F.col("s_nationkey") % 4).cast("string")).alias("source"))

    @cached_property
    def project_people(self) -> DataFrame:
        role = F.when(F.col("l_linenumber") == 1, "coordinator").otherwise("researcher")
        return self.table("lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_suppkey").alias("person_slug"), role.alias("role")).distinct()

    @cached_property
    def project_groups(self) -> DataFrame:
        place = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        line = self.table("lineitem").select("l_orderkey", "l_suppkey")
        return line.join(place.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("project_id"), F.substring("r_name", 1, 3).alias("group_code")).distinct()

    @cached_property
    def partners(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        part = self.table("part").select("p_partkey", "p_brand", "p_type")
        kind = F.when(F.col("p_type").isin("STANDARD", "ECONOMY", "MEDIUM"), "academic").otherwise("industry")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("project_id"), F.col("p_brand").alias("partner_name"), kind.alias("partner_type"), F.col("l_linenumber").alias("ordinal"))

    @cached_property
    def fields(self) -> DataFrame:
        """Label and value rows of the projects, some values empty or null."""
        o = self.table("orders")
        stacked = "stack(3, 'status', nullif(o_orderstatus, 'O'), 'priority', if(o_orderkey % 5 = 0, '', o_orderpriority), 'date', cast(date_format(o_orderdate, 'yyyy-MM-dd') as string)) as (label, value_text)"
        return o.where("o_orderstatus != 'P'").selectExpr("o_orderkey as project_id", stacked)

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("site_total"))

    @cached_property
    def targets(self) -> DataFrame:
        status = F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type"))
        return self.table("events").select(F.col("event_id").alias("target_id"), F.col("user_id").alias("run_id"), status.alias("status"))

    @cached_property
    def theses(self) -> DataFrame:
        d = self.table("documents")
        return d.select(
            F.col("doc_id").alias("handle"),
            F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
            (F.lit(1990) + F.col("doc_id") % 30).cast("string").alias("year"),
            (F.col("n_chars") > 500).alias("full_text"),
        )

    @cached_property
    def thesis_people(self) -> DataFrame:
        """An author, a supervisor, and for every third document a second supervisor; slugs are null where unresolved."""
        d = self.table("documents").select("doc_id", "source")
        status = F.when(F.col("doc_id") % 4 == 0, "unmatched").when(F.col("doc_id") % 4 == 1, "confident").otherwise("exact")
        resolved = F.col("doc_id") % 4 != 0
        rows = [
            (F.lit(True), F.concat(F.lit("author "), F.col("doc_id").cast("string")), "author", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 10 + 1)),
            (F.lit(True), F.col("source"), "supervisor", F.when(resolved, F.col("doc_id") % 10 + 1)),
            (F.col("doc_id") % 3 == 0, F.concat(F.lit("co "), F.col("source")), "supervisor", F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") * 7) % 10 + 1)),
        ]
        array = F.array(*[F.when(on, F.struct(name.alias("name_raw"), F.lit(role).alias("role"), slug.alias("person_slug"))) for on, name, role, slug in rows])
        flat = d.select(F.col("doc_id").alias("handle"), status.alias("s"), F.explode(F.filter(array, lambda x: x.isNotNull())).alias("x"))
        return flat.select("handle", "x.name_raw", "x.role", "x.person_slug", F.when(F.col("x.person_slug").isNull(), "unmatched").when(F.col("s") == "unmatched", "confident").otherwise(F.col("s")).alias("match_status"))

    @cached_property
    def citations(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_orderkey") % 1000).alias("handle"), F.col("l_partkey").alias("reference_id")).distinct()

    @cached_property
    def references(self) -> DataFrame:
        cited = self.citations.groupBy("reference_id").agg(F.count("*").alias("cited_by"))
        p = self.table("part")
        tier = F.when(F.col("p_size") % 3 == 0, "doi").when(F.col("p_size") % 3 == 1, "title").otherwise("unmatched")
        return p.join(cited, F.col("p_partkey") == F.col("reference_id")).select("reference_id", F.col("p_name").alias("display"), tier.alias("match_tier"), "cited_by")

    @cached_property
    def passages(self) -> DataFrame:
        """Embedded passages: handle is the label, ordinal the id."""
        return self.table("embeddings").select(F.col("vec_id").alias("ordinal"), F.col("label").alias("handle"), "embedding")
