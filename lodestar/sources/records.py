"""Harvested records: XML records of a repository and JSON items with language-tagged metadata, as columns of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCTORAL = "doctoralThesis"


def parse_records(df: DataFrame, column: str = "xml") -> DataFrame:
    """One row for each record of a page: handle, deleted, set specs, types, titles, creators; resumption tokens beside.

    Prefixes and default namespaces are dropped first, so paths name elements alone.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(column), r"\sxmlns(?::\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1")
    pages = df.withColumn("_x", plain)
    record = F.explode(F.regexp_extract_all("_x", F.lit(r"(?s)<record\b.*?</record>"), F.lit(0)))
    rows = pages.select(F.nullif(F.regexp_extract("_x", r"(?s)<resumptionToken[^>]*>([^<]*)</resumptionToken>", 1), F.lit("")).alias("token"), record.alias("_r"))

    def all_of(path: str) -> Column:
        return F.expr(f"xpath(_r, '{path}/text()')")

    return rows.select(
        F.element_at(F.split(F.expr("xpath_string(_r, 'record/header/identifier')"), ":"), -1).alias("handle"),
        F.expr("xpath_string(_r, 'record/header/@status') = 'deleted'").alias("deleted"),
        all_of("record/header/setSpec").alias("sets"),
        all_of("record//type").alias("types"),
        all_of("record//title").alias("titles"),
        all_of("record//creator").alias("creators"),
        F.expr("xpath_string(_r, 'record/header/datestamp')").alias("datestamp"),
        "token",
    )


def doctoral(records: DataFrame) -> DataFrame:
    return records.where(~F.col("deleted") & F.exists("types", lambda t: t.endswith(DOCTORAL)))


def first_set_wins(records: DataFrame, order: list[str]) -> DataFrame:
    """One row a handle: that of the first set in order it was harvested from (column harvested_set)."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("harvested_set"))
    cols = [c for c in records.columns if c != "handle"]
    return records.groupBy("handle").agg(F.min_by(F.struct(*cols), place).alias("r")).select("handle", "r.*")


ITEM = "struct<handle:string,metadata:array<struct<key:string,value:string,language:string>>>"


def parse_items(df: DataFrame, column: str = "json") -> DataFrame:
    """handle, title, abstracts by language, authors, advisors, keywords, date, rights of JSON items."""
    item = df.select(F.from_json(column, ITEM).alias("i"))

    def values(key: str, language: str | None = None) -> Column:
        hit = F.filter("i.metadata", lambda m: (m["key"] == key) & (F.coalesce(m["language"], F.lit("")).startswith(language) if language else F.lit(True)))
        return F.transform(hit, lambda m: m["value"])

    def one(*found: Column) -> Column:
        return F.coalesce(*[F.get(v, F.lit(0)) for v in found])

    abstract = "dc.description.abstract"
    return item.select(
        F.col("i.handle").alias("handle"),
        one(values("dc.title")).alias("title"),
        one(values(abstract, "pt")).alias("abstract_pt"),
        one(values(abstract, "en")).alias("abstract_en"),
        values("dc.contributor.author").alias("authors"),
        values("dc.contributor.advisor").alias("supervisors"),
        values("dc.subject").alias("keywords"),
        one(values("dc.date.issued")).alias("date"),
        one(values("dc.rights")).alias("rights"),
    )


def download_link(html: Column) -> Column:
    """The first link to a bitstream that is no decoy (-1)."""
    links = F.regexp_extract_all(html, F.lit('href="([^"]*(?:/bitstreams?/|download)[^"]*)"'), F.lit(1))
    return F.get(F.filter(links, lambda x: ~x.contains("/-1")), F.lit(0))
