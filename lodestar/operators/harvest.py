"""A harvest run written into the stored tables: outcome of each target, project rows, child rows, the run's figures.

A run is two tables: listing (seq, title, url, details, scope), one row a target in the order it was met, and fetched (seq,
http_status, error, page), one row a target that was asked for; page is a struct of what the detail page gave, null where
it could not be read. Targets fall into four states, and what a state may write differs:

    no_detail_url  the site links no page: the row's title, listing columns and reason are written, url and slug emptied
    ok             the page's columns are written too, and all children of the project are replaced, by none if it has none
    http_error     title, url, listing columns, status and reason are written; page columns and children stay as stored
    pending        nothing was asked for yet (the run was cut off): nothing is written

Projects are told apart by their normalised titles. Where a run meets one more than once, each column has the value of the
last row in order that may write it, which one aggregation gives without going through the rows in turn: the last row, and
the last successful row, of each title. first_seen_at is kept once it is set.

Defined cases: targets without a title are left out of projects and children (they stay among the targets); a fetched row
without a listing row is ignored; null arrays of a page count as empty. seq is a key of both tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text

NO_PAGE = "no detail url published by site"
#: Columns that any outcome writes.
COMMON = ["title", "detail_url", "slug", "listing_details", "listing_scope", "detail_fetched", "detail_unavailable_reason", "detail_http_status", "last_scraped_at"]
#: Columns that only a page writes, in the order of the stored table.
PAGE = ["scope", "synopsis", "funding_raw", "partners_raw", "keywords_raw"]
AMOUNTS, DATES = ["total_budget", "own_budget"], ["start_date", "end_date"]


def outcomes(listing: DataFrame, fetched: DataFrame, listing_url: str | None = None) -> DataFrame:
    """listing's rows with title_norm, status, http_status, error and page. A url that is blank or the listing's own address
    (listing_url) is no detail page."""
    bare = F.regexp_replace(F.trim(F.coalesce("url", F.lit(""))), "/+$", "")
    stub = bare.isin(*{"", (listing_url or "").rstrip("/")})
    met = listing.join(fetched.select("seq", "http_status", "error", "page", F.lit(True).alias("_asked")), "seq", "left")
    status = F.when(stub, "no_detail_url").when(F.col("_asked").isNull(), "pending").when(F.col("page").isNotNull(), "ok").otherwise("http_error")
    ran = status.isin("ok", "http_error")
    return met.select(
        *listing.columns,
        text.normalize_title("title").alias("title_norm"),
        status.alias("status"),
        F.when(ran, F.col("http_status")).alias("http_status"),
        F.when(status == "http_error", F.col("error")).alias("error"),
        F.when(status == "ok", F.col("page")).alias("page"),
    )


def targets(done: DataFrame) -> DataFrame:
    """The run's log: seq, title, url, status, http_status, error."""
    return done.select("seq", "title", "url", "status", "http_status", "error")


def run_figures(done: DataFrame) -> DataFrame:
    """One row: listing_rows, detail_ok, detail_failed, stubs and pending, which sum up to listing_rows."""
    count = {"detail_ok": "ok", "detail_failed": "http_error", "stubs": "no_detail_url", "pending": "pending"}
    return done.agg(F.count("*").alias("listing_rows"), *[F.count_if(F.col("status") == s).alias(c) for c, s in count.items()])


def _written(done: DataFrame) -> DataFrame:
    return done.where("status != 'pending' and title_norm is not null")


def _common(now: Column) -> Column:
    """What a row of any outcome writes."""
    stub, ok = F.col("status") == "no_detail_url", F.col("status") == "ok"
    reason = F.when(stub, NO_PAGE).when(~ok, F.concat(F.lit("fetch failed: "), F.coalesce("error", F.lit("unknown"))))
    value = {
        "title": F.col("title"), "detail_url": F.when(~stub, F.col("url")), "slug": F.when(~stub, text.slug_of_url(F.col("url"))), "listing_details": F.col("details"), "listing_scope": F.col("scope"),
        "detail_fetched": ok, "detail_unavailable_reason": reason, "detail_http_status": F.col("http_status"), "last_scraped_at": now,
    }
    return F.struct(*[value[c].alias(c) for c in COMMON])


def _of_page() -> list[Column]:
    """The stored columns of a page: as they stand, amounts and currencies parsed, dates parsed."""
    p = F.col("_page")
    out = [p[c].alias(c) for c in PAGE]
    for c in AMOUNTS:
        money = text.parse_money(p[f"{c}_raw"])
        out += [p[f"{c}_raw"].alias(f"{c}_raw"), money["amount"].alias(f"{c}_amount"), money["currency"].alias(f"{c}_currency")]
    for c in DATES:
        out += [p[f"{c}_raw"].alias(f"{c}_raw"), text.parse_date(p[f"{c}_raw"]).alias(c)]
    return out


def projects(done: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """The project table after the run. stored has title_norm, the columns named above and first_seen_at; others that it has
    stay as they are, and are null in new rows."""
    ok = F.col("status") == "ok"
    per = _written(done).groupBy("title_norm").agg(F.max_by(_common(now), "seq").alias("_last"), F.max_by("page", F.when(ok, F.col("seq"))).alias("_page"))
    new = per.select("title_norm", "_last.*", F.col("_page").isNotNull().alias("_read"), *_of_page())
    n, o = new.withColumn("_met", F.lit(True)).alias("n"), stored.withColumn("_old", F.lit(True)).alias("o")

    def value(c: str) -> Column:
        if c == "title_norm":
            return F.coalesce(f"o.{c}", f"n.{c}")
        if c == "first_seen_at":
            return F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(now)
        if c not in new.columns:
            return F.col(f"o.{c}")
        wins = F.col("n._met" if c in COMMON else "n._read")
        return F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return o.join(n, F.col("o.title_norm") == F.col("n.title_norm"), "full_outer").select(*[value(c).alias(c) for c in stored.columns])


def children(done: DataFrame, stored: DataFrame, rows: Column) -> DataFrame:
    """A child table (title_norm and the fields of rows) after the run. rows: an array of structs of a page, page's fields under
    the column page. Projects read in this run lose all stored children and get those of their last page."""
    ok = _written(done).where("status = 'ok'").groupBy("title_norm").agg(F.max_by("page", "seq").alias("page"))
    kept = stored.join(ok.select("title_norm"), "title_norm", "left_anti").select(*stored.columns)
    return kept.unionByName(ok.select("title_norm", F.explode(rows).alias("_c")).select("title_norm", "_c.*").select(*stored.columns))


def numbered(items: Column, field: str) -> Column:
    """An array as structs of field and ordinal."""
    return F.transform(items, lambda x, i: F.struct(x.alias(field), i.alias("ordinal")))


def team(page: Column) -> Column:
    """slug, role, ordinal: the coordinator, then the researchers as listed."""
    lead = F.when(page["coordinator"].isNotNull(), F.array(F.struct(page["coordinator"]["slug"].alias("slug"), F.lit("coordinator").alias("role"), F.lit(0).alias("ordinal"))))
    rest = F.transform(page["researchers"], lambda x, i: F.struct(x["slug"].alias("slug"), F.lit("researcher").alias("role"), i.alias("ordinal")))
    return F.concat(F.coalesce(lead, F.array()), F.coalesce(rest, F.array()))


def named_people(done: DataFrame, stored: DataFrame) -> DataFrame:
    """slug, name after the run: the last page that names a person gives the name."""
    one = F.concat(F.coalesce(F.when(F.col("page.coordinator").isNotNull(), F.array("page.coordinator")), F.array()), F.coalesce("page.researchers", F.array()))
    seen = _written(done).where("status = 'ok'").select("seq", F.posexplode(one).alias("at", "p")).groupBy("p.slug").agg(F.max_by("p.name", F.struct("seq", "at")).alias("_new"))
    return stored.join(seen, "slug", "full_outer").select("slug", F.coalesce("_new", "name").alias("name"))
