"""Staff directories crawled over stored pages: units with sections and paging, four shapes of page, a floor for each unit.

Every stored page on a unit's host is parsed once, where it lies, by a table function that knows the four shapes. What the
crawl then follows are narrow rows: of each page its next link, of each person a key. The frontier holds one page a unit, so
a round takes all units one page further; there are as many rounds as the longest unit has pages, whatever the number of units.
A section ends at a page that names nobody new to its unit (sites answer pages past the end with old or empty ones).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import canonical_url, display_name, fold, published_name
from lodestar.operators.helpers import shared_folder, written
from lodestar.sources.html import VOID

#: Words of ranks, what heads a list of names, an e-mail, the classes that mark a name and the link to more.
RANKS = (
    "professor", "professora", "investigador", "investigadora", "assistente", "leitor", "leitora", "docente", "monitor", "monitora", "diretor", "diretora",
    "subdiretor", "técnic", "especialista", "emérit", "jubilad", "aposentad", "convidad", "coordenador", "bolseir",
)
NOT_A_NAME = re.compile(
    r"^(?:[A-Z]|professores?|professoras?|docentes?|investigador|filtros?|pessoas|"
    r"corpo\s+docente|jubilados?|aposentados?|in\s+memoriam|contactos?)\b",
    re.I,
)
EMAIL = re.compile(r"[\w.\-+]+@[\w.\-]+\.\w+")
CARD_NAME, LINKED_NAME, MORE = {"text-lg", "font-bold"}, {"person-name"}, {"jscroll-next"}
#: Elements whose beginning ends open ones of the same list or table where their end tag was left out.
ENDED = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "li": {"li"}}
#: Public registers whose pages stand for one person; a site's own patterns go before them.
REGISTERS = (r"^https?://(?:www\.)?cienciavitae\.pt/(?:portal/)?[A-Z0-9]{4}-[A-Z0-9\-]+/?$", r"^https?://orcid\.org/[0-9X\-]+/?$")


class Page(HTMLParser):
    """Elements and texts in order of their beginning; each knows its parent and where what it holds ends. What lies inside
    an element is a range, so questions of containment are comparisons of positions."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag: list[str | None] = []
        self.held: list = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        for i in self.open:
            self.end[i] = len(self.tag)

    def _put(self, tag: str | None, held) -> None:
        self.parent.append(self.open[-1] if self.open else -1)
        self.tag.append(tag)
        self.held.append(held)
        self.end.append(len(self.tag))

    def handle_starttag(self, tag, attrs):
        bound = next((n for n in range(len(self.open) - 1, -1, -1) if self.tag[self.open[n]] in ("table", "ul", "ol")), -1) if tag in ENDED else 0
        if any(self.tag[i] in ENDED.get(tag, ()) for i in self.open[bound + 1 :]):
            first = next(n for n in range(bound + 1, len(self.open)) if self.tag[self.open[n]] in ENDED[tag])
            for i in self.open[first:]:
                self.end[i] = len(self.tag)
            del self.open[first:]
        self._put(tag, dict(attrs))
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self._put(tag, dict(attrs))

    def handle_endtag(self, tag):
        if any(self.tag[i] == tag for i in self.open):
            while self.tag[i := self.open.pop()] != tag:
                self.end[i] = len(self.tag)
            self.end[i] = len(self.tag)

    def handle_data(self, data):
        if not self.open or self.tag[self.open[-1]] not in ("script", "style"):
            self._put(None, data)

    def all(self, *tags: str, inside: int | None = None, marked: set[str] = frozenset()) -> list[int]:
        span = range(len(self.tag)) if inside is None else range(inside + 1, self.end[inside])
        return [i for i in span if self.tag[i] in tags and marked <= set((self.held[i].get("class") or "").split())]

    def strings(self, i: int) -> list[str]:
        return [x for k in range(i, self.end[i]) if self.tag[k] is None and (x := " ".join(self.held[k].split()))]

    def text(self, i: int) -> str:
        return " ".join("".join(self.held[k] for k in range(i, self.end[i]) if self.tag[k] is None).split())

    def links(self, i: int | None = None) -> list[str]:
        return [h for k in self.all("a", inside=i) if (h := self.held[k].get("href"))]


def is_rank(s: str) -> bool:
    return any(w in s.lower() for w in RANKS)


def looks_like_a_name(published: str) -> bool:
    """Two words or more without figures, at most 120 characters; no heading of a list and no rank."""
    s = published_name(published) or ""
    n = len(s.split())
    return n >= 2 and len(s) <= 120 and not any(c.isdigit() for c in s) and not (n < 3 and NOT_A_NAME.match(s)) and not (n <= 4 and is_rank(s))


@cache
def _pattern(p: str) -> re.Pattern:
    return re.compile(p, re.I)


def person_url(links: list[str], url: str, patterns: list[str]) -> str | None:
    """The link that stands for a person: of the first pattern that any matches, the first one."""
    whole = [urljoin(url, x) for x in links]
    return next((x for p in patterns for x in whole if _pattern(p).match(x)), None)


def mail_of(links: list[str]) -> str | None:
    return next((x[7:] for x in links if x.lower().startswith("mailto:")), None)


#: name, person_url, role, email
Person = tuple[str, str | None, str | None, str | None]


def name_tables(page: Page) -> Iterator[Person]:
    """Tables of three rows or more with one cell a row, without any link or e-mail: names of former staff."""
    for t in page.all("table"):
        cells = [page.all("td", "th", inside=r) for r in page.all("tr", inside=t)]
        if len(cells) >= 3 and all(len(c) == 1 for c in cells) and not page.all("a", inside=t) and not EMAIL.search(" ".join(page.strings(t))):
            yield from ((name, None, None, None) for (c,) in cells if looks_like_a_name(name := page.text(c)))


def cards(page: Page, url: str, patterns: list[str]) -> Iterator[Person]:
    """Tables of names, then cards: a name's card is the widest element around it that holds no other name."""
    yield from name_tables(page)
    marks = page.all("span", marked=CARD_NAME)
    for i in marks:
        if not looks_like_a_name(name := page.text(i)):
            continue
        card, up = i, page.parent[i]
        while up >= 0 and page.tag[up] not in ("body", "html") and bisect_left(marks, page.end[up]) - bisect_left(marks, up) == 1:
            card, up = up, page.parent[up]
        texts, links = page.strings(card), page.links(card)
        mail = EMAIL.search(" ".join(texts))
        yield name, person_url(links, url, patterns), next(filter(is_rank, texts), None), mail[0] if mail else mail_of(links)


def linked(page: Page, url: str, patterns: list[str]) -> Iterator[Person]:
    """Links to the site's own pages of people (the first pattern), each with its longest text that is a name."""
    longest: dict[str, str] = {}
    for i in page.all("a"):
        target, name = urljoin(url, page.held[i].get("href") or ""), page.text(i)
        if patterns and _pattern(patterns[0]).match(target) and looks_like_a_name(name):
            longest[target] = max(longest.get(target, ""), name, key=len)
    yield from ((name, target, None, None) for target, name in longest.items())


def marked(page: Page, url: str, patterns: list[str]) -> Iterator[Person]:
    """Links marked as names."""
    for i in page.all("a", marked=LINKED_NAME):
        if (href := page.held[i].get("href")) and len((name := page.text(i)).split()) >= 2:
            yield name, urljoin(url, href), None, None


def tabled(page: Page, url: str, patterns: list[str]) -> Iterator[Person]:
    """Rows with a mail link, the name in the first cell, a rank in the second if it is one."""
    for r in page.all("tr"):
        cells, links = page.all("td", "th", inside=r), page.links(r)
        if cells and (mail := mail_of(links)) and looks_like_a_name(name := page.text(cells[0])):
            role = page.text(cells[1]) if len(cells) > 1 else ""
            yield name, person_url(links, url, patterns), role if role and "@" not in role and is_rank(role) else None, mail


SHAPES = {"cards": cards, "linked": linked, "marked": marked, "tabled": tabled}


@F.udtf(returnType="ordinal int, name string, person_url string, role string, email string, next_url string")
class ParsePage:
    """Of one page: a row (ordinal -1) with its link to more, and a row a person in the page's order. An unknown shape raises."""

    def eval(self, shape: str, html: str, url: str, patterns: list[str]):
        if shape not in SHAPES:
            raise ValueError(f"no shape {shape}; there are {', '.join(SHAPES)}")
        page = Page(html or "")
        more = next((h for i in page.all("a", marked=MORE) if (h := page.held[i].get("href"))), None) if shape == "marked" else None
        yield -1, None, None, None, None, more and urljoin(url, more)
        for n, row in enumerate(SHAPES[shape](page, url, list(patterns or []))):
            yield n, *row, None


UNITS = "unit string, shape string, paging string, sections array<string>, max_pages int, least int"
PAGINGS = ("none", "page", "follow_next")


def host(url: Column) -> Column:
    return F.regexp_extract(canonical_url(url), r"^[^/]*", 0)


def parsed_pages(units: DataFrame, pages: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """unit, url and what each page on a host of the unit shows; a page stored twice counts once (the greatest html)."""
    homes = units.select("unit", "shape", F.explode("sections").alias("s")).select("unit", "shape", host(F.col("s")).alias("host")).distinct()
    stored = pages.select("url", "html").where("url is not null").withColumn("host", host(F.col("url"))).join(homes.select("host").distinct(), "host", "left_semi")
    mine = stored.groupBy("url", "host").agg(F.max("html").alias("html")).join(homes, "host").select("unit", "shape", "url", "html")
    every = F.array(*[F.lit(p) for p in (*patterns, *REGISTERS)])
    return mine.withColumn("patterns", every).lateralJoin(ParsePage(F.col("shape").outer(), F.col("html").outer(), F.col("url").outer(), F.col("patterns").outer())).drop("shape", "html", "patterns")


def crawl(units: DataFrame, pages: DataFrame, patterns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """People, and a report by unit. units: UNITS; pages: url, html; patterns: of the sites' own pages of people.

    People: unit, section (the address it was read under), page (from 0), ordinal, name as published, display, person_url,
    role, email, key (the person's address, else the folded name; a key's first row in its unit counts). A unit's sections are
    read one after the other. Report: unit, pages, people and status: ``ok``; ``missing`` where a section's first page is not
    stored; ``short`` where fewer than least people were found. Only people of units that are ok come out.

    Defined cases: a null html is an empty page; no units or no pages give no people; a page that its own next link names ends the
    section; an unknown shape or paging raises; other columns are ignored."""
    spark = units.sparkSession
    units = written(units.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in UNITS.split(", ")]))
    odd = units.where(~F.col("paging").isin(*PAGINGS)).select("paging").first()
    if odd:
        raise ValueError(f"no paging {odd[0]}; there are {', '.join(PAGINGS)}")
    seen_pages = written(parsed_pages(units, pages, patterns))
    known = seen_pages.where("ordinal < 0").select("unit", "url", F.col("next_url").alias("more"))
    key = F.coalesce(F.nullif(canonical_url(F.col("person_url")), F.lit("")), F.concat(F.lit("name:"), fold("name")))
    people = written(seen_pages.where("ordinal >= 0").withColumn("key", key).drop("next_url"))
    folder = shared_folder(spark)
    state = "unit string, section int, page int, url string"
    read = "unit string, url string, section int, page int, found boolean, round int"
    new = "unit string, key string, url string, section int, page int, ordinal int, name string, person_url string, role string, email string, round int"
    found, visits = spark.createDataFrame([], new), spark.createDataFrame([], read)
    frontier, turn = units.where(F.size("sections") > 0).select("unit", F.lit(0).alias("section"), F.lit(0).alias("page"), F.get("sections", F.lit(0)).alias("url")), 0
    while not frontier.isEmpty():
        rest = [c for c in people.columns if c not in ("unit", "key")]
        here = people.join(frontier, ["unit", "url"]).groupBy("unit", "key").agg(F.min_by(F.struct(*rest, "section", "page"), "ordinal").alias("r")).select("unit", "key", "r.*")
        here.join(found, ["unit", "key"], "left_anti").write.parquet(f"{folder}/people/round={turn}")
        found = spark.read.schema(new).parquet(f"{folder}/people")
        fresh = found.where(F.col("round") == turn).groupBy("unit").agg(F.count("*").alias("fresh"))
        at = frontier.join(known.withColumn("found", F.lit(True)), ["unit", "url"], "left").join(units, "unit").join(fresh, "unit", "left")
        at.select("unit", "url", "section", "page", F.coalesce("found", F.lit(False)).alias("found")).write.parquet(f"{folder}/visits/round={turn}")
        visits = spark.read.schema(read).parquet(f"{folder}/visits")
        base = F.get("sections", F.col("section"))
        counted = F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("page="), (F.col("page") + 2).cast("string"))
        onward = F.when(F.col("paging") == "page", counted).when((F.col("paging") == "follow_next") & (F.col("more") != F.col("url")), F.col("more"))
        goes = F.coalesce(F.col("found") & (F.col("fresh") > 0) & (F.col("page") + 1 < F.col("max_pages")) & onward.isNotNull(), F.lit(False))
        step = at.withColumn("_goes", goes).withColumn("_onward", onward).where(F.col("_goes") | (F.col("found").isNotNull() | (F.col("page") > 0)) & (F.col("section") + 1 < F.size("sections")))
        section = F.when(F.col("_goes"), F.col("section")).otherwise(F.col("section") + 1)
        frontier = step.select(
            "unit", section.cast("int").alias("section"), F.when(F.col("_goes"), F.col("page") + 1).otherwise(0).cast("int").alias("page"), F.when(F.col("_goes"), F.col("_onward")).otherwise(F.get("sections", section)).alias("url")
        )
        frontier.write.parquet(f"{folder}/frontier/{turn}")
        frontier, turn = spark.read.schema(state).parquet(f"{folder}/frontier/{turn}"), turn + 1
    pages_read = visits.groupBy("unit").agg(F.count_if("found").alias("pages"), F.bool_or(~F.col("found") & (F.col("page") == 0)).alias("_lost"))
    counts = found.groupBy("unit").agg(F.count("*").alias("people"))
    both = units.join(pages_read, "unit", "left").join(counts, "unit", "left")
    n = F.coalesce("people", F.lit(0))
    status = F.when(F.coalesce("_lost", F.lit(True)), "missing").when(n < F.col("least"), "short").otherwise("ok")
    report = written(both.select("unit", F.coalesce("pages", F.lit(0)).alias("pages"), n.alias("people"), status.alias("status")))
    out = found.join(report.where("status = 'ok'").select("unit"), "unit", "left_semi").join(units.select("unit", "sections"), "unit")
    out = out.select("unit", F.get("sections", F.col("section")).alias("section"), "page", "ordinal", "name", display_name("name").alias("display"), "person_url", "role", "email", "key")
    return out, report
