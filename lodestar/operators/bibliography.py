"""Citation parsing and deduplication. Sequential parsing is one Arrow-batched function a document; everything after is joins."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import fold_text
from lodestar.operators.helpers import written

#: What heads a list of references, what a year and a DOI look like, how an entry begins in each style.
HEADING = re.compile(
    r"^\s*(?:\d{1,4}\s*[\.\)]?\s*)?"
    r"(references|reference list|bibliography|bibliographie|bibliografia"
    r"|bibliograf[ií]a|refer[êe]ncias|referencias|literature cited|works cited)"
    r"\s*[:\.]?\s*(?:\d{1,4})?\s*$",
    re.IGNORECASE,
)
YEAR = re.compile(r"(?:1[89]|20)\d{2}")
DOI = re.compile(r"\b10\.\d{4,9}/[^\s,;\"'<>()\[\]]{4,}", re.IGNORECASE)
STYLES = {
    "numbered": re.compile(r"^\s*\d{1,3}\s*[\.\)]\s+\S"),
    "bracketed": re.compile(r"^\s*\[\s*\d{1,3}\s*\]\s*\S"),
    "labelled": re.compile(r"^\s*\[[^\]\d][^\]]{2,60}\]\s*\S"),
    "authoryear": re.compile(
        r"^\s*[A-ZÀ-Þ][\w'’\-]+\s*,\s*(?:[A-ZÀ-Þ]\.|[A-ZÀ-Þ][\w'’\-]+)"
        r"|^\s*[A-ZÀ-Þ][\w'’\-]+\s*\((?:1[89]|20)\d{2}"
    ),
    "authorfull": re.compile(r"^\s*(?:[A-ZÀ-Þ][\w'’\-]+\.?\s+){1,3}[A-ZÀ-Þ][\w'’\-]+\s*,\s"),
}
#: The marks of a Markdown heading, allowed before a heading besides.
MARKS = re.compile(r"\s*#{1,6}\s+")
LABEL = re.compile(r"\s*(?:\[[^\]]{1,60}\]|\d{1,3}\s*[.)])\s*")
QUOTED = re.compile(r"[“\"«‘]([^”\"»’]{15,300})[”\"»’]")
YEAR_OF = (re.compile(r"\(\s*((?:1[89]|20)\d{2})\s*[a-z]?\s*\)"), re.compile(r"(?<![\d/(])\b((?:1[89]|20)\d{2})[a-z]?\s*[.,]"))
SENTENCE = re.compile(r"\.\s+(?=[A-ZÀ-Þ]|In\b|$)")
INITIALS = re.compile(r"\s*(?:[A-ZÀ-Þ]\.\s*)+")
SURNAME = tuple(map(re.compile, (r"\s*([A-ZÀ-Þ][\w'’-]+)\s*,", r"\s*(?:[A-ZÀ-Þ][\w'’-]+\.?\s+){1,3}([A-ZÀ-Þ][\w'’-]+)\s*[,.&]", r"\s*([A-ZÀ-Þ][\w'’-]+)")))
#: Lines of a window, the share of them that must look cited, lines between parts of one list, least entries
#: and greatest distance of starts in a list without a heading, where such a list may begin, the score it needs.
WINDOW, DENSITY, GAP, TAIL, STEP, LATE, BELIEVED = 16, 0.45, 60, 20, 12, 0.55, 0.25
#: Lengths of an entry, of the middle entry of a good list, of a title; how far on a year still dates the authors.
ENTRY, MIDDLE, TITLE, EARLY = (40, 1500), (60, 600), (15, 400), 0.55


def flags(test, lines: list[str]) -> np.ndarray:
    return np.array([test(x) is not None for x in lines], bool)


def looks_cited(line: str) -> bool:
    """line: stripped."""
    return len(line) >= 12 and (line.count(",") >= 2 or YEAR.search(line) is not None or DOI.search(line) is not None)


def part_ends(cited: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Of each line, where a part that begins there ends: windows are laid end to end up to one that neither itself nor at
    three times its length looks cited. One table of windows by phase answers for all lines at once."""
    n = len(filled)
    sums = np.zeros((2, n + 1), np.int64)
    np.cumsum([cited, filled], axis=1, out=sums[:, 1:])
    at = np.arange(n)
    thin = np.full(-(-n // WINDOW) * WINDOW, n)
    thin[:n] = at
    for length in (WINDOW, 3 * WINDOW):
        many, held = sums[:, np.minimum(at + length, n)] - sums[:, :n]
        thin[:n][many / np.maximum(held, 1) >= DENSITY] = n
    return np.minimum.accumulate(thin.reshape(-1, WINDOW)[::-1], axis=0)[::-1].ravel()[:n]


def headed(lines: list[str]) -> list[slice]:
    """The parts behind headings, close ones joined. Only what follows the first heading is looked at."""
    at = [i for i, x in enumerate(lines) if HEADING.match(x) or ("#" in x and HEADING.match(MARKS.sub("", x, count=1)))]
    if not at:
        return []
    first, below = at[0] + 1, [x.strip() for x in lines[at[0] + 1 :]]
    ends = first + part_ends(np.array([looks_cited(x) for x in below], bool), np.array([x != "" for x in below], bool))
    # one more cell at both ends, outside
    inside, held = np.zeros(len(lines) + 2, bool), -1
    for i in at:
        # a heading within or right behind a part is that of a page
        if i > held and i + 1 < len(lines) and ends[i + 1 - first] >= i + 5:
            held = int(ends[i + 1 - first])
            inside[i + 2 : held + 1] = True
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    between = edges[1:-1].reshape(-1, 2)
    kept = between[between[:, 1] - between[:, 0] > GAP]
    return [slice(a, b) for a, b in np.concatenate([edges[:1], kept.ravel(), edges[-1:]]).reshape(-1, 2)]


class Part:
    """Lines of one list, with the length of each and whether it holds a year."""

    def __init__(self, lines: list[str]):
        self.lines = [x.strip() for x in lines]
        self.length = np.array([len(x) for x in self.lines], np.int64)
        self.total = int(self.length.sum())
        self.dated = flags(YEAR.search, lines)
        self.paragraphs = self.length > 0
        self.paragraphs[1:] &= self.length[:-1] == 0

    def fit(self, starts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """For entries that begin at starts: how well they explain the part, the number of each line's entry (0: none), and
        which entries can be one. An entry's length and year are sums over its lines; no text is joined for that."""
        entry = np.cumsum(starts)
        n = int(entry[-1]) + 1
        entry *= self.length > 0
        length, dated = np.bincount(entry, self.length + 1, n)[1:] - 1, np.bincount(entry, self.dated, n)[1:]
        can = (dated > 0) & (length >= ENTRY[0]) & (length <= ENTRY[1])
        some = np.sort(length[can])
        n = len(some)
        if n < 3:
            return 0.0, entry, can
        usual = 2 * MIDDLE[0] <= some[(n - 1) // 2] + some[n // 2] <= 2 * MIDDLE[1]
        return min(1.0, some.sum() / self.total) * (n / len(can)) * (1.0 if usual else 0.4), entry, can

    def texts(self, entry: np.ndarray, can: np.ndarray) -> list[str]:
        rows = [(e, x) for e, x in zip(entry, self.lines) if e and can[e - 1]]
        return [" ".join(x for _, x in g) for _, g in itertools.groupby(rows, key=lambda r: r[0])]


def entries(lines: list[str]) -> list[tuple[str, str]]:
    """style and text of each entry, by the style that explains the lines best (the earlier one on ties)."""
    part = Part(lines)
    starts = {style: flags(pattern.match, lines) for style, pattern in STYLES.items()}
    fits = {style: part.fit(at) for style, at in starts.items() if at.sum() >= 3} | {"blankline": part.fit(part.paragraphs)}
    style = max(fits, key=lambda k: fits[k][0])
    return [(style, e) for e in part.texts(*fits[style][1:])] if fits[style][0] else []


def unheaded(lines: list[str]) -> list[slice]:
    """Where no heading was left: the longest run of one style's starts near the end, of the style that explains its run best."""
    late, best = int(len(lines) * LATE), (BELIEVED, [])
    if len(lines) - late < TAIL:
        return []
    for pattern in STYLES.values():
        at = late + np.flatnonzero(flags(pattern.match, lines[late:]))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(at) > STEP) + 1, [len(at)]])
        k = int(np.argmax(np.diff(bounds)))
        run = at[bounds[k] : bounds[k + 1]]
        if len(run) >= TAIL:
            where = slice(int(run[0]), min(int(run[-1]) + STEP, len(lines)))
            score = Part(lines[where]).fit(np.isin(np.arange(where.start, where.stop), run))[0]
            best = max(best, (score, [where]), key=lambda x: x[0])
    return best[1]


def references(text: str) -> list[tuple[str, str]]:
    """style and text of each entry, as they stand."""
    lines = text.splitlines()
    return [e for where in headed(lines) or unheaded(lines) for e in entries(lines[where])]


def display_form(entry: str) -> str:
    """Without the mark of its list, runs of white space as one blank."""
    m = LABEL.match(entry)
    return " ".join(entry[m.end() if m else 0 :].split())


def title_spans(body: str, years: list[re.Match]) -> Iterator[tuple[int, int]]:
    """Where a title may stand, likeliest place first: from an early year to the end of its sentence (a late year dates the
    journal, and so do those after it), then every sentence but the first, which names the authors."""
    stops = [m.span() for m in SENTENCE.finditer(body)]
    for y in itertools.takewhile(lambda y: y.start() <= EARLY * len(body), years):
        begin = len(body) - len(body[y.end() :].lstrip(" .,:"))
        yield begin, next((a for a, _ in stops if a >= begin), len(body))
    yield from zip((b for _, b in stops), [*(a for a, _ in stops[1:]), len(body)])


def parse_entry(entry: str) -> dict[str, str | None]:
    """title, year, first author and cleaned DOI of one entry."""
    m = LABEL.match(entry)
    body = entry[m.end() if m else 0 :].strip()
    years = [y for y in (p.search(body) for p in YEAR_OF) if y]
    if quoted := QUOTED.search(body):
        title = quoted[1].strip(" ,.;")
    else:
        told = (body[a:b].strip(" ,.;") for a, b in title_spans(body, years))
        title = next((t for t in told if TITLE[0] <= len(t) <= TITLE[1]), None)
    bare = YEAR.search(body)
    named = body[i.end() :] if (i := INITIALS.match(body)) else body
    author = next((a[1] for a in (p.match(named) for p in SURNAME) if a), None)
    return {"title": title, "year": years[0][1] if years else bare[0] if bare else None, "first_author": author, "doi": first_doi(entry)}


def first_doi(s: str) -> str | None:
    """The first DOI in lower case without closing signs; none if its suffix is short or breaks off at a separator."""
    m = DOI.search(s)
    d = m[0].rstrip(".,;:)]}’”").lower() if m else ""
    return d if len(d.partition("/")[2]) >= 4 and d[-1] not in "-./_" else None


def title_key(author: str | None, title: str | None) -> str | None:
    """author|title with only letters and figures; none for titles under twelve."""
    t = re.sub(r"[^a-z0-9]", "", fold_text(title) or "")
    return f"{re.sub(r'[^a-z0-9]', '', fold_text(author) or '')}|{t}" if len(t) >= 12 else None


SCHEMA = "slug string, ordinal int, style string, entry string, display string, title string, year string, first_author string, doi string, title_key string"


def parse_references(docs: DataFrame) -> DataFrame:
    """slug, text to one row for each entry; documents without a list of references have no row."""

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32() if x == "ordinal" else pa.string() for x in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for slug, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (style, e) in enumerate(references(text or "")):
                    p = parse_entry(e)
                    row = (slug, i, style, e, display_form(e), p["title"], p["year"], p["first_author"], p["doi"], title_key(p["first_author"], p["title"]))
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return docs.select(F.col("slug").cast("string"), F.col("text").cast("string")).mapInArrow(scan, SCHEMA)


#: Rows that a range of keys holds, about: a task sorts a few ranges.
RANGE_ROWS = 100_000


def ranged(rows: DataFrame, key: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with _b, the number of its range of keys: as many ranges as the rows ask for; 20 keys a range, those of the
    smallest hashes, set the bounds. Any bounds give right results. What is held for them is 20 keys a range. A row meets
    every step-th bound, then the step bounds behind the last one that it reaches: twice the root of the number of ranges.

    rows are read three times (here, and by what looks over the borders of ranges), so they should be a written table."""
    ranges = max(1, math.ceil(rows.count() / range_rows))
    if ranges == 1:
        return rows.withColumn("_b", F.lit(0))
    few = rows.select(key.alias("_k")).orderBy(F.xxhash64("_k"), "_k").limit(20 * ranges).agg(F.sort_array(F.collect_list("_k")).alias("k"))
    bounds, step = few.select(F.filter("k", lambda _, i: i % 20 == 19)).scalar(), max(1, math.isqrt(ranges))
    coarse = F.size(F.filter(F.filter("_k", lambda _, i: i % step == 0), lambda x: x <= key))
    # the bound at (coarse - 1) * step is reached; those behind it, up to the next coarse one, are looked at
    fine = F.size(F.filter(F.slice("_k", (F.greatest("_c", F.lit(1)) - 1) * step + 2, step - 1), lambda x: x <= key))
    placed = rows.withColumn("_k", bounds).withColumn("_c", coarse)
    return placed.withColumn("_b", F.when(F.col("_c") == 0, 0).otherwise((F.col("_c") - 1) * step + 1 + fine)).drop("_k", "_c")


def drop_truncated(dois: DataFrame, column: str = "doi", range_rows: int = RANGE_ROWS) -> DataFrame:
    """DOIs that are no strict prefix of another. In order, a prefix stands right before something it begins; ranges are sorted
    by themselves and the last of a range looks at the first of the next one."""
    d = ranged(written(dois.where(F.col(column).isNotNull()).select(column).distinct()), F.col(column), range_rows)
    border = d.groupBy("_b").agg(F.min(column).alias("_m")).withColumn("_m", F.lead("_m").over(Window.orderBy("_b")))
    inside = d.withColumn("_n", F.lead(column).over(Window.partitionBy("_b").orderBy(column)))
    # at most one row a bucket is broadcast
    following = F.coalesce("_n", "_m")
    return inside.join(F.broadcast(border), "_b").where(following.isNull() | ~following.startswith(F.col(column))).select(column)


def work_key() -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), F.col("doi")), F.col("title_key"), F.concat(F.lit("raw:"), F.col("slug"), F.lit(":"), F.col("ordinal").cast("string")))


def group_works(parsed: DataFrame, shown: str = "display") -> DataFrame:
    """One row a work: tier, the longest wording (the first on ties), year and author from the first entry that has them."""
    keyed = parsed.withColumn("work_key", work_key()).withColumn("match_tier", F.when(F.col("doi").isNotNull(), "doi").when(F.col("title_key").isNotNull(), "title").otherwise("unmatched"))
    order = F.struct("slug", "ordinal")
    longest = F.struct(-F.length(shown), F.col("slug"), F.col("ordinal"))

    def first(c: str) -> Column:
        return F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c)

    return keyed.groupBy("work_key", "match_tier").agg(F.min_by(shown, longest).alias("display"), F.min_by("doi", order).alias("doi"), first("year"), first("first_author"), F.count("*").alias("entries"), F.countDistinct("slug").alias("cited_by"))


def numbered(works: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Ids from 1 by citations, most first, then key: ranges are numbered by themselves behind the sizes of those before."""
    rows = ranged(written(works), F.struct(-F.col("cited_by"), F.col("work_key")), range_rows)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("cited_by"), "work_key"))
    # at most one row a bucket is broadcast
    return rows.join(F.broadcast(before), "_b").select(*works.columns, (place + F.col("_before")).alias("reference_id"))


def title_recall(parsed: DataFrame) -> DataFrame:
    """Of works whose DOI occurs twice or more: how many also agree in their title key."""
    w = parsed.where("doi is not null").groupBy("doi").agg(F.count("*").alias("n"), F.countDistinct("title_key").alias("k"), F.count("title_key").alias("with_key")).where("n >= 2")
    return w.agg(F.count("*").alias("works"), F.count_if((F.col("k") == 1) & (F.col("with_key") == F.col("n"))).alias("agree"))


def parse_coverage(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    per = parsed.groupBy("slug").agg(F.count("*").alias("n"), F.count("doi").alias("dois"))
    return docs.select("slug").join(per, "slug", "left").agg(F.count("*").alias("documents"), F.count("n").alias("with_references"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum("dois"), F.lit(0)).alias("with_doi"))
