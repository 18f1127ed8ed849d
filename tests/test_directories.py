"""Crawls of stored directory pages: four shapes, paging, floors."""

import pytest

from lodestar.sources import directories as d

SITE = (r"^https?://(?:www\.)?site\.example/[a-z]+/pessoas/[^/]+/?$",)
ALL = [*SITE, *d.REGISTERS]
CARD = '<div class="g"><a href="/x/pessoas/{k}"><img src=p></a><div><span class="font-bold text-lg">{name}</span><p>{role}</p><a href="mailto:{k}@site.example">mail</a></div></div>'


def parse(shape, html):
    return list(d.SHAPES[shape](d.Page(html), "https://site.example/x/list", ALL))


def test_cards_take_nothing_from_their_neighbours():
    html = "<html><body><h2>Corpo Docente</h2>" + CARD.format(k="ana", name="Doutora Ana Reis", role="Professora Auxiliar") + CARD.format(k="rui", name="RUI SÁ LOPES", role="sala dois") + '<span class="text-lg font-bold">Filtros</span></body></html>'
    assert parse("cards", html) == [
        ("Doutora Ana Reis", "https://site.example/x/pessoas/ana", "Professora Auxiliar", "ana@site.example"),
        ("RUI SÁ LOPES", "https://site.example/x/pessoas/rui", None, "rui@site.example"),
    ]


def test_tables_of_names():
    def table(*rows):
        return "<table>" + "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows) + "</table>"

    assert parse("cards", table(["Ana Reis"], ["Rui Lopes"], ["Sala 12"])) == [("Ana Reis", None, None, None), ("Rui Lopes", None, None, None)]
    assert parse("cards", table(["Ana Reis"], ["Rui Lopes"])) == []
    assert parse("cards", table(["Ana Reis"], ["Rui Lopes"], ["a", "b"])) == []
    assert parse("cards", table(["Ana Reis"], ["Rui Lopes"], ["<a href=x>Eva Sousa</a>"])) == []
    assert parse("cards", table(["Ana Reis"], ["Rui Lopes"], ["eva@site.example"])) == []


def test_links_and_rows():
    html = '<a href="/x/pessoas/ana">AR</a><a href="/x/pessoas/ana">Ana Reis</a><a href="/x/pessoas/ana">Ana Maria Reis</a><a href="/other/">Rui Lopes</a><a>No Link</a>'
    assert parse("linked", html) == [("Ana Maria Reis", "https://site.example/x/pessoas/ana", None, None)]
    assert parse("marked", '<a class="b person-name" href="p/1">Reis, Ana</a><a class=person-name href=q>Filtros</a><a href=p>Rui Lopes</a>') == [("Reis, Ana", "https://site.example/x/p/1", None, None)]
    rows = "<table><tr><th>Name<th>Rank</tr><tr><td>Ana Reis</td><td>Professora</td><td><a href='mailto:a@b.c'>m</a><a href='https://orcid.org/0000-0001'>o</a></td></tr><tr><td>Rui Lopes<td>r@b.c<td><a href='mailto:r@b.c'>m</a></tr><tr><td>Eva Sousa<td>Leitora</tr></table>"
    assert parse("tabled", rows) == [("Ana Reis", "https://orcid.org/0000-0001", "Professora", "a@b.c"), ("Rui Lopes", None, None, "r@b.c")]


def test_names():
    good = ["Ana Reis", "Doutor João da Silva", "Professora Ana Maria Reis Lopes"]
    bad = ["", "Ana", "Sala 12", "Professores Jubilados", "Professor Auxiliar Convidado", "A Reis", "x" * 60 + " " + "y" * 60]
    assert [d.looks_like_a_name(x) for x in good + bad] == [True] * 3 + [False] * 7


def test_crawl(spark):
    def marked(*names, more=None):
        return "".join(f'<a class="person-name" href="/p/{n[0]}{n[-1]}">{n}</a>' for n in names) + (f'<a class="jscroll-next" href="{more}">more</a>' if more else "")

    def linked(*names):
        return "".join(f'<a href="/u/pessoas/{n.split()[-1]}">{n}</a>' for n in names)

    h = "https://site.example"
    pages = [
        # a section that pages by links, one link leading to itself, and a second section with one of the same people
        (f"{h}/f", marked("Reis, Ana", "Lopes, Rui", more="/q?offset=2")), (f"{h}/q?offset=2", marked("Sousa, Eva", more="/q?offset=2")), (f"{h}/g", marked("Reis, Ana", "Melo, Ivo")),
        # numbered pages; the third says what the second said, so the fourth is never read
        (f"{h}/n", linked("Ana Um")), (f"{h}/n?page=2", linked("Rui Dois")), (f"{h}/n?page=3", linked("Rui Dois")), (f"{h}/n?page=4", linked("Eva Quatro")),
        # no more than the greatest number of pages; a query in the address
        (f"{h}/m?a=1", linked("Ana Um")), (f"{h}/m?a=1&page=2", linked("Rui Dois")), (f"{h}/m?a=1&page=3", linked("Eva Tres")),
        (f"{h}/s", linked("Ana Um")), ("https://elsewhere.example/", linked("Not Mine")), (f"{h}/none", None), (None, "x"),
    ]
    units = [
        ("follow", "marked", "follow_next", [f"{h}/f", f"{h}/g"], 40, 4), ("number", "linked", "page", [f"{h}/n"], 40, 1), ("bound", "linked", "page", [f"{h}/m?a=1"], 2, 0), ("short", "linked", "none", [f"{h}/s"], 40, 2),
        ("lost", "linked", "none", [f"{h}/s", f"{h}/gone", f"{h}/n"], 40, 0), ("empty", "cards", "none", [f"{h}/none"], 40, 0), ("nothing", "cards", "none", [], 40, 0),
    ]
    u, p = spark.createDataFrame(units, d.UNITS), spark.createDataFrame([*pages, pages[0]], "url string, html string")
    people, report = d.crawl(u, p, SITE)
    assert {tuple(r) for r in report.collect()} == {("follow", 3, 4, "ok"), ("number", 3, 2, "ok"), ("bound", 2, 2, "ok"), ("short", 1, 1, "short"), ("lost", 1, 1, "missing"), ("empty", 1, 0, "ok"), ("nothing", 0, 0, "missing")}
    got = {(r.unit, r.section, r.page, r.display) for r in people.collect()}
    assert got == {
        ("follow", f"{h}/f", 0, "Ana Reis"), ("follow", f"{h}/f", 0, "Rui Lopes"), ("follow", f"{h}/f", 1, "Eva Sousa"), ("follow", f"{h}/g", 0, "Ivo Melo"),
        ("number", f"{h}/n", 0, "Ana Um"), ("number", f"{h}/n", 1, "Rui Dois"), ("bound", f"{h}/m?a=1", 0, "Ana Um"), ("bound", f"{h}/m?a=1", 1, "Rui Dois"),
    }
    assert d.crawl(u.limit(0), p, SITE)[0].count() == 0
    assert {r.status for r in d.crawl(u.limit(2), p.limit(0), SITE)[1].collect()} == {"missing"}
    with pytest.raises(ValueError, match="no paging"):
        d.crawl(spark.createDataFrame([("x", "cards", "odd", ["a"], 1, 1)], d.UNITS), p)
