from lodestar.sources import html, markdown, records

MD = """---
handle: 10/1
title: "A: title"
authors:
  - Lovelace, Ada
supervisors:
  - Turing, Alan
  - Hopper, Grace
date: 2020-05-01
keywords: [net, sec, net]
abstract_en: >
  folded
  text
full_text: true
oai_sets:
  - s1
  - s1
---
Body --- here.
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text(MD)
    (tmp_path / "b.md").write_text("no head")
    c = markdown.read_corpus(spark, str(tmp_path))
    r = c.first()
    assert c.count() == 1
    assert (r.handle, r.title, r.abstract_en, r.full_text, r.body) == ("10/1", "A: title", "folded text", True, "Body --- here.")
    assert [x.keyword for x in markdown.thesis_keywords(c).orderBy("ordinal").collect()] == ["net", "sec", "net"]
    assert markdown.thesis_sets(c).count() == 1
    assert markdown.theses(c).first().slug == "10-1"
    assert markdown.mentions(c).count() == 3


def test_records(spark):
    xml = '<OAI xmlns="http://x"><ListRecords><record><header status="deleted"><identifier>oai:x:10/2</identifier></header></record><record><header><identifier>oai:x:10/3</identifier><setSpec>s</setSpec></header><metadata><oai_dc:dc xmlns:oai_dc="u"><dc:title>T</dc:title><dc:type>info:doctoralThesis</dc:type></oai_dc:dc></metadata></record><resumptionToken>tok</resumptionToken></ListRecords></OAI>'
    r = records.parse_records(spark.createDataFrame([(xml,)], "xml string"))
    assert r.count() == 2
    d = records.doctoral(r).first()
    assert (d.handle, d.titles, d.token) == ("10/3", ["T"], "tok")
    js = '{"handle": "10/4", "metadata": [{"key": "dc.title", "value": "T"}, {"key": "dc.description.abstract", "value": "pt", "language": "pt_PT"}, {"key": "dc.contributor.author", "value": "A"}]}'
    i = records.parse_items(spark.createDataFrame([(js,)], "json string")).first()
    assert (i.title, i.abstract_pt, i.abstract_en, i.authors) == ("T", "pt", None, ["A"])


def test_html(spark):
    page = "<html><script>x</script><div><strong>Scope:</strong><p>National</p><strong>Partners</strong><ul><li>A</li><li><a href='/p'>B</a></li></ul></div><div class=card><h3><a href='/people/ada'>LOVELACE, ADA</a></h3><p>Professor</p></div></html>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    f = html.page_fields(df)
    got = [(r.label, r.ordinal, r.value_text, r.href) for r in f.collect()]
    assert got[:3] == [("Scope", 0, "National", None), ("Partners", 0, "A", None), ("Partners", 1, "B", "/p")]
    t = html.typed_fields(f, {"scope": "scope"}, {"partners": "partners"}, key="page_id").first()
    assert (t.scope, t.partners) == ("National", ["A", "B"])
    assert [(r.name, r.href, r.role) for r in html.page_people(df).collect()] == [("Ada Lovelace", "/people/ada", "Professor")]
