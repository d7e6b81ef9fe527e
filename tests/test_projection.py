"""Projection of structured XML on hand-written documents, and on deep ones against a walk through the tree."""

import random
import xml.etree.ElementTree as ET

from quire.operators import jobs, projection

DOC = """<document xmlns="http://x/l" xmlns:m="http://x/m">
  <title><tag>1</tag>On  <emph>Deep</emph> Trees</title>
  <creator><personname>Ann Lee</personname></creator><creator><personname>ANN LEE</personname></creator><creator>Bo</creator>
  <note role="author">x</note><note role="venue">Trees 2019</note>
  <abstract xml:id="abs"><p>Short.</p></abstract>
  <section xml:id="s1"><title>Our Method</title>
    <para><p xml:id="p1">Let <Math tex="a+b" mode="inline"><m:math><m:merror/></m:math></Math>, as in <cite>[<ref idref="b1"/>, <ref idref="b2"/>]</cite>; <tag>no</tag>done<note>n</note>.</p></para>
    <theorem><title>T</title><caption>Cap</caption><p>inner <equation><Math tex="z"/></equation></p></theorem>
    <subsection><title>Results</title><figure><caption>Fig <text>one</text></caption><table><tr><td rowspan="2" colspan="2">a</td><th>b</th></tr></table></figure></subsection>
    <p>after</p>
  </section>
  <Math mode="display"><m:math><m:ci>q</m:ci></m:math></Math>
  <bibliography><bibitem xml:id="b1" key="k1"><bib-name>C D</bib-name><title>Old</title> in 1987 or 1999 <ref role="url">http://u</ref><cite><ref idref="b9"/></cite></bibitem></bibliography>
</document>"""


def tables(spark, *texts):
    return projection.project(spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string"))


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.select(*names).collect()]


def test_everything_of_a_document(spark):
    t = tables(spark, DOC, "<a><b></a>", None)
    papers = {r["doc_id"]: r for r in t["papers"].collect()}
    p = papers[0]
    assert (p["title"], p["abstract"], p["authors"], p["year"], p["venue"], p["fault"]) == ("On Deep Trees", "Short.", ["Ann Lee", "Bo"], 2019, "Trees 2019", None)
    assert papers[1]["fault"] and papers[2]["fault"] and papers[1]["title"] == ""
    assert sorted(rows(t["sections"], "ordinal", "level", "kind", "title", "role", "pointer")) == [
        (0, 0, "abstract", "Abstract", "abstract", "/document[1]/abstract[1]"),
        (1, 1, "section", "Our Method", "method", "/document[1]/section[1]"),
        (2, 2, "subsection", "Results", "results", "/document[1]/section[1]/subsection[1]"),
    ]
    at = dict(rows(t["elements"].where("pre is not null"), "pre", "pointer"))
    short = lambda k: None if k is None else at[k].removeprefix("/document[1]/")
    got = sorted((o, k, short(pre), short(sec), short(up), title, text) for o, k, pre, sec, up, title, text in rows(t["contents"], "ordinal", "kind", "pre", "section", "parent", "title", "text"))
    s = "section[1]"
    assert got == [
        (0, "p", "abstract[1]/p[1]", "abstract[1]", None, "", "Short."),
        (1, "p", f"{s}/para[1]/p[1]", s, None, "", "Let $a+b$ , as in [b1,b2] ; donen."),
        (2, "theorem", f"{s}/theorem[1]", s, None, "Cap", "TCapinner $z$"),
        (3, "p", f"{s}/theorem[1]/p[1]", s, f"{s}/theorem[1]", "", "inner $z$"),
        (4, "equation", f"{s}/theorem[1]/p[1]/equation[1]", s, f"{s}/theorem[1]/p[1]", "", "$z$"),
        (5, "figure", f"{s}/subsection[1]/figure[1]", f"{s}/subsection[1]", None, "Fig one", "Fig oneab"),
        (6, "table", f"{s}/subsection[1]/figure[1]/table[1]", f"{s}/subsection[1]", f"{s}/subsection[1]/figure[1]", "", "ab"),
        (7, "p", f"{s}/p[1]", s, None, "", "after"),
        (8, "formula", "Math[1]", None, None, "", "$$"),
    ]
    assert sorted(rows(t["formulas"], "tex", "mode", "sound"), key=repr) == sorted([("a+b", "inline", False), ("z", None, None), ("", "display", True)], key=repr)
    assert sorted(rows(t["cells"], "row", "col", "row_span", "col_span", "header", "text")) == [(0, 0, 2, 2, False, "a"), (0, 2, 1, 1, True, "b")]
    assert rows(t["references"], "key", "xml_id", "title", "authors", "year", "identifiers") == [("k1", "b1", "Old", ["C D"], 1987, {"url": "http://u"})]
    assert sorted(rows(t["mentions"], "target", "context")) == [("b1", got[1][6]), ("b2", got[1][6])]
    chunks = sorted(rows(projection.chunk_projected(t), "ordinal", "kind", "content", "role"))
    assert chunks == [
        (0, "abstract", "[On Deep Trees > Abstract] Short.", "abstract"),
        (1, "section", f"[On Deep Trees > Our Method] {got[1][6]}\n\ninner $z$\n\nafter", "method"),
        (2, "section", "[On Deep Trees > Results] Fig oneab\n\nab", "results"),
        (3, "section", "[On Deep Trees] $$", None),
    ]


def test_empty_table(spark):
    t = projection.project(spark.createDataFrame([], "doc_id long, xml string"))
    assert all(df.count() == 0 for df in t.values())


def test_containment_at_any_depth(spark):
    """Random trees and a chain of 300 elements, against ancestors found by walking up."""
    rng = random.Random(3)

    def grow(n):
        root = ET.Element("a")
        known = [root]
        for _ in range(n):
            known.append(ET.SubElement(rng.choice(known[-4:]), rng.choice(["a", "p", "table", "section"])))
        return root

    chain = ET.Element("a")
    at = chain
    for k in range(300):
        at = ET.SubElement(at, "table" if k == 5 else "section")
    ET.SubElement(at, "p")
    roots = [grow(n) for n in (0, 1, 40, 200)] + [chain]
    e = projection.elements(spark.createDataFrame([(k, ET.tostring(r, encoding="unicode")) for k, r in enumerate(roots)], "doc_id long, xml string"))
    met = projection.within(e.select("doc_id", e["pre"].alias("at"), "size", "tag"), e.select("doc_id", "pre", "last"))
    want = set()
    for k, root in enumerate(roots):
        number = {x: i for i, x in enumerate(root.iter())}
        want |= {(k, number[y], number[x]) for x in root.iter() for y in x.iter()}
    found = [(r["doc_id"], r["at"], r["outer"]["pre"]) for r in met.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    nodes = projection.contents(e, projection.sections(e)).where("doc_id = 4")
    able = jobs.chunk_eligible(nodes.selectExpr("doc_id", "pre as node", "parent", "kind"))
    assert [r["kind"] for r in able.collect()] == ["table"]  # the paragraph is in it, 295 levels down


def test_eligibility_of_long_chains(spark):
    """A chain of 400 parents: what is below the table is not taken, what is above is."""
    table = [(1, k, k - 1 if k else None, "table" if k == 200 else "p" if k in (399, 150) else "section") for k in range(400)]
    got = jobs.chunk_eligible(spark.createDataFrame(table, "doc_id long, node int, parent int, kind string"))
    assert sorted(r["node"] for r in got.collect()) == [150, 200]


def test_year_outside_title_and_identifiers(spark):
    doc = '<document><bibliography><bibitem key="a"><title>Before 1984</title>, 1999. <bib-data role="DOI">10.1/1900</bib-data></bibitem><bibitem key="b"><title>In 1984</title></bibitem></bibliography></document>'
    assert sorted(rows(tables(spark, doc)["references"], "key", "year")) == [("a", 1999), ("b", 1984)]


def test_projection_moves_no_text(spark):
    """Contents, formulas, mentions and eligibility come from the parse: no exchange; chunks move a document's rows once."""
    e = projection.elements(spark.createDataFrame([(1, DOC)], "doc_id long, xml string"))
    for df in (projection.contents(e), projection.formulas(e), projection.mentions(e)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert projection.chunk_projected({"contents": projection.contents(e)})._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
