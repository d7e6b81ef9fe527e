"""Structured XML documents as rows: one parse gives every element with its place in the tree and what is around it.

A document is parsed whole, and the parser knows what is open when an element starts, so sections, containers, texts and contexts
come with the rows; the tables are then selections, and groups or windows within a document.

An element has `pre`, its number in document order, and `last`, the greatest number within it, so what it contains is the
interval pre + 1 .. last. For containment among rows of other kinds (`within`) with an equi-join
an interval is cut into the few aligned stretches of 2^level numbers that make it up, and a place asks for the one
stretch of each level that holds it: both sides grow with the logarithm of a document's size, at any depth of nesting.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T
from quire.operators.jobs import SECTION_KINDS, chunked
from quire.plans.materialize import written
from quire.plans.session import small_batches

#: Elements that are content of a document, of its sections, and references to its literature. Fixed values.
CONTENT_KINDS = ("p", "table", "figure", "theorem", "proof", "equation", "equationgroup")
LITERATURE = ("bibliography", "biblist", "bibitem")
VENUE_ROLES, IDENTIFIER_ROLES = ("journal", "venue", "conference"), ("doi", "arxiv", "url")
YEAR = r"\b(?:19|20)[0-9]{2}\b"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
ELEMENTS = (
    "doc_id long, pre int, last int, parent int, depth int, size int, tag string, pointer string, xml_id string, attrs map<string,string>, "
    "above int, above_pointer string, level int, section int, section_pointer string, section_title string, held int, held_pointer string, bound boolean, "
    "ordinal int, paper string, title string, caption string, text string, childless boolean, sound boolean, items array<int>, "
    "lines array<struct<table:int,row:int>>, cites array<struct<pointer:string,owner:int,place:string,context:string>>, fault string"
)
#: Rows of a batch that leaves the parser.
OUT_ROWS = 4_096


class _Element:
    """What is known of an element; what it lacks is null."""

    last = parent = depth = size = tag = pointer = xml_id = attrs = above = above_pointer = level = section = section_pointer = section_title = None
    pre = held = held_pointer = bound = ordinal = paper = title = caption = text = childless = sound = items = lines = cites = fault = person = None
    head = tail = ""

    def __init__(self, doc: int):
        self.doc_id = doc


class _Reader:
    """The elements of one document from the parser's events, in document order. What is around an element is handed down by its parent."""

    def __init__(self, doc: int):
        self.doc, self.rows, self.open, self.plain, self.mixed, self.ended = doc, [], [], [], [], None
        self.errors, self.contents, self.abstract = 0, 0, None

    def start(self, name: str, attrs: dict) -> None:
        e, up, tag = _Element(self.doc), self.open[-1] if self.open else None, name.rpartition("}")[2]
        e.pre, e.tag, e.depth, e.xml_id, e.counts = len(self.rows), tag, len(self.open), attrs.get(XML_ID), {}
        e.attrs = [(k.rpartition("}")[2], v) for k, v in attrs.items()] if attrs else []
        e.here = len(self.plain), len(self.mixed)
        if up is None:
            e.pointer, e.quiet, e.own, e.around, e.inner, e.cited, e.noted, e.tables = f"/{tag}[1]", -1, None, None, None, (), (), ()
        else:
            counts = up.counts
            counts[tag] = n = counts.get(tag, 0) + 1
            e.parent, e.pointer = up.pre, f"{up.pointer}/{tag}[{n}]"
            # own: the innermost section; around: that or the abstract; inner: the innermost content element; all with the parent itself
            e.quiet, e.own, e.around, e.inner, e.cited, e.noted, e.tables = up.quiet, up.own, up.around, up.inner, up.cited, up.noted, up.tables
        if e.inner is not None:
            e.held, e.held_pointer = e.inner.pre, e.inner.pointer
        if e.around is not None:
            e.section, e.section_pointer = e.around.pre, e.around.pointer
        e.outer, e.sec = e.inner, e.around
        if tag in CONTENT_KINDS:
            e.ordinal, e.childless, e.bound = self.contents, True, e.inner is not None and (e.inner.bound or e.inner.tag in ("p", "table", "figure"))
            self.contents += 1
            if e.inner is not None:
                e.inner.childless = False
            e.inner = e
        elif tag in SECTION_KINDS:
            e.level = 1
            if e.own is not None:
                e.above, e.above_pointer, e.level = e.own.pre, e.own.pointer, e.own.level + 1
            e.own = e.around = e
        elif tag == "Math":
            e.quiet = e.pre
            if e.inner is None:
                e.ordinal = self.contents
                self.contents += 1
        elif tag == "cite":
            e.quiet = e.pre
            if not e.noted:
                e.cited = (*e.cited, e)
        elif tag in ("tags", "tag"):
            e.quiet = e.pre
        elif tag == "abstract" and e.parent == 0 and self.abstract is None:
            self.abstract = e.around = e
        elif tag == "merror":
            self.errors += 1
        elif tag == "tr":
            e.lines = []
            for t in e.tables:
                e.lines.append((t.pre, t.trs))
                t.trs += 1
        elif tag in ("td", "th") and up is not None and up.tag == "tr":
            e.lines = up.lines
        if tag == "table":
            e.trs, e.tables = 0, (*e.tables, e)
        elif tag in LITERATURE:
            e.noted = (*e.noted, e)
        elif tag == "math":
            e.before = self.errors
        if e.noted and tag != "bibitem":
            e.items = [x.pre for x in e.noted if x.tag == "bibitem"]
        self.rows.append(e)
        self.open.append(e)
        self.ended = None

    def _text(self, e: _Element) -> str:
        """All text within an element that has just ended."""
        return " ".join("".join(self.plain[e.here[0] :]).split())

    def _mixed(self, e: _Element) -> str:
        """The same with marks for formulas and cites within it, without number tags."""
        return " ".join("".join([t for t, quiet in self.mixed[e.here[1] :] if quiet <= e.pre]).split())

    def end(self, _: str) -> None:
        e = self.ended = self.open.pop()
        up, tag = self.open[-1] if self.open else None, e.tag
        e.last = len(self.rows) - 1
        if tag in CONTENT_KINDS or tag in ("td", "th") or e is self.abstract:
            e.text = self._mixed(e)
        elif tag in ("date", "note", "bibitem") or (tag == "creator" and e.parent == 0) or (e.items and tag in ("title", "bib-title", "bib-name", "personname", "bib-data", "ref")):
            e.text = (e.person if tag == "creator" else None) or self._text(e)
        if up is None:
            return
        if tag == "Math":
            tex = dict(e.attrs).get("tex") or self._text(e)
            self.mixed.append((f" ${tex}$ ", up.quiet))
        elif tag == "cite":
            ids = [v for r in self.rows[e.pre :] if r.tag == "ref" for k, v in r.attrs if k == "idref" and v]
            self.mixed.append((f" [{','.join(ids)}] ", up.quiet))
        elif tag == "title" and up.title is None:
            parts = [e.head]
            for kid in self.rows[e.pre + 1 :]:
                if kid.parent == e.pre:
                    parts += [kid.head if kid.tag != "tag" else "", kid.tail]
            up.title = " ".join(" ".join(parts).split())
        elif tag == "caption" and up.caption is None:
            up.caption = self._text(e)
        elif tag == "personname" and up.tag == "creator" and up.person is None:
            up.person = self._text(e)
        elif tag == "math" and up.tag == "Math" and up.sound is None:
            up.sound = self.errors == e.before

    def data(self, text: str) -> None:
        self.plain.append(text)
        if self.open:
            self.mixed.append((text, self.open[-1].quiet))
        if self.ended is not None:
            self.ended.tail += text
        elif self.open:
            self.open[-1].head += text

    def close(self) -> list[_Element]:
        """The rows, with what is only known at the end."""
        for e in self.rows:
            e.size = len(self.rows)
            if e.ordinal is not None:
                e.paper = self.rows[0].title or ""
                if e.sec is not None:
                    e.section_title = "Abstract" if e.sec is self.abstract else e.sec.title or ""
            if e.tag == "ref" and e.cited:
                e.cites = [(c.pointer, c.held, c.held_pointer, c.outer.text[:1000] if c.outer is not None else "") for c in e.cited]
        return self.rows


def elements(docs: DataFrame, doc_id: str = "doc_id", xml: str = "xml") -> DataFrame:
    """docs -> one row for each element of each document, from one parse; tags and attributes without namespace.

    `pointer` is the path of sibling numbers for each tag (`/document[1]/section[2]/p[1]`). What is around an element, the parser knows when it starts:
    above and above_pointer name the innermost section around a section, level its depth; section, section_pointer and section_title the innermost section or
    abstract around any element; held and held_pointer the innermost content element around it; items the bibliography items around it, lines the tables around a
    cell's row with its number in each, cites the cites outside the bibliography around a reference, with content element and context. Of a content element, or a
    formula outside of them: ordinal and paper (the document's title), bound (whether it is in a paragraph, table or figure) and childless. text is that of content
    elements, cells and the abstract (`$tex$` for formulas, `[ids]` for cites, no number tags), and of what papers and references are read from. sound tells
    whether a formula's MathML is free of errors. A document that is null or no XML gives one row without pre and with the fault.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ELEMENTS))

    def batch(rows: list[_Element]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([getattr(r, f.name) for r in rows], f.type) for f in schema], schema=schema)

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ET

        rows: list[_Element] = []
        for p in parts:
            for doc, text in zip(p.column(0), p.column(1), strict=True):
                reader = _Reader(doc.as_py())
                try:
                    parser = ET.XMLParser(target=reader)
                    parser.feed(text.as_py() or "")
                    rows += parser.close()
                except ET.ParseError as e:
                    rows.append(_Element(reader.doc))
                    rows[-1].fault = str(e)
                if len(rows) >= OUT_ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    small_batches(docs.sparkSession)
    some = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(xml).cast("string").alias("xml"))
    return some.mapInArrow(parse, ELEMENTS)


def _cover(first: Column, after: Column) -> Column:
    """The aligned stretches (level, number) that make up first .. after - 1."""

    def at(level: Column) -> Column:
        unit = F.pow(F.lit(2.0), level)
        a, b = F.ceil(first / unit), F.floor(after / unit)
        low = F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.cast("int").alias("number")))
        high = F.when((a + a % 2 < b) & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).cast("int").alias("number")))
        return F.array(low, high)

    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(after, F.lit(2)))).cast("int"))
    return F.filter(F.flatten(F.transform(levels, at)), lambda s: s.isNotNull())


def within(places: DataFrame, outer: DataFrame) -> DataFrame:
    """places(doc_id, at, size, ...) and outer(doc_id, pre, last, ...) -> their pairs with pre <= at <= last; outer's columns as one struct `outer`.

    `size` is the number of elements of the document.
    """
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.col("size"), F.lit(2)))).cast("int"))
    asks = places.withColumn("_s", F.explode(F.transform(levels, lambda k: F.struct(k.alias("level"), F.floor(F.col("at") / F.pow(F.lit(2.0), k)).cast("int").alias("number")))))
    held = outer.select("doc_id", F.struct(*[c for c in outer.columns if c != "doc_id"]).alias("outer"), F.explode(_cover(F.col("pre"), F.col("last") + 1)).alias("_s"))
    return asks.join(held, ["doc_id", "_s"]).drop("_s")


def sections(e: DataFrame) -> DataFrame:
    """(doc_id, pre, last, ordinal, level, kind, title, role, parent, above, pointer, xml_id): the first abstract right below the root at level 0, then sections in document order, level and parent by nesting; above is the parent's pointer."""
    abstract = (F.col("tag") == "abstract") & F.col("text").isNotNull()
    own = e.where(F.col("tag").isin(*SECTION_KINDS) | abstract)
    none = F.lit(None)
    both = own.select(
        "doc_id", "pre", "last", F.when(abstract, 0).otherwise(F.col("level")).cast("int").alias("level"), F.col("tag").alias("kind"), F.when(abstract, "Abstract").otherwise(F.coalesce("title", F.lit(""))).alias("title"),
        F.when(abstract, none).otherwise(F.col("above")).alias("parent"), F.when(abstract, none).otherwise(F.col("above_pointer")).alias("above"), "pointer", "xml_id",
    )
    order = W.partitionBy("doc_id").orderBy(F.col("kind") != "abstract", "pre")
    return both.withColumns({"ordinal": F.row_number().over(order) - 1, "role": T.semantic_role(F.col("title"))})


def contents(e: DataFrame, secs: DataFrame | None = None) -> DataFrame:
    """(doc_id, pre, last, size, ordinal, kind, title, text, tex, section, section_pointer, section_title, role, parent, parent_pointer, pointer, xml_id, eligible, paper): content elements and formulas outside of them.

    section and parent are numbers of the innermost section and content element around; title is the caption. All is known from the parse,
    so rows are not moved (`secs` is no longer needed). eligible is what `chunk_eligible` finds by parent and kind; paper is the document's title.
    """
    formula, tex, kind = F.col("tag") == "Math", F.col("attrs")["tex"], F.col("tag")
    able = F.when(kind.isin("table", "figure", "Math"), True).when(kind.isin("theorem", "proof"), F.col("childless")).otherwise(~F.col("bound"))
    return e.where("ordinal is not null").select(
        "doc_id", "pre", "last", "size", "ordinal", F.when(formula, "formula").otherwise(kind).alias("kind"), F.coalesce("caption", F.lit("")).alias("title"),
        F.when(formula, F.concat(F.lit("$"), F.coalesce(tex, F.lit("")), F.lit("$"))).otherwise(F.col("text")).alias("text"), tex.alias("tex"),
        "section", "section_pointer", "section_title", T.semantic_role(F.col("section_title")).alias("role"), F.col("held").alias("parent"), F.col("held_pointer").alias("parent_pointer"), "pointer", "xml_id", able.alias("eligible"), "paper",
    )


def formulas(e: DataFrame) -> DataFrame:
    """(doc_id, pre, owner, place, mode, tex, sound, pointer): owner and place are the content element around, or the formula itself; sound tells whether its MathML is free of errors (null: it has none)."""
    math = e.where("tag = 'Math'")
    return math.select("doc_id", "pre", F.coalesce("held", "pre").alias("owner"), F.coalesce("held_pointer", "pointer").alias("place"), F.col("attrs")["mode"].alias("mode"), F.coalesce(F.col("attrs")["tex"], F.lit("")).alias("tex"), "sound", "pointer")


def cells(e: DataFrame) -> DataFrame:
    """(doc_id, table, row, col, row_span, col_span, header, text, pointer): cells of the rows within each table; a column's number counts the spans before it."""
    span = lambda name: F.coalesce(F.nullif(F.col("attrs")[name], F.lit("")).try_cast("int"), F.lit(1))
    own = e.where(F.col("tag").isin("td", "th")).select("doc_id", F.explode("lines").alias("l"), F.col("parent").alias("line"), "pre", span("rowspan").alias("row_span"), span("colspan").alias("col_span"), ((F.col("tag") == "th") | F.col("attrs")["thead"].isNotNull()).alias("header"), "text", "pointer")
    before = F.sum("col_span").over(W.partitionBy("doc_id", "table", "line").orderBy("pre").rowsBetween(W.unboundedPreceding, -1))
    return own.select("*", "l.table", "l.row").select("doc_id", "table", "row", F.coalesce(before, F.lit(0)).cast("int").alias("col"), "row_span", "col_span", "header", "text", "pointer")


def references(e: DataFrame) -> DataFrame:
    """(doc_id, pre, key, xml_id, raw, title, authors, year, identifiers, pointer): one row a bibliography item. Its year is the first that is in neither
    its title nor its identifiers, else the first of all."""
    roles, item, at = F.lower(F.coalesce(F.col("attrs")["role"], F.lit(""))), F.col("tag") == "bibitem", F.col("pre")
    kind = F.when(item, "item").when(F.col("tag").isin("bib-title", "title"), "title").when(F.col("tag").isin("bib-name", "personname"), "author").when(F.col("tag").isin("bib-data", "ref") & roles.isin(*IDENTIFIER_ROLES), roles)
    told = e.where(item | (F.size("items") > 0)).withColumn("kind", kind).where("kind in ('item', 'title') or (kind is not null and text <> '')")
    told = told.select("doc_id", F.explode(F.when(item, F.array("pre")).otherwise(F.col("items"))).alias("item"), "pre", "kind", "text", F.when(item, F.struct(F.col("attrs")["key"].alias("key"), "xml_id", "pointer")).alias("own"))
    of = lambda k: F.when(F.col("kind") == k, at)
    some = told.groupBy("doc_id", F.col("item").alias("pre")).agg(
        F.max("own").alias("own"), F.max(F.when(F.col("kind") == "item", F.col("text"))).alias("raw"), F.nullif(F.min_by("text", of("title")), F.lit("")).alias("title"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "author", F.struct(at.alias("at"), "text")))), lambda a: a["text"]).alias("authors"),
        *[F.max_by("text", of(r)).alias(r) for r in IDENTIFIER_ROLES],
    )
    ids = F.map_filter(F.create_map(*[x for r in IDENTIFIER_ROLES for x in (F.lit(r), F.col(r))]), lambda _, v: v.isNotNull())
    rest = F.col("raw")
    for part in ("title", *IDENTIFIER_ROLES):
        rest = F.when(F.col(part).isNull(), rest).otherwise(F.replace(rest, F.col(part), F.lit(" ")))
    year = F.coalesce(*[F.nullif(F.regexp_extract(x, YEAR, 0), F.lit("")) for x in (rest, F.col("raw"))]).cast("int")
    return some.select("doc_id", "pre", "own.key", "own.xml_id", "raw", "title", "authors", year.alias("year"), ids.alias("identifiers"), "own.pointer")


def mentions(e: DataFrame) -> DataFrame:
    """(doc_id, at, target, owner, place, context, pointer): what each cite outside the bibliography refers to, with number and pointer of the content element around and up to 1000 characters of it."""
    refs = e.where("tag = 'ref' and cites is not null").select("doc_id", F.col("pre").alias("at"), F.col("attrs")["idref"].alias("target"), F.explode("cites").alias("c")).where("target <> ''")
    return refs.select("doc_id", "at", "target", "c.owner", "c.place", "c.context", "c.pointer")


def papers(e: DataFrame) -> DataFrame:
    """(doc_id, title, abstract, authors, year, venue, fault), one row a document: names once each by their normal form, the year of the first date or note that has one, the first note with a venue's role."""
    tag, creator, first = F.col("tag"), (F.col("tag") == "creator") & (F.col("parent") == 0), lambda c, when: F.min(F.when(when, F.struct("pre", c.alias("x"))))
    own = e.where((F.col("pre") == 0) | F.col("fault").isNotNull() | creator | tag.isin("date", "note") | ((tag == "abstract") & F.col("text").isNotNull()))
    # a document's rows meet once: names are grouped within it, then all
    own = own.select("doc_id", "pre", "tag", "fault", "title", "text", creator.alias("named"), F.col("attrs")["role"].alias("role")).repartition("doc_id").withColumn("same", F.when(F.coalesce("named", F.lit(False)), T.normalized_name(F.col("text"))))
    year = F.when(tag.isin("date", "note"), F.regexp_extract("text", YEAR, 0))
    parts = own.groupBy("doc_id", "same").agg(
        F.max("fault").alias("fault"), F.max(F.when(F.col("pre") == 0, F.col("title"))).alias("title"), F.max(F.when(tag == "abstract", F.col("text"))).alias("abstract"),
        first(F.col("text"), F.col("same") != "").alias("name"), first(year, year != "").alias("year"), first(F.col("text"), (tag == "note") & F.col("role").isin(*VENUE_ROLES)).alias("venue"),
    )
    names = F.transform(F.array_sort(F.collect_list("name")), lambda n: n["x"])
    out = parts.groupBy("doc_id").agg(F.max("fault").alias("fault"), F.max("title").alias("title"), F.max("abstract").alias("abstract"), names.alias("authors"), F.min("year").alias("year"), F.min("venue").alias("venue"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select("doc_id", text("title").alias("title"), text("abstract").alias("abstract"), "authors", F.col("year.x").cast("int").alias("year"), text("venue.x").alias("venue"), "fault")


def project(docs: DataFrame, doc_id: str = "doc_id", xml: str = "xml") -> dict[str, DataFrame]:
    """docs(doc_id, xml) -> tables elements, papers, sections, contents, formulas, cells, references and mentions, all from one parse that is written once.

    Rows without doc_id are left out; doc_id must tell documents apart. A document that is no XML has a row in papers with its fault, and no others.
    """
    e = written(elements(docs, doc_id, xml), "elements")
    return {"elements": e, "papers": papers(e), "sections": sections(e), "contents": contents(e), "formulas": formulas(e), "cells": cells(e), "references": references(e), "mentions": mentions(e)}


def chunk_projected(projected: dict[str, DataFrame], most: int = 4000) -> DataFrame:
    """Chunks of eligible content elements by section, prefixed by `[title > heading] `: (doc_id, section, role, kind, ordinal, content, content_sha256, tokens, nodes, first, last)."""
    nodes = projected["contents"].where("eligible and text <> ''")
    prefix = F.concat(F.lit("["), "paper", F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" > "), F.col("section_title"))).otherwise(""), F.lit("] "))
    # a document's rows meet once; groups come in the order of their first node
    first = F.min("ordinal").over(W.partitionBy("doc_id", "section"))
    kind = F.when(F.startswith(F.substring_index("section_pointer", "/", -1), F.lit("abstract[")), "abstract").otherwise("section")
    picked = nodes.select("doc_id", F.col("section").alias("of"), "ordinal", "text", "pointer", prefix.alias("prefix"), "role", kind.alias("kind")).repartition("doc_id")
    picked = picked.withColumnsRenamed({"of": "section", "ordinal": "pos"}).withColumn("ordinal", F.col("pos"))
    picked = picked.withColumn("group", first).select("doc_id", F.col("group").alias("section"), "pos", "text", "pointer", "prefix", F.struct(F.col("section").alias("of"), "role", "kind").alias("about"))
    made = chunked(picked, most)
    return made.select("doc_id", F.col("about.of").alias("section"), "about.role", "about.kind", "ordinal", "content", "content_sha256", "tokens", "nodes", F.get("pointers", F.lit(0)).alias("first"), F.get("pointers", F.size("pointers") - 1).alias("last"))


def paper_tables(projected: dict[str, DataFrame], most: int = 50) -> DataFrame:
    """The first `most` tables of each document: (doc_id, place, pointer, caption, section_title, role, cells), cells by row and column as structs with spans and header flag."""
    tables = projected["contents"].where("kind = 'table'").withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal"))).where(F.col("place") <= most)
    entry = F.struct("row", "col", "row_span", "col_span", "text", "header")
    held = projected["cells"].groupBy("doc_id", F.col("table").alias("pre")).agg(F.array_sort(F.collect_list(entry)).alias("cells"))
    out = tables.join(held, ["doc_id", "pre"], "left")
    return out.select("doc_id", "place", "pointer", F.col("title").alias("caption"), "section_title", "role", "cells")
