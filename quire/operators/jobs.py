"""Corpus build and enrichment jobs: whole tables in, whole tables out; outcomes are columns, not exceptions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T
from quire.operators import matching as M
from quire.plans.materialize import written
from quire.plans.session import small_batches

PARTS = "page_id long, kind string, ordinal int, parent int, tag string, text string, target string, row int, col int"
#: Rows of a frame that leaves the parser.
OUT_ROWS = 4_096


def project_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> rows of kinds section, node, link, cell, math, cite and reference, from one parse of each page.

    ordinal counts a page's rows in document order; parent is the ordinal of the section (nodes, cells) or node (links, math, cites) it is in.
    target is a link's address, a formula's TeX, the ids that a cite names, or a reference's key. In texts formulas stand as `$tex$`
    and cites as `[ids]`. Unclosed tags end where the next block begins. Broken markup never fails a page.
    """

    names = [x.split()[0] for x in PARTS.split(", ")]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"parent": "Int32", "row": "Int32", "col": "Int32"})

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows: list[tuple] = []
            for page, html in zip(p["page_id"], p["html"], strict=True):
                rows += page_rows(int(page), html or "")
                if len(rows) >= OUT_ROWS:
                    yield framed(rows)
                    rows = []
            if rows:
                yield framed(rows)

    small_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(parse, PARTS)


def page_rows(page: int, html: str) -> list[tuple]:
    """The rows of one page: a small reader over the standard parser's events."""
    from html.parser import HTMLParser

    rows: list[list] = []

    class Reader(HTMLParser):
        section, node, table, line, column, quiet = None, None, 0, -1, -1, 0

        def add(self, kind: str, parent, tag: str, target=None, row=None, col=None) -> list:
            rows.append([page, kind, len(rows), parent, tag, "", target, row, col])
            return rows[-1]

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.quiet += 1
            elif tag == "math":
                tex = dict(attrs).get("tex") or dict(attrs).get("alttext") or ""
                self.add("math", self.node and self.node[2], tag, tex)
                self.handle_data(f"${tex}$")
                self.quiet += 1
            elif tag in ("bibref", "ref"):
                ids = next((v for k, v in attrs if k in ("bibrefs", "labelref", "idref") and v), "")
                self.add("cite", self.node and self.node[2], tag, ids)
                self.handle_data(f"[{ids}]")
            elif tag == "bibitem":
                self.node = self.add("reference", None, tag, next((v for k, v in attrs if k in ("key", "xml:id", "id") and v), None))
            elif tag in ("h1", "h2", "h3", "h4", "title"):
                self.node = self.section = self.add("section", None, tag)
            elif tag in ("p", "li", "blockquote", "pre"):
                self.node = self.add("node", self.section and self.section[2], tag)
            elif tag == "a":
                self.add("link", self.node and self.node[2], tag, dict(attrs).get("href"))
            elif tag == "table":
                self.table, self.line = self.table + 1, -1
            elif tag == "tr":
                self.line, self.column = self.line + 1, -1
            elif tag in ("td", "th"):
                self.column += 1
                self.node = self.add("cell", self.section and self.section[2], tag, None, self.line, self.column)

        def handle_endtag(self, tag):
            if tag in ("script", "style", "math"):
                self.quiet = max(0, self.quiet - 1)
            elif tag in ("p", "li", "blockquote", "pre", "td", "th", "h1", "h2", "h3", "h4", "title", "bibitem"):
                self.node = None

        def handle_data(self, data):
            if self.node is not None and not self.quiet:
                self.node[5] += data

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    return [tuple(r[:5]) + (" ".join(r[5].split()), *r[6:]) for r in rows]


def chunked(nodes: DataFrame, most: int = 4000) -> DataFrame:
    """nodes(doc_id, section, pos, text, prefix) -> chunks: nodes of a section packed in order while prefix and texts (2 more each) fit
    `most`; a node over it stands alone, none is split. A fold within the section, then one row a chunk. With columns pointer (of a node) and
    about (of a section), chunks have pointers, one a node, and about."""
    also = [c for c in ("pointer",) if c in nodes.columns]
    item = F.struct(F.col("pos").cast("int").alias("pos"), "text", *also)
    told = ["about"] if "about" in nodes.columns else []
    per = nodes.where("text <> ''").groupBy("doc_id", "section").agg(F.first("prefix").alias("prefix"), F.array_sort(F.collect_list(item)).alias("items"), *[F.first(c).alias(c) for c in told])
    none = F.filter("items", lambda _: F.lit(False))
    start = F.struct(F.filter(F.array("items"), lambda _: F.lit(False)).alias("done"), none.alias("cur"), F.length("prefix").alias("n"))

    def step(s: Column, x: Column) -> Column:
        size = F.length(x["text"]) + 2
        full = (F.size(s["cur"]) > 0) & (s["n"] + size > most)
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), F.array(x).alias("cur"), (F.length("prefix") + size).alias("n"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["cur"], F.array(x)).alias("cur"), (s["n"] + size).alias("n")))

    packed = F.aggregate("items", start, step, lambda s: F.concat(s["done"], F.array(s["cur"])))
    one = per.select("doc_id", "section", "prefix", *told, F.posexplode(packed).alias("n", "part"))
    content = F.concat("prefix", F.array_join(F.transform("part", lambda i: i["text"]), "\n\n"))
    lists = [F.transform("part", lambda i: i["pos"]).alias("nodes"), *[F.transform("part", lambda i: i["pointer"]).alias("pointers") for _ in also]]
    out = one.select("doc_id", "section", "n", content.alias("content"), *lists, *told)
    order = W.partitionBy("doc_id").orderBy("section", "n")
    return out.withColumn("ordinal", F.row_number().over(order) - 1).withColumns({"content_sha256": F.sha2("content", 256), "tokens": T.token_estimate(F.col("content"))}).drop("n")


def chunk_eligible(nodes: DataFrame) -> DataFrame:
    """nodes(doc_id, node, parent, kind) -> the ones that chunks are made of: paragraphs and equations outside p, table and figure; tables,
    figures and formulas; theorems and proofs without children. A node's ancestors are looked through twice as far every round, so
    any depth takes its logarithm in joins; parents that form a circle are an error."""
    inside = F.col("kind").isin("p", "table", "figure")
    up = nodes.select("doc_id", F.col("node").alias("above"), inside.alias("hit"))
    # bound: whether an ancestor below `above` holds the node; above: the next to look at, from where 2^round more are known
    walk = nodes.where("parent is not null").select("doc_id", "node", F.col("parent").alias("above")).join(up, ["doc_id", "above"]).select("doc_id", "node", "above", F.col("hit").alias("bound"))
    walk = written(walk, "walk")
    for turn in range(64):
        further = walk.select("doc_id", F.col("node").alias("above"), F.col("above").alias("next"), F.col("bound").alias("more"))
        joined = walk.where("not bound and above is not null").join(further, ["doc_id", "above"], "left")
        fresh = joined.select("doc_id", "node", F.col("next").alias("above"), F.coalesce("more", F.lit(False)).alias("bound"))
        if fresh.where("above is not null and not bound").isEmpty():
            walk = fresh.unionByName(walk.where("bound or above is null"))
            break
        walk = written(fresh.unionByName(walk.where("bound or above is null")), "walk")
    else:
        raise ValueError("parents form a circle")
    bound = walk.where("bound").select("doc_id", "node")
    parents = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("node")).distinct()
    free = nodes.where(F.col("kind").isin("p", "equation", "equationgroup")).join(bound, ["doc_id", "node"], "left_anti")
    plain = nodes.where(F.col("kind").isin("table", "figure", "formula"))
    childless = nodes.where(F.col("kind").isin("theorem", "proof")).join(parents, ["doc_id", "node"], "left_anti")
    return free.unionByName(plain).unionByName(childless)


def grade_structure(pages: DataFrame, least_paragraphs: int = 10, most_errors: int = 50) -> DataFrame:
    """pages(page_id, html) -> tier clean, degraded or failed, with reasons and counts; a tag counts where it opens."""

    def n(tags: str) -> Column:
        return F.regexp_count("html", F.lit(f"(?i)<(?:{tags})[ >]"))

    p = pages.select("page_id", F.trim(F.regexp_extract("html", "(?is)<title>([^<]*)", 1)).alias("title"), n("h[1-6]").alias("sections"), n("p").alias("paragraphs"), n("ul|ol").alias("lists"), n("li").alias("items"), n("nav").alias("navs"), F.regexp_count("html", F.lit("[*%#]{3}")).alias("errors"))
    hard = F.filter(F.array(F.when(F.col("title") == "", "no_title"), F.when(F.col("sections") == 0, "no_sections"), F.when(F.col("paragraphs") < least_paragraphs, "too_few_paragraphs")), lambda x: x.isNotNull())
    soft = F.filter(F.array(F.when(F.col("errors") > most_errors, "errors"), F.when((F.col("lists") > 0) & (F.col("items") == 0), "list_lost"), F.when(F.col("navs") == 0, "nav_lost"), F.when(F.lower("title").startswith("supplementary"), "title_supplement")), lambda x: x.isNotNull())
    reasons = F.when(F.size(hard) > 0, hard).otherwise(soft)
    return p.withColumns({"reasons": reasons, "tier": F.when(F.size(hard) > 0, "failed").when(F.size(soft) > 0, "degraded").otherwise("clean")})


STRUCTURE = "doc_id long, valid boolean, title string, has_abstract boolean, abstract_chars int, creators int, sections int, paragraphs int, body_chars int, figures int, tables int, maths int, has_bibliography boolean, bibitems int"
#: Elements that are sections of a structured document. Fixed values.
SECTION_KINDS = ("part", "chapter", "section", "subsection", "subsubsection", "appendix")


def structure_stats(docs: DataFrame, doc_id: str = "doc_id", xml: str = "xml") -> DataFrame:
    """Counts of each structured XML document from one parse of it; namespaces do not matter. A document that is no XML has valid = false and zeros."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        for p in parts:
            rows = []
            for k, text in zip(p["doc_id"], p["xml"], strict=True):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    rows.append((k, False, "", False, 0, 0, 0, 0, 0, 0, 0, 0, False, 0))
                    continue
                held = {}
                for e in root.iter():
                    held.setdefault(str(e.tag).rpartition("}")[2], []).append(e)
                n = lambda *names: sum(len(held.get(x, ())) for x in names)
                plain = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""
                title = next((e for e in root if str(e.tag).rpartition("}")[2] == "title"), None)
                abstract = held.get("abstract", [None])[0]
                rows.append((k, True, plain(title), abstract is not None, len(plain(abstract)), n("creator"), n(*SECTION_KINDS), n("para"), len(plain(root)), n("figure"), n("table"), n("Math"), n("bibliography") > 0, n("bibitem")))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in STRUCTURE.split(", ")])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(xml).alias("xml")).mapInPandas(parse, STRUCTURE)


def grade_documents(docs: DataFrame, least_paragraphs: int = 10, most_errors: int = 50) -> DataFrame:
    """docs(doc_id, xml, log) -> their structure with tier clean, degraded or failed, the reasons, and the log's errors and warnings.

    No XML, title, sections or too few paragraphs fail a document; a fatal log, many errors, a bibliography without items, no abstract or a
    supplement's title degrade it.
    """
    logs = docs.select("doc_id", F.regexp_count(F.coalesce("log", F.lit("")), F.lit("(?m)^Error:")).alias("errors"), F.regexp_count(F.coalesce("log", F.lit("")), F.lit("(?m)^Warning:")).alias("warnings"), F.contains(F.coalesce("log", F.lit("")), F.lit("Fatal:")).alias("fatal"))
    p = structure_stats(docs).join(logs, "doc_id")

    def of(*rules: tuple[Column, str]) -> Column:
        return F.filter(F.array(*[F.when(c, r) for c, r in rules]), lambda x: x.isNotNull())

    hard = F.when(~F.col("valid"), F.array(F.lit("invalid_xml"))).otherwise(of((F.col("title") == "", "no_title"), (F.col("sections") == 0, "no_sections"), (F.col("paragraphs") < least_paragraphs, "too_few_paragraphs")))
    soft = of((F.col("fatal"), "fatal"), (F.col("errors") > most_errors, f"errors_gt_{most_errors}"), (F.col("has_bibliography") & (F.col("bibitems") == 0), "bib_lost"), (~F.col("has_abstract"), "abstract_lost"), (F.startswith(F.lower("title"), F.lit("supplementary")), "title_supplement"))
    p = p.withColumns({"hard": hard, "soft": soft})
    failed = F.size("hard") > 0
    tier = F.when(failed, "failed").when(F.size("soft") > 0, "degraded").otherwise("clean")
    return p.withColumns({"tier": tier, "reasons": F.when(failed, F.col("hard")).otherwise(F.col("soft"))}).drop("hard", "soft", "fatal")


def ingest_status(graded: DataFrame) -> DataFrame:
    """Documents by tier and by reason."""
    tiers = graded.groupBy(F.concat(F.lit("tier:"), "tier").alias("what")).agg(F.count("*").alias("n"))
    return tiers.unionByName(graded.select(F.explode("reasons").alias("r")).groupBy(F.concat(F.lit("reason:"), "r").alias("what")).agg(F.count("*").alias("n")))


# Dimension, points, pattern over its text in lower case.
QUALITY = (
    ("reproducibility", 3, r"github\.com|gitlab\.com|bitbucket\.org|code\s+available|open.?source"),
    ("reproducibility", 2, r"dataset|benchmark|corpus|test\s+set|validation\s+set"),
    ("reproducibility", 2, r"learning\s+rate|batch\s+size|epoch|hyperparameter|lambda|dropout"),
    ("reproducibility", 2, r"reproduc|implementation\s+detail|training\s+detail|experimental\s+setup"),
    ("reproducibility", 1, r"checkpoint|pre.?trained|model\s+weight"),
    ("problem", 3, r"we\s+(?:address|tackle|study|investigate|focus\s+on)"),
    ("problem", 2, r"challenge|problem|difficulty|limitation|gap|issue"),
    ("problem", 2, r"motivat|why|important|significance|impact"),
    ("problem", 2, r"goal|objective|aim|target|purpose"),
    ("problem", 1, r"task|problem\s+(?:of|setting|formulation)"),
    ("innovation", 3, r"novel|new\s+approach|first\s+time|state.of.the.art|outperform|superior"),
    ("innovation", 3, r"compared?\s+(?:to|with)|versus|baseline|prior\s+(?:work|art)|existing\s+method"),
    ("innovation", 2, r"contribution|we\s+propose|we\s+introduce|our\s+method|our\s+approach"),
    ("innovation", 2, r"ablation|component\s+analysis|effect\s+of"),
    ("experiments", 2, r"benchmark|standard\s+dataset|evaluation\s+protocol"),
    ("experiments", 2, r"accuracy|precision|recall|f1|bleu|rouge|perplexity|loss|metric|measure"),
    ("experiments", 2, r"significant|p.?value|confidence|standard\s+deviation|variance|mean|average"),
    ("experiments", 2, r"baseline|comparison|prior\s+work|existing\s+(?:method|approach)"),
    ("experiments", 2, r"table\s+[0-9]|figure\s+[0-9]|fig\.\s*[0-9]"),
)
KEY_SECTIONS = ("introduction", "method", "experiment", "conclusion")
GRADES = (("A", 0.85), ("B", 0.70), ("C", 0.55), ("D", 0.40))


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars that are in no group."""
    out, depth, at = [""], 0, 0
    while at < len(pattern):
        c = pattern[at]
        step = 2 if c == "\\" else 1
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += pattern[at : at + step]
        at += step
    return out


def stands(x: Column, pattern: str) -> Column:
    """x.rlike(pattern), with a search for the plain text that each alternative is or begins with before the regular expression; most texts end there."""
    plain, rest = [], []
    for part in _alternatives(pattern):
        if re.fullmatch(r"(?:[a-z0-9 ]|\\\.)+", part):
            plain.append(F.contains(x, F.lit(part.replace("\\.", "."))))
        else:
            head = re.match(r"[a-z0-9]*(?![?*])", part)[0]  # a letter that may be missing is none to look for
            rest.append(F.contains(x, F.lit(head)) & x.rlike(part) if head else x.rlike(part))
    found = plain[0] if plain else rest.pop(0)
    for c in (*plain[1:], *rest):
        found = found | c
    return found


def quality_score(papers: DataFrame) -> DataFrame:
    """papers(title, n_authors, year, venue, abstract, sections array<struct<heading, level, content>>, n_citations) with seven dimensions of
    0..10, their total and a grade by total / 70. Column expressions only."""
    s = F.col("sections")
    low = F.transform(s, lambda x: F.struct(F.lower(x["heading"]).alias("h"), F.lower(x["content"]).alias("c"), x["level"].alias("l")))

    def text(pick: str | None) -> Column:
        hit = F.filter("_s", lambda x: x["h"].rlike(pick)) if pick else F.col("_s")
        return F.array_join(F.transform(hit, lambda x: x["c"]), " ")

    abstract = F.lower(F.coalesce("abstract", F.lit("")))
    p = papers.withColumn("_s", low).withColumns({"_reproducibility": text(None), "_problem": F.concat(abstract, F.lit(" "), text("introduction|problem|motivation")), "_experiments": text("experiment|result|evaluation|analysis"), "_heads": F.array_join(F.transform("_s", lambda x: x["h"]), "\n")})
    p = p.withColumn("_innovation", F.concat(abstract, F.lit(" "), "_reproducibility"))  # the whole body is put together once

    def points(dim: str) -> Column:
        out = F.lit(0)
        for name, n, pattern in QUALITY:
            if name == dim:
                out = out + stands(F.col(f"_{dim}"), pattern).cast("int") * n
        return F.least(out, F.lit(10))

    n, levels = F.size(s), F.size(F.array_distinct(F.transform(s, lambda x: x["level"])))
    found = F.lit(0)
    for k in KEY_SECTIONS:
        found = found + F.col("_heads").contains(k).cast("int")
    structure = F.when(n >= 5, 4).when(n >= 3, 3).when(n >= 1, 2).otherwise(0) + found + F.when(levels >= 2, 2).when((levels == 1) & (n > 3), 1).otherwise(0)
    c = F.col("n_citations")
    full = ((F.coalesce("title", F.lit("")) != "").cast("int") + (F.coalesce("n_authors", F.lit(0)) > 0).cast("int") + F.col("year").isNotNull().cast("int") + (F.coalesce("venue", F.lit("")) != "").cast("int") + (F.length(abstract) > 50).cast("int")) * 2
    dims = {"metadata": full, "structure": F.least(structure, F.lit(10)), "citations": F.when(c >= 30, 10).when(c >= 20, 8).when(c >= 10, 6).when(c >= 5, 4).when(c >= 1, 2).otherwise(0)} | {d: points(d) for d in ("reproducibility", "problem", "innovation", "experiments")}
    out = p.withColumns(dims)
    total = sum((F.col(d) for d in list(dims)[1:]), F.col("metadata"))
    grade = F.lit("F")
    for g, least in reversed(GRADES):
        grade = F.when(F.col("total") / 70 >= least, F.lit(g)).otherwise(grade)
    return out.withColumn("total", total).withColumn("grade", grade).drop("_s", "_heads", "_reproducibility", "_problem", "_innovation", "_experiments")


def classify(papers: DataFrame, taxonomy: list[tuple[str, str, str]], hints: dict[str, str] | None = None) -> DataFrame:
    """papers(doc_id, text, venue) -> (doc_id, domains, sub_directions, methods) by a taxonomy of (domain, sub-direction, keyword) in order.

    Keywords are found as substrings of the lower-cased text; a venue hint (any case) adds 5 to its domain. At most two domains, of 3 points or
    else the best one; of the three best sub-directions those in such a domain; the first ten keywords of more than three letters. Ties go
    by taxonomy order. The taxonomy is a parameter of bounded size and travels as a literal.
    """
    domains = list(dict.fromkeys(t[0] for t in taxonomy))
    subs = list(dict.fromkeys((t[0], t[1]) for t in taxonomy))
    table = F.array(*[F.struct(F.lit(domains.index(d)).alias("d"), F.lit(subs.index((d, s))).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (d, s, k) in enumerate(taxonomy)])
    found = T.once(F.lower("text"), lambda low: F.filter(table, lambda t: F.contains(low, t["k"])))
    hits = papers.select("doc_id", F.lower(F.coalesce("venue", F.lit(""))).alias("venue"), F.coalesce(found, F.filter(table, lambda t: F.lit(False))).alias("hits"))
    hint = F.lit(-1)
    for v, d in (hints or {}).items():
        hint = F.when(F.col("venue") == v.lower(), F.lit(domains.index(d))).otherwise(hint)

    def counted(n: int, field: str, extra: Column | None = None) -> Column:
        """(points, -order) of each domain or sub-direction that has any, best first."""
        one = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((F.size(F.filter("hits", lambda h: h[field] == k)) + (F.when(extra == k, 5).otherwise(0) if extra is not None else F.lit(0))).alias("n"), (-k).alias("k")))
        return F.sort_array(F.filter(one, lambda x: x["n"] > 0), asc=False)

    p = hits.withColumns({"ds": F.slice(counted(len(domains), "d", hint), 1, 2), "ss": F.slice(counted(len(subs), "s"), 1, 3)})
    strong = F.filter("ds", lambda x: x["n"] >= 3)
    p = p.withColumn("top", F.transform(F.when(F.size(strong) > 0, strong).otherwise(F.slice("ds", 1, 1)), lambda x: -x["k"]))
    names, sub_names, sub_domain = F.array(*map(F.lit, domains)), F.array(*[F.lit(f"{d}/{s}") for d, s in subs]), F.array(*[F.lit(domains.index(d)) for d, _ in subs])
    chosen = F.filter("ss", lambda x: F.array_contains("top", F.get(sub_domain, -x["k"])))
    methods = F.slice(F.array_distinct(F.transform(F.filter("hits", lambda h: F.length(h["k"]) > 3), lambda h: h["k"])), 1, 10)
    return p.select("doc_id", F.transform("top", lambda k: F.get(names, k)).alias("domains"), F.transform(chosen, lambda x: F.get(sub_names, -x["k"])).alias("sub_directions"), methods.alias("methods"))


def complete_years(papers: DataFrame, facts: DataFrame) -> DataFrame:
    """papers(a, title, year, text) x facts(b, title, year): a year that is there stays, else the matched fact's, else the inferred one; `way` tells which."""
    m = M.match_titles_overlap(papers.where("year is null").select("a", "title"), facts.select("b", "title"))
    known = m.join(facts.select("b", F.col("year").alias("fact_year")), "b").select("a", "fact_year")
    j = papers.join(known, "a", "left").withColumn("guess", F.when(F.col("year").isNull() & F.col("fact_year").isNull(), T.infer_year(F.col("text"))))
    way = F.when(F.col("year").isNotNull(), "present").when(F.col("fact_year").isNotNull(), "fact").when(F.col("guess").isNotNull(), "inferred").otherwise("missing")
    return j.select("a", F.coalesce("year", "fact_year", "guess").alias("year"), way.alias("way"))


def complete_venues(papers: DataFrame) -> DataFrame:
    """An empty venue becomes arXiv with a preprint id, Preprint with a title, else stays and is skipped."""
    empty = F.coalesce("venue", F.lit("")) == ""
    has_id, has_title = F.coalesce("arxiv_id", F.lit("")) != "", F.coalesce("title", F.lit("")) != ""
    return papers.withColumns({"status": F.when(~empty, "present").when(has_id, "arxiv").when(has_title, "preprint").otherwise("skipped"), "venue": F.when(~empty, F.col("venue")).when(has_id, "arXiv").when(has_title, "Preprint")})


def interest_terms(logs: DataFrame, vocabulary: list[str], stop: list[str], most: int) -> DataFrame:
    """logs(conv_id, turn, role, text) -> (place, term, n): the user's words; ones of the vocabulary among the 50 most frequent first, then others
    of 3 letters or more among the 100 most frequent. Equal counts go to the word seen first."""
    words = logs.where("role = 'user'").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"[a-zA-Z]{2,}|[一-鿿]+"), F.lit(0))).alias("pos", "term"))
    counts = words.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "turn", "pos")).alias("at"))
    top = counts.orderBy(F.desc("n"), "at").limit(100).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "at")))
    known = F.col("term").isin(*vocabulary)
    tier = F.when(known & (F.col("r") <= 50), 0).when(~known & ~F.col("term").isin(*stop) & (F.length("term") >= 3), 1)
    picked = top.withColumn("tier", tier).where("tier is not null").withColumn("place", F.row_number().over(W.orderBy("tier", "r")))
    return picked.where(F.col("place") <= most).select("place", "term", "n")


def ingest(papers: DataFrame, taxonomy: list[tuple[str, str, str]]) -> DataFrame:
    """papers(doc_id, title, abstract, text, lang, source): year, note, quality and tags of every paper as columns, with a status for each step."""
    q = papers.withColumns({"n_authors": F.size(F.split("title", " ")), "year": T.infer_year(F.col("text")), "venue": T.detect_venue(F.col("text")), "n_citations": F.size(T.cite_keys(F.col("text"))), "sections": F.transform(F.split("text", "\n"), lambda x: F.struct(F.substring(x, 1, 40).alias("heading"), F.lit(1).alias("level"), x.alias("content")))})
    scored = quality_score(q)
    tags = classify(papers.select("doc_id", "text", F.col("source").alias("venue")), taxonomy)
    note = render_note(F.col("title"), F.split("title", " "), F.col("abstract"), F.col("doc_id").cast("string"))
    j = scored.withColumn("note", note).join(tags, "doc_id", "left")
    return j.select("doc_id", "year", "total", "grade", "note", "domains", "methods", F.when(F.col("year").isNull(), "missing").otherwise("ok").alias("year_status"), F.when(F.size("domains") > 0, "ok").otherwise("untagged").alias("tag_status"), F.when(F.col("title") == "", "no_title").otherwise("ok").alias("status"))


def render_note(title: Column, authors: Column, abstract: Column, key: Column) -> Column:
    """A Markdown reading note."""
    names = F.concat(F.array_join(F.slice(authors, 1, 5), ", "), F.when(F.size(authors) > 5, F.concat(F.lit(" et al. ("), F.size(authors), F.lit(")"))).otherwise(""))
    summary = F.when(abstract == "", "*No abstract available.*").otherwise(T.first_sentence(abstract))
    points = T.contributions(abstract)
    listed = F.when(F.size(points) == 0, "*None found.*").otherwise(F.array_join(F.transform(points, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n"))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), F.concat(F.lit("**Authors:** "), names), F.concat(F.lit("**Id:** `"), key, F.lit("`")), F.lit(""), F.lit("## Summary"), F.concat(F.lit("> "), summary), F.lit(""), F.lit("## Core Contributions"), listed)


def bibtex(key: Column, title: Column, authors: Column, year: Column, venue: Column) -> Column:
    """One BibTeX entry; year and journal only where they are known."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"  {name} = {{"), value, F.lit("},"))

    lines = F.array(F.concat(F.lit("@article{"), key, F.lit(",")), line("title", title), line("author", F.array_join(authors, " and ")), F.when(year.isNotNull(), line("year", year.cast("string"))), F.when(F.coalesce(venue, F.lit("")) != "", line("journal", venue)), F.lit("}"))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def scan_status(papers: DataFrame, **parts: DataFrame) -> DataFrame:
    """Which of its parts each paper has: papers(doc_id), and for each flag a table of (doc_id)."""
    flags = [(n, t.select("doc_id").distinct().withColumn(n, F.lit(True))) for n, t in parts.items()]
    out = papers.select("doc_id")
    for n, t in flags:
        out = out.join(t, "doc_id", "left").withColumn(n, F.coalesce(n, F.lit(False)))
    return out


def scan_totals(status: DataFrame) -> DataFrame:
    """The flags of `scan_status` in numbers: (what, n) for all papers, each flag, all flags and none."""
    flags = [c for c in status.columns if c != "doc_id"]
    every, none = F.lit(True), F.lit(True)
    for c in flags:
        every, none = every & F.col(c), none & ~F.col(c)
    sums = [F.count("*").alias("total"), *[F.count_if(c).alias(c) for c in flags], F.count_if(every).alias("complete"), F.count_if(none).alias("bare")]
    return status.agg(*sums).unpivot([], ["total", *flags, "complete", "bare"], "what", "n")


def research_sync(directions: DataFrame, feed: DataFrame, corpus: DataFrame) -> DataFrame:
    """directions(category, keywords) and feed(doc_id, title): per category, papers whose title has a keyword as a word, once a category, and how many the corpus lacks."""
    keys = directions.select("category", F.explode(F.split("keywords", r"\s*[;,]\s*")).alias("k")).select("category", F.lower(F.trim("k")).alias("word")).where("word <> ''").distinct()
    words = feed.select("doc_id", F.explode(F.array_distinct(F.split(T.normalized_title(F.col("title")), " "))).alias("word"))
    met = words.join(keys, "word").select("category", "doc_id").distinct()
    new = met.join(corpus.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    return new.groupBy("category").agg(F.count("*").alias("matched"), F.count_if(F.col("known").isNull()).alias("new"))


def sync_directions(directions: DataFrame, feed: DataFrame, corpus: DataFrame, day: str, asked: DataFrame | None = None, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """directions(category, keywords, search_count, last_searched), feed(doc_id, title, fault), corpus(doc_id) -> (summary, errors).

    Each keyword of a category takes the first `most` papers by doc_id whose title has it as a word; what several keywords take counts
    once, and what the corpus holds is left out. A paper without fault is ingested, one with a fault is an error. summary: category,
    keywords, found, downloaded, ingested, failed, the direction's new search_count and last_searched (which stay if all that was
    downloaded failed), and its history row. errors: (category, doc_id, error), also for a category of asked(category) that no direction
    has; categories compare without case.
    """
    name = F.lower("category")
    wanted = directions if asked is None else directions.join(asked.select(name.alias("c")).distinct(), name == F.col("c"), "left_semi")
    keys = wanted.select("category", F.explode(F.split("keywords", r"\s*[;,]\s*")).alias("k")).select("category", F.lower(F.trim("k")).alias("word")).where("word <> ''").distinct()
    words = feed.select("doc_id", F.explode(F.array_distinct(F.split(T.normalized_title(F.col("title")), " "))).alias("word"))
    nth = F.row_number().over(W.partitionBy("category", "word").orderBy("doc_id"))
    taken = words.join(keys, "word").withColumn("nth", nth).where(F.col("nth") <= most).select("category", "doc_id").distinct()
    known = corpus.select("doc_id").distinct().withColumn("known", F.lit(True))
    met = written(taken.join(known, "doc_id", "left").join(feed.select("doc_id", "title", "fault"), "doc_id").select("category", "doc_id", "title", "fault", F.col("known").isNull().alias("new")), "taken")
    sums = met.groupBy("category").agg(F.count("*").alias("found"), F.count_if("new").alias("downloaded"), F.count_if(F.col("new") & F.col("fault").isNull()).alias("ingested"), F.count_if(F.col("new") & F.col("fault").isNotNull()).alias("failed"))
    counted = wanted.join(keys.groupBy("category").agg(F.count("*").alias("n_keywords")), "category", "left").join(sums, "category", "left").na.fill(0, ["n_keywords", "found", "downloaded", "ingested", "failed"])
    done = (F.col("ingested") > 0) | (F.col("downloaded") == 0)
    history = F.struct(F.lit("sync").alias("action"), F.lit(day).alias("date"), F.col("downloaded").alias("papers_found"), "ingested")
    summary = counted.select("category", F.col("n_keywords").alias("keywords"), "found", "downloaded", "ingested", "failed", (F.coalesce("search_count", F.lit(0)) + done.cast("int")).alias("search_count"), F.when(done, F.lit(day)).otherwise(F.col("last_searched")).alias("last_searched"), history.alias("history"))
    errors = met.where(F.col("new") & F.col("fault").isNotNull()).select("category", "doc_id", F.concat("title", F.lit(": "), "fault").alias("error"))
    if asked is not None:
        lost = asked.select("category").distinct().join(directions.select(name.alias("c")).distinct(), name == F.col("c"), "left_anti")
        errors = errors.unionByName(lost.select("category", F.lit(None).cast("long").alias("doc_id"), F.lit("unknown direction").alias("error")))
    return summary, errors


def complete_authors(papers: DataFrame, feed: DataFrame) -> DataFrame:
    """papers(a, title, authors) x feed(b, title, authors): empty lists filled by title match, with status."""
    m = M.match_metadata_jaccard(papers.where(F.size("authors") <= 0).select("a", "title"), feed.select("b", "title")).select("a", "b")
    got = m.join(feed.select("b", F.col("authors").alias("found")), "b").select("a", "found")
    j = papers.join(got, "a", "left")
    return j.select("a", F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.col("found")).alias("authors"), F.when(F.size("authors") > 0, "present").when(F.col("found").isNotNull(), "filled").otherwise("skipped").alias("status"))


#: What a match in the feed can fill.
ENRICHED = ("arxiv_id", "doi", "year", "venue", "authors")


def _blank(c: str, kind: str) -> Column:
    return F.size(F.coalesce(F.col(c), F.array().cast(kind))) == 0 if kind.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def enrich_metadata(papers: DataFrame, feed: DataFrame) -> DataFrame:
    """papers(a, title, arxiv_id, ...) x feed(b, title, arxiv_id, ...) -> papers' fields of ENRICHED with what is missing filled, `filled` (its names), matched_year and status.

    A paper without arXiv id takes from the feed's best title match whatever field of ENRICHED both have and it lacks; the venue of a
    match, and of a paper with an id but no venue, is arXiv where the feed names none. Status: already_have, no_title, enriched or no_match.
    """
    kinds = dict(papers.dtypes)
    fields = [f for f in ENRICHED if f in kinds and (f in feed.columns or f == "venue")]
    have, untitled = ~_blank("arxiv_id", "string"), F.coalesce("title", F.lit("")) == ""
    m = M.match_metadata_jaccard(papers.where(~have & ~untitled).select("a", "title"), feed.where(~_blank("arxiv_id", "string")).select("b", "title")).select("a", "b")
    named = {f: F.col(f) if f in feed.columns else F.lit("arXiv") for f in fields}
    got = m.join(feed.select("b", *[x.alias(f"m_{f}") for f, x in named.items()]), "b").drop("b").withColumn("met", F.lit(True))
    if "venue" in fields:  # an id tells the venue without a match
        j = papers.join(got, "a", "left").withColumn("m_venue", F.when(have, F.lit("arXiv")).otherwise(F.col("m_venue")))
    else:
        j = papers.join(got, "a", "left")
    takes = {f: _blank(f, kinds[f]) & ~_blank(f"m_{f}", kinds[f]) for f in fields}
    filled = F.filter(F.array(*[F.when(t, F.lit(f)) for f, t in takes.items()]), lambda x: x.isNotNull())
    status = F.when(have, "already_have").when(untitled, "no_title").when(F.col("met"), "enriched").otherwise("no_match")
    year = F.col("m_year") if "year" in fields else F.lit(None).cast("int")
    return j.select("a", *[F.when(takes[f], F.col(f"m_{f}")).otherwise(F.col(f)).alias(f) for f in fields], filled.alias("filled"), year.alias("matched_year"), status.alias("status"))


def enrichment_totals(enriched: DataFrame) -> DataFrame:
    """(what, n) of `enrich_metadata`: all papers, each status, venues filled without a match, and matches that know a year."""
    status, names = F.col("status"), ["already_have", "no_title", "enriched", "no_match"]
    venue = (status == "already_have") & F.array_contains("filled", "venue")
    sums = [F.count("*").alias("total"), *[F.count_if(status == n).alias(n) for n in names], F.count_if(venue).alias("venue_filled"), F.count_if((status == "enriched") & F.col("matched_year").isNotNull()).alias("year_filled")]
    return enriched.agg(*sums).unpivot([], ["total", *names, "venue_filled", "year_filled"], "what", "n")


def on_topics(papers: DataFrame, topics: list[str]) -> DataFrame:
    """papers(title, abstract, ...) once for every topic whose text stands in title or abstract (any case)."""
    wanted = F.array(*[F.lit(t.lower()) for t in topics])
    return papers.withColumn("topic", F.explode(T.once(F.lower(F.concat_ws("\n", "title", "abstract")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))))


def survey_report(papers: DataFrame, topics: list[str]) -> DataFrame:
    """papers(doc_id, title, abstract, source, year): per topic, papers by source and by year."""
    t = on_topics(papers, topics)
    return t.groupingSets([["topic", "source"], ["topic", "year"], ["topic"]], "topic", "source", "year").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def landscape_report(papers: DataFrame, topics: list[str], most: int = 20) -> DataFrame:
    """papers(doc_id, title, abstract, grade, total): per topic the grade counts and the key papers by total."""
    t = on_topics(papers, topics)
    grades = t.groupBy("topic", F.coalesce("grade", F.lit("N/A")).alias("item")).agg(F.count("*").alias("n")).select("topic", F.lit("grade").alias("part"), "item", F.col("n").cast("long").alias("n"))
    w = W.partitionBy("topic").orderBy(F.desc_nulls_last("total"), "doc_id")
    key = t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return grades.unionByName(key.select("topic", F.lit("paper").alias("part"), F.col("doc_id").cast("string").alias("item"), F.col("place").cast("long").alias("n")))


_REPORT = ("topic", "part", "item", "place", "n", "text")


def survey(papers: DataFrame, topics: list[str], most: int = 20) -> DataFrame:
    """papers(doc_id, title, abstract, year, authors, venue, grade, domains) -> the parts of a survey of each topic: (topic, part, item, place, n, text).

    A survey takes the first `most` papers of a topic by doc_id. Parts: `papers` (how many), `domain` (domains of the first ten, the most frequent
    first), `year` (papers of a year, with the first five titles) and `paper` (a line for each). Papers without a year are on no timeline.
    """
    place = F.row_number().over(W.partitionBy("topic").orderBy("doc_id"))
    p = on_topics(papers, topics).withColumn("place", place).where(F.col("place") <= most)
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))
    count = p.groupBy("topic").agg(F.count("*").alias("n")).select("topic", F.lit("papers").alias("part"), F.lit("").alias("item"), F.lit(1).alias("place"), "n", F.lit(None).cast("string").alias("text"))
    tags = p.where("place <= 10").select("topic", F.explode("domains").alias("item")).groupBy("topic", "item").agg(F.count("*").alias("n"))
    tags = tags.select("topic", F.lit("domain").alias("part"), "item", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("n"), "item")).alias("place"), "n", F.lit(None).cast("string").alias("text"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("place", F.left(title, F.lit(80)).alias("title")))), 1, 5)  # at most `most`
    years = p.where("year > 0").groupBy("topic", "year").agg(F.count("*").alias("n"), F.array_join(F.transform(first, lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("text"))
    years = years.select("topic", F.lit("year").alias("part"), F.col("year").cast("string").alias("item"), F.row_number().over(W.partitionBy("topic").orderBy("year")).alias("place"), "n", "text")
    line = F.concat(F.lit("**"), F.left(title, F.lit(100)), F.lit("** ("), F.coalesce(F.col("year").cast("string"), F.lit("?")), F.lit(") "), F.array_join(F.slice("authors", 1, 3), ", "), F.coalesce(F.concat(F.lit(" | "), F.nullif("venue", F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(" | Grade: "), F.nullif("grade", F.lit(""))), F.lit("")))
    listed = p.select("topic", F.lit("paper").alias("part"), F.col("doc_id").cast("string").alias("item"), "place", F.lit(1).cast("long").alias("n"), line.alias("text"))
    return count.unionByName(tags).unionByName(years).unionByName(listed).select(*_REPORT)


def landscape(papers: DataFrame, topics: list[str], most: int = 20) -> DataFrame:
    """papers(doc_id, title, year, grade, total, domains, sub_directions) -> the parts of a landscape of each topic, by tags: (topic, part, item, place, n, text).

    A paper belongs to a topic whose text one of its tags contains (any case). Parts: `matched` (the most frequent domain that contains the
    topic, else sub-direction, else the topic itself; n: all papers), `year`, `grade` (A to F, then N/A) and `paper` (the best by total).
    """
    wanted = F.array(*map(F.lit, topics))

    def holds(tags: str):
        return lambda t: F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lower(t)))

    p = papers.withColumn("topic", F.explode(F.filter(wanted, lambda t: holds("domains")(t) | holds("sub_directions")(t))))
    named = None
    for turn, tags in enumerate(("domains", "sub_directions")):
        some = papers.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("c")).withColumn("topic", F.explode(F.filter(wanted, lambda t: F.contains(F.lower("tag"), F.lower(t))))).withColumn("turn", F.lit(turn))
        named = some if named is None else named.unionByName(some)
    matched = named.groupBy("topic").agg(F.min(F.struct("turn", (-F.col("c")).alias("c"), "tag"))["tag"].alias("tag"))
    every = papers.sparkSession.createDataFrame([(t,) for t in topics], "topic string").join(matched, "topic", "left").join(p.groupBy("topic").agg(F.count("*").alias("n")), "topic", "left")
    none = F.lit(None).cast("string").alias("text")
    head = every.select("topic", F.lit("matched").alias("part"), F.coalesce("tag", "topic").alias("item"), F.lit(1).alias("place"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), none)
    years = p.where("year > 0").groupBy("topic", "year").agg(F.count("*").alias("n")).select("topic", F.lit("year").alias("part"), F.col("year").cast("string").alias("item"), F.row_number().over(W.partitionBy("topic").orderBy("year")).alias("place"), "n", none)
    grade = F.coalesce("grade", F.lit("N/A"))
    grades = p.groupBy("topic", grade.alias("item")).agg(F.count("*").alias("n")).select("topic", F.lit("grade").alias("part"), "item", F.row_number().over(W.partitionBy("topic").orderBy(F.col("item") == "N/A", "item")).alias("place"), "n", none)
    best = p.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy(F.desc(F.coalesce("total", F.lit(0))), "doc_id"))).where(F.col("place") <= most)
    line = F.concat(F.lit("**"), F.left(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")), F.lit(80)), F.lit("** ("), F.coalesce(F.col("year").cast("string"), F.lit("?")), F.lit(") -- Grade "), F.coalesce("grade", F.lit("?")))
    listed = best.select("topic", F.lit("paper").alias("part"), F.col("doc_id").cast("string").alias("item"), "place", F.lit(1).cast("long").alias("n"), line.alias("text"))
    return head.unionByName(years).unionByName(grades).unionByName(listed).select(*_REPORT)
