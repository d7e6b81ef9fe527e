"""Queries of the corpus jobs and of the data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import jobs as J
from quire.operators import registry as Q
from quire.operators import retrieval as R
from quire.plans.session import table
from quire.queries import query
from quire.registered import relational as REL
from quire.registered import views as V


def _t(spark, d, name):
    return table(spark, d, name)


@query("job1_project_pages")
def job1(spark, d):
    return J.project_pages(_t(spark, d, "pages"))


def _chunk_nodes(spark, d):
    n = V.nodes(spark, d)
    title = V.papers(spark, d).select("doc_id", F.concat(F.lit("["), F.substring("title", 1, 40), F.lit("] ")).alias("prefix"))
    return n.select("doc_id", F.floor(F.col("pos") / 5).cast("int").alias("section"), "pos", F.col("line").alias("text")).join(title, "doc_id")


# Nodes of a section are taken one after another; a new chunk opens where prefix and texts would pass 1000 characters.
_CHUNKS = f"""WITH RECURSIVE {V.NODES}, {V.PAPERS}, i AS (SELECT n.doc_id, (pos // 5)::INT AS section, pos, line, '[' || left(title, 40) || '] ' AS prefix, row_number() OVER (PARTITION BY n.doc_id, pos // 5 ORDER BY pos) AS k FROM nodes n JOIN papers p ON n.doc_id = p.doc_id WHERE line <> ''),
f AS (SELECT doc_id, section, k, 0 AS chunk, length(prefix) + length(line) + 2 AS size FROM i WHERE k = 1 UNION ALL SELECT i.doc_id, i.section, i.k, chunk + (size + length(line) + 2 > 1000)::INT, CASE WHEN size + length(line) + 2 > 1000 THEN length(prefix) ELSE size END + length(line) + 2 FROM f JOIN i ON f.doc_id = i.doc_id AND f.section = i.section AND i.k = f.k + 1),
c AS (SELECT i.doc_id, i.section, chunk, prefix || string_agg(line, chr(10) || chr(10) ORDER BY pos) AS content FROM f JOIN i ON f.doc_id = i.doc_id AND f.section = i.section AND f.k = i.k GROUP BY 1, 2, 3, prefix),
o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY section, chunk) - 1)::INT AS ordinal FROM c)
"""


@query("job2_chunk", _CHUNKS + "SELECT doc_id, section, ordinal, content, greatest(1, length(content) // 4)::INT AS tokens, sha256(content) AS content_sha256 FROM o")
def job2(spark, d):
    return J.chunked(_chunk_nodes(spark, d), 1000).select("doc_id", "section", "ordinal", "content", "tokens", "content_sha256")


_KINDS = ("p", "figure", "theorem", "table", "equation", "proof", "section")


@query("job3_chunk_eligibility", f"WITH RECURSIVE {V.NODES}, n AS (SELECT doc_id, pos AS node, CASE WHEN pos > 0 THEN (pos - 1) // 2 END AS parent, [{', '.join(repr(k) for k in _KINDS)}][(pos + doc_id) % 7 + 1] AS kind FROM nodes), a AS (SELECT doc_id, node, parent AS above FROM n WHERE parent IS NOT NULL UNION ALL SELECT a.doc_id, a.node, n.parent FROM a JOIN n ON a.doc_id = n.doc_id AND a.above = n.node WHERE n.parent IS NOT NULL), b AS (SELECT DISTINCT a.doc_id, a.node FROM a JOIN n ON a.doc_id = n.doc_id AND a.above = n.node WHERE n.kind IN ('p', 'table', 'figure')) SELECT doc_id, node FROM n WHERE kind IN ('table', 'figure') OR (kind IN ('p', 'equation') AND (doc_id, node) NOT IN (SELECT doc_id, node FROM b)) OR (kind IN ('theorem', 'proof') AND (doc_id, node) NOT IN (SELECT doc_id, parent FROM n WHERE parent IS NOT NULL))")
def job3(spark, d):
    n = V.nodes(spark, d).select("doc_id", F.col("pos").alias("node"), F.when(F.col("pos") > 0, F.floor((F.col("pos") - 1) / 2).cast("int")).alias("parent"), F.get(F.array(*map(F.lit, _KINDS)), ((F.col("pos") + F.col("doc_id")) % 7).cast("int")).alias("kind"))
    return J.chunk_eligible(n).select("doc_id", "node")


@query("job4_embed_chunks")
def job4(spark, d):
    c = J.chunked(_chunk_nodes(spark, d), 1000).select(F.concat_ws("-", "doc_id", "ordinal").alias("chunk_id"), F.col("content").alias("text"))
    return R.embedded(c).select("chunk_id", "embedding", "sound", "content_sha256")


@query("job4_embedded_chunks", _CHUNKS + "SELECT doc_id || '-' || ordinal AS chunk_id, true AS sound, 1.0::DOUBLE AS length, sha256(content) AS content_sha256 FROM o")
def job4_sound(spark, d):
    """What holds of every embedding: its width, and that it has length one (every chunk has words)."""
    length = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 3)
    return job4(spark, d).select("chunk_id", "sound", length.alias("length"), "content_sha256")


@query("job5_reembed_changed", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def job5(spark, d):
    docs = _t(spark, d, "documents")
    known = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("content_sha256")).distinct()
    return R.changed(docs.select("doc_id", "text"), known).select("doc_id")


def _n(tags):
    return f"len(regexp_extract_all(html, '(?i)<(?:{tags})[ >]'))"


_GRADE = f"s AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title>([^<]*)', 1)) AS title, {_n('h[1-6]')} AS sections, {_n('p')} AS paragraphs, {_n('ul|ol')} AS lists, {_n('li')} AS items, {_n('nav')} AS navs, len(regexp_extract_all(html, '[*%#]{{3}}')) AS errors FROM pages), h AS (SELECT *, list_filter([CASE WHEN title = '' THEN 'no_title' END, CASE WHEN sections = 0 THEN 'no_sections' END, CASE WHEN paragraphs < 10 THEN 'too_few_paragraphs' END], lambda x: x IS NOT NULL) AS hard, list_filter([CASE WHEN errors > 50 THEN 'errors' END, CASE WHEN lists > 0 AND items = 0 THEN 'list_lost' END, CASE WHEN navs = 0 THEN 'nav_lost' END, CASE WHEN starts_with(lower(title), 'supplementary') THEN 'title_supplement' END], lambda x: x IS NOT NULL) AS soft FROM s), g AS (SELECT page_id, CASE WHEN len(hard) > 0 THEN 'failed' WHEN len(soft) > 0 THEN 'degraded' ELSE 'clean' END AS tier, CASE WHEN len(hard) > 0 THEN hard ELSE soft END AS reasons FROM h)"


@query("job6_grade_structure", f"WITH {_GRADE} SELECT page_id, tier, array_to_string(reasons, ';') AS reasons FROM g")
def job6(spark, d):
    return J.grade_structure(_t(spark, d, "pages")).select("page_id", "tier", F.array_join("reasons", ";").alias("reasons"))


# Documents as structured XML: sections of five lines, with a title, abstract, bibliography and log by rules on the id.
_DOCX = f"""{V.NODES}, c AS (SELECT doc_id, count(*) AS lines, max(pos // 5) + 1 AS sections FROM nodes GROUP BY 1),
g AS (SELECT doc_id, sections::INT AS sections, lines::INT AS paragraphs, (CASE WHEN doc_id % 7 = 0 THEN 60 ELSE doc_id % 3 END)::INT AS errors,
CASE WHEN doc_id % 29 = 0 THEN ['invalid_xml'] ELSE list_filter([CASE WHEN doc_id % 13 = 0 THEN 'no_title' END, CASE WHEN lines < 10 THEN 'too_few_paragraphs' END], lambda x: x IS NOT NULL) END AS hard,
list_filter([CASE WHEN doc_id % 11 = 0 THEN 'fatal' END, CASE WHEN doc_id % 7 = 0 THEN 'errors_gt_50' END, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 0 THEN 'bib_lost' END, CASE WHEN doc_id % 5 = 0 THEN 'abstract_lost' END, CASE WHEN doc_id % 17 = 0 THEN 'title_supplement' END], lambda x: x IS NOT NULL) AS soft FROM c)"""


@query("job6_grade_documents", f"WITH {_DOCX} SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 0 ELSE sections END::INT AS sections, CASE WHEN doc_id % 29 = 0 THEN 0 ELSE paragraphs END::INT AS paragraphs, errors, CASE WHEN len(hard) > 0 THEN 'failed' WHEN len(soft) > 0 THEN 'degraded' ELSE 'clean' END AS tier, array_to_string(CASE WHEN len(hard) > 0 THEN hard ELSE soft END, ';') AS reasons FROM g")
def job6_documents(spark, d):
    k = F.col("doc_id")
    lines = F.split("text", "\n", -1)
    paras = F.transform(lines, lambda x: F.concat(F.lit("<para>"), F.regexp_replace(x, r"[^A-Za-z0-9 ]", " "), F.lit("</para>")))
    sections = T.once(paras, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / 5).cast("int")), lambda i: F.concat(F.lit("<section>"), F.array_join(F.slice(p, i * 5 + 1, F.lit(5)), ""), F.lit("</section>"))))
    title = F.when(k % 13 == 0, "").when(k % 17 == 0, "<title>Supplementary &amp; more</title>").otherwise("<title>On <b>things</b></title>")
    abstract = F.when(k % 5 == 0, "").otherwise("<abstract>short</abstract>")
    refs = F.when(k % 4 == 0, "<bibliography><bibitem/></bibliography>").when(k % 2 == 0, "<bibliography/>").otherwise("")
    end = F.when(k % 29 == 0, "</doc>").otherwise("</document>")
    xml = F.concat(F.lit('<document xmlns="urn:x">'), title, abstract, F.array_join(sections, ""), refs, end)
    log = F.concat(F.when(k % 11 == 0, "Fatal: stop\n").otherwise("ok\n"), F.repeat(F.lit("Error: bad\n"), F.when(k % 7 == 0, 60).otherwise(k % 3).cast("int")), F.lit("Warning: w"))
    found = J.grade_documents(_t(spark, d, "documents").select(k, xml.alias("xml"), log.alias("log")))
    return found.select("doc_id", "sections", "paragraphs", "errors", "tier", F.array_join("reasons", ";").alias("reasons"))


@query("agg11_ingest_status", f"WITH {_GRADE} SELECT 'tier:' || tier AS what, count(*) AS n FROM g GROUP BY 1 UNION ALL SELECT 'reason:' || r, count(*) FROM (SELECT unnest(reasons) AS r FROM g) GROUP BY 1")
def agg11(spark, d):
    return J.ingest_status(J.grade_structure(_t(spark, d, "pages")))


# Documents as papers with sections whose headings and some words come from ids, so that every rule is met somewhere.
_HEADS = ("Introduction", "Our Method", "Experiments", "Conclusion", "Problem and motivation")
_MARKS = ("we propose a novel dataset with table 3", "learning rate and baseline accuracy", "code available; we study a task", "significant ablation versus prior work", "goal: checkpoint of an evaluation protocol", "plain words", "important challenge")


def _scored(spark, d):
    heads, marks = F.array(*map(F.lit, _HEADS)), F.array(*map(F.lit, _MARKS))

    def cut(lines):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 5).cast("int")), lambda k: F.struct(F.get(heads, k % 5).alias("heading"), (k % 2).alias("level"), F.concat_ws(" ", F.array_join(F.slice(lines, k * 5 + 1, F.lit(5)), "\n"), F.get(marks, ((F.col("doc_id") + k) % 7).cast("int"))).alias("content")))

    part = T.once(F.split("text", "\n", -1), cut)
    k = F.col("doc_id")
    p = V.papers(spark, d).select("doc_id", "title", (k % 3).cast("int").alias("n_authors"), F.when(k % 4 > 0, 2020).alias("year"), F.when(k % 5 > 1, F.col("source")).alias("venue"), "abstract", part.alias("sections"), (k % 37).cast("int").alias("n_citations"))
    return J.quality_score(p)


def _pts(dim, col):
    return "least(10, " + " + ".join(f"{n} * regexp_matches({col}, '{p}')::INT" for dd, n, p in J.QUALITY if dd == dim) + ")"


_SCORE = f"""{V.SECTIONS}, {V.PAPERS}, x AS (SELECT doc_id, ordinal, lower([{', '.join(repr(h) for h in _HEADS)}][ordinal % 5 + 1]) AS h, lower(content || ' ' || [{', '.join(repr(m) for m in _MARKS)}][(doc_id + ordinal) % 7 + 1]) AS c FROM sections),
a AS (SELECT doc_id, count(*) AS n, count(DISTINCT ordinal % 2) AS levels, string_agg(h, chr(10)) AS hs, string_agg(c, ' ' ORDER BY ordinal) AS body, coalesce(string_agg(c, ' ' ORDER BY ordinal) FILTER (WHERE regexp_matches(h, 'introduction|problem|motivation')), '') AS intro, coalesce(string_agg(c, ' ' ORDER BY ordinal) FILTER (WHERE regexp_matches(h, 'experiment|result|evaluation|analysis')), '') AS exps FROM x GROUP BY 1),
y AS (SELECT p.doc_id, 2 * ((title <> '')::INT + (p.doc_id % 3 > 0)::INT + (p.doc_id % 4 > 0)::INT + (p.doc_id % 5 > 1)::INT + (length(abstract) > 50)::INT) AS metadata, least(10, CASE WHEN n >= 5 THEN 4 WHEN n >= 3 THEN 3 WHEN n >= 1 THEN 2 ELSE 0 END + contains(hs, 'introduction')::INT + contains(hs, 'method')::INT + contains(hs, 'experiment')::INT + contains(hs, 'conclusion')::INT + CASE WHEN levels >= 2 THEN 2 WHEN levels = 1 AND n > 3 THEN 1 ELSE 0 END) AS structure, CASE WHEN p.doc_id % 37 >= 30 THEN 10 WHEN p.doc_id % 37 >= 20 THEN 8 WHEN p.doc_id % 37 >= 10 THEN 6 WHEN p.doc_id % 37 >= 5 THEN 4 WHEN p.doc_id % 37 >= 1 THEN 2 ELSE 0 END AS citations, {_pts('reproducibility', 'body')} AS reproducibility, {_pts('problem', "lower(abstract) || ' ' || intro")} AS problem, {_pts('innovation', "lower(abstract) || ' ' || body")} AS innovation, {_pts('experiments', 'exps')} AS experiments FROM papers p JOIN a USING (doc_id)),
z AS (SELECT *, metadata + structure + citations + reproducibility + problem + innovation + experiments AS total FROM y),
sc AS (SELECT *, CASE WHEN total / 70 >= 0.85 THEN 'A' WHEN total / 70 >= 0.7 THEN 'B' WHEN total / 70 >= 0.55 THEN 'C' WHEN total / 70 >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM z)"""


@query("job7_quality_score", f"WITH {_SCORE} SELECT doc_id, metadata, structure, citations, reproducibility, problem, innovation, experiments, total, grade FROM sc")
def job7(spark, d):
    return _scored(spark, d).select("doc_id", "metadata", "structure", "citations", "reproducibility", "problem", "innovation", "experiments", "total", "grade")


# A taxonomy of syllables that the invented documents hold.
TAXONOMY = [("North", "ice", "thion"), ("North", "ice", "ereshing"), ("North", "snow", "andor"), ("South", "sun", "mentque"), ("South", "sun", "euxaux"), ("South", "sea", "ouauxle"), ("East", "dawn", "keitun"), ("East", "dawn", "lichsch"), ("West", "dusk", "ciónad"), ("West", "dusk", "osarr"), ("West", "star", "lyth"), ("West", "star", "ble")]
_HINTS = {"SRC3": "North", "src7": "East"}
_DOMS, _SUBS = list(dict.fromkeys(t[0] for t in TAXONOMY)), list(dict.fromkeys((t[0], t[1]) for t in TAXONOMY))
_VALUES = ", ".join(f"({i}, '{a}', {_DOMS.index(a)}, '{a}/{b}', {_SUBS.index((a, b))}, '{k}')" for i, (a, b, k) in enumerate(TAXONOMY))
_CLASS = f"tx AS (SELECT * FROM (VALUES {_VALUES}) v(i, dom, di, sub, si, kw)), hit AS (SELECT doc_id, source, tx.* FROM documents JOIN tx ON contains(lower(text), kw)), dsc AS (SELECT doc_id, dom, di, sum(n) AS n FROM (SELECT doc_id, dom, di, count(*) AS n FROM hit GROUP BY ALL UNION ALL SELECT doc_id, CASE source WHEN 'src3' THEN 'North' ELSE 'East' END, CASE source WHEN 'src3' THEN 0 ELSE 2 END, 5 FROM documents WHERE source IN ('src3', 'src7')) GROUP BY 1, 2, 3), dr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, di) AS r FROM dsc), dt AS (SELECT doc_id, dom, r FROM dr d WHERE r <= 2 AND (n >= 3 OR (r = 1 AND NOT EXISTS (SELECT 1 FROM dr e WHERE e.doc_id = d.doc_id AND e.r <= 2 AND e.n >= 3)))), ssc AS (SELECT doc_id, sub, dom, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, si) AS r FROM hit GROUP BY doc_id, sub, dom, si), st AS (SELECT s.doc_id, sub, s.r FROM ssc s JOIN dt USING (doc_id, dom) WHERE s.r <= 3), mt AS (SELECT doc_id, kw, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit WHERE length(kw) > 3)"


@query("job8_classify", f"WITH {_CLASS} SELECT d.doc_id, coalesce((SELECT string_agg(dom, '|' ORDER BY r) FROM dt WHERE dt.doc_id = d.doc_id), '') AS domains, coalesce((SELECT string_agg(sub, '|' ORDER BY r) FROM st WHERE st.doc_id = d.doc_id), '') AS subs, coalesce((SELECT string_agg(kw, '|' ORDER BY r) FROM mt WHERE mt.doc_id = d.doc_id AND r <= 10), '') AS methods FROM documents d")
def job8(spark, d):
    c = J.classify(_t(spark, d, "documents").select("doc_id", "text", F.col("source").alias("venue")), TAXONOMY, _HINTS)
    return c.select("doc_id", F.array_join("domains", "|").alias("domains"), F.array_join("sub_directions", "|").alias("subs"), F.array_join("methods", "|").alias("methods"))


_J9A = "a0 AS (SELECT p_partkey AS a, lower(p_name || ' ' || p_brand[7:]) AS s, CASE WHEN p_size % 3 = 0 THEN 2000 + p_size END AS year, CASE WHEN p_size % 3 = 1 THEN 2017 + p_size % 3 END AS guess FROM part), b0 AS (SELECT min(p_partkey) AS b, t FROM (SELECT p_partkey, lower(p_name || ' ' || p_brand[7:] || ' ' || p_size) AS t FROM part) GROUP BY t), f0 AS (SELECT DISTINCT s FROM a0 WHERE year IS NULL), w0 AS (SELECT s, b, t, len(list_intersect(string_split(s, ' '), string_split(t, ' '))) AS c, len(list_distinct(string_split(s, ' '))) AS na, len(list_distinct(string_split(t, ' '))) AS nb FROM f0, b0), k0 AS (SELECT s, b, CASE WHEN s = t THEN 3 WHEN (contains(s, t) OR contains(t, s)) THEN 2 WHEN c / greatest(na, nb) > 0.7 THEN 1 END AS tier, CASE WHEN s = t THEN 1.0 WHEN (contains(s, t) OR contains(t, s)) THEN least(length(s), length(t)) ELSE c / greatest(na, nb) END AS score FROM w0), m0 AS (SELECT s, b FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY tier DESC, score DESC, b) AS n FROM k0 WHERE tier IS NOT NULL) WHERE n = 1)"


@query("job9_complete_years", f"WITH {_J9A} SELECT a0.a, coalesce(year, 1900 + b % 90, guess)::INT AS year, CASE WHEN year IS NOT NULL THEN 'present' WHEN b IS NOT NULL THEN 'fact' WHEN guess IS NOT NULL THEN 'inferred' ELSE 'missing' END AS way FROM a0 LEFT JOIN m0 ON a0.s = m0.s AND a0.year IS NULL")
def job9(spark, d):
    p, k, s = _t(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    number = F.substring("p_brand", 7, 10)
    papers = p.select(k.alias("a"), F.concat_ws(" ", "p_name", number).alias("title"), F.when(s % 3 == 0, 2000 + s).cast("int").alias("year"), F.when(s % 3 == 1, F.concat(F.lit("in "), (2017 + s % 3).cast("string"), F.lit(" we"))).otherwise("no").alias("text"))
    facts = p.select(k.alias("b"), F.concat_ws(" ", "p_name", number, s.cast("string")).alias("title"), (1900 + k % 90).cast("int").alias("year"))
    # equal titles stand for one fact, the least
    facts = facts.groupBy("title").agg(F.min("b").alias("b")).select("b", "title", (1900 + F.col("b") % 90).cast("int").alias("year"))
    return J.complete_years(papers, facts)


@query("job10_complete_venues", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN 'arXiv' WHEN doc_id % 4 = 2 THEN 'Preprint' END AS venue, CASE doc_id % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'preprint' ELSE 'skipped' END AS status FROM documents")
def job10(spark, d):
    k = F.col("doc_id") % 4
    p = _t(spark, d, "documents").select("doc_id", F.when(k == 0, F.col("source")).alias("venue"), F.when(k == 1, "2401.1").alias("arxiv_id"), F.when(k < 3, "t").alias("title"))
    return J.complete_venues(p).select("doc_id", "venue", "status")


_VOC, _STOP = ("the", "les", "und", "que", "ist"), ("and", "der", "des")


@query("job11_interest_terms", f"WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[a-zA-Z]{{2,}}|[一-鿿]+')) AS term, generate_subscripts(regexp_extract_all(text, '[a-zA-Z]{{2,}}|[一-鿿]+'), 1) AS pos FROM conversations WHERE role = 'user'), c AS (SELECT term, count(*) AS n, min((conv_id::BIGINT * 100 + turn) * 100000 + pos) AS at0 FROM w GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, at0) AS r FROM c), t AS (SELECT *, CASE WHEN term IN {_VOC} AND r <= 50 THEN 0 WHEN term NOT IN {_VOC} AND term NOT IN {_STOP} AND length(term) >= 3 THEN 1 END AS tier FROM r WHERE r <= 100) SELECT place, term, n FROM (SELECT *, row_number() OVER (ORDER BY tier, r) AS place FROM t WHERE tier IS NOT NULL) WHERE place <= 12")
def job11(spark, d):
    return J.interest_terms(_t(spark, d, "conversations"), list(_VOC), list(_STOP), 12)


@query("job12_ingest")
def job12(spark, d):
    return J.ingest(V.papers(spark, d), TAXONOMY)


@query("job13_scan_status", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_source, doc_id IN (SELECT page_id FROM pages) AS has_page FROM documents")
def job13(spark, d):
    return _scanned(spark, d)


def _scanned(spark, d):
    return J.scan_status(_t(spark, d, "documents"), has_source=_t(spark, d, "labels"), has_page=_t(spark, d, "pages").select(F.col("page_id").alias("doc_id")))


@query("job13_scan_totals", "WITH f AS (SELECT doc_id IN (SELECT doc_id FROM labels) AS s, doc_id IN (SELECT page_id FROM pages) AS p FROM documents) SELECT unnest(['total', 'has_source', 'has_page', 'complete', 'bare']) AS what, unnest([count(*), count(*) FILTER (WHERE s), count(*) FILTER (WHERE p), count(*) FILTER (WHERE s AND p), count(*) FILTER (WHERE NOT s AND NOT p)]) AS n FROM f")
def job13_totals(spark, d):
    return J.scan_totals(_scanned(spark, d))


@query("job14_research_sync", f"WITH {V.PAPERS}, k AS (SELECT DISTINCT lang AS category, unnest(['the', 'les', lang, 'und', 'of']) AS word FROM documents), w AS (SELECT DISTINCT doc_id, unnest(string_split({REL._N.format('title')}, ' ')) AS word FROM papers), m AS (SELECT DISTINCT category, doc_id FROM w JOIN k USING (word)) SELECT category, count(*) AS matched, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS new FROM m GROUP BY 1")
def job14(spark, d):
    directions = _t(spark, d, "documents").select(F.col("lang").alias("category")).distinct().withColumn("keywords", F.concat(F.lit("the; LES ,"), "category", F.lit("; und;of;")))
    return J.research_sync(directions, V.papers(spark, d).select("doc_id", "title"), _t(spark, d, "labels"))


_J15 = "WITH a AS (SELECT p_partkey AS a, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS ws, p_size FROM part), b AS (SELECT min(p_partkey) AS b, ws FROM (SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_type || ' ' || p_name || ' ' || p_size), ' '))) AS ws FROM part) GROUP BY ws), f AS (SELECT DISTINCT ws FROM a WHERE {cond}), k AS (SELECT f.ws, b.b, len(list_intersect(f.ws, b.ws)) / (len(f.ws) + len(b.ws) - len(list_intersect(f.ws, b.ws))) AS score, len(f.ws) AS n FROM f, b), best AS (SELECT ws, b FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY score DESC, b) AS r FROM k WHERE score > CASE WHEN n <= 4 THEN 0.5 ELSE 0.6 END) WHERE r = 1) "


def _feed(spark, d):
    p = _t(spark, d, "part")
    title = F.concat_ws(" ", "p_type", "p_name", F.col("p_size").cast("string"))
    words = F.array_sort(T.word_set(title))
    return p.groupBy(words.alias("ws")).agg(F.min("p_partkey").alias("b"), F.min_by(title, "p_partkey").alias("title"))


@query("job15_complete_authors", _J15.format(cond="p_size % 2 = 0") + "SELECT a.a, CASE WHEN p_size % 2 = 1 THEN 'own' WHEN b IS NOT NULL THEN 'f' || b END AS authors, CASE WHEN p_size % 2 = 1 THEN 'present' WHEN b IS NOT NULL THEN 'filled' ELSE 'skipped' END AS status FROM a LEFT JOIN best ON a.ws = best.ws AND p_size % 2 = 0")
def job15(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("a"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.when(F.col("p_size") % 2 == 1, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("authors"))
    feed = _feed(spark, d).select("b", "title", F.array(F.concat(F.lit("f"), "b")).alias("authors"))
    return J.complete_authors(p, feed).select("a", F.get("authors", F.lit(0)).alias("authors"), "status")


@query("job16_enrich_metadata", _J15.format(cond="p_size % 3 > 1") + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'already_have' WHEN p_size % 3 = 1 THEN 'no_title' WHEN b IS NOT NULL THEN 'enriched' ELSE 'no_match' END AS status FROM a LEFT JOIN best ON a.ws = best.ws AND p_size % 3 > 1) GROUP BY 1")
def job16(spark, d):
    s = F.col("p_size") % 3
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("a"), F.when(s != 1, F.concat_ws(" ", "p_name", "p_type")).otherwise("").alias("title"), F.when(s == 0, "2401.00001").alias("arxiv_id"))
    feed = _feed(spark, d).select("b", "title", F.concat(F.lit("2402."), "b").alias("arxiv_id"))
    return J.enrich_metadata(p, feed).groupBy("status").agg(F.count("*").alias("n"))


_TOPICS = ("tion", "ver", "ment")
_ON = f"tp AS (SELECT p.*, t FROM papers p, (SELECT unnest({list(_TOPICS)}) AS t) WHERE contains(lower(title || chr(10) || abstract), t))"


@query("job17_survey_report", f"WITH {V.PAPERS}, {_ON} SELECT t AS topic, source, (2000 + doc_id % 5)::INT AS year, count(*) AS n, min(doc_id) AS first FROM tp GROUP BY GROUPING SETS ((t, source), (t, year), (t))")
def job17(spark, d):
    p = V.papers(spark, d).select("doc_id", "title", "abstract", "source", (2000 + F.col("doc_id") % 5).cast("int").alias("year"))
    return J.survey_report(p, list(_TOPICS))


@query("job18_landscape_report", f"WITH {V.PAPERS}, {_ON}, l AS (SELECT doc_id, max(quality) AS q, max(quality * 2 + toxic) AS total FROM labels GROUP BY 1), j AS (SELECT tp.*, q, total, row_number() OVER (PARTITION BY t ORDER BY total DESC NULLS LAST, tp.doc_id) AS place FROM tp LEFT JOIN l USING (doc_id)) SELECT t AS topic, 'grade' AS part, coalesce('g' || q, 'N/A') AS item, count(*) AS n FROM j GROUP BY 1, 3 UNION ALL SELECT t, 'paper', doc_id::VARCHAR, place FROM j WHERE place <= 20")
def job18(spark, d):
    lab = _t(spark, d, "labels").groupBy("doc_id").agg(F.concat(F.lit("g"), F.max("quality")).alias("grade"), F.max(F.col("quality") * 2 + F.col("toxic")).alias("total"))
    p = V.papers(spark, d).select("doc_id", "title", "abstract").join(lab, "doc_id", "left")
    return J.landscape_report(p, list(_TOPICS))


# ---- sinks as expressions ---------------------------------------------------------------------------------------


@query("snk3_export_bibtex", f"WITH {V.PAPERS} SELECT doc_id, '@article{{' || doc_id || ',' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  author = {{' || array_to_string(string_split(title, ' ')[1:2], ' and ') || '}},' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '  year = {{' || (2000 + doc_id % 20) || '}},' || chr(10) ELSE '' END || '  journal = {{' || source || '}},' || chr(10) || '}}' AS entry FROM papers")
def snk3(spark, d):
    k = F.col("doc_id")
    return V.papers(spark, d).select("doc_id", J.bibtex(k.cast("string"), F.col("title"), F.slice(F.split("title", " ", -1), 1, 2), F.when(k % 2 == 0, 2000 + k % 20), F.col("source")).alias("entry"))


_FIRST = "coalesce(list_filter(list_transform(string_split(regexp_replace(trim(abstract), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 30)[1], left(abstract, 200))"
_FOUND = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(abstract, '{p}')" for p in (r"(?is)we\s+(?:propose|introduce|present|develop|design|show|demonstrate)\s+[^.]+", r"(?is)(?:our|the\s+main|a\s+key)\s+contribution[^.]*")) + r"), regexp_extract_all(abstract, '(?is)this\s+(?:paper|work|study)\s+(?:proposes|introduces|presents|develops|shows)[^.]+'))"


@query("snk5_render_notes", f"WITH {V.PAPERS}, x AS (SELECT doc_id, title, abstract, string_split(title, ' ') AS a, {_FIRST} AS summary, list_transform(list_filter({_FOUND}, lambda s: length(trim(s)) > 20), lambda s: left(trim(s), 200))[1:5] AS points FROM papers) SELECT doc_id, '# ' || title || chr(10) || chr(10) || '**Authors:** ' || array_to_string(a[1:5], ', ') || CASE WHEN len(a) > 5 THEN ' et al. (' || len(a) || ')' ELSE '' END || chr(10) || '**Id:** `' || doc_id || '`' || chr(10) || chr(10) || '## Summary' || chr(10) || '> ' || CASE WHEN abstract = '' THEN '*No abstract available.*' ELSE summary END || chr(10) || chr(10) || '## Core Contributions' || chr(10) || CASE WHEN len(points) = 0 THEN '*None found.*' ELSE array_to_string(list_transform(points, lambda p, i: i || '. ' || p), chr(10)) END AS note FROM x")
def snk5(spark, d):
    return V.papers(spark, d).select("doc_id", J.render_note(F.col("title"), F.split("title", " "), F.col("abstract"), F.col("doc_id").cast("string")).alias("note"))


# ---- data-quality checks ----------------------------------------------------------------------------------------


@query("q1_validate_manifest", "WITH m AS (SELECT p_name AS paper_id, p_partkey AS row FROM part) SELECT 'duplicate' AS rule, paper_id AS value, count(*) AS n FROM m GROUP BY paper_id HAVING n > 1 UNION ALL SELECT 'unsafe', paper_id, count(*) FROM m WHERE NOT regexp_full_match(paper_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') GROUP BY paper_id")
def q1(spark, d):
    return Q.validate_manifest(_t(spark, d, "part").select(F.col("p_name").alias("paper_id")), ["paper_id"])


@query("q2_verify_artifacts", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'size' WHEN doc_id % 7 = 1 THEN 'sha256' END AS fault FROM documents WHERE doc_id % 7 < 2")
def q2(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    k = F.col("doc_id") % 7
    manifest = docs.select("doc_id", (F.octet_length("content") + F.when(k == 0, 1).otherwise(0)).alias("size_bytes"), F.when(k == 1, "bad").otherwise(F.sha2("content", 256)).alias("sha256"))
    return Q.verify_artifacts(docs, manifest)


@query("q3_check_constraints", "SELECT 'range:l_discount' AS rule, count(*) AS n FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT 'enum:l_returnflag', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'unique:l_orderkey,l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'foreign:l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def q3(spark, d):
    li = _t(spark, d, "lineitem")
    return Q.check_constraints(li, {"range:l_discount": F.col("l_discount") <= 0.08, "enum:l_returnflag": F.col("l_returnflag").isin("A", "N")}, [["l_orderkey", "l_linenumber"]], {"l_partkey": _t(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))})


_KIND = ("relational", "lexical", "vector", "graph", "semantic")


def _registry(spark, d):
    """A build for each supplier: five kinds, three releases, every seventh not sealed, parent the relational build of its five."""
    k = F.col("s_suppkey")
    return _t(spark, d, "supplier").select(F.concat(F.lit("b"), k).alias("build_id"), F.concat(F.lit("r"), F.floor(k / 5) % 3).alias("release"), F.get(F.array(*map(F.lit, _KIND)), (k % 5).cast("int")).alias("kind"), F.lit(Q.config_hash("build", {"dim": 64})).alias("config_hash"), F.when(k % 7 == 0, "failed").otherwise("sealed").alias("status"), F.concat(F.lit("b"), k - k % 5).alias("parent"))


_REG = f"reg AS (SELECT 'b' || s_suppkey AS build_id, s_suppkey AS k, 'r' || (s_suppkey // 5 % 3) AS release, {list(_KIND)}[s_suppkey % 5 + 1] AS kind, CASE WHEN s_suppkey % 7 = 0 THEN 'failed' ELSE 'sealed' END AS status, 'b' || (s_suppkey - s_suppkey % 5) AS parent FROM supplier)"


@query("q4_sealed_builds", f"WITH {_REG} SELECT release, kind, min(build_id) AS build_id FROM reg WHERE status = 'sealed' GROUP BY 1, 2")
def q4(spark, d):
    """What a job finds before it starts: the sealed build of each release and kind with its configuration."""
    reg = _registry(spark, d)
    return reg.where((F.col("config_hash") == Q.config_hash("build", {"dim": 64})) & (F.col("status") == "sealed")).groupBy("release", "kind").agg(F.min("build_id").alias("build_id"))


@query("q5_validate_builds", f"WITH {_REG}, w AS (SELECT k // 5 AS s, build_id, CASE WHEN k % 11 = 0 THEN 'vector' ELSE kind END AS kind, release, status, kind AS real, parent FROM reg), b AS (SELECT s, max(build_id) AS base, max(release) AS base_release FROM w WHERE kind = 'relational' GROUP BY 1) SELECT 's' || s AS snapshot, kind, build_id, CASE WHEN status <> 'sealed' THEN 'not_sealed' WHEN real <> kind THEN 'wrong_kind' WHEN release <> base_release THEN 'other_release' WHEN kind <> 'relational' AND parent <> base THEN 'other_parent' END AS fault FROM w LEFT JOIN b USING (s) WHERE fault IS NOT NULL")
def q5(spark, d):
    """Every five builds are a snapshot; every eleventh is taken for a vector build."""
    reg = _registry(spark, d)
    k = F.substring("build_id", 2, 20).cast("long")
    wanted = reg.select(F.concat(F.lit("s"), F.floor(k / 5)).alias("snapshot"), F.when(k % 11 == 0, "vector").otherwise(F.col("kind")).alias("kind"), "build_id")
    return Q.validate_builds(reg, wanted)


@query("q6_read_as_of", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def q6(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("b"), F.col("o_orderkey") % 3).alias("build_id"))
    snaps = _t(spark, d, "region").select(F.concat(F.lit("s"), "r_regionkey").alias("snapshot"), F.lit("relational").alias("kind"), F.concat(F.lit("b"), F.col("r_regionkey")).alias("build_id"))
    channels = _t(spark, d, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 1, "live").otherwise("old").alias("channel"), F.concat(F.lit("s"), "r_regionkey").alias("snapshot"))
    return Q.read_as_of(orders, snaps, channels, "live", "relational").select("o_orderkey")


@query("q7_readiness", "SELECT 'relational' AS kind, count(*) AS n, 'ready' AS state FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'lexical', count(*), 'ready' FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'vector', 0, 'empty' UNION ALL SELECT 'graph', 0, 'missing'")
def q7(spark, d):
    counts = _t(spark, d, "orders").groupBy(F.concat(F.lit("b"), F.col("o_orderkey") % 3).alias("build_id")).agg(F.count("*").alias("n")).where("build_id <> 'b2'")
    snaps = _t(spark, d, "region").where("r_regionkey < 3").select(F.get(F.array(*map(F.lit, _KIND)), F.col("r_regionkey").cast("int")).alias("kind"), F.concat(F.lit("b"), "r_regionkey").alias("build_id"))
    return Q.readiness(snaps, counts, ["relational", "lexical", "vector", "graph"])
