"""Queries of filters, joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quire.functions import accounting as A
from quire.functions import text as T
from quire.operators import lines as L
from quire.operators import matching as M
from quire.operators import papers as P
from quire.operators import reports as R
from quire.operators import sets as S
from quire.operators import usage as U
from quire.plans.session import table
from quire.queries import query
from quire.registered import views as V


def _t(spark, d, name):
    return table(spark, d, name)


# ---- filters ----------------------------------------------------------------------------------------------------


@query("flt1_list_papers", "SELECT o_orderkey AS paper_id, year(o_orderdate) AS year, o_orderpriority AS title FROM orders WHERE year(o_orderdate) = 1997 ORDER BY title, paper_id LIMIT 200 OFFSET 20")
def flt1(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("title"))
    return P.list_papers(rows, year=1997, offset=20, limit=500)


@query("flt2_keyword_search", f"WITH {V.PAPERS}, s AS (SELECT *, 10 * contains(lower(title), 'tion')::INT + 5 * contains(lower(abstract), 'tion')::INT AS base, len(list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), 'tion'))) AS n FROM papers) SELECT doc_id, (CASE WHEN base = 0 THEN least(3, n) ELSE base + (n > 0)::INT END)::INT AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def flt2(spark, d):
    score = P.keyword_score(F.col("title"), F.col("abstract"), F.split("text", "\n", -1), "tion")
    return V.papers(spark, d).select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


@query("flt3_topic_filter", f"WITH {V.PAPERS} SELECT doc_id FROM papers WHERE contains(lower(title), 'ver') OR contains(lower(abstract), 'ver')")
def flt3(spark, d):
    return R.topic_filter(V.papers(spark, d), "ver").select("doc_id")


@query("flt4_outline", f"WITH {V.SECTIONS} SELECT ordinal, heading FROM sections WHERE doc_id = 7")
def flt4(spark, d):
    return P.outline(V.sections(spark, d), 7).select("ordinal", "heading")


_SEC = "s.*, 'sec-' || ordinal AS section_id, CASE WHEN ordinal % 2 = 0 THEN 'method' ELSE 'results' END AS role"


def _with_roles(spark, d):
    return V.sections(spark, d).withColumns({"section_id": F.concat(F.lit("sec-"), "ordinal"), "role": F.when(F.col("ordinal") % 2 == 0, "method").otherwise("results")})


@query("flt5_select_section", f"WITH {V.SECTIONS}, s AS (SELECT {_SEC} FROM sections s), w AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sec-1' WHEN 1 THEN '1' WHEN 2 THEN 'results' ELSE 'none' END AS key FROM documents), m AS (SELECT s.doc_id, key, ordinal, CASE WHEN section_id = key THEN 0 WHEN ordinal::VARCHAR = key OR lower(heading) = lower(key) OR role = lower(key) THEN 1 END AS r FROM s JOIN w USING (doc_id)) SELECT doc_id, key, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY r, ordinal) AS n FROM m WHERE r IS NOT NULL) WHERE n = 1")
def flt5(spark, d):
    k = F.col("doc_id") % 4
    wanted = _t(spark, d, "documents").select("doc_id", F.when(k == 0, "sec-1").when(k == 1, "1").when(k == 2, "results").otherwise("none").alias("key"))
    return P.select_section(_with_roles(spark, d), wanted).select("doc_id", "key", "ordinal")


@query("flt6_section_span", f"WITH {V.SECTIONS} SELECT doc_id, ordinal FROM (SELECT doc_id, ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM sections WHERE ordinal >= 1) WHERE n <= 3")
def flt6(spark, d):
    return P.section_span(V.sections(spark, d), 1, 3).select("doc_id", "ordinal")


@query("flt7_passage_scope", f"WITH {V.SECTIONS}, s AS (SELECT {_SEC} FROM sections s) SELECT doc_id, ordinal FROM s WHERE role = 'results' OR contains(lower(heading), 'results')")
def flt7(spark, d):
    return P.passage_scope(_with_roles(spark, d), section="results").select("doc_id", "ordinal")


@query("flt8_sections_by_roles", f"WITH {V.SECTIONS}, s AS (SELECT {_SEC} FROM sections s) SELECT doc_id, ordinal, role FROM s WHERE role IN ('method', 'limitations') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def flt8(spark, d):
    return R.sections_by_roles(_with_roles(spark, d), ["method", "limitations"], _t(spark, d, "labels").where("quality = 1")).select("doc_id", "ordinal", "role")


@query("ret7_gap_evidence", f"WITH {V.SECTIONS} SELECT doc_id, ordinal, (['method', 'limitations', 'conclusion'])[ordinal % 3 + 1] AS role FROM sections WHERE ordinal % 3 > 0")
def ret7_gaps(spark, d):
    roles = F.array(*map(F.lit, ("method", "limitations", "conclusion")))
    return R.gap_evidence(V.sections(spark, d).withColumn("role", F.get(roles, F.col("ordinal") % 3))).select("doc_id", "ordinal", "role")


@query("flt9_audit_range", f"WITH {V.AUDIT} SELECT event_id FROM audit WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' AND tenant = 3")
def flt9(spark, d):
    return P.audit_range(V.audit(spark, d), "2024-01-03", "2024-01-10", 3).select("event_id")


@query("flt10_tool_decision", f"WITH {V.AUDIT}, c AS (SELECT event_type AS tool, CASE event_type WHEN 'purchase' THEN 'admin' ELSE 'read' END AS needs FROM events WHERE event_type <> 'signup' GROUP BY 1) SELECT event_id, CASE WHEN c.needs IS NULL THEN 'unknown_tool' WHEN c.needs = 'admin' AND a.key % 2 = 0 THEN 'missing_capability' WHEN a.tenant >= 8 THEN 'tenant_denied' WHEN a.bytes % 3 = 0 AND a.key % 5 <> 0 THEN 'workspace_write_denied' ELSE 'allowed' END AS decision FROM audit a LEFT JOIN c ON a.event_type = c.tool")
def flt10(spark, d):
    a = V.audit(spark, d)
    caps = F.concat(F.array(F.lit("read")), F.when(F.col("key") % 2 == 1, F.array(F.lit("admin"))).otherwise(F.array().cast("array<string>")), F.when(F.col("key") % 5 == 0, F.array(F.lit("workspace"))).otherwise(F.array().cast("array<string>")))
    calls = a.select("event_id", F.col("event_type").alias("tool"), caps.alias("capabilities"), "tenant", (F.col("bytes") % 3 == 0).alias("writes"))
    catalog = a.select(F.col("event_type").alias("tool")).where("tool <> 'signup'").distinct().select("tool", F.when(F.col("tool") == "purchase", "admin").otherwise("read").alias("needs"), F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")).alias("tenants"))
    return P.tool_decision(calls, catalog).select("event_id", "decision")


@query("flt11_key_status", "SELECT key, CASE WHEN revoked IS NOT NULL THEN 'revoked' WHEN expires <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'active' END AS status FROM (SELECT user_id AS key, max(ts) FILTER (WHERE event_type = 'error' AND value > 15) AS revoked, max(ts) AS expires FROM events GROUP BY 1)")
def flt11(spark, d):
    keys = _t(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 15), F.col("ts"))).alias("revoked"), F.max("ts").alias("expires"))
    return keys.select("key", P.key_status(F.col("revoked"), F.col("expires"), F.lit("2024-01-20").cast("timestamp")).alias("status"))


@query("flt12_retention", f"WITH {V.AUDIT} SELECT event_id FROM audit WHERE ts >= TIMESTAMP '2024-07-15' - INTERVAL 180 DAY")
def flt12(spark, d):
    return P.retention(V.audit(spark, d), "2024-07-15").select("event_id")


# ---- joins ------------------------------------------------------------------------------------------------------


@query("j1_papers_artifacts", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(spark, d):
    return R.papers_with_artifacts(_t(spark, d, "orders"), _t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j2_paper_detail", f"WITH {V.PAPERS}, l AS (SELECT doc_id, arg_max(quality, toxic) AS quality FROM labels GROUP BY 1), a AS (SELECT doc_id, string_agg(w, ';' ORDER BY i) AS authors FROM (SELECT doc_id, unnest(string_split(title, ' ')[1:3]) AS w, generate_subscripts(string_split(title, ' ')[1:3], 1) AS i FROM papers) GROUP BY 1) SELECT p.doc_id, quality, authors FROM papers p LEFT JOIN l USING (doc_id) LEFT JOIN a USING (doc_id)")
def j2(spark, d):
    p = V.papers(spark, d)
    assessments = _t(spark, d, "labels").select("doc_id", F.col("toxic").alias("at"), "quality")
    authors = p.select("doc_id", F.posexplode(F.slice(F.split("title", " ", -1), 1, 3)).alias("position", "name"))
    ids = p.select("doc_id", F.explode(_identifiers()).alias("i")).select("doc_id", "i.*")
    found = R.paper_detail(p, assessments, authors, ids)
    return found.select("doc_id", "quality", F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda a: a["name"]), ";")).alias("authors"))


def _identifiers():
    k = F.col("doc_id")
    entry = lambda cond, scheme, value: F.when(cond, F.struct(F.lit(scheme).alias("scheme"), F.concat(F.lit(value), k.cast("string")).alias("value"), F.lit(scheme == "arxiv").alias("is_primary")))
    return F.filter(F.array(entry(k % 2 == 0, "doi", "10.1/"), entry(k % 3 == 0, "arxiv", "2401.")), lambda x: x.isNotNull())


@query("j2_paper_identifiers", "SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'arxiv=2401.' || doc_id || '!' END, CASE WHEN doc_id % 2 = 0 THEN 'doi=10.1/' || doc_id END], lambda x: x IS NOT NULL), ';') AS identifiers, least(3, len(string_split(string_split(text, chr(10))[1], ' ')))::INT AS n_authors FROM documents")
def j2_identifiers(spark, d):
    p = V.papers(spark, d)
    assessments = _t(spark, d, "labels").select("doc_id", F.col("toxic").alias("at"), "quality")
    authors = p.select("doc_id", F.posexplode(F.slice(F.split("title", " ", -1), 1, 3)).alias("position", "name"))
    ids = p.select("doc_id", F.explode(_identifiers()).alias("i")).select("doc_id", "i.*")
    found = R.paper_detail(p, assessments, authors, ids)
    shown = F.transform("identifiers", lambda i: F.concat(i["scheme"], F.lit("="), i["value"], F.when(i["is_primary"], "!").otherwise("")))
    return found.select("doc_id", F.array_join(shown, ";").alias("identifiers"), F.size("authors").alias("n_authors"))


@query("j3_passages_papers", f"WITH {V.SECTIONS}, {V.PAPERS} SELECT n.doc_id, n.pos, p.title, s.heading FROM nodes n JOIN papers p USING (doc_id) LEFT JOIN sections s ON s.doc_id = n.doc_id AND s.ordinal = n.pos // 5 AND n.pos % 5 = 0")
def j3(spark, d):
    n = V.nodes(spark, d).select("doc_id", "pos", F.when(F.col("pos") % 5 == 0, F.floor(F.col("pos") / 5)).cast("int").alias("ordinal"))
    return R.passages_in_context(n, V.papers(spark, d), V.sections(spark, d)).select("doc_id", "pos", "title", "heading")


@query("j4_citation_contexts", "WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey AS ref FROM lineitem), x AS (SELECT p_partkey AS src, unnest([p_partkey + 1, p_partkey * 2]) AS ref FROM part) SELECT DISTINCT l_orderkey, l_linenumber, ref, src AS target FROM m JOIN x USING (ref)")
def j4(spark, d):
    mentions = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ref"))
    k = F.col("p_partkey")
    edges = _t(spark, d, "part").select(k.alias("src"), F.array(k + 1, k * 2).alias("reference_ids"))
    return U.citation_contexts(mentions, edges).select("l_orderkey", "l_linenumber", "ref", F.col("src").alias("target"))


@query("j6_resolve_ids", "WITH q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR WHEN p_partkey % 3 = 1 THEN upper(p_name) || '!' ELSE 'x' || p_partkey END AS q FROM part), i AS (SELECT p_partkey::VARCHAR AS v, p_partkey AS w FROM part), t AS (SELECT DISTINCT trim(regexp_replace(lower(p_name || CASE WHEN p_partkey < 64 THEN '' ELSE ' ' || p_partkey END), '[^a-z0-9]+', ' ', 'g')) AS n, p_partkey AS w FROM part), dd AS (SELECT q, count(DISTINCT w) AS n, min(w) AS w FROM q JOIN i ON q = v GROUP BY 1), f AS (SELECT q.q, count(DISTINCT t.w) AS n, min(t.w) AS w FROM q LEFT JOIN t ON trim(regexp_replace(lower(q.q), '[^a-z0-9]+', ' ', 'g')) = t.n WHERE q.q NOT IN (SELECT q FROM dd) GROUP BY 1) SELECT q, CASE WHEN n = 1 THEN w END AS work, n::INT AS n, CASE n WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status FROM (SELECT * FROM dd UNION ALL SELECT * FROM f)")
def j6(spark, d):
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    q = p.select(F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.upper("p_name"), F.lit("!"))).otherwise(F.concat(F.lit("x"), k)).alias("q")).distinct()
    ids = p.select(k.cast("string").alias("value"), k.alias("work"))
    titles = p.select(F.concat("p_name", F.when(k < 64, "").otherwise(F.concat(F.lit(" "), k))).alias("title"), k.alias("work"))
    return M.resolve_ids(q, ids, titles)


@query("j7_resolve_paper_keys", "WITH p AS (SELECT DISTINCT doc_id AS id, '24' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad(doc_id::VARCHAR, 5, '0') AS arxiv, '10.1/d' || doc_id AS doi, 'slug-' || source || '-' || doc_id || '-end' AS slug FROM documents), q AS (SELECT DISTINCT CASE id % 8 WHEN 0 THEN id::VARCHAR WHEN 1 THEN 'arXiv:' || arxiv || 'v2' WHEN 2 THEN 'https://doi.org/' || upper(doi) WHEN 3 THEN upper(source_of) WHEN 4 THEN ' ' || replace(source_of, '-', ' ') || ' ' WHEN 5 THEN chr(97 + (id % 26)::INT) || chr(97 + (id // 26 % 26)::INT) WHEN 6 THEN slug ELSE 'nothing-' || id END AS q FROM (SELECT *, 'SRC' || (id % 7) || '-' || id || '-E' AS source_of FROM p)), h AS (SELECT q, id, 0 AS way FROM q JOIN p ON trim(q) IN (id::VARCHAR, arxiv, doi, slug) UNION ALL SELECT q, id, 1 FROM q JOIN p ON regexp_replace(trim(q), '(?i)^(?:arxiv:)?([0-9]{4}\\.[0-9]{4,5})(?:v[0-9]+)?$', '\\1') = arxiv UNION ALL SELECT q, id, 2 FROM q JOIN p ON lower(regexp_replace(trim(q), '(?i)^https?://(?:dx\\.)?doi\\.org/', '')) = lower(doi) UNION ALL SELECT q, id, 3 FROM q JOIN p ON contains(slug, replace(lower(trim(q)), ' ', '-'))) SELECT q.q, arg_min(id, way * 1000000000::BIGINT + id) AS paper_id, min(way) AS way FROM q LEFT JOIN h ON q.q = h.q GROUP BY 1")
def j7(spark, d):
    k = F.col("paper_id")
    p = _t(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("24"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("arxiv_id"), F.concat(F.lit("10.1/d"), "doc_id").alias("doi"), F.concat(F.lit("slug-"), "source", F.lit("-"), "doc_id", F.lit("-end")).alias("slug")).distinct()
    kind, tail = k % 8, F.concat(F.lit("SRC"), k % 7, F.lit("-"), k, F.lit("-E"))
    letters = F.concat(F.char(F.lit(97) + k % 26), F.char(F.lit(97) + F.floor(k / 26) % 26))
    q = F.when(kind == 0, k.cast("string")).when(kind == 1, F.concat(F.lit("arXiv:"), "arxiv_id", F.lit("v2"))).when(kind == 2, F.concat(F.lit("https://doi.org/"), F.upper("doi"))).when(kind == 3, tail)
    q = q.when(kind == 4, F.concat(F.lit(" "), F.replace(tail, F.lit("-"), F.lit(" ")), F.lit(" "))).when(kind == 5, letters).when(kind == 6, F.col("slug")).otherwise(F.concat(F.lit("nothing-"), k))
    q = p.select(q.alias("q")).distinct()
    return M.resolve_paper_keys(q, p)


_N = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _refs(spark, d):
    """Documents cite the benchmark items: the raw text is the document, some titles are exact."""
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("work"), F.col("text").alias("title"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), (F.col("doc_id") % 50).alias("citing"), F.col("text").alias("raw"))
    exact = items.select((F.col("work") + 1_000_000).alias("ref_id"), F.lit(-1).cast("long").alias("citing"), F.lit("").alias("raw"), F.upper("title").alias("title"))
    return docs.withColumn("title", F.lit("unknown")).select("ref_id", "citing", "title", "raw").unionByName(exact.select("ref_id", "citing", "title", "raw")), items


_J8 = f"items AS (SELECT min(item_id) AS work, {_N.format('text')} AS norm FROM benchmark GROUP BY 2), refs AS (SELECT doc_id AS ref_id, doc_id % 50 AS citing, {_N.format('text')} AS raw, 'unknown' AS title FROM documents UNION ALL SELECT item_id + 1000000, -1, '', {_N.format('text')} FROM benchmark), ex AS (SELECT ref_id, citing, work, 0.99 AS confidence FROM refs JOIN items ON refs.title = items.norm), lo AS (SELECT ref_id, citing, arg_max(work, length(norm) * 1000000 - work) AS work, 0.92 AS confidence FROM refs JOIN items ON length(norm) >= 24 AND contains(raw, norm) WHERE ref_id NOT IN (SELECT ref_id FROM ex) GROUP BY 1, 2), res AS (SELECT * FROM ex UNION ALL SELECT * FROM lo)"


@query("j8_resolve_refs_title", f"WITH {_J8} SELECT ref_id, citing, work, confidence::DOUBLE AS confidence FROM res WHERE citing <> work")
def j8(spark, d):
    return M.resolve_refs_title(*_refs(spark, d))


@query("j9_resolve_refs_doi", "SELECT p_partkey AS ref_id, s_suppkey AS work FROM part JOIN supplier ON lower(trim(' 10.5/S' || (p_partkey % 500) || ' ')) = '10.5/s' || s_suppkey")
def j9(spark, d):
    refs = _t(spark, d, "part").select(F.col("p_partkey").alias("ref_id"), F.concat(F.lit(" 10.5/S"), F.col("p_partkey") % 500, F.lit(" ")).alias("doi"))
    papers = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("work"), F.concat(F.lit("10.5/s"), "s_suppkey").alias("paper_doi"))
    return M.resolve_refs_doi(refs, papers).select("ref_id", "work")


def _srt(x):
    return "array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(" + x + "), '[^a-z0-9 \\t\\n\\r]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')), ' ')), ' ')"


_FUZZ_A = "p_name || ' ' || p_type || CASE p_partkey % 3 WHEN 0 THEN 'x' ELSE '' END"
_FUZZ_B = "p_type || ' ' || p_name"


def _fuzzy(spark, d):
    p = _t(spark, d, "part")
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.concat_ws(" ", "p_name", F.concat("p_type", F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""))).alias("title"))
    papers = p.select(F.col("p_partkey").alias("work"), F.concat_ws(" ", "p_type", "p_name").alias("title"))
    return refs, papers


_J10 = f"a AS (SELECT p_partkey AS ref_id, {_srt(_FUZZ_A)} AS s FROM part), b AS (SELECT t, min(work) AS work FROM (SELECT p_partkey AS work, {_srt(_FUZZ_B)} AS t FROM part) GROUP BY 1), f AS (SELECT DISTINCT s FROM a), sc AS (SELECT s, work, 100.0 * (1.0 - levenshtein(s, t) / greatest(length(s), length(t))) AS score FROM f, b WHERE levenshtein(s, t) <= 0.2 * greatest(length(s), length(t))), best AS (SELECT s, work, score FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, work) AS n FROM sc WHERE score >= 85) WHERE n = 1)"


@query("j10_resolve_refs_fuzzy", f"WITH {_J10} SELECT ref_id, work, round(score, 6)::DOUBLE AS score FROM a JOIN best USING (s)")
def j10(spark, d):
    return M.resolve_refs_fuzzy(*_fuzzy(spark, d), partial=None)


@query("j10_resolve_refs_partial")
def j10_partial(spark, d):
    """Names, every other one with a word more, against longer titles: the second step finds names that are part of a title."""
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    refs = p.select(k.alias("ref_id"), F.concat_ws(" ", "p_name", F.when(k % 2 == 0, F.lit("study"))).alias("title"))
    return M.resolve_refs_fuzzy(refs, p.select(k.alias("work"), F.concat_ws(" ", F.lit("on"), "p_name", "p_brand").alias("title")))


@query("j11_resolve_cascade", f"WITH {_J10}, lv AS (SELECT ref_id, CASE WHEN ref_id % 5 = 0 THEN 'doi' WHEN s IN (SELECT s FROM best) THEN 'title' ELSE 'unresolved' END AS level FROM a) SELECT level, count(*) AS n, round(count(*) / (SELECT count(*) FROM a), 6)::DOUBLE AS share FROM lv GROUP BY 1")
def j11(spark, d):
    refs, papers = _fuzzy(spark, d)
    k = F.col("ref_id")
    refs = refs.withColumn("doi", F.when(k % 5 == 0, F.concat(F.lit("10.9/"), k)))
    papers = papers.withColumn("paper_doi", F.concat(F.lit("10.9/"), "work"))
    return U.resolution_levels(U.resolve_cascade(refs, papers, partial=None))


@query("j12_match_titles_overlap", "WITH a AS (SELECT p_partkey AS a, lower(p_name || ' ' || p_brand[7:]) AS s FROM part), b AS (SELECT min(p_partkey) AS b, t FROM (SELECT p_partkey, lower(CASE p_partkey % 4 WHEN 0 THEN p_name ELSE p_name || ' ' || p_brand[7:] || ' ' || p_size END) AS t FROM part) GROUP BY t), f AS (SELECT DISTINCT s FROM a), w AS (SELECT s, b, t, len(list_intersect(string_split(s, ' '), string_split(t, ' '))) AS c, len(list_distinct(string_split(s, ' '))) AS na, len(list_distinct(string_split(t, ' '))) AS nb FROM f, b), k AS (SELECT s, b, CASE WHEN s = t THEN 3 WHEN (contains(s, t) OR contains(t, s)) THEN 2 WHEN c / greatest(na, nb) > 0.7 THEN 1 END AS tier, CASE WHEN s = t THEN 1.0 WHEN (contains(s, t) OR contains(t, s)) THEN least(length(s), length(t)) ELSE c / greatest(na, nb) END AS score FROM w), best AS (SELECT s, b, tier, score FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY tier DESC, score DESC, b) AS n FROM k WHERE tier IS NOT NULL) WHERE n = 1) SELECT a.a, b, tier, round(score, 6)::DOUBLE AS score FROM a JOIN best USING (s)")
def j12(spark, d):
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    number = F.substring("p_brand", 7, 10)
    left = p.select(k.alias("a"), F.concat_ws(" ", "p_name", number).alias("title"))
    right = p.select(k.alias("b"), F.when(k % 4 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", number, F.col("p_size").cast("string"))).alias("title"))
    return M.match_titles_overlap(left, right)


@query("j13_match_metadata_jaccard", "WITH a AS (SELECT p_partkey AS a, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS ws FROM part), b AS (SELECT min(p_partkey) AS b, ws FROM (SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_type || ' ' || p_name || ' ' || p_size), ' '))) AS ws FROM part) GROUP BY ws), f AS (SELECT DISTINCT ws FROM a), k AS (SELECT f.ws, b.b, len(list_intersect(f.ws, b.ws)) / (len(f.ws) + len(b.ws) - len(list_intersect(f.ws, b.ws))) AS score, len(f.ws) AS n FROM f, b), best AS (SELECT ws, b, score FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY score DESC, b) AS r FROM k WHERE score > CASE WHEN n <= 4 THEN 0.5 ELSE 0.6 END) WHERE r = 1) SELECT a.a, b, round(score, 6)::DOUBLE AS score FROM a JOIN best USING (ws)")
def j13(spark, d):
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    feed = p.select(k.alias("b"), F.concat_ws(" ", "p_type", "p_name", F.col("p_size").cast("string")).alias("title"))
    return M.match_metadata_jaccard(p.select(k.alias("a"), F.concat_ws(" ", "p_name", "p_type").alias("title")), feed)


@query("j14_missing_citations", "SELECT DISTINCT 'k' || (p_partkey % 977) AS key FROM part WHERE p_partkey % 977 NOT IN (SELECT s_suppkey FROM supplier)")
def j14(spark, d):
    drafts = _t(spark, d, "part").select(F.concat(F.lit("see \\cite{k"), F.col("p_partkey") % 977, F.lit("} and")).alias("text"))
    known = _t(spark, d, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("key"))
    return S.missing_citations(drafts, known)


@query("j15_not_yet_ingested", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j15(spark, d):
    return S.not_yet_ingested(_t(spark, d, "documents").select("doc_id", "source"), _t(spark, d, "labels"), "doc_id").select("doc_id")


@query("j16_unanalyzed_weeks", "SELECT user_id AS project, min(week) AS week FROM (SELECT DISTINCT user_id, year(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS week FROM events) WHERE NOT (user_id % 2 = 0 AND week = '2024-W01') GROUP BY 1")
def j16(spark, d):
    logs = _t(spark, d, "events").select(F.col("user_id").alias("project"), A.iso_week_id(F.col("ts")).alias("week")).distinct()
    done = logs.where("project % 2 = 0 and week = '2024-W01'")
    return S.unanalyzed_weeks(logs, done)


@query("j17_merge_sources", "SELECT d.doc_id, coalesce(nullif(CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.source END, ''), p.url) AS venue, CASE WHEN p.page_id % 2 = 0 THEN 2000 + p.page_id % 20 ELSE 1990 END::INT AS year, CASE WHEN length(p.html) > length(d.text) + greatest(500, length(d.text) * 0.2) THEN 'fallback' ELSE 'primary' END AS content_from, concat_ws('|', CASE WHEN d.doc_id % 3 <> 0 AND d.source <> '' AND p.url <> '' AND d.source <> p.url THEN 'venue' END, CASE WHEN p.page_id % 2 = 0 AND 2000 + p.page_id % 20 <> 1990 THEN 'year' END) AS conflicts FROM documents d JOIN pages p ON d.doc_id = p.page_id")
def j17(spark, d):
    primary = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("venue"), F.lit(1990).alias("year"), F.col("text").alias("content"))
    fallback = _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("f_venue"), F.when(F.col("page_id") % 2 == 0, 2000 + F.col("page_id") % 20).cast("int").alias("f_year"), F.col("html").alias("f_content"))
    out = U.merge_sources(primary, fallback)
    return out.where("has_fallback").select("doc_id", "venue", "year", "content_from", F.array_join(F.map_keys("conflicts"), "|").alias("conflicts"))


@query("j18_apply_metadata", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.lang END, l.quality::VARCHAR) AS lang, CASE WHEN d.doc_id % 2 <> 0 AND l.quality IS NOT NULL THEN 'lang' ELSE '' END AS filled FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def j18(spark, d):
    papers = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    meta = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("m_lang"))
    return U.apply_metadata(papers, meta, ["lang"]).select("doc_id", "lang", F.array_join("filled", "|").alias("filled"))


@query("j19_dominates", "WITH i AS (SELECT p_partkey AS id, p_size % 5 + 1 AS a, p_partkey % 5 + 1 AS b, (p_partkey // 5) % 5 + 1 AS c FROM part) SELECT s.id AS source, t.id AS target, (t.a >= s.a AND t.b >= s.b AND t.c >= s.c AND (t.a > s.a OR t.b > s.b OR t.c > s.c)) AS dominates FROM i s JOIN i t ON t.id = s.id + 1")
def j19(spark, d):
    k = F.col("p_partkey")
    inn = _t(spark, d, "part").select(k.alias("id"), (F.col("p_size") % 5 + 1).alias("a"), (k % 5 + 1).alias("b"), (F.floor(k / 5) % 5 + 1).alias("c"))
    pairs = inn.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return U.dominates(pairs, inn, ["a", "b", "c"])


@query("j20_compare_runs", "WITH m AS (SELECT l_suppkey AS metric, sum(l_quantity) FILTER (WHERE l_linenumber % 2 = 0) AS a, sum(l_quantity) FILTER (WHERE l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY 1) SELECT metric, round(a - b, 4) AS diff FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def j20(spark, d):
    li = _t(spark, d, "lineitem")
    run, base = (li.where(F.col("l_linenumber") % 2 == k).groupBy(F.col("l_suppkey").alias("metric")).agg(F.sum("l_quantity").alias("value")) for k in (0, 1))
    return U.compare_runs(run, base)


@query("j21_token_audit", "SELECT event_id, c_name, n_name FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 100")
def j21(spark, d):
    e = _t(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("principal"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("principal"), "c_name", F.col("c_nationkey").alias("tenant"))
    return R.token_audit(e, c, _t(spark, d, "nation").select(F.col("n_nationkey").alias("tenant"), "n_name"), "2024-01-05", "2024-01-25").select("event_id", "c_name", "n_name")


@query("j22_researcher_list", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 = 0 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2)")
def j22(spark, d):
    c = _t(spark, d, "customer").withColumn("team", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")))
    return U.active_members(c, _t(spark, d, "nation").where("n_regionkey <= 2").select(F.col("n_nationkey").alias("team"))).select("c_custkey", "c_name")


_HEALTH = "CASE WHEN b.key IS NULL THEN 'no_backend' WHEN b.event_type = 'error' THEN 'backend_failed' WHEN b.event_type = 'signup' THEN 'not_ready' WHEN b.ts < TIMESTAMP '2024-01-28' THEN 'stale_probe' WHEN b.value > 20 THEN 'version_mismatch' ELSE 'healthy' END"


@query("j23_route_health", f"WITH b AS (SELECT user_id AS key, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1), r AS (SELECT c_custkey AS route, c_custkey AS key FROM customer) SELECT route, {_HEALTH} AS reason FROM r LEFT JOIN b USING (key)")
def j23(spark, d):
    last = M.latest_per_key(_t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")])
    backends = last.select(F.col("user_id").alias("backend"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), (F.col("event_type") != "signup").alias("ready"), F.col("ts").alias("probed_at"), (F.col("value") <= 20).alias("version_ok"))
    routes = _t(spark, d, "customer").select(F.col("c_custkey").alias("route"), F.col("c_custkey").alias("backend"))
    return U.route_health(routes, backends, F.lit("2024-01-28").cast("timestamp")).select("route", "reason")


@query("j24_reference_evidence", f"WITH {V.NODES}, i AS (SELECT DISTINCT unnest([item_id, item_id + 1, item_id * 3]) AS doc_id FROM benchmark) SELECT n.doc_id, n.pos, left(n.line, 500) AS quote FROM nodes n JOIN i USING (doc_id)")
def j24(spark, d):
    i = F.col("item_id")
    ids = _t(spark, d, "benchmark").select(F.explode(F.array(i, i + 1, i * 3)).alias("doc_id")).distinct()
    return V.nodes(spark, d).join(ids, "doc_id").select("doc_id", "pos", T.quote(F.col("line")).alias("quote"))


@query("j25_mention_to_reference", "WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS target FROM pages), r AS (SELECT page_id, '/' || regexp_extract(html, 'href=\"/([^\"]*)\"', 1) AS xml_id FROM pages) SELECT m.page_id, m.target, count(*) AS n, (r.xml_id IS NOT NULL) AS resolved FROM m LEFT JOIN r ON m.page_id = r.page_id AND m.target = r.xml_id GROUP BY ALL")
def j25(spark, d):
    p = _t(spark, d, "pages")
    mentions = p.select(F.col("page_id").alias("work"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'))).alias("target"))
    refs = p.select(F.col("page_id").alias("work"), F.concat(F.lit("/"), F.regexp_extract("html", 'href="/([^"]*)"', 1)).alias("xml_id"))
    return R.mention_to_reference(mentions, refs).withColumnRenamed("work", "page_id").select("page_id", "target", "n", "resolved")


# ---- aggregates -------------------------------------------------------------------------------------------------


@query("agg1_usage_by_tenant", f"WITH {V.AUDIT}, u AS (SELECT tenant, count(*) AS n, count(*) FILTER (WHERE outcome = 'forwarded') AS forwarded, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'rejected') AS rejected, round(avg(latency), 2) AS avg_latency, max(latency) AS max_latency, count(latency) AS latencies, sum(bytes) AS bytes, sum(CASE WHEN outcome = 'forwarded' THEN 1 END) AS quota FROM audit WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1) SELECT n_nationkey AS tenant, coalesce(n, 0) AS n, coalesce(forwarded, 0) AS forwarded, coalesce(failed, 0) AS failed, coalesce(rejected, 0) AS rejected, avg_latency, max_latency, coalesce(latencies, 0)::BIGINT AS latencies, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(quota, 0)::BIGINT AS quota FROM nation LEFT JOIN u ON n_nationkey = tenant")
def agg1(spark, d):
    tenants = _t(spark, d, "nation").select(F.col("n_nationkey").alias("tenant"))
    events = V.audit(spark, d).withColumn("quota", F.when(F.col("outcome") == "forwarded", 1))
    return R.usage_by_tenant(P.audit_range(events, "2024-01-01", "2024-01-15"), tenants)


@query("agg3_corpus_stats", f"WITH {V.PAPERS}, p AS (SELECT *, CASE WHEN doc_id % 4 <> 0 THEN 2000 + doc_id % 23 END AS year, len(string_split(text, chr(10))) AS n_sections, len(string_split(title, ' ')) AS n_authors FROM papers), y AS (SELECT 'by year' AS what, year::VARCHAR AS key, count(*)::DOUBLE AS value FROM p WHERE year IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10), v AS (SELECT 'by venue' AS what, source AS key, count(*)::DOUBLE AS value FROM p WHERE source <> '' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) SELECT 'papers' AS what, '' AS key, count(*)::DOUBLE AS value FROM p UNION ALL SELECT 'total', 'sections', sum(n_sections)::DOUBLE FROM p UNION ALL SELECT 'total', 'authors', sum(n_authors)::DOUBLE FROM p UNION ALL SELECT 'coverage', 'year', round(avg((year IS NOT NULL)::INT), 2) FROM p UNION ALL SELECT 'coverage', 'abstract', round(avg((abstract <> '')::INT), 2) FROM p UNION ALL SELECT 'coverage', 'venue', round(avg((coalesce(source, '') <> '')::INT), 2) FROM p UNION ALL SELECT * FROM y UNION ALL SELECT * FROM v")
def agg3(spark, d):
    k = F.col("doc_id")
    p = V.papers(spark, d).select("doc_id", "abstract", F.col("source").alias("venue"), F.when(k % 4 != 0, 2000 + k % 23).alias("year"), F.split("title", " ", -1).alias("authors"), F.split("text", "\n", -1).alias("sections"))
    return R.corpus_stats(p, ["year", "abstract", "venue"], ["sections", "authors"], ["year", "venue"])


@query("agg4_snapshot_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels")
def agg4(spark, d):
    return U.counts({n: _t(spark, d, n) for n in ("documents", "pages", "embeddings", "labels")})


@query("agg5_tag_stats", f"WITH {V.PAPERS} SELECT w AS tag, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS w FROM papers) GROUP BY 1 ORDER BY n DESC, tag LIMIT 30")
def agg5(spark, d):
    words = F.array_distinct(F.filter(F.split(T.normalized_title(F.col("title")), " "), lambda x: x != ""))
    return U.top_tags(V.papers(spark, d).select(words.alias("tags")), 30)


@query("agg6_grade_distribution", "SELECT coalesce(quality::VARCHAR, 'N/A') AS grade, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1")
def agg6(spark, d):
    return R.grade_distribution(_t(spark, d, "documents"), _t(spark, d, "labels").select("doc_id", F.col("quality").alias("grade")))


@query("agg7_evidence_by_reference", "SELECT l_partkey, array_to_string(list_sort(list_distinct(list(l_orderkey))), ',') AS nodes FROM lineitem GROUP BY 1")
def agg7(spark, d):
    mentions = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("reference"), F.col("l_orderkey").alias("node"))
    return R.evidence_by_reference(mentions).select(F.col("reference").alias("l_partkey"), F.array_join("nodes", ",").alias("nodes"))


@query("agg8_citation_edges", "SELECT l_partkey AS src, l_suppkey AS dst, max(l_discount) AS confidence, array_to_string(list_sort(list(l_orderkey)), ',') AS reference_ids, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS evidence FROM lineitem GROUP BY 1, 2")
def agg8(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("reference_id"), F.array("l_linenumber").alias("evidence"))
    return U.citation_edges(li).select("src", "dst", "confidence", F.array_join("reference_ids", ",").alias("reference_ids"), F.array_join("evidence", ",").alias("evidence"))


@query("agg9_section_text", f"WITH {V.NODES} SELECT doc_id, (pos // 5)::INT AS ordinal, left(string_agg(line, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE length(line) > 20), 20000) AS text FROM nodes GROUP BY 1, 2")
def agg9(spark, d):
    n = V.nodes(spark, d).withColumn("ordinal", F.floor(F.col("pos") / 5).cast("int"))
    return U.section_text(n, F.length("line") > 20)


@query("agg10_build_totals", "SELECT count(DISTINCT o_orderkey) AS works, count(l_orderkey) AS nodes, count(DISTINCT l_partkey) AS refs FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def agg10(spark, d):
    nodes = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("reference"))
    return R.build_totals(_t(spark, d, "orders").select(F.col("o_orderkey").alias("work")), nodes)


@query("agg12_key_usage_windows", "SELECT user_id AS key, epoch_us(ts) - epoch_us(ts) % 3600000000 AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def agg12(spark, d):
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("key"), A.window_start(F.col("ts"), 3600).alias("window_start")).agg(F.count("*").alias("n"))


@query("agg13_term_counts", "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]{2,}')) AS term FROM conversations) GROUP BY 1")
def agg13(spark, d):
    return U.term_counts(_t(spark, d, "conversations"))


@query("agg14_log_week_summary", "SELECT conv_id % 5 AS project, turn % 3 AS week, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS n_other FROM conversations GROUP BY 1, 2")
def agg14(spark, d):
    return R.log_week_summary(_t(spark, d, "conversations").select((F.col("conv_id") % 5).alias("project"), (F.col("turn") % 3).alias("week"), "role"))


_TAGS = ("title", "h1", "p", "table", "math", "li", "a")


@query("agg15_structural_counts", "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[ >]'))::INT AS n_{t}" for t in _TAGS) + " FROM pages")
def agg15(spark, d):
    return R.structural_counts(_t(spark, d, "pages"), _TAGS).select("page_id", *[f"n_{t}" for t in _TAGS])


@query("agg16_log_line_counts", f"WITH {V.NODES} SELECT doc_id, count(*) FILTER (WHERE starts_with(line, 'E')) AS errors, count(*) FILTER (WHERE starts_with(line, 'T')) AS warnings FROM nodes GROUP BY 1")
def agg16(spark, d):
    return R.log_line_counts(_t(spark, d, "documents"), {"errors": "E", "warnings": "T"}).select("doc_id", "errors", "warnings")


# ---- windows ----------------------------------------------------------------------------------------------------


@query("win1_latest_per_key", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def win1(spark, d):
    return M.latest_per_key(_t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


@query("win2_latest_assessment", "SELECT user_id % 100 AS artifact, arg_max(value, ts) AS value FROM events GROUP BY 1")
def win2(spark, d):
    return R.latest_assessment(_t(spark, d, "events").select((F.col("user_id") % 100).alias("artifact"), "value", "ts"), "artifact", "value", "ts")


@query("win3_section_budget", f"WITH {V.NODES}, c AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nodes) SELECT doc_id, pos, left(line, greatest(1000 - before, 0)::INT) AS text, before + length(line) > 1000 AS truncated FROM c WHERE before < 1000")
def win3(spark, d):
    return U.char_budget(V.nodes(spark, d), 1000).select("doc_id", "pos", "text", "truncated")


@query("win4_admitted_requests", "WITH w AS (SELECT event_id, user_id % 10 AS tenant, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(ts) % 86400000000 AS ws FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY tenant, ws ORDER BY us, event_id) AS n FROM w) SELECT event_id, n <= 20 AS admitted, greatest(20 - n, 0)::BIGINT AS remaining, CASE WHEN n > 20 THEN greatest(1, least(86400, ceil((ws + 86400000000 - us) / 1000000.0)))::INT END AS retry_after FROM r")
def win4(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("tenant"), "ts")
    return U.admitted_requests(e, limit=20, seconds=86_400).select("event_id", "admitted", "remaining", "retry_after")


@query("win6_timeline", f"WITH y AS (SELECT o_orderkey, o_orderpriority AS title, year(o_orderdate) AS year FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY year) AS total FROM y) SELECT year, total, o_orderkey, title FROM r WHERE n <= 5")
def win6(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"))
    return U.timeline(rows, "year", ["o_orderkey"], 5)


_CTX = "CASE WHEN pos % 7 = 3 THEN '! err' WHEN pos % 7 = 5 THEN 'l.' || pos || ' here' WHEN pos % 7 = 1 THEN 'open (f' || pos || '.tex' ELSE line END"


@query("win7_log_context", f"WITH {V.NODES}, m AS (SELECT doc_id, pos, {_CTX} AS line FROM nodes), w AS (SELECT *, first(nullif(regexp_extract(line, 'l\\.([0-9]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS line_no, last(nullif(regexp_extract(line, '\\(([^ \\t]+\\.tex)', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS file FROM m) SELECT doc_id, pos, line_no, file FROM w WHERE starts_with(line, '!')")
def win7(spark, d):
    n = F.col("pos")
    made = F.when(n % 7 == 3, "! err").when(n % 7 == 5, F.concat(F.lit("l."), n, F.lit(" here"))).when(n % 7 == 1, F.concat(F.lit("open (f"), n, F.lit(".tex"))).otherwise(F.col("line"))
    return L.error_context(V.nodes(spark, d).withColumn("line", made), F.col("line").startswith("!"))


@query("win8_line_regions", f"WITH {V.NODES}, m AS (SELECT *, length(line) < 30 AS h, sum((length(line) < 30)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS region FROM nodes) SELECT doc_id, region::BIGINT AS region, max(line) FILTER (WHERE h) AS heading, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT h), '') AS body FROM m GROUP BY 1, 2")
def win8(spark, d):
    return L.regions(V.nodes(spark, d), F.length("line") < 30)


@query("win9_dense_reordinal", f"WITH {V.NODES} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal FROM nodes WHERE length(line) > 20")
def win9(spark, d):
    return R.dense_reordinal(V.nodes(spark, d), F.length("line") > 20).select("doc_id", "pos", "ordinal")


@query("win10_sibling_pointer", "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS tag, generate_subscripts(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1), 1) AS pos FROM pages) SELECT page_id, pos, '/' || tag || '[' || row_number() OVER (PARTITION BY page_id, tag ORDER BY pos) || ']' AS pointer FROM t")
def win10(spark, d):
    tags = _t(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"))).alias("p", "tag"))
    return R.sibling_pointer(tags).select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "pointer")


# ---- sorts, pages and top-k -------------------------------------------------------------------------------------


@query("top1_audit_page", "SELECT event_id, replace(replace(base64(encode(epoch_us(ts) || chr(31) || event_id)), '+', '-'), '/', '_') AS cursor FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 500) ORDER BY ts DESC, event_id DESC LIMIT 51")
def top1(spark, d):
    rows = _t(spark, d, "events")
    page = P.keyset_page(rows, [("ts", True), ("event_id", True)], (F.lit("2024-01-20").cast("timestamp"), 500), 50)
    return page.select("event_id", P.cursor_of(A.micros(F.col("ts")), F.col("event_id")).alias("cursor"))


@query("top2_tenant_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 21")
def top2(spark, d):
    return P.keyset_page(_t(spark, d, "customer"), [("c_custkey", False)], (40,), 20).select("c_custkey", "c_name")


@query("top4_key_papers", "SELECT d.doc_id, q AS quality FROM documents d JOIN (SELECT doc_id, max(quality) * 10 + max(toxic) AS q FROM labels GROUP BY 1) USING (doc_id) ORDER BY q DESC, doc_id LIMIT 20")
def top4(spark, d):
    q = _t(spark, d, "labels").groupBy("doc_id").agg((F.max("quality") * 10 + F.max("toxic")).alias("score"))
    return R.key_papers(_t(spark, d, "documents"), q).withColumnRenamed("score", "quality")


@query("top5_top_formulas", f"WITH {V.NODES}, s AS (SELECT doc_id, pos, (pos % 3 = 0)::INT * 10 + least(length(line) / 20.0, 5.0) + (pos % 2 = 0)::INT * 3 AS score FROM nodes) SELECT doc_id, pos, round(score, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS n FROM s) WHERE n <= 5")
def top5(spark, d):
    n = V.nodes(spark, d).select("doc_id", "pos", F.when(F.col("pos") % 3 == 0, "l").alias("label"), F.col("line").alias("latex"), F.when(F.col("pos") % 2 == 0, "align").otherwise("inline").alias("env"))
    return U.top_formulas(n, 5).select("doc_id", "pos", F.round("score", 6).alias("score"))


@query("top6_main_document", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, n_chars DESC, lower(doc_id::VARCHAR)) AS n FROM documents) WHERE n = 1")
def top6(spark, d):
    files = _t(spark, d, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("file"), F.col("n_chars").alias("size"), "lang")
    return R.main_document(files, F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)).select(F.col("work").alias("source"), F.col("file").alias("doc_id"))


@query("top7_tables_of", "SELECT o_orderkey, array_to_string(list(l_linenumber || ':' || l_quantity::INT ORDER BY l_linenumber, l_partkey, l_quantity), ',') AS cells FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def top7(spark, d):
    works = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("work"))
    text = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    found = R.tables_of(works, _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "work"), ["l_linenumber", "l_partkey", "l_quantity"], text)
    return found.select(F.col("work").alias("o_orderkey"), F.array_join("cells", ",").alias("cells"))


# ---- sets -------------------------------------------------------------------------------------------------------


@query("set1_union_matches", "SELECT p_partkey AS id FROM part WHERE p_size < 5 UNION SELECT p_partkey FROM part WHERE p_name LIKE 'red%' UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set1(spark, d):
    p, li = _t(spark, d, "part"), _t(spark, d, "lineitem")
    return M.union_matches(p.where("p_size < 5").select(F.col("p_partkey").alias("id")), p.where("p_name like 'red%'").select(F.col("p_partkey").alias("id")), li.where("l_quantity > 49").select(F.col("l_partkey").alias("id")))


@query("set2_exact_dedup", "WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept FROM documents) SELECT doc_id AS removed, kept FROM k WHERE doc_id <> kept")
def set2(spark, d):
    return S.exact_dedup(_t(spark, d, "documents"), "doc_id", F.col("text"))[1]


@query("set3_formula_dedup", f"WITH {V.NODES} SELECT doc_id, min(pos) AS pos FROM nodes GROUP BY doc_id, trim(regexp_replace(line, '\\s+', ' ', 'g'))")
def set3(spark, d):
    return S.first_by_hash(V.nodes(spark, d), ["doc_id"], F.trim(F.regexp_replace("line", r"\s+", " ")), "pos").select("doc_id", "pos")


@query("set4_record_dedup", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1")
def set4(spark, d):
    return S.record_dedup(_t(spark, d, "conversations"), ["role", "text"], ["conv_id", "turn"]).select("conv_id", "turn")


@query("set6_upsert", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 10000000, 'N' FROM orders WHERE o_orderkey % 3 = 0")
def set6(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    third = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("N"))
    new = third.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return S.upsert_ignore(S.upsert_update(o, third, "o_orderkey"), new.unionByName(o.where("o_orderkey % 5 = 0")), "o_orderkey")


@query("set7_idempotent_ops", "SELECT user_id % 20 AS actor, event_type AS op, value::INT AS key, count(*) AS n, CASE WHEN count(*) = 1 THEN 'first' WHEN count(DISTINCT props) = 1 THEN 'replay' ELSE 'conflict' END AS status FROM events GROUP BY 1, 2, 3")
def set7(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 20).alias("actor"), F.col("event_type").alias("op"), F.rint("value").cast("int").alias("key"), F.sha2("props", 256).alias("digest"))
    return S.idempotent_ops(e)


@query("set8_repeated_margins", f"WITH {V.NODES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS b FROM nodes WHERE trim(line) <> ''), e AS (SELECT DISTINCT source, doc_id, trim(line) AS bare FROM f WHERE least(a, b) <= 2 AND length(trim(line)) < 120), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM nodes GROUP BY 1), x AS (SELECT source, bare FROM e JOIN p USING (source) GROUP BY source, bare, pages HAVING count(*) >= greatest(2, pages // 20)) SELECT doc_id, pos FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source = n.source AND x.bare = trim(n.line))")
def set8(spark, d):
    return L.repeated_margins(V.nodes(spark, d), "doc_id", "source", share=20).select("doc_id", "pos")


@query("set9_interest_merge", "WITH a AS (SELECT lower(p_type) AS cat, lower(p_name) AS kw, max(p_size) AS m FROM part GROUP BY 1, 2) SELECT cat, array_to_string(list_sort(list(kw)), ',') AS keywords, max(m) AS max_results FROM a GROUP BY 1")
def set9(spark, d):
    p = _t(spark, d, "part").select(F.col("p_type").alias("category"), F.array("p_name").alias("keywords"), F.col("p_size").alias("max_results"), F.col("p_partkey").alias("at"))
    old, new = p.where("at % 2 = 0"), p.where("at % 2 = 1").withColumn("category", F.lower("category"))
    return S.interest_merge(old, new).select("cat", F.array_join(F.array_sort(F.transform("keywords", lambda k: F.lower(k))), ",").alias("keywords"), "max_results")


@query("set5_author_dedup", "WITH a AS (SELECT o_custkey % 100 AS paper, lower(c_name) AS n, min(o_orderkey) AS pos FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT paper, pos, 'author_' || left(sha256(trim(regexp_replace(n, '[^a-z0-9]+', ' ', 'g'))), 32) AS author_id FROM a")
def set5(spark, d):
    a = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_custkey") % 100).alias("paper"), F.col("o_orderkey").alias("pos"), "c_name")
    kept = S.first_by_hash(a, ["paper"], T.normalized_title(F.col("c_name")), "pos")
    return kept.select("paper", "pos", T.stable_id("author", T.normalized_title(F.col("c_name"))).alias("author_id"))


# ---- dates, numbers, arrays -------------------------------------------------------------------------------------


@query("fn1_window_start", "SELECT event_id, epoch_us(ts) - epoch_us(ts) % 604800000000 AS week, epoch_us(ts) - epoch_us(ts) % 60000000 AS minute FROM events")
def fn1(spark, d):
    return _t(spark, d, "events").select("event_id", A.window_start(F.col("ts"), 604_800).alias("week"), A.window_start(F.col("ts"), 60).alias("minute"))


@query("fn2_retry_after", "SELECT event_id, greatest(1, least(86400, ceil((3600000000 - epoch_us(ts) % 3600000000) / 1000000.0)))::INT AS retry, greatest(50 - user_id, 0) AS remaining FROM events")
def fn2(spark, d):
    us = A.micros(F.col("ts"))
    return _t(spark, d, "events").select("event_id", A.retry_after(us, A.window_start(F.col("ts"), 3600) + 3_600_000_000).alias("retry"), A.remaining(F.lit(50), F.col("user_id")).alias("remaining"))


@query("fn3_iso_week_id", "SELECT o_orderkey, isoyear(o_orderdate) || '-W' || lpad(week(o_orderdate)::VARCHAR, 2, '0') AS week FROM orders")
def fn3(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", A.iso_week_id(F.col("o_orderdate")).alias("week"))


@query("fn4_to_utc", "SELECT event_id, epoch_us(ts) + CASE user_id % 2 WHEN 0 THEN 18000000000 ELSE -19800000000 END AS us FROM events")
def fn4(spark, d):
    zone = F.when(F.col("user_id") % 2 == 0, "-05:00").otherwise("+05:30")
    return _t(spark, d, "events").select("event_id", A.micros(A.to_utc(F.col("ts"), zone)).alias("us"))


@query("fn5_cosine_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn5(spark, d):
    e = _t(spark, d, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("k"), F.col("embedding").alias("other")), F.col("vec_id") == F.col("k")).select("vec_id", F.round(A.cosine(F.col("embedding"), F.col("other")), 5).alias("value"))


@query("fn6_rrf", "SELECT event_id, round(1.0 / (60 + user_id), 6)::DOUBLE AS value FROM events")
def fn6(spark, d):
    return _t(spark, d, "events").select("event_id", A.rrf(F.col("user_id")).alias("value"))


@query("fn7_json_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + i AS ref FROM events, (SELECT unnest([0, 1]) AS i)")
def fn7(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    properties = F.to_json(F.struct(F.array(k, k + 1).alias("reference_ids")))
    return _t(spark, d, "events").select("event_id", F.explode(R.reference_ids(properties, "reference_ids array<bigint>")).alias("ref"))


@query("fn8_merge_json", "SELECT event_id, event_type || ',' || user_id AS merged FROM events")
def fn8(spark, d):
    a = F.create_map(F.lit("kind"), F.lit("old"), F.lit("user"), F.col("user_id").cast("string"))
    m = A.merge_json(a, F.create_map(F.lit("kind"), F.col("event_type")))
    return _t(spark, d, "events").select("event_id", F.concat_ws(",", m["kind"], m["user"]).alias("merged"))


@query("fn9_evidence_ids", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_size, p_partkey, p_size, 7])), ',') AS ids FROM part")
def fn9(spark, d):
    s, k = F.col("p_size").cast("long"), F.col("p_partkey").cast("long")
    return _t(spark, d, "part").select("p_partkey", F.array_join(A.evidence_ids(F.array(F.array(s, k), F.array(s, F.lit(7).cast("long")))), ",").alias("ids"))


@query("fn10_metadata_assertions", f"WITH {V.PAPERS}, a AS (SELECT doc_id, 'title' AS field, title AS value FROM papers UNION ALL SELECT doc_id, 'abstract', abstract FROM papers UNION ALL SELECT doc_id, 'venue', source FROM papers UNION ALL SELECT doc_id, 'year', (1990 + doc_id % 30)::VARCHAR FROM papers WHERE doc_id % 2 = 0), b AS (SELECT *, CASE WHEN field = 'title' AND doc_id % 3 = 0 THEN 'pdf' ELSE 'tex' END AS source_kind, CASE WHEN field = 'title' AND doc_id % 6 = 0 THEN doc_id || '.pdf' ELSE doc_id || '.tex' END AS source_path FROM a WHERE value <> '') SELECT *, CASE field WHEN 'title' THEN 0.85 WHEN 'abstract' THEN 0.8 WHEN 'venue' THEN 0.4 ELSE 0.35 END::DOUBLE AS confidence, true AS selected, 'metadata-assertion_' || left(sha256(concat_ws(chr(31), doc_id, field, value, source_kind, source_path)), 32) AS id FROM b")
def fn10(spark, d):
    k = F.col("doc_id")
    p = V.papers(spark, d).select(k, "title", "abstract", F.col("source").alias("venue"), F.when(k % 2 == 0, 1990 + k % 30).alias("year"))
    sources = F.when(k % 3 == 0, F.create_map(F.lit("title"), F.lit("pdf:first-page")))
    found = R.metadata_assertions(p, "doc_id", ["title", "abstract", "venue", "year"], sources, F.concat(k, F.lit(".tex")), F.when(k % 6 == 0, F.concat(k, F.lit(".pdf"))))
    return found.select(F.col("paper").alias("doc_id"), "field", "value", "source_kind", "source_path", "confidence", "selected", "id")


@query("fn11_confidence", "SELECT p_partkey, ([0.99, 0.92, 0.85, 0.65, 0.35, 0.4, 0.8, 0.8, 0.0])[(p_partkey % 9 + 1)::INT]::DOUBLE AS value FROM part")
def fn11(spark, d):
    names = F.array(*map(F.lit, ("normalized-title-exact", "normalized-title-substring", "title", "authors", "year", "venue", "arxiv_id", "abstract", "other")))
    return _t(spark, d, "part").select("p_partkey", A.confidence(F.get(names, (F.col("p_partkey") % 9).cast("int"))).alias("value"))
