"""Queries of reports and record keeping whose results have several parts."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quire.functions import text as T
from quire.operators import jobs as J, projection as P, registry as Q, reports as R, sets as S, usage as U
from quire.plans.materialize import fresh_path
from quire.plans.session import table
from quire.queries import query
from quire.registered import jobs as JOBS, projection as PROJ, relational as REL, views as V
from quire.sources import readers, sinks


def _t(spark, d, name):
    return table(spark, d, name)


# ---- following directions ---------------------------------------------------------------------------------------

# A direction for each language, asked for in upper case, and one that does not exist; every fifth paper has a fault.
_SYNC = f"""{V.PAPERS}, k AS (SELECT DISTINCT lang AS category, unnest(['the', 'les', lang, 'und', 'of']) AS word FROM documents), w AS (SELECT DISTINCT doc_id, unnest(string_split({REL._N.format('title')}, ' ')) AS word FROM papers),
r AS (SELECT DISTINCT category, doc_id FROM (SELECT category, doc_id, row_number() OVER (PARTITION BY category, word ORDER BY doc_id) AS n FROM w JOIN k USING (word)) WHERE n <= 40),
m AS (SELECT r.*, title, CASE WHEN doc_id % 5 = 0 THEN 'no text' END AS fault, doc_id NOT IN (SELECT doc_id FROM labels) AS new FROM r JOIN papers USING (doc_id)),
g AS (SELECT category, count(*) AS found, count(*) FILTER (WHERE new) AS downloaded, count(*) FILTER (WHERE new AND fault IS NULL) AS ingested, count(*) FILTER (WHERE new AND fault IS NOT NULL) AS failed FROM m GROUP BY 1),
d AS (SELECT lang AS category, length(lang) AS before, count(*) AS docs FROM documents GROUP BY 1)"""


def _synced(spark, d):
    docs = _t(spark, d, "documents")
    directions = docs.select(F.col("lang").alias("category")).distinct().select("category", F.concat(F.lit("the; LES ,"), "category", F.lit("; und;of;")).alias("keywords"), F.length("category").alias("search_count"), F.lit("2023-12-31").alias("last_searched"))
    asked = directions.select(F.upper("category").alias("category")).unionByName(directions.limit(1).select(F.lit("None such").alias("category")))
    feed = V.papers(spark, d).select("doc_id", "title", F.when(F.col("doc_id") % 5 == 0, "no text").alias("fault"))
    return J.sync_directions(directions, feed, _t(spark, d, "labels"), "2024-01-01", asked, 40)


@query("job14_sync_directions", f"WITH {_SYNC} SELECT d.category, (SELECT count(*) FROM k WHERE k.category = d.category) AS keywords, coalesce(found, 0) AS found, coalesce(downloaded, 0) AS downloaded, coalesce(ingested, 0) AS ingested, coalesce(failed, 0) AS failed, (before + (coalesce(ingested, 0) > 0 OR coalesce(downloaded, 0) = 0)::INT)::INT AS search_count, CASE WHEN coalesce(ingested, 0) > 0 OR coalesce(downloaded, 0) = 0 THEN '2024-01-01' ELSE '2023-12-31' END AS last_searched, 'sync 2024-01-01 ' || coalesce(downloaded, 0) || ' ' || coalesce(ingested, 0) AS history FROM d LEFT JOIN g USING (category)")
def job14_sync(spark, d):
    return _synced(spark, d)[0].withColumn("history", F.concat_ws(" ", "history.action", "history.date", F.col("history.papers_found").cast("string"), F.col("history.ingested").cast("string")))


@query("job14_sync_errors", f"WITH {_SYNC} SELECT category, doc_id, title || ': ' || fault AS error FROM m WHERE new AND fault IS NOT NULL UNION ALL SELECT 'None such', NULL, 'unknown direction'")
def job14_errors(spark, d):
    return _synced(spark, d)[1]


# ---- metadata of a feed -----------------------------------------------------------------------------------------

_FILLED = JOBS._J15.format(cond="p_size % 3 > 1").replace("p_size FROM part)", "p_size, p_partkey FROM part)", 1) + """, r AS (SELECT a.a, p_size, CASE WHEN p_size % 3 > 1 THEN b END AS b FROM a LEFT JOIN best ON a.ws = best.ws AND p_size % 3 > 1),
s AS (SELECT a, b, p_size % 3 = 0 AS have, p_size % 3 = 1 AS untitled, a % 2 = 0 AS has_year, a % 5 = 0 AS has_venue FROM r)"""


def _enriched(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size") % 3
    none = F.array().cast("array<string>")
    papers = _t(spark, d, "part").select(k.alias("a"), F.when(s != 1, F.concat_ws(" ", "p_name", "p_type")).otherwise("").alias("title"), F.when(s == 0, "2401.00001").alias("arxiv_id"), F.lit("").alias("doi"), F.when(k % 2 == 0, 1999).alias("year"), F.when(k % 5 == 0, "J").alias("venue"), F.when(k % 7 == 0, F.array(F.lit("own"))).otherwise(none).alias("authors"))
    b = F.col("b")
    feed = JOBS._feed(spark, d).select("b", "title", F.concat(F.lit("2402."), b).alias("arxiv_id"), F.when(b % 2 == 1, F.concat(F.lit("10.1/"), b)).alias("doi"), F.when(b % 3 > 0, 2000 + b % 20).cast("int").alias("year"), F.array(F.concat(F.lit("f"), b)).alias("authors"))
    return J.enrich_metadata(papers, feed)


@query("job16_enriched_fields", _FILLED + "SELECT a, CASE WHEN have THEN '2401.00001' WHEN b IS NOT NULL THEN '2402.' || b END AS arxiv_id, CASE WHEN b % 2 = 1 THEN '10.1/' || b ELSE '' END AS doi, CASE WHEN has_year THEN 1999 WHEN b % 3 > 0 THEN 2000 + b % 20 END::INT AS year, CASE WHEN has_venue THEN 'J' WHEN have OR b IS NOT NULL THEN 'arXiv' END AS venue, CASE WHEN a % 7 = 0 THEN 'own' WHEN b IS NOT NULL THEN 'f' || b ELSE '' END AS authors, array_to_string(list_filter([CASE WHEN NOT have AND b IS NOT NULL THEN 'arxiv_id' END, CASE WHEN b % 2 = 1 THEN 'doi' END, CASE WHEN NOT has_year AND b % 3 > 0 THEN 'year' END, CASE WHEN NOT has_venue AND (have OR b IS NOT NULL) THEN 'venue' END, CASE WHEN a % 7 <> 0 AND b IS NOT NULL THEN 'authors' END], lambda x: x IS NOT NULL), ',') AS filled, CASE WHEN have THEN 'already_have' WHEN untitled THEN 'no_title' WHEN b IS NOT NULL THEN 'enriched' ELSE 'no_match' END AS status FROM s".replace("SELECT a,", " SELECT a,", 1))
def job16_fields(spark, d):
    return _enriched(spark, d).select("a", "arxiv_id", "doi", "year", "venue", F.array_join("authors", ",").alias("authors"), F.array_join("filled", ",").alias("filled"), "status")


@query("job16_enrichment_totals", _FILLED + " SELECT unnest(['total', 'already_have', 'no_title', 'enriched', 'no_match', 'venue_filled', 'year_filled']) AS what, unnest([count(*), count(*) FILTER (WHERE have), count(*) FILTER (WHERE untitled), count(b), count(*) FILTER (WHERE NOT have AND NOT untitled AND b IS NULL), count(*) FILTER (WHERE have AND NOT has_venue), count(*) FILTER (WHERE b % 3 > 0)]) AS n FROM s")
def job16_totals(spark, d):
    return J.enrichment_totals(_enriched(spark, d))


# ---- surveys ----------------------------------------------------------------------------------------------------

_TAGS = "CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN ['Speech'] ELSE ['Speech', 'Vision ' || doc_id % 2] END"
_P = f"{V.PAPERS}, l AS (SELECT doc_id, max(quality) AS q, max(quality * 2 + toxic) AS total FROM labels GROUP BY 1), a AS (SELECT p.*, CASE WHEN doc_id % 4 > 0 THEN 2000 + doc_id % 5 END AS year, 'g' || q AS grade, total, {_TAGS} AS domains, CASE WHEN doc_id % 2 = 0 THEN ['Robots', 'Speech acts'] ELSE [] END AS subs FROM papers p LEFT JOIN l USING (doc_id))"


def _tagged(spark, d):
    k = F.col("doc_id")
    none = F.array().cast("array<string>")
    lab = _t(spark, d, "labels").groupBy("doc_id").agg(F.concat(F.lit("g"), F.max("quality")).alias("grade"), F.max(F.col("quality") * 2 + F.col("toxic")).alias("total"))
    domains = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(F.lit("Speech"))).otherwise(F.array(F.lit("Speech"), F.concat(F.lit("Vision "), (k % 2).cast("string"))))
    subs = F.when(k % 2 == 0, F.array(F.lit("Robots"), F.lit("Speech acts"))).otherwise(none)
    p = V.papers(spark, d).join(lab, "doc_id", "left")
    return p.withColumns({"year": F.when(k % 4 > 0, 2000 + k % 5).cast("int"), "authors": F.slice(F.split("title", " ", -1), 1, 4), "venue": F.col("source"), "domains": domains, "sub_directions": subs})


@query("job17_survey_parts", f"""WITH {_P}, {JOBS._ON.replace('FROM papers p', 'FROM a p')}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS place FROM tp) WHERE place <= 20),
dm AS (SELECT t, item, count(*) AS n FROM (SELECT t, unnest(domains) AS item FROM p WHERE place <= 10) GROUP BY 1, 2)
SELECT t AS topic, 'papers' AS part, '' AS item, 1::BIGINT AS place, count(*) AS n, NULL AS text FROM p GROUP BY 1
UNION ALL SELECT t, 'domain', item, row_number() OVER (PARTITION BY t ORDER BY n DESC, item), n, NULL FROM dm
UNION ALL SELECT t, 'year', year::VARCHAR, row_number() OVER (PARTITION BY t ORDER BY year), count(*), array_to_string(list('- ' || CASE WHEN title = '' THEN 'Untitled' ELSE left(title, 80) END ORDER BY place)[1:5], chr(10)) FROM p WHERE year > 0 GROUP BY t, year
UNION ALL SELECT t, 'paper', doc_id::VARCHAR, place, 1, '**' || CASE WHEN title = '' THEN 'Untitled' ELSE left(title, 100) END || '** (' || coalesce(year::VARCHAR, '?') || ') ' || array_to_string(string_split(title, ' ')[1:3], ', ') || coalesce(' | ' || nullif(source, ''), '') || coalesce(' | Grade: ' || grade, '') FROM p""")
def job17_parts(spark, d):
    return J.survey(_tagged(spark, d), list(JOBS._TOPICS)).withColumn("place", F.col("place").cast("long"))


@query("job18_landscape_parts", f"""WITH {_P}, t AS (SELECT unnest(['speech', 'Robot', 'vision 1', 'nothing']) AS t), tp AS (SELECT a.*, t FROM a, t WHERE len(list_filter(list_concat(domains, subs), lambda x: contains(lower(x), lower(t)))) > 0),
tags AS (SELECT 0 AS turn, unnest(domains) AS tag FROM a UNION ALL SELECT 1, unnest(subs) FROM a), mt AS (SELECT t, arg_min(tag, (turn, -c, tag)) AS tag FROM (SELECT turn, tag, count(*) AS c FROM tags GROUP BY 1, 2) x JOIN t ON contains(lower(tag), lower(t)) GROUP BY 1)
SELECT t.t AS topic, 'matched' AS part, coalesce(tag, t.t) AS item, 1::BIGINT AS place, (SELECT count(*) FROM tp WHERE tp.t = t.t) AS n, NULL AS text FROM t LEFT JOIN mt ON t.t = mt.t
UNION ALL SELECT t, 'year', year::VARCHAR, row_number() OVER (PARTITION BY t ORDER BY year), count(*), NULL FROM tp WHERE year > 0 GROUP BY t, year
UNION ALL SELECT t, 'grade', g, row_number() OVER (PARTITION BY t ORDER BY g = 'N/A', g), count(*), NULL FROM (SELECT t, coalesce(grade, 'N/A') AS g FROM tp) GROUP BY t, g
UNION ALL SELECT t, 'paper', doc_id::VARCHAR, place, 1, '**' || CASE WHEN title = '' THEN 'Untitled' ELSE left(title, 80) END || '** (' || coalesce(year::VARCHAR, '?') || ') -- Grade ' || coalesce(grade, '?') FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY coalesce(total, 0) DESC, doc_id) AS place FROM tp) WHERE place <= 20""")
def job18_parts(spark, d):
    return J.landscape(_tagged(spark, d), ["speech", "Robot", "vision 1", "nothing"]).withColumn("place", F.col("place").cast("long"))


# ---- documents and their files ----------------------------------------------------------------------------------


@query("top6_main_by_includes", r"SELECT source, doc_id, n AS includes FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, length(t) DESC, lower(doc_id::VARCHAR)) AS r FROM (SELECT source, doc_id, (doc_id % 4)::INT AS n, '\documentclass' || repeat('\input{a}', (doc_id % 2)::INT) || repeat('\include{b}', (doc_id % 4 - doc_id % 2)::INT) || text AS t FROM documents WHERE doc_id % 3 > 0)) WHERE r = 1")
def top6_includes(spark, d):
    k = F.col("doc_id")
    text = F.concat(F.when(k % 3 > 0, F.lit("\\documentclass")).otherwise(""), F.repeat(F.lit("\\input{a}"), (k % 2).cast("int")), F.repeat(F.lit("\\include{b}"), (k % 4 - k % 2).cast("int")), "text")
    files = _t(spark, d, "documents").select(F.col("source").alias("work"), k.alias("file"), text.alias("text"))
    return R.main_by_includes(files).select(F.col("work").alias("source"), F.col("file").alias("doc_id"), "includes")


@query("top7_paper_tables", f"WITH {PROJ._LINES}, h AS (SELECT doc_id, k, c AS title FROM l WHERE j = 0), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM l WHERE j = 2) SELECT t.doc_id, place, s || '/table[1]' AS pointer, 'Table ' || pos AS caption, title AS section_title, '0,0,1,1,k,true;0,1,1,2,' || pos || ',false;0,3,1,1,' || c || ',true;1,0,1,1,z,false' AS cells FROM t JOIN h ON t.doc_id = h.doc_id AND t.k = h.k WHERE place <= 3")
def top7_tables(spark, d):
    shown = F.transform("cells", lambda c: F.concat_ws(",", *[c[n].cast("string") for n in ("row", "col", "row_span", "col_span", "text", "header")]))
    found = P.paper_tables(P.project(PROJ.structured(spark, d)), 3)
    return found.select("doc_id", F.col("place").cast("long").alias("place"), "pointer", "caption", "section_title", F.array_join(shown, ";").alias("cells"))


# Artifacts in one of four serialisations; the canonical one has attributes in order and no empty tags.
_FORM = "'<a b=\"1\" c=\"' || doc_id // 2 || '\"><d></d>' || lang || '</a>'"


def _artifacts(spark, d):
    k = F.col("doc_id")
    n = F.floor(k / 2).cast("string")
    plain = F.concat(F.lit('<a b="1" c="'), n, F.lit('"><d></d>'), "lang", F.lit("</a>"))
    other = F.concat(F.lit("<a  c='"), n, F.lit("' b='1' ><d /><![CDATA["), "lang", F.lit("]]></a>"))
    return _t(spark, d, "documents").select("doc_id", F.when(k % 11 == 0, "<a><b></a>").when(k % 2 == 0, plain).otherwise(other).alias("xml"), plain.alias("form"))


@query("q2_canonical_artifacts", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'size' WHEN doc_id % 7 = 1 THEN 'sha256' WHEN doc_id % 11 = 0 THEN 'no_xml' ELSE 'canonical' END AS fault FROM documents WHERE doc_id % 7 < 2 OR doc_id % 11 = 0 OR doc_id % 5 = 0")
def q2_canonical(spark, d):
    k, files = F.col("doc_id"), _artifacts(spark, d)
    manifest = files.select("doc_id", (F.octet_length("xml") + F.when(k % 7 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(k % 7 == 1, "bad").otherwise(F.sha2("xml", 256)).alias("sha256"), F.when(k % 5 == 0, "bad").otherwise(F.sha2("form", 256)).alias("canonical_sha256"))
    return Q.verify_artifacts(files.select("doc_id", F.col("xml").cast("binary").alias("content")), manifest)


@query("set2_canonical_dedup", f"WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_FORM}) AS kept FROM documents WHERE doc_id % 11 > 0) SELECT doc_id AS removed, kept FROM k WHERE doc_id <> kept")
def set2_canonical(spark, d):
    files = _artifacts(spark, d).withColumn("canonical", T.canonical_xml(F.col("xml"))).where("canonical is not null")
    return S.exact_dedup(files, "doc_id", F.col("canonical"))[1]


@query("ret7_compare_methods", f"WITH {V.SECTIONS} SELECT doc_id, ordinal, content FROM sections WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) AND ordinal % 3 = 0")
def ret7_compare(spark, d):
    """The method sections of the ten longest documents."""
    works = [r["doc_id"] for r in _t(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id").collect()]
    roles = F.array(*map(F.lit, ("method", "limitations", "conclusion")))
    return R.compare_methods(V.sections(spark, d).withColumn("role", F.get(roles, F.col("ordinal") % 3)), works).select("doc_id", "ordinal", "content")


# ---- lists of any length ----------------------------------------------------------------------------------------


@query("snk6_report_files", f"WITH {V.PAPERS}, p AS (SELECT lang AS category, title, doc_id % 9 = 0 AS bad FROM papers) SELECT category, '# 2024-01-01: ' || category || chr(10) || chr(10) || '## Synced (' || count(*) FILTER (WHERE NOT bad) || ')' || chr(10) || coalesce(string_agg('- ' || title || chr(10), '' ORDER BY encode(title)) FILTER (WHERE NOT bad), '') || CASE WHEN bool_or(bad) THEN chr(10) || '## Errors' || chr(10) || string_agg('- ' || title || chr(10), '' ORDER BY encode(title)) FILTER (WHERE bad) ELSE '' END AS report FROM p GROUP BY 1")
def snk6_files(spark, d):
    path = fresh_path(spark, "report")
    sinks.write_sync_report(V.papers(spark, d).select(F.col("lang").alias("category"), "title", F.when(F.col("doc_id") % 9 == 0, "lost").otherwise("ok").alias("status")), "2024-01-01", path)
    return spark.read.text(path, wholetext=True).select("category", F.col("value").alias("report"))


@query("agg8_edge_references", "SELECT l_partkey AS src, l_suppkey AS dst, (row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey) - 1)::INT AS place, l_orderkey AS reference_id, l_discount AS confidence FROM (SELECT l_partkey, l_suppkey, l_orderkey, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL)")
def agg8_references(spark, d):
    return U.edge_references(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("reference_id")))


# ---- steps of an ingest, and writers read back ------------------------------------------------------------------

_NO_HINTS = JOBS._CLASS[: JOBS._CLASS.index("UNION ALL SELECT doc_id, CASE source")] + JOBS._CLASS[JOBS._CLASS.index(") GROUP BY 1, 2, 3)") :]


@query("job12_ingest_steps", f"WITH {V.PAPERS}, {_NO_HINTS}, e AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b20[12][0-9]\\b'))::INT AS y, generate_subscripts(regexp_extract_all(text, '\\b20[12][0-9]\\b'), 1) AS i FROM documents), c AS (SELECT doc_id, y, count(*) AS n, min(i) AS f FROM e WHERE y >= 2017 GROUP BY 1, 2), y AS (SELECT doc_id, arg_max(y, n * 1000000 - f)::INT AS year FROM c GROUP BY 1), r AS (SELECT p.doc_id, year, title, (SELECT string_agg(dom, '|' ORDER BY r) FROM dt WHERE dt.doc_id = p.doc_id) AS domains, coalesce((SELECT string_agg(kw, '|' ORDER BY r) FROM mt WHERE mt.doc_id = p.doc_id AND r <= 10), '') AS methods FROM papers p LEFT JOIN y USING (doc_id)) SELECT doc_id, year, coalesce(domains, '') AS domains, methods, CASE WHEN year IS NULL THEN 'missing' ELSE 'ok' END AS year_status, CASE WHEN domains IS NULL THEN 'untagged' ELSE 'ok' END AS tag_status, CASE WHEN title = '' THEN 'no_title' ELSE 'ok' END AS status FROM r")
def job12_steps(spark, d):
    found = J.ingest(V.papers(spark, d), JOBS.TAXONOMY)
    return found.select("doc_id", "year", F.array_join("domains", "|").alias("domains"), F.array_join("methods", "|").alias("methods"), "year_status", "tag_status", "status")


@query("src7_read_transcripts", "SELECT role, left(trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]*>', ' ', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g'), ' +', ' ', 'g')), CASE role WHEN 'user' THEN 500 ELSE 2000 END) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(regexp_replace(regexp_replace(text, '<[^<>]*>', ' ', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g')) <> ''")
def src7_transcripts(spark, d):
    """Every second turn is a list of typed parts."""
    path = fresh_path(spark, "transcripts")
    part = F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
    lines = _t(spark, d, "conversations").select(F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("role", F.col("text").alias("content")))).otherwise(F.to_json(F.struct("role", part.alias("content")))).alias("value"))
    lines.write.text(path)
    return readers.read_transcripts(spark, path)


@query("snk7_append_week_log", "SELECT conv_id::VARCHAR AS session, turn::BIGINT AS seq, 'p' || conv_id % 3 AS project FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)")
def snk7_append(spark, d):
    """The first two turns are logged first, then all turns: the log holds each once."""
    path = fresh_path(spark, "weeks")
    turns = _t(spark, d, "conversations").select(F.concat(F.lit("p"), F.col("conv_id") % 3).alias("project"), F.lit("2024-W01").alias("week"), F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("long").alias("seq"))
    none = turns.limit(0)
    first = turns.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy("seq"))).where("n <= 2").drop("n")
    sinks.append_week_log(first, none, path)
    logged = spark.read.schema("session string, seq long, project string, week string").json(path)
    sinks.append_week_log(turns, logged, path)
    return spark.read.schema("session string, seq long, project string, week string").json(path).select("session", "seq", "project")


@query("snk2_write_manifest", "WITH g AS (SELECT page_id, list_filter([CASE WHEN trim(regexp_extract(html, '(?is)<title>([^<]*)', 1)) = '' THEN 'no_title' END, CASE WHEN len(regexp_extract_all(html, '(?i)<(?:h[1-6])[ >]')) = 0 THEN 'no_sections' END, CASE WHEN len(regexp_extract_all(html, '(?i)<(?:p)[ >]')) < 10 THEN 'too_few_paragraphs' END], lambda x: x IS NOT NULL) AS r FROM pages) SELECT 'failed' AS file, page_id::VARCHAR AS page_id, array_to_string(r, ';') AS reasons FROM g WHERE len(r) > 0 UNION ALL SELECT 'manifest', page_id::VARCHAR, NULL FROM g WHERE len(r) = 0")
def snk2_write(spark, d):
    path = fresh_path(spark, "manifests")
    graded = J.grade_structure(_t(spark, d, "pages")).select("page_id", "tier", "reasons")
    sinks.write_manifest(graded, f"{path}/m")
    sinks.write_failed(graded, f"{path}/f")
    failed = spark.read.csv(f"{path}/f", header=True).select(F.lit("failed").alias("file"), "page_id", "reasons")
    return failed.unionByName(spark.read.csv(f"{path}/m", header=True).select(F.lit("manifest").alias("file"), "page_id", F.lit(None).cast("string").alias("reasons")))
