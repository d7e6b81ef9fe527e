"""Queries of sources, sinks and streams: written or drained to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators import jobs as J
from quire.plans.materialize import fresh_path
from quire.plans.session import table
from quire.queries import query
from quire.registered import views as V
from quire.sources import readers, sinks
from quire.streaming import accounting as S
from quire.streaming import quota as Q


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.readStream.schema(S.EVENT).parquet(f"{d}/[e]vents.parquet")  # a pattern may name a file or a folder
    kind = F.when(F.col("event_type").isin("purchase", "view"), "forwarded").when(F.col("event_type") == "error", "failed").otherwise("rejected")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("user_id") % 10).alias("tenant"), "event_type", kind.alias("outcome"), F.get_json_object("props", "$.k").cast("long").alias("bytes"), "value")


def _drain(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    S.drained(stream, path, fresh_path(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(path)


@query("st1_stream_usage", f"WITH {V.AUDIT}, w AS (SELECT epoch_us(ts) - epoch_us(ts) % 86400000000 AS window_start, * FROM audit) SELECT window_start, tenant, count(*) AS n, count(*) FILTER (WHERE outcome = 'forwarded') AS forwarded, sum(bytes)::BIGINT AS bytes FROM w WHERE window_start + 86400000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM audit) GROUP BY 1, 2")
def st1(spark, d):
    return _drain(S.stream_usage(_events(spark, d), 86_400), "usage")


@query("st2_stream_admission", "WITH w AS (SELECT event_id, user_id % 10 AS tenant, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(ts) % 86400000000 AS ws FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY tenant, ws ORDER BY us, event_id) AS n FROM w) SELECT event_id, n <= 20 AS admitted, greatest(20 - n, 0)::INT AS remaining, CASE WHEN n > 20 THEN greatest(1, least(86400, ceil((ws + 86400000000 - us) / 1000000.0)))::INT END AS retry_after FROM r")
def st2(spark, d):
    return _drain(S.stream_admission(_events(spark, d), 20, 86_400), "admission").select("event_id", "admitted", "remaining", "retry_after")


_LEASES = """WITH RECURSIVE e AS (SELECT event_id, user_id || '-' || event_id // 500 AS lease, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'refresh' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' ELSE 'reserve' END AS action, row_number() OVER (PARTITION BY user_id, event_id // 500 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT lease, 0::BIGINT AS n, 'none' AS state, 0::BIGINT AS expiry, NULL::BIGINT AS event_id, '' AS result FROM (SELECT DISTINCT lease FROM e) UNION ALL
SELECT lease, n, CASE WHEN action = 'reserve' AND was = 'none' THEN 'active' WHEN action = 'complete' AND was = 'active' THEN 'completed' WHEN action = 'fail' AND was = 'active' THEN 'failed' ELSE was END,
CASE WHEN (action = 'reserve' AND was = 'none') OR (action = 'refresh' AND was = 'active') THEN us + 86400000000 WHEN action IN ('complete', 'fail') AND was = 'active' THEN us ELSE expiry END, event_id,
CASE WHEN action = 'reserve' AND was = 'none' THEN 'active' WHEN action = 'refresh' AND was = 'active' THEN 'extended' WHEN action = 'complete' AND was = 'active' THEN 'completed' WHEN action = 'fail' AND was = 'active' THEN 'failed' ELSE 'ignored_' || was END
FROM (SELECT e.*, r.expiry, CASE WHEN r.state = 'active' AND e.us >= r.expiry THEN 'expired' ELSE r.state END AS was FROM r JOIN e ON e.lease = r.lease AND e.n = r.n + 1)),
last AS (SELECT lease, arg_max(state, n) AS state, arg_max(expiry, n) AS expiry FROM r GROUP BY 1)
SELECT event_id, lease, result FROM r WHERE n > 0 UNION ALL SELECT NULL, lease, 'expired' FROM last WHERE state = 'active' AND expiry < (SELECT epoch_us(max(ts)) - 600000000 FROM events)"""


@query("st3_stream_leases", _LEASES)
def st3(spark, d):
    e = _events(spark, d)
    action = F.when(F.col("event_type") == "signup", "refresh").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("reserve")
    return _drain(S.stream_leases(e.select("event_id", "ts", F.concat_ws("-", F.col("user_id"), F.floor(F.col("event_id") / 500)).alias("lease"), action.alias("action")), 86_400), "leases")


# Windows of a day, leases of six hours; every tenth tenant is not limited. Per tenant one event after another, with the list of active leases.
_QUOTA = """WITH RECURSIVE e AS (SELECT event_id, user_id % 10 AS tenant, user_id || '-' || event_id // 500 AS lease, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(ts) % 86400000000 AS ws, CASE event_type WHEN 'signup' THEN 'refresh' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' ELSE 'reserve' END AS action, CASE WHEN user_id % 10 < 9 THEN 4 + user_id % 10 END AS lim, 1 + user_id % 3 AS conc, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT tenant, 0::BIGINT AS n, 0::BIGINT AS cur, 0::BIGINT AS used, []::STRUCT(l VARCHAR, w BIGINT, x BIGINT)[] AS ls, []::STRUCT(l VARCHAR, w BIGINT, x BIGINT)[] AS gone, NULL::BIGINT AS event_id, NULL::VARCHAR AS lease, NULL::VARCHAR AS result, NULL::BIGINT AS lim, 0::BIGINT AS us, 0::BIGINT AS ws FROM (SELECT DISTINCT tenant FROM e) UNION ALL
SELECT tenant, n, greatest(cur, ws), used + (result = 'admitted')::BIGINT,
CASE WHEN result = 'admitted' THEN list_append(live, {'l': lease, 'w': ws, 'x': us + 21600000000}) WHEN result = 'extended' THEN list_transform(live, lambda y: CASE WHEN y.l = lease THEN {'l': y.l, 'w': y.w, 'x': us + 21600000000} ELSE y END) WHEN result IN ('completed', 'failed') THEN list_filter(live, lambda y: y.l <> lease) ELSE live END,
gone, event_id, lease, result, lim, us, ws
FROM (SELECT *, CASE WHEN action = 'reserve' THEN CASE WHEN lim IS NULL THEN 'unlimited' WHEN has THEN 'ignored' WHEN used >= lim THEN 'request_limit_exceeded' WHEN len(list_filter(live, lambda y: y.w = ws)) >= conc THEN 'concurrency_limit_exceeded' ELSE 'admitted' END WHEN NOT has THEN 'ignored' WHEN action = 'refresh' THEN 'extended' WHEN action = 'complete' THEN 'completed' ELSE 'failed' END AS result
FROM (SELECT *, len(list_filter(live, lambda y: y.l = lease)) > 0 AS has FROM (SELECT e.tenant, e.n, r.cur, CASE WHEN e.ws > r.cur THEN 0 ELSE r.used END AS used, list_filter(r.ls, lambda y: y.x > e.us) AS live, list_filter(r.ls, lambda y: y.x <= e.us) AS gone, e.event_id, e.lease, e.action, e.us, e.ws, e.lim, e.conc FROM r JOIN e ON e.tenant = r.tenant AND e.n = r.n + 1)))),
final AS (SELECT tenant, arg_max(ls, n) AS ls FROM r GROUP BY 1)
SELECT event_id, tenant, lease, result, CASE WHEN result IN ('admitted', 'request_limit_exceeded', 'concurrency_limit_exceeded') THEN greatest(0, lim - used)::INT END AS remaining, len(list_filter(ls, lambda y: y.w = ws))::INT AS active, CASE result WHEN 'request_limit_exceeded' THEN greatest(1, least(86400, ceil((ws + 86400000000 - us) / 1000000.0)))::INT WHEN 'concurrency_limit_exceeded' THEN 1 END AS retry_after FROM r WHERE n > 0
UNION ALL SELECT NULL, tenant, g.l, 'expired', NULL, NULL, NULL FROM (SELECT tenant, unnest(gone) AS g FROM r)
UNION ALL SELECT NULL, tenant, g.l, 'expired', NULL, NULL, NULL FROM (SELECT tenant, unnest(ls) AS g FROM final) WHERE g.x <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)"""


@query("st2_stream_quota", _QUOTA)
def st2_quota(spark, d):
    e, t = _events(spark, d), F.col("tenant")
    action = F.when(F.col("event_type") == "signup", "refresh").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("reserve")
    limits = F.when(t < 9, 4 + t).cast("int"), (1 + F.col("user_id") % 3).cast("int")
    asked = e.select("event_id", "ts", "tenant", F.concat_ws("-", F.col("user_id"), F.floor(F.col("event_id") / 500)).alias("lease"), action.alias("action"), limits[0].alias("request_limit"), limits[1].alias("concurrency_limit"))
    return _drain(Q.stream_quota(asked, 86_400, 21_600), "quota")


_CIRCUIT = """WITH RECURSIVE e AS (SELECT event_id, user_id % 10 AS backend, epoch_us(ts) AS us, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT backend, 0::BIGINT AS n, 0 AS failures, 0::BIGINT AS until, NULL::BIGINT AS event_id, '' AS state FROM (SELECT DISTINCT backend FROM e) UNION ALL
SELECT backend, n, CASE WHEN st = 'open' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN st = 'open' THEN until WHEN ok THEN 0 WHEN failures + 1 >= 2 THEN us + 3600000000 ELSE until END, event_id, st
FROM (SELECT e.*, r.failures, r.until, CASE WHEN r.failures < 2 THEN 'closed' WHEN e.us < r.until THEN 'open' ELSE 'half_open' END AS st FROM r JOIN e ON e.backend = r.backend AND e.n = r.n + 1))
SELECT event_id, backend, state, state <> 'open' AS allowed FROM r WHERE n > 0"""


@query("st4_stream_circuit", _CIRCUIT)
def st4(spark, d):
    e = _events(spark, d)
    return _drain(S.stream_circuit(e.select("event_id", "ts", F.col("tenant").alias("backend"), (F.col("event_type") != "error").alias("ok")), 2, 3600), "circuit")


@query("st5_stream_dedup", "SELECT user_id, event_type, value::INT AS key FROM events GROUP BY 1, 2, 3")
def st5(spark, d):
    e = _events(spark, d).withColumn("key", F.rint("value").cast("int"))
    return _drain(S.stream_dedup(e.select("ts", "user_id", "event_type", "key"), ["user_id", "event_type", "key"], "400 days"), "dedup").select("user_id", "event_type", "key")


@query("st6_stream_ingest", "SELECT doc_id, sha256(text) AS sha FROM documents")
def st6(spark, d):
    path = fresh_path(spark, "ingested")
    docs = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/[d]ocuments.parquet")
    S.stream_ingest(docs, lambda x: x.select("doc_id", "row_key", F.sha2("text", 256).alias("sha")), path, fresh_path(spark, "ingest-state")).awaitTermination()
    return spark.read.schema("doc_id long, sha string").parquet(path).select("doc_id", "sha")


@query("src1_read_manifest", "SELECT p_partkey::VARCHAR AS paper_id, p_name AS title, p_size::BIGINT AS size_bytes, sha256(p_name) AS sha256, 'clean' AS quality_tier FROM part")
def src1(spark, d):
    path = fresh_path(spark, "manifest")
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_size").alias("size_bytes"), F.sha2("p_name", 256).alias("sha256"), F.lit("clean").alias("quality_tier"))
    p.write.csv(path, header=True)
    return readers.read_manifest(spark, path)


@query("src3_read_week_logs", "SELECT 'p' || (conv_id % 3) AS project, role, trim(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g')) AS text FROM conversations WHERE text IS NOT NULL")
def src3(spark, d):
    path = fresh_path(spark, "logs")
    c = table(spark, d, "conversations").select(F.concat(F.lit("p"), F.col("conv_id") % 3).alias("p"), "role", F.trim(F.regexp_replace("text", "[\\x00-\\x1f\\x7f]", " ")).alias("text"))
    for k in range(3):
        c.where(F.col("p") == f"p{k}").drop("p").write.json(f"{path}/p{k}/week-1.jsonl")
    return readers.read_week_logs(spark, path).select("project", "role", "text")


@query("src7_clean_turns", "SELECT conv_id, turn, t AS text FROM (SELECT *, left(trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]*>', ' ', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g'), ' +', ' ', 'g')), CASE role WHEN 'user' THEN 500 ELSE 2000 END) AS t FROM conversations WHERE role IN ('user', 'assistant')) WHERE t <> ''")
def src7(spark, d):
    return readers.clean_turns(table(spark, d, "conversations")).select("conv_id", "turn", "text")


@query("snk1_write_projection", "SELECT o_orderkey, 'b' || (o_orderkey % 2) AS build_id FROM orders WHERE o_orderkey % 2 = 1 OR o_orderstatus = 'F'")
def snk1(spark, d):
    path = fresh_path(spark, "projection")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_projection(o.where("o_orderkey % 2 = 0"), path, "b0")
    sinks.write_projection(o.where("o_orderkey % 2 = 1"), path, "b1")
    sinks.write_projection(o.where("o_orderkey % 2 = 0 and o_orderstatus = 'F'"), path, "b0")
    return spark.read.schema("o_orderkey long, o_orderstatus string, build_id string").parquet(path).select("o_orderkey", "build_id")


@query("snk2_failed_rows", "WITH g AS (SELECT page_id, list_filter([CASE WHEN trim(regexp_extract(html, '(?is)<title>([^<]*)', 1)) = '' THEN 'no_title' END, CASE WHEN len(regexp_extract_all(html, '(?i)<(?:h[1-6])[ >]')) = 0 THEN 'no_sections' END, CASE WHEN len(regexp_extract_all(html, '(?i)<(?:p)[ >]')) < 10 THEN 'too_few_paragraphs' END], lambda x: x IS NOT NULL) AS r FROM pages) SELECT page_id, array_to_string(r, ';') AS reasons FROM g WHERE len(r) > 0")
def snk2(spark, d):
    return sinks.failed_rows(J.grade_structure(table(spark, d, "pages")).select("page_id", "tier", "reasons"))


@query("snk4_write_scores", "SELECT d.doc_id, q AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)")
def snk4(spark, d):
    path = fresh_path(spark, "scored")
    scores = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sinks.write_scores(table(spark, d, "documents").select("doc_id", "source", F.lit(-1).alias("quality")), scores, "doc_id", path, "b1")
    return spark.read.parquet(path).select("doc_id", "quality")


@query("snk6_sync_report", f"WITH {V.PAPERS} SELECT lang AS category, '# 2024-01-01: ' || lang || chr(10) || chr(10) || '## Synced (' || count(*) || ')' || chr(10) || string_agg('- ' || title, chr(10) ORDER BY encode('- ' || title)) AS report FROM papers GROUP BY 1")
def snk6(spark, d):
    return sinks.sync_report(V.papers(spark, d).select(F.col("lang").alias("category"), "title", F.lit("ok").alias("status")), "2024-01-01")


@query("snk7_new_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 2")
def snk7(spark, d):
    c = table(spark, d, "conversations").select(F.lit("p").alias("project"), F.lit("w").alias("week"), F.col("conv_id").alias("session"), F.col("turn").alias("seq"))
    logged = c.where("seq < 2").select("project", "week", "session")
    return sinks.new_turns(c, logged).select(F.col("session").alias("conv_id"), F.col("seq").alias("turn"))


@query("job1_text_rows", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:h1|h2|h3|h4|title|p|li|blockquote|pre|td|th)[ >]')) FROM pages) GROUP BY 1")
def job1_rows(spark, d):
    """The parser's text rows, counted: each block tag gives one."""
    return J.project_pages(table(spark, d, "pages")).where(F.col("kind").isin("section", "node", "cell")).groupBy("page_id").agg(F.count("*").alias("n"))


# ---- sources that read one document a file: suppliers become small files ----------------------------------------


def _files(df: DataFrame, name: str, kind: str = "text") -> str:
    """One file a row, written by all tasks, each of which puts its files in place itself; a folder is read by its name, as a pattern would list every file for itself."""
    path = fresh_path(df.sparkSession, name)
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").format(kind).save(path)
    return path


@query("src2_read_parsed_docs", "SELECT 's' || s_suppkey AS paper_id, s_name AS title, (1990 + s_suppkey % 30)::INT AS year, 'A' || s_nationkey AS author FROM supplier")
def src2(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("paper_id"), F.col("s_name").alias("title"), (1990 + F.col("s_suppkey") % 30).alias("year"), F.array(F.concat(F.lit("A"), "s_nationkey"), F.lit("B")).alias("authors"))
    return readers.read_parsed_docs(spark, _files(s, "parsed", "json")).select("paper_id", "title", "year", F.get("authors", F.lit(0)).alias("author"))


@query("src4_read_documents_xml", "SELECT sha256('<document><title>' || s_name || '</title></document>' || chr(10)) AS sha256, s_name AS title FROM supplier")
def src4(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("<document><title>"), "s_name", F.lit("</title></document>")).alias("value"))
    return readers.read_documents_xml(spark, _files(s, "xml")).select("sha256", F.xpath_string("content", F.lit("document/title")).alias("title"))


@query("src5_read_arxiv_atom", "SELECT s_name AS title, 'N' || s_nationkey || '|Co Author' AS authors, (2000 + s_suppkey % 20)::INT AS year, '24' || lpad((s_suppkey % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad(s_suppkey::VARCHAR, 5, '0') AS arxiv_id, 'about ' || s_suppkey AS abstract, 'http://x/' || s_suppkey AS pdf_url FROM supplier")
def src5(spark, d):
    k = F.col("s_suppkey")
    arxiv = F.concat(F.lit("24"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad(k.cast("string"), 5, "0"))
    entry = F.concat(F.lit("<entry><title>"), "s_name", F.lit("</title><author><name>N"), "s_nationkey", F.lit("</name></author><author><name>Co  Author</name></author><published>"), 2000 + k % 20, F.lit("-03-01T00:00:00Z</published><id>http://a/abs/"), arxiv, F.lit("v3</id><summary> about "), k, F.lit('</summary><link title="pdf" href="http://x/'), k, F.lit('"/></entry>'))
    # a feed holds a page of entries, as arXiv answers
    page = table(spark, d, "supplier").groupBy(F.floor(k / 100)).agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))
    feed = readers.read_arxiv_atom(spark, _files(page.select("value"), "feed"))
    return feed.select("title", F.array_join("authors", "|").alias("authors"), "year", "arxiv_id", "abstract", "pdf_url")


@query("src6_read_innovation_facts", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'innovation' ELSE 'cites' END AS kind, CASE WHEN p_partkey % 3 < 2 THEN 'x' || p_partkey END AS id, CASE WHEN p_partkey % 3 < 2 THEN 2000 + p_size % 20 END::INT AS year, CASE WHEN p_partkey % 3 = 1 THEN p_size % 5 + 1 END::INT AS a, CASE WHEN p_partkey % 3 = 2 THEN 't' || p_size END AS target FROM part")
def src6(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    line = F.when(k % 3 == 0, F.concat(F.lit("paper x"), k, F.lit(" "), 2000 + s % 20)).when(k % 3 == 1, F.concat(F.lit("  innovation x"), k, F.lit(" line core "), 2000 + s % 20, F.lit(" "), s % 5 + 1, F.lit(" 2 3"))).otherwise(F.concat(F.lit("cites s"), k, F.lit(" t"), s))
    path = fresh_path(spark, "facts")
    table(spark, d, "part").select(F.explode(F.array(line, F.lit("-- no fact"))).alias("value")).write.text(path)
    return readers.read_innovation_facts(spark, path).select("kind", "id", "year", "a", "target")
