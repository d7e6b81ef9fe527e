"""Queries of retrieval and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import graph as G
from quire.operators import matching as M
from quire.operators import retrieval as R
from quire.operators import usage as U
from quire.plans.materialize import fresh_path
from quire.plans.session import table
from quire.queries import query
from quire.registered import relational, views as V

_N = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"

# Each benchmark item asks in one of three forms for its first words.
_ASK = f"w AS (SELECT item_id AS query_id, string_split({_N.format('text')}, ' ') AS w FROM benchmark), g AS (SELECT query_id, 1 AS g, w[1] AS term FROM w UNION ALL SELECT query_id, CASE WHEN query_id % 3 = 1 THEN 1 ELSE 2 END, w[2] FROM w UNION ALL SELECT query_id, 3, w[3] FROM w WHERE query_id % 3 = 0), needs AS (SELECT query_id, count(DISTINCT g) AS needs FROM g GROUP BY 1), never AS (SELECT query_id, w[3] AS term FROM w WHERE query_id % 3 = 1), phrase AS (SELECT query_id, w[1] || ' ' || w[2] AS p FROM w WHERE query_id % 3 = 2)"


def _questions(spark, d):
    w = F.split(T.normalized_title(F.col("text")), " ")
    k = F.col("item_id") % 3
    a, b, c = (F.get(w, F.lit(i)) for i in range(3))
    x, y, z = map(R.literal, (a, b, c))
    q = F.when(k == 0, F.concat_ws(" ", x, y, z)).when(k == 1, F.concat(x, F.lit(" or "), y, F.lit(" -"), c)).otherwise(F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"')))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), q.alias("q"))


def _lexical_sql(passages: str, k: int) -> str:
    return f"""p AS ({passages}), tok AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(string_split(norm, ' ')) AS term FROM p) GROUP BY 1, 2), idf AS (SELECT term, ln(1.0 + (SELECT count(*) FROM p) / count(*)) AS idf FROM tok GROUP BY 1),
    h AS (SELECT g.query_id, tok.id, count(DISTINCT g.g) AS has, round(sum(tf * idf), 6) AS score FROM g JOIN idf USING (term) JOIN tok USING (term) GROUP BY 1, 2),
    f AS (SELECT h.* FROM h JOIN needs USING (query_id) LEFT JOIN phrase USING (query_id) JOIN p ON p.id = h.id WHERE has = needs AND (phrase.p IS NULL OR contains(' ' || norm || ' ', ' ' || phrase.p || ' ')) AND NOT EXISTS (SELECT 1 FROM never n JOIN tok t ON n.term = t.term WHERE n.query_id = h.query_id AND t.id = h.id)),
    lex AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= {k})"""


_DOCS = f"SELECT doc_id AS id, {_N.format('text')} AS norm FROM documents"


@query("ret1_lexical_papers", f"WITH {V.PAPERS}, {_ASK}, {_lexical_sql('SELECT doc_id AS id, ' + _N.format('title || chr(32) || abstract') + ' AS norm FROM papers', 10)} SELECT query_id, id, round(score, 4) AS score, rank FROM lex")
def ret1(spark, d):
    p = V.papers(spark, d).select(F.col("doc_id").alias("id"), F.concat_ws(" ", "title", "abstract").alias("text"))
    return R.lexical_search(_questions(spark, d), p, 10).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query("ret2_lexical_passages", f"WITH {V.NODES}, {_ASK}, {_lexical_sql('SELECT doc_id * 100000 + pos AS id, ' + _N.format('line') + ' AS norm FROM nodes', 10)} SELECT query_id, id, round(score, 4) AS score, rank FROM lex")
def ret2(spark, d):
    p = V.nodes(spark, d).select((F.col("doc_id") * 100_000 + F.col("pos")).alias("id"), F.col("line").alias("text"))
    return R.lexical_search(_questions(spark, d), p, 10).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


# A cover ends where the earliest of the last hits of all groups moves on.
def _cover_sql(passages: str, k: int) -> str:
    return f"""p AS ({passages}), tok AS (SELECT id, unnest(string_split(norm, ' ')) AS term, generate_subscripts(string_split(norm, ' '), 1) AS pos FROM p), h AS (SELECT DISTINCT g.query_id, id, g.g, pos FROM g JOIN tok USING (term)),
    ok AS (SELECT h.query_id, h.id FROM h JOIN needs USING (query_id) LEFT JOIN phrase USING (query_id) JOIN p ON p.id = h.id WHERE phrase.p IS NULL OR contains(' ' || norm || ' ', ' ' || phrase.p || ' ') GROUP BY h.query_id, h.id, needs HAVING count(DISTINCT g) = needs),
    o AS (SELECT query_id, id FROM ok WHERE NOT EXISTS (SELECT 1 FROM never n JOIN tok t ON n.term = t.term WHERE n.query_id = ok.query_id AND t.id = ok.id)),
    l AS (SELECT h.query_id, h.id, h.pos, gg.g, max(CASE WHEN h.g = gg.g THEN h.pos END) OVER (PARTITION BY h.query_id, h.id, gg.g ORDER BY h.pos) AS last FROM h JOIN o ON h.query_id = o.query_id AND h.id = o.id JOIN (SELECT DISTINCT query_id, g FROM g) gg ON gg.query_id = h.query_id),
    c AS (SELECT query_id, id, pos, CASE WHEN count(*) = count(last) THEN min(last) END AS low FROM l GROUP BY 1, 2, 3),
    s AS (SELECT c.query_id, id, round(sum(CASE WHEN low > coalesce(was, -1) THEN 1.0::DOUBLE / (1 + greatest(0, pos - low + 1 - needs)) ELSE 0 END), 6) AS score FROM (SELECT *, lag(low) OVER (PARTITION BY query_id, id ORDER BY pos) AS was FROM c) c JOIN needs USING (query_id) GROUP BY 1, 2),
    lex AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k})"""


@query("ret1_cover_papers", f"WITH {_ASK}, {_cover_sql(_DOCS, 10)} SELECT query_id, id, round(score, 4) AS score, rank FROM lex")
def ret1_cover(spark, d):
    """Whole documents, so that covers are many and long."""
    p = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.cover_search(_questions(spark, d), p, 10).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query("ret2_cover_passages", f"WITH {V.NODES}, {_ASK}, {_cover_sql('SELECT doc_id * 100000 + pos AS id, ' + _N.format('line') + ' AS norm FROM nodes', 10)} SELECT query_id, id, round(score, 4) AS score, rank FROM lex")
def ret2_cover(spark, d):
    """Passages are indexed once as a build; the search reads the build alone."""
    p = V.nodes(spark, d).select((F.col("doc_id") * 100_000 + F.col("pos")).alias("id"), F.col("line").alias("text"))
    index = R.index_passages(p, fresh_path(spark, "index"))
    return R.cover_search(_questions(spark, d), p, 10, index).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e, e.where("id % 100 = 0").withColumnRenamed("id", "query_id")


def _vec_sql(k: int, own: str = "") -> str:
    return f"vec AS (SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 {own})) WHERE rank <= {k})"


@query("top3_vector_topk", f"WITH {_vec_sql(10)} SELECT query_id, id, round(distance, 5) AS distance, rank FROM vec")
def top3(spark, d):
    e, q = _vectors(spark, d)
    return R.vector_search(q, e, 10).select("query_id", "id", F.round("distance", 5).alias("distance"), "rank")


@query("ret3_vector_passages", f"WITH {_vec_sql(10, 'AND e.label = 3')} SELECT query_id, id, round(distance, 5) AS distance, rank FROM vec")
def ret3(spark, d):
    _, q = _vectors(spark, d)
    scoped = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.vector_search(q, scoped, 10).select("query_id", "id", F.round("distance", 5).alias("distance"), "rank")


#: A vector's question is the first three words of its document.
_OWN = f"w AS (SELECT doc_id AS query_id, string_split({_N.format('text')}, ' ') AS w FROM documents WHERE doc_id % 100 = 0), g AS (SELECT DISTINCT query_id, i AS g, w[i] AS term FROM w, (SELECT unnest([1, 2, 3]) AS i) WHERE w[i] IS NOT NULL), needs AS (SELECT query_id, count(DISTINCT g) AS needs FROM g GROUP BY 1), never AS (SELECT 0 AS query_id, '' AS term WHERE false), phrase AS (SELECT 0 AS query_id, '' AS p WHERE false)"
_FUSE = "rr AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM lex UNION ALL SELECT query_id, id, rank FROM vec) GROUP BY 1, 2), top AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rr) WHERE rank <= 10)"


def _asked(spark, d):
    w = F.split(T.normalized_title(F.col("text")), " ")
    docs = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.transform(F.slice(w, 1, 3), R.literal), " ").alias("q"))
    _, v = _vectors(spark, d)
    return docs.join(v, "query_id", "left")


def hybrid(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.hybrid_search(_asked(spark, d), p, _vectors(spark, d)[0], 10)


_HYBRID = f"WITH {_OWN}, {_lexical_sql(_DOCS, 30)}, {_vec_sql(30, 'AND q.vec_id IN (SELECT doc_id FROM documents)')}, {_FUSE}"


@query("ret4_hybrid_passages", f"{_HYBRID} SELECT query_id, id, score::DOUBLE AS score, rank, query_id NOT IN (SELECT query_id FROM vec) AS degraded FROM top")
def ret4(spark, d):
    return hybrid(spark, d)


@query("ret5_recommend", f"{_HYBRID}, m AS (SELECT query_id, id % 50 AS work, id, rank FROM top WHERE id <> query_id), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, work ORDER BY rank) AS n FROM m) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, work) AS place FROM b WHERE n = 1 QUALIFY place <= 5")
def ret5(spark, d):
    found = hybrid(spark, d).where("id <> query_id").withColumn("work", F.col("id") % 50)
    return R.first_per_work(found, 5).select("query_id", "id", "place")


@query("win5_first_per_work", f"WITH {_vec_sql(30)}, m AS (SELECT query_id, id % 10 AS work, id, rank FROM vec), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, work ORDER BY rank) AS n FROM m) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, work) AS place FROM b WHERE n = 1 QUALIFY place <= 5")
def win5(spark, d):
    e, q = _vectors(spark, d)
    return R.first_per_work(R.vector_search(q, e, 30).withColumn("work", F.col("id") % 10), 5).select("query_id", "id", "place")


@query("ret6_claim_candidates", f"{_HYBRID} SELECT query_id, id, 'unverified' AS verdict FROM top")
def ret6(spark, d):
    return R.claims(hybrid(spark, d)).select("query_id", "id", "verdict")


@query("ret7_method_sections", f"WITH {V.NODES} SELECT doc_id, (pos // 5)::INT AS ordinal, left(string_agg(line, chr(10) || chr(10) ORDER BY pos), 20000) AS text FROM nodes WHERE (pos // 5) % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1, 2")
def ret7(spark, d):
    n = V.nodes(spark, d).withColumn("ordinal", F.floor(F.col("pos") / 5).cast("int")).where("ordinal % 2 = 0")
    works = table(spark, d, "labels").where("quality = 0").select("doc_id").distinct()
    return U.section_text(n.join(works, "doc_id", "left_semi"), F.lit(True))


@query("ret8_evidence_pointers", f"WITH {V.NODES} SELECT doc_id AS paper, pos AS node, '/' || pos AS pointer, left(line, 500) AS quote FROM nodes WHERE length(line) > 40")
def ret8(spark, d):
    rows = V.nodes(spark, d).where(F.length("line") > 40)
    return R.evidence(rows, "doc_id", "pos", "source", "line", "node", F.lit(1.0)).select("evidence.paper", "evidence.node", "evidence.pointer", "evidence.quote")


@query("ret9_parsed_document", "SELECT o_orderkey, count(l_linenumber) AS n_items, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def ret9(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    p = R.parsed_documents(o, {"items": (items, ["l_linenumber", "l_partkey"])}, "o_orderkey")
    return p.select("o_orderkey", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.array_join(F.transform("items", lambda i: i["l_partkey"].cast("string")), ",").alias("parts")).withColumn("n_items", F.greatest("n_items", F.lit(0)))


@query("ret10_graph_query", f"WITH {V.PAPERS}, {_ASK}, {_lexical_sql('SELECT doc_id AS id, ' + _N.format('title') + ' AS norm FROM papers', 5)} SELECT query_id, id, rank FROM lex")
def ret10(spark, d):
    p = V.papers(spark, d).select(F.col("doc_id").alias("id"), F.col("title").alias("text"))
    return R.lexical_search(_questions(spark, d), p, 5).select("query_id", "id", "rank")


# ---- graph: parts and suppliers by line items; customers, nations and regions -----------------------------------


def _authorship(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("work"), F.col("l_suppkey").alias("author"))
    return li.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_name").alias("name")), "author")


def _nodes(spark, d):
    return G.build_nodes(table(spark, d, "part").select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title")), _authorship(spark, d))


_NODES = "gn AS (SELECT 'paper:' || p_partkey AS node, 'paper' AS kind, p_name AS label FROM part UNION ALL SELECT 'author:' || s_suppkey, 'author', s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem))"
_EDGES = "ge AS (SELECT DISTINCT 'author:' || l_suppkey AS src, 'paper:' || l_partkey AS dst FROM lineitem)"


@query("gr1_build_nodes", f"WITH {_NODES} SELECT * FROM gn")
def gr1(spark, d):
    return _nodes(spark, d)


@query("gr2_authorship_edges", f"WITH {_EDGES} SELECT * FROM ge")
def gr2(spark, d):
    return G.build_authorship_edges(_authorship(spark, d), _nodes(spark, d)).select("src", "dst")


@query("gr3_citation_edges", f"WITH {relational._J8} SELECT citing, work, max(confidence)::DOUBLE AS confidence, string_agg(ref_id::VARCHAR, ',' ORDER BY ref_id) AS reference_ids FROM res WHERE citing <> work GROUP BY 1, 2")
def gr3(spark, d):
    r = M.resolve_refs_title(*relational._refs(spark, d))
    e = U.citation_edges(r.select(F.col("citing").alias("src"), F.col("work").alias("dst"), "confidence", F.col("ref_id").alias("reference_id"), F.array("ref_id").alias("evidence")))
    return e.select(F.col("src").alias("citing"), F.col("dst").alias("work"), "confidence", F.array_join("reference_ids", ",").alias("reference_ids"))


def _typed(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.concat(F.lit("author:"), "l_suppkey").alias("src"), F.concat(F.lit("paper:"), "l_partkey").alias("dst")).agg(F.max("l_discount").alias("confidence"))
    return e.select(F.concat_ws("~", "src", "dst").alias("edge"), "src", "dst", F.lit("WROTE").alias("type"), "confidence")


_TYPED = "te AS (SELECT 'author:' || l_suppkey || '~paper:' || l_partkey AS edge, 'author:' || l_suppkey AS src, 'paper:' || l_partkey AS dst, 'WROTE' AS type, max(l_discount) AS confidence FROM lineitem GROUP BY l_suppkey, l_partkey)"


@query("j5_graph_neighbors", f"WITH {_NODES}, {_TYPED}, s AS (SELECT node AS seed FROM gn), m AS (SELECT seed, te.* FROM s JOIN te ON seed = src UNION ALL SELECT seed, te.* FROM s JOIN te ON seed = dst), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, type, edge) AS n FROM m) SELECT seed, edge, a.label AS src_label, b.label AS dst_label FROM r JOIN gn a ON a.node = src JOIN gn b ON b.node = dst WHERE n <= 5")
def j5(spark, d):
    n = _nodes(spark, d)
    return G.neighbors(n.select(F.col("node").alias("seed")), _typed(spark, d), n, limit=5).select("seed", "edge", "src_label", "dst_label")


@query("gr4_cite_network", f"WITH {_NODES}, {_TYPED}, r AS (SELECT src AS seed, te.*, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, type, edge) AS n FROM te) SELECT seed, edge FROM r WHERE n <= 3")
def gr4(spark, d):
    n = _nodes(spark, d)
    return G.neighbors(n.where("kind = 'author'").select(F.col("node").alias("seed")), _typed(spark, d), n, direction="out", types=["WROTE"], limit=3).select("seed", "edge")


@query("agg2_graph_stats", f"WITH {_NODES}, {_TYPED} SELECT 'node' AS what, kind, count(*) AS n FROM gn GROUP BY kind UNION ALL SELECT 'node', '*', count(*) FROM gn UNION ALL SELECT 'edge', type, count(*) FROM te GROUP BY type UNION ALL SELECT 'edge', '*', count(*) FROM te")
def agg2(spark, d):
    return G.stats(_nodes(spark, d), _typed(spark, d))


@query("gr5_lineage", "WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT 'c' || a.k AS src, 'c' || b.k AS dst, CASE WHEN a.n = b.n THEN 2 ELSE 4 END::INT AS hops, CASE WHEN a.n = b.n THEN 'cn' || a.k || '>,cn' || b.k || '<' ELSE 'cn' || a.k || '>,nr' || a.n || '>,nr' || b.n || '<,cn' || b.k || '<' END AS path FROM c a JOIN c b ON b.k = a.k + 1 WHERE a.r = b.r")
def gr5(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    edges = c.select(F.concat(F.lit("cn"), "c_custkey").alias("edge"), F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst")).unionByName(n.select(F.concat(F.lit("nr"), "n_nationkey").alias("edge"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")))
    last = c.agg(F.max("c_custkey").alias("last"))
    pairs = c.join(last, F.col("c_custkey") < F.col("last")).select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("c"), F.col("c_custkey") + 1).alias("dst"))
    return G.lineage(pairs, edges).select("src", "dst", "hops", F.array_join("path", ",").alias("path"))


@query("gr6_citations_by_key", "WITH h AS (SELECT doc_id AS paper, work, min(pos) AS pos FROM (SELECT doc_id, unnest([doc_id, doc_id * 2, doc_id + 1]) AS work, unnest([0, 1, 2]) AS pos FROM documents) WHERE work IN (SELECT doc_id FROM documents) AND work <> doc_id GROUP BY 1, 2) SELECT paper, work FROM h ORDER BY paper, pos, work LIMIT 200")
def gr6(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select(k.cast("string").alias("id"), k.alias("work"), F.concat(F.lit("t"), k).alias("squashed")).distinct()
    refs = table(spark, d, "documents").select(k.alias("paper"), F.array(k.cast("string"), F.concat(F.lit("t"), k * 2), (k + 1).cast("string")).alias("keys"))
    return G.citations_by_key(refs, docs)


@query("gr7_degrees", "WITH n AS (SELECT 'd' || doc_id AS node FROM documents), e AS (SELECT DISTINCT 'd' || doc_id AS src, 'd' || dst AS dst FROM (SELECT doc_id, unnest([doc_id * 2, doc_id // 3, doc_id + 7]) AS dst FROM documents WHERE doc_id % 5 <> 0) WHERE dst IN (SELECT doc_id FROM documents)), o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY 1) SELECT node, coalesce(o.n, 0)::BIGINT AS n_out, coalesce(i.n, 0)::BIGINT AS n_in, round(CASE WHEN o.n IS NULL OR i.n IS NULL THEN 0.0 ELSE i.n * o.n / (i.n + o.n) END, 6)::DOUBLE AS bridge, (o.n IS NULL AND i.n IS NULL) AS isolated FROM n LEFT JOIN o USING (node) LEFT JOIN i USING (node)")
def gr7(spark, d):
    """Documents that cite others by a rule on their ids; every fifth cites none."""
    k, docs = F.col("doc_id"), table(spark, d, "documents").select("doc_id").distinct()
    name = lambda x: F.concat(F.lit("d"), x)
    cited = docs.where("doc_id % 5 <> 0").select(k.alias("by"), F.explode(F.array(k * 2, F.floor(k / 3), k + 7)).alias("doc_id")).distinct()
    edges = cited.join(docs, "doc_id", "left_semi").select(name(F.col("by")).alias("src"), name(k).alias("dst"))
    return G.degrees(edges, docs.select(name(k).alias("node")))


@query("gr8_cocitation", "WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT x.dst AS a, y.dst AS b, count(*) AS n FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2 HAVING n >= 2")
def gr8(spark, d):
    return G.cocitation(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


# Five rounds one after another; every node has links out, as each link goes both ways.
_RANK = "WITH l AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), e AS (SELECT src, dst FROM l UNION ALL SELECT dst, src FROM l), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), r0 AS (SELECT src AS node, 1.0::DOUBLE / (SELECT count(*) FROM o) AS rank FROM o), " + ", ".join(f"r{k} AS (SELECT dst AS node, 0.15 / (SELECT count(*) FROM o) + 0.85 * sum(rank / n) AS rank FROM e JOIN r{k - 1} ON src = node JOIN o USING (src) GROUP BY 1)" for k in range(1, 6))


@query("gr8_pagerank", f"{_RANK} SELECT node, round(rank, 9) AS rank FROM r5")
def gr8_rank(spark, d):
    """Nodes are numbers, even ones parts and odd ones suppliers, until they are named at the end."""
    li = table(spark, d, "lineitem")
    e = li.select(F.shiftleft("l_partkey", 1).alias("src"), F.shiftleft("l_suppkey", 1).bitwiseOR(F.lit(1)).alias("dst"))
    found = G.pagerank(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), rounds=5)
    name = F.concat(F.when(F.col("node") % 2 == 0, "p").otherwise("s"), F.shiftright("node", 1))
    return found.select(name.alias("node"), F.round("rank", 9).alias("rank"))


@query("gr8_coupling", "WITH e AS (SELECT DISTINCT l_orderkey % 2000 AS src, l_partkey AS dst FROM lineitem) SELECT x.src AS a, y.src AS b, count(*) AS n FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2 HAVING n >= 4")
def gr8_coupling(spark, d):
    return G.coupling(table(spark, d, "lineitem").select((F.col("l_orderkey") % 2000).alias("src"), F.col("l_partkey").alias("dst")), 4)


@query("gr8_concept_pairs", "WITH w AS (SELECT DISTINCT l_orderkey AS work, l_suppkey AS concept FROM lineitem) SELECT x.concept AS a, y.concept AS b, count(*) AS n FROM w x JOIN w y ON x.work = y.work AND x.concept < y.concept GROUP BY 1, 2 HAVING n >= 2")
def gr8_concepts(spark, d):
    return G.concept_pairs(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("concept")))
