"""Queries of the text functions, over titles, lines, part names and markup made from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions import text as T
from quire.plans.session import table
from quire.queries import query
from quire.registered import views as V


def _sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _sql_cite(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 \\t\\n\\r]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


def _titles(name: str, make, sql: str) -> None:
    """A query of doc_id and value over the titles."""

    @query(name, f"WITH {V.PAPERS} SELECT doc_id, {sql} AS value FROM papers")
    def _(spark, d):
        return V.papers(spark, d).select("doc_id", make(F.col("title")).alias("value"))


def _lines(name: str, make, sql: str) -> None:
    @query(name, f"WITH {V.NODES} SELECT doc_id, pos, {sql} AS value FROM nodes")
    def _(spark, d):
        return V.nodes(spark, d).select("doc_id", "pos", make(F.col("line")).alias("value"))


#: Markup made from a part: the same text in both languages.
MARKUP = ["\\cite{", ("p_name", "_"), ", key", "p_partkey", "} as in \\ref{sec:", "p_size", "} by \\textbf{", "p_name", "} \\citep[p. 2]{b", "p_size", ",a", "p_size", "}\n% year: 20", ("p_size2",), "\n\\large rest"]


def _made(parts: list) -> Column:
    cols = []
    for p in parts:
        if isinstance(p, tuple):
            cols.append(F.lpad((F.col("p_size") % 25).cast("string"), 2, "0") if p[0] == "p_size2" else F.replace(p[0], F.lit(" "), F.lit(p[1])))
        else:
            cols.append(F.col(p).cast("string") if p.startswith("p_") else F.lit(p))
    return F.concat(*cols)


def _made_sql(parts: list) -> str:
    sql = []
    for p in parts:
        if isinstance(p, tuple):
            sql.append("lpad((p_size % 25)::VARCHAR, 2, '0')" if p[0] == "p_size2" else f"replace({p[0]}, ' ', '{p[1]}')")
        else:
            sql.append(f"{p}::VARCHAR" if p.startswith("p_") else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(sql)


def _parts(name: str, made: list, make, sql: str) -> None:
    """A query of p_partkey and value over a text x made from each part."""

    @query(name, f"SELECT p_partkey, {sql} AS value FROM (SELECT *, {_made_sql(made)} AS x FROM part)")
    def _(spark, d):
        return table(spark, d, "part").withColumn("x", _made(made)).select("p_partkey", make(F.col("x")).alias("value"))


_titles("str1_normalized_title", T.normalized_title, _sql_norm("title"))
_titles("str3_normalized_cite", T.normalized_cite, _sql_cite("title"))
_titles("str4_squash_title", T.squash_title, "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')")
_PLAIN = "list_filter(string_split_regex(regexp_replace({x}, '[^a-zA-Z0-9 \\t\\n\\r]', '', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> '')"
_titles("str5_title_identifier", T.title_identifier, f"CASE WHEN len({_PLAIN.format(x='title')}) = 0 THEN 'Untitled' ELSE array_to_string(list_transform({_PLAIN.format(x='title')}, lambda w: upper(w[1]) || lower(w[2:])), '_') END")
_titles("str5_module_name", T.module_name, f"array_to_string(list_transform({_PLAIN.format(x='title')}, lambda w: lower(w))[1:6], '_')")
_lines("str6_safe_id", T.safe_id, "regexp_replace(line, '[^A-Za-z0-9._-]+', '_', 'g')")
_lines("str6_is_safe_id", T.is_safe_id, "regexp_full_match(line, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}')")
_ROLE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(n, '{s}')" for s in signs) + f" THEN '{role}'" for role, signs in T.ROLES) + " END"


@query("str7_semantic_role", f"SELECT p_partkey, {_ROLE} AS role FROM (SELECT p_partkey, {_sql_norm('x')} AS n FROM (SELECT p_partkey, p_name || ' ' || CASE p_size % 6 WHEN 0 THEN 'Our METHOD' WHEN 1 THEN 'Prior-Work' WHEN 2 THEN 'Results, and Analysis' WHEN 3 THEN 'Future   work' WHEN 4 THEN 'Bibliography' ELSE p_type END AS x FROM part))")
def str7(spark, d):
    end = F.when(F.col("p_size") % 6 == 0, "Our METHOD").when(F.col("p_size") % 6 == 1, "Prior-Work").when(F.col("p_size") % 6 == 2, "Results, and Analysis").when(F.col("p_size") % 6 == 3, "Future   work").when(F.col("p_size") % 6 == 4, "Bibliography").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", T.semantic_role(F.concat_ws(" ", "p_name", end)).alias("role"))


_lines("str8_token_estimate", T.token_estimate, "greatest(1, length(line) // 4)::INT")
_titles("str9_first_sentence", T.first_sentence, "coalesce(list_filter(list_transform(string_split(regexp_replace(trim(title), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 30)[1], left(title, 200))")
_CONTRIB_TEXT = ["We propose a ", "p_name", " of kind ", "p_type", ". Our contribution is ", "p_brand", " with care and more. This paper presents ", "p_name", " number ", "p_size", ". we SHOW it"]
_CONTRIB = [p.replace("(?i)", "(?is)") for p in T.CONTRIBUTIONS]
_parts(
    "str10_contributions",
    _CONTRIB_TEXT,
    lambda x: F.array_join(T.contributions(x), "|"),
    "array_to_string(list_transform(list_filter(list_concat(list_concat(" + f"regexp_extract_all(x, '{_CONTRIB[0]}'), regexp_extract_all(x, '{_CONTRIB[1]}')), regexp_extract_all(x, '{_CONTRIB[2]}')" + "), lambda s: length(trim(s)) > 20), lambda s: left(trim(s), 200))[1:5], '|')",
)


@query("str11_method_overview", f"WITH {V.SECTIONS}, m AS (SELECT doc_id, arg_min(content, ordinal) AS c FROM sections WHERE regexp_matches(lower(heading), '{T.METHOD_SIGNS}|tion|ment') AND length(content) > 50 GROUP BY 1) SELECT doc_id, CASE WHEN length(c) > 500 THEN left(c, 500) || '...' ELSE c END AS value FROM m")
def str11(spark, d):
    """Headings here are invented, so two frequent syllables stand for method words."""

    def cut(lines):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 5).cast("int")), lambda k: F.struct(F.regexp_replace(F.get(lines, k * 5), "(?i)tion|ment", "method").alias("heading"), F.array_join(F.slice(lines, k * 5 + 1, F.lit(5)), "\n").alias("content")))

    part = T.once(F.split("text", "\n", -1), cut)
    return table(spark, d, "documents").select("doc_id", T.method_overview(part).alias("value")).where("value is not null")


@query("str12_title_similarity", "SELECT a.p_partkey, round(CASE WHEN greatest(length(a.s), length(b.s)) = 0 THEN 0.0 ELSE 100.0 * (1.0 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s))) END, 6) AS value FROM (SELECT p_partkey, array_to_string(list_sort(string_split(" + _sql_cite("p_name") + ", ' ')), ' ') AS s FROM part) a JOIN (SELECT p_partkey - 1 AS k, array_to_string(list_sort(string_split(" + _sql_cite("p_name") + ", ' ')), ' ') AS s FROM part) b ON a.p_partkey = b.k")
def str12(spark, d):
    p = table(spark, d, "part")
    return p.join(p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("other")), F.col("p_partkey") == F.col("k")).select("p_partkey", F.round(T.title_similarity(F.col("p_name"), F.col("other")), 6).alias("value"))


_WS = "list_distinct(list_filter(string_split(" + _sql_cite("{x}") + ", ' '), lambda w: w <> ''))"


@query("str13_word_scores", f"WITH {V.PAPERS}, w AS (SELECT doc_id, {_WS.format(x='title')} AS a, {_WS.format(x='abstract')} AS b FROM papers) SELECT doc_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / greatest(len(a), len(b)) END, 6) AS overlap FROM w")
def str13(spark, d):
    a, b = F.col("title"), F.col("abstract")
    return V.papers(spark, d).select("doc_id", F.round(T.word_jaccard(a, b), 6).alias("jaccard"), F.round(T.word_overlap_max(a, b), 6).alias("overlap"))


@query("str14_extract_year", "SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 2000 + p_size % 20 WHEN 1 THEN 2010 + p_size % 10 WHEN 2 THEN 2015 WHEN 3 THEN 2020 + p_size % 5 WHEN 4 THEN 1999 WHEN 5 THEN 2016 WHEN 6 THEN 2019 WHEN 7 THEN 2023 WHEN 8 THEN 2018 ELSE 2012 END AS year, CASE p_size % 10 WHEN 0 THEN 'tex:acm_year' WHEN 1 THEN 'tex:conference_style' WHEN 2 THEN 'tex:document_style' WHEN 3 THEN 'tex:year_comment' WHEN 4 THEN 'tex:date' WHEN 5 THEN 'tex:conference_text' WHEN 6 THEN 'tex:year_macro' WHEN 7 THEN 'tex:arxiv_submission' ELSE 'tex:document_style' END AS place FROM part")
def str14(spark, d):
    n = F.col("p_size")
    forms = (
        F.concat(F.lit("\\acmYear{"), (2000 + n % 20).cast("string"), F.lit("} % year: 1990")),
        F.concat(F.lit("\\usepackage[x]{icml"), (2010 + n % 10).cast("string"), F.lit("}")),
        F.lit("\\documentclass[a4]{paper2015x}"),
        F.concat(F.lit("text % Year = "), (2020 + n % 5).cast("string")),
        F.lit("\\date{May 1999}"),
        F.lit("In NeurIPS 2016 and ICML 2017"),
        F.lit("\\newcommand{\\confyear}{2019}"),
        F.lit("see arXiv:2304.01234v2"),
        F.lit("\\usepackage{geometry}\\usepackage[b5]{conf2009v2018-2020}"),
        F.lit("\\documentclass[draft2012]{x1998}"),
    )
    x = forms[9]
    for k in range(9):
        x = F.when(n % 10 == k, forms[k]).otherwise(x)
    return table(spark, d, "part").select("p_partkey", T.year_of(x).alias("y")).select("p_partkey", "y.year", "y.place")


_YEARS = ["seen in 20", ("p_size2",), " and 2018, then 2021; 2018 again but 2015 and 20", ("p_size2",)]


@query("str15_infer_year", "WITH x AS (SELECT p_partkey, [2000 + p_size % 25, 2018, 2021, 2018, 2015, 2000 + p_size % 25] AS ys FROM part), e AS (SELECT p_partkey, unnest(ys) AS y, generate_subscripts(ys, 1) AS i FROM x), c AS (SELECT p_partkey, y, count(*) AS n, min(i) AS f FROM e WHERE y >= 2017 GROUP BY 1, 2) SELECT p_partkey, arg_max(y, n * 1000 - f)::INT AS value FROM c GROUP BY 1")
def str15(spark, d):
    return table(spark, d, "part").select("p_partkey", T.infer_year(_made(_YEARS)).alias("value"))


@query("str16_detect_venue", "SELECT p_partkey, (['NeurIPS', 'ICML', 'CVPR', NULL])[(p_partkey % 4 + 1)::INT] AS value FROM part")
def str16(spark, d):
    names = F.array(*map(F.lit, ("Advances in NeurIPS 32", "an ICML workshop, not in Nature", "Proc. CVPR", "a journal of its own")))
    x = F.concat(F.lit("x"), "p_size", F.lit(" "), F.get(names, (F.col("p_partkey") % 4).cast("int")))
    return table(spark, d, "part").select("p_partkey", T.detect_venue(x).alias("value"))


_titles("str16_detect_venue_titles", T.detect_venue, "CASE " + " ".join(f"WHEN regexp_matches(lower(left(title, 5000)), '{p}') THEN '{v}'" for p, v in T.VENUES) + " END")
_parts("str17_arxiv_id", ["see arXiv:24", ("p_size2",), ".", "p_partkey", "00000v3"], T.arxiv_id, "nullif(regexp_extract(x, '(?i)arxiv(?:\\.org/abs/)?[:/]?\\s*([0-9]{4}\\.[0-9]{4,5})(?:v[0-9]+)?', 1), '')")
_parts("str17_normalized_arxiv", ["arXiv:24", ("p_size2",), ".1234v", "p_size"], T.normalized_arxiv, "'24' || lpad((p_size % 25)::VARCHAR, 2, '0') || '.1234'")
_parts("str17_normalized_doi", [" HTTPS://doi.org/10.1/", "p_brand", "p_partkey"], T.normalized_doi, "lower('10.1/' || p_brand || p_partkey)")
_parts("str18_cite_keys", MARKUP, lambda x: F.array_join(T.cite_keys(x), "|"), "array_to_string(list_sort(list_distinct([replace(p_name, ' ', '_'), 'key' || p_partkey, 'b' || p_size, 'a' || p_size])), '|')")
_parts("str19_replace_markup", MARKUP, T.replace_citations, "'[cite:' || replace(p_name, ' ', '_') || '; key' || p_partkey || '] as in [ref:sec:' || p_size || '] by \\textbf{' || p_name || '} [cite:b' || p_size || '; a' || p_size || ']' || chr(10) || '% year: 20' || lpad((p_size % 25)::VARCHAR, 2, '0') || chr(10) || '\\large rest'")
_parts("str20_clean_markup", MARKUP, T.clean_markup, "'\\cite{' || replace(p_name, ' ', '_') || ', key' || p_partkey || '} as in \\ref{sec:' || p_size || '} by ' || p_name || ' \\citep[p. 2]{b' || p_size || ',a' || p_size || '}' || chr(10) || chr(10) || 'rest'")
_parts("str21_dehyphenate", ["The ﬁrst of", "p_size", "-\nlines  and soﬀt ", "p_name", "\n\n\n\nend"], T.dehyphenate, "'The first of' || p_size || 'lines and sofft ' || p_name || chr(10) || chr(10) || 'end'")
_parts("str22_bibtex_authors", ["{Smith}, ", "p_name", " and van Dyk, Jr, ", "p_brand", " and  Plain   Name and "], lambda x: F.array_join(T.bibtex_authors(x), "|"), "p_name || ' Smith|' || p_brand || ' van Dyk Jr|Plain Name'")
_METRIC_TEXT = ["accuracy: ", "p_size", ".5% and F1 of 0.", "p_size", "; accuracy = 12. | BLEU | ", "p_size", " | loss: 0.", "p_size", " loss = 2.5"]
_parts("str23_paper_metrics", _METRIC_TEXT, lambda x: F.array_join(F.transform(T.paper_metrics(x), lambda m: F.concat_ws("=", m["name"], F.round(m["value"] * 1_000_000).cast("long").cast("string"))), "|"), "'accuracy=' || round(greatest(CASE WHEN p_size + 0.5 > 1 THEN (p_size + 0.5) / 100 ELSE p_size + 0.5 END, 0.12) * 1000000)::BIGINT || '|f1_score=' || round(('0.' || p_size)::DOUBLE * 1000000)::BIGINT || '|bleu=' || round(CASE WHEN p_size > 1 THEN p_size / 100.0 ELSE p_size END * 1000000)::BIGINT || '|loss=' || round(('0.' || p_size)::DOUBLE * 1000000)::BIGINT")
_parts("str24_run_metrics", ["epoch 1 loss: 3.5 val_loss=2.", "p_size", "\nepoch 2 loss: 1.", "p_size", " accuracy=", "p_size", ".25"], lambda x: F.array_join(F.transform(T.run_metrics(x), lambda m: F.concat_ws("=", m["name"], F.round(m["value"] * 1_000_000).cast("long").cast("string"))), "|"), "'accuracy=' || round(CASE WHEN p_size + 0.25 > 1 THEN (p_size + 0.25) / 100 ELSE p_size + 0.25 END * 1000000)::BIGINT || '|loss=' || round(('1.' || p_size)::DOUBLE * 1000000)::BIGINT || '|val_loss=' || round(('2.' || p_size)::DOUBLE * 1000000)::BIGINT")
_HYPER = ["Learning rate of 0.0", "p_size", ", batch size = ", "p_size", " for ", "p_partkey", " epochs using Adam optimizer; weight decay: 1e-", "p_size"]


@query("str25_hyperparameters", "SELECT p_partkey, ('0.0' || p_size)::DOUBLE AS learning_rate, p_size::INT AS batch_size, p_partkey::INT AS epochs, 'Adam' AS optimizer, ('1e-' || p_size)::DOUBLE AS weight_decay, NULL::INT AS warmup_steps FROM part")
def str25(spark, d):
    return table(spark, d, "part").select("p_partkey", T.hyperparameters(_made(_HYPER)).alias("h")).select("p_partkey", "h.*")


_lines("str28_log_clean", lambda x: T.log_clean(F.concat(F.lit("<b>\t"), x, F.lit("</b>\r\n x"))), "trim(regexp_replace(line || '  x', ' +', ' ', 'g'))")
_titles("str28_project_name", T.project_name, "regexp_replace(lower(title), '[^a-z0-9_-]+', '-', 'g')")
_MIXED = ["<p>We use <Math mode=\"inline\" tex=\"x^", "p_size", "\"><XMath>x</XMath></Math>\n as in <cite class=\"c\"><bibref bibrefs=\"b1,b", "p_partkey", "\" show=\"n\"/></cite> &amp;  <em>", "p_name", "</em></p>"]
_parts("str29_mixed_text", _MIXED, T.mixed_text, "'We use $x^' || p_size || '$ as in [b1,b' || p_partkey || '] & ' || p_name")
_lines("str30_quote", lambda x: T.quote(x, 40), "left(line, 40)")


@query("str31_digests", f"WITH {V.PAPERS} SELECT doc_id, sha256(text) AS sha, md5(title) AS md, 'paper_' || left(sha256(doc_id::VARCHAR || chr(31) || title), 32) AS sid, sha256('{{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}}') AS canonical FROM papers")
def str31(spark, d):
    return V.papers(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("title").alias("md"), T.stable_id("paper", F.col("doc_id"), F.col("title")).alias("sid"), T.canonical_digest(F.struct("doc_id", "lang")).alias("canonical"))


_AUTHORS = ["Ann Lee, ", "p_name", " University and Bo Chu; MIT, 12 Main Street way ", "p_size", "0, Carl ", "p_brand"]


@query("str32_is_affiliation", "SELECT p_partkey, p_partkey % 10 NOT IN (0, 7, 8) AS value FROM part")
def str32(spark, d):
    """Short signs count as words of their own only, and one that ends in a point only before a letter or digit."""
    n = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("Maxime Oquab "), n), F.concat(F.lit("Meta "), n), F.concat(F.lit("Digital Economy Group "), n), F.concat(F.lit("1"), n, F.lit(" Elm Street")), F.lit("Mountain Top, CA"), F.lit("UAB"), F.concat(F.lit("["), n, F.lit("] Someone")), F.lit("Jane Doe"), F.lit("Acme inc. of"), F.lit("Villa Tech"))
    return table(spark, d, "part").select("p_partkey", T.is_affiliation(F.get(forms, (F.col("p_partkey") % 10).cast("int"))).alias("value"))


_parts("str33_split_authors", _AUTHORS, lambda x: F.array_join(T.split_authors(x), "|"), "'Ann Lee|Bo Chu|Carl ' || p_brand")
_parts("str34_heading_level", ["p_size", ".2 Proposed Method"], T.heading_level, "2")
_lines("str34_heading_level_lines", T.heading_level, "CASE WHEN trim(regexp_replace(line, '\\s+', ' ', 'g')) = '' OR length(trim(regexp_replace(line, '\\s+', ' ', 'g'))) > 110 THEN NULL WHEN regexp_replace(upper(trim(regexp_replace(line, '\\s+', ' ', 'g'))), ':+$', '') IN (" + ", ".join(f"'{h}'" for h in T.KNOWN_HEADINGS) + ") THEN 1 END::INT")
_parts("str35_clean_title", ["A \\textbf{", "p_name", "}\\thanks{x ", "p_size", "} study\\\\of ~ $", "p_brand", "$"], T.clean_title, "'A ' || p_name || ' study of ' || p_brand")
_parts("str35_clean_abstract", ["Abstract: we  \\emph{see} ", "p_name", " \\cite{a,b", "p_size", "}\n% gone\n\\begin{x}end"], T.clean_abstract, "'we see ' || p_name || ' [cite:a; b' || p_size || '] end'")


@query("str36_document_year", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1950 + p_size ELSE 2000 + p_size % 25 END::INT AS value FROM part")
def str36(spark, d):
    n = F.col("p_size")
    dates = F.when(n % 2 == 0, F.array(F.concat(F.lit("June "), (1950 + n).cast("string")))).otherwise(F.array(F.lit("no date")))
    return table(spark, d, "part").select("p_partkey", T.document_year(F.array(F.concat(F.lit("Proc. 20"), F.lpad((n % 25).cast("string"), 2, "0"))), dates).alias("value"))


@query("str26_log_classify", f"WITH {V.NODES} SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN 'fatal' WHEN 1 THEN 'overfull' WHEN 2 THEN 'undefined_citation' WHEN 3 THEN 'info' END AS kind, CASE pos % 5 WHEN 1 THEN pos || '.5' WHEN 2 THEN 'k' || pos END AS detail FROM nodes WHERE pos % 5 < 4")
def str26(spark, d):
    from quire.operators.lines import classify_log

    n = F.col("pos")
    made = F.when(n % 5 == 0, F.concat(F.lit("! "), "line")).when(n % 5 == 1, F.concat(F.lit("Overfull \\hbox ("), n, F.lit(".5pt too wide) at line 3"))).when(n % 5 == 2, F.concat(F.lit("LaTeX Warning: Citation `k"), n, F.lit("' undefined"))).when(n % 5 == 3, F.lit("LaTeX Warning: label changed")).otherwise(F.lit("plain"))
    return classify_log(V.nodes(spark, d).withColumn("line", made)).select("doc_id", "pos", "kind", "detail")


@query("str27_tag_balance", f"WITH {V.NODES} SELECT doc_id, 'e' || (pos % 3) AS env, (count(*) FILTER (WHERE pos % 2 = 0)) AS n_begin, (count(*) FILTER (WHERE pos % 4 = 0)) AS n_end FROM nodes WHERE pos % 2 = 0 OR pos % 4 = 0 GROUP BY 1, 2 HAVING n_begin <> n_end")
def str27(spark, d):
    from quire.operators.lines import tag_balance

    n = F.col("pos")
    env = F.concat(F.lit("e"), n % 3)
    made = F.concat(F.when(n % 2 == 0, F.concat(F.lit("\\begin{"), env, F.lit("} "))).otherwise(""), F.when(n % 4 == 0, F.concat(F.lit("x \\end{"), env, F.lit("}"))).otherwise(""))
    return tag_balance(V.nodes(spark, d).withColumn("line", made))


@query("str2_normalized_name", "SELECT c_custkey, trim(regexp_replace(lower(nfc_normalize(c_name)), '[^a-z0-9_]+', ' ', 'g')) AS value FROM customer")
def str2(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.normalized_name(F.col("c_name")).alias("value"))
