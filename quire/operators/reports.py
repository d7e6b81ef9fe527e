"""Listings and reports over papers, sections, references, events and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import accounting as A
from quire.functions import text as T


def topic_filter(papers: DataFrame, word: str) -> DataFrame:
    """Papers whose title or abstract holds the word, in any case."""
    return papers.where(F.lower("title").contains(word.lower()) | F.lower("abstract").contains(word.lower()))


def sections_by_roles(sections: DataFrame, roles: list[str], works: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Sections of the roles, of the works given or of all."""
    found = sections.where(F.col("role").isin(*roles))
    return found if works is None else found.join(works.select(key).distinct(), key, "left_semi")


def method_sections(sections: DataFrame, works: DataFrame | None = None) -> DataFrame:
    return sections_by_roles(sections, ["method"], works)


def compare_methods(sections: DataFrame, works: list) -> DataFrame:
    """The method sections of 2 to 10 works."""
    if not 2 <= len(works) <= 10:
        raise ValueError("2 to 10 works can be compared")
    return sections.where(F.col("doc_id").isin(*works) & (F.col("role") == "method"))


def gap_evidence(sections: DataFrame) -> DataFrame:
    """Sections in which papers name their limits; no gaps are inferred from them."""
    return sections_by_roles(sections, ["limitations", "conclusion"]).withColumn("note", F.lit("source sections, no inferred gaps"))


def papers_with_artifacts(papers: DataFrame, artifacts: DataFrame, on: Column) -> DataFrame:
    return papers.join(artifacts, on)


def paper_detail(papers: DataFrame, assessments: DataFrame, authors: DataFrame, identifiers: DataFrame) -> DataFrame:
    """papers(doc_id, ...), assessments(doc_id, at, quality), authors(doc_id, position, name), identifiers(doc_id, scheme, value, is_primary): each
    paper with its latest assessment, its authors in order and its identifiers by scheme, both as arrays of structs (empty: none)."""
    latest = assessments.groupBy("doc_id").agg(F.max_by("quality", "at").alias("quality"))
    out = papers.join(latest, "doc_id", "left")
    for name, rows, fields in (("authors", authors, ("position", "name")), ("identifiers", identifiers, ("scheme", "value", "is_primary"))):
        entry = F.struct(*fields)
        kind = rows.select(F.array(entry).alias("x")).schema["x"].dataType
        out = out.join(rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def passages_in_context(nodes: DataFrame, papers: DataFrame, sections: DataFrame) -> DataFrame:
    """nodes(doc_id, pos, ordinal) with their paper's title and, where they open one, their section's heading."""
    heads = sections.select("doc_id", "ordinal", "heading")
    return nodes.join(papers.select("doc_id", "title"), "doc_id").join(heads, ["doc_id", "ordinal"], "left")


def token_audit(events: DataFrame, principals: DataFrame, tenants: DataFrame, start: str, end: str, most: int = 100) -> DataFrame:
    """The newest events(event_id, ts, principal) of a half-open range with principals(principal, name, tenant) and tenants(tenant, tenant_name)."""
    within = events.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return within.join(principals, "principal").join(tenants, "tenant").orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def mention_to_reference(mentions: DataFrame, refs: DataFrame) -> DataFrame:
    """mentions(work, target) against refs(work, xml_id): how often each target is mentioned and whether the work has a reference of that id."""
    known = refs.select("work", F.col("xml_id").alias("target"), F.lit(True).alias("known")).distinct()
    return mentions.join(known, ["work", "target"], "left").groupBy("work", "target", F.coalesce("known", F.lit(False)).alias("resolved")).agg(F.count("*").alias("n"))


def usage_by_tenant(events: DataFrame, tenants: DataFrame) -> DataFrame:
    """events(tenant, outcome, latency, bytes, quota) -> counts by outcome, latency (count, average, maximum), bytes and quota of each tenant; tenants without events appear with zeros."""
    by = events.groupBy("tenant").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("forwarded", "failed", "rejected")],
        F.count("latency").alias("latencies"),
        F.round(F.avg("latency"), 2).alias("avg_latency"),
        F.max("latency").alias("max_latency"),
        F.sum("bytes").alias("bytes"),
        F.sum("quota").alias("quota"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "forwarded", "failed", "rejected", "latencies", "bytes", "quota")}
    return tenants.join(by, "tenant", "left").withColumns(zero)


def corpus_stats(papers: DataFrame, fields: list[str], sizes: list[str], by: list[str], most: int = 10) -> DataFrame:
    """(what, key, value): papers, sums of the array columns `sizes`, the share of papers with each of `fields` (2 decimals), and how many papers
    have each value of the columns `by` (of each the `most` most frequent, ties by value)."""
    empty = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) != "" for f in fields}
    totals = papers.agg(F.count("*").alias("papers"), *[F.sum(F.greatest(F.size(c), F.lit(0))).alias(f"total {c}") for c in sizes], *[F.round(F.avg(empty[f].cast("int")), 2).alias(f"coverage {f}") for f in fields])
    names = totals.columns
    out = totals.select(F.explode(F.array(*[F.struct(F.lit(n.partition(" ")[0]).alias("what"), F.lit(n.partition(" ")[2]).alias("key"), F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias("value")) for n in names])).alias("s")).select("s.*")
    for c in by:
        counts = papers.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").cast("double").alias("value"))
        out = out.unionByName(counts.orderBy(F.desc("value"), "key").limit(most).select(F.lit(f"by {c}").alias("what"), "key", "value"))
    return out


def grade_distribution(papers: DataFrame, grades: DataFrame) -> DataFrame:
    """papers(doc_id), grades(doc_id, grade): how many papers have each best grade; N/A without one."""
    best = grades.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    return papers.select("doc_id").join(best, "doc_id", "left").groupBy(F.coalesce(F.col("grade").cast("string"), F.lit("N/A")).alias("grade")).agg(F.count("*").alias("n"))


def evidence_by_reference(mentions: DataFrame) -> DataFrame:
    """mentions(reference, node) -> the distinct nodes of each reference, sorted."""
    return mentions.groupBy("reference").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def build_totals(works: DataFrame, nodes: DataFrame) -> DataFrame:
    """works(work), nodes(work, node, reference) -> one row of counts."""
    return works.join(nodes, "work", "left").agg(F.count_distinct("work").alias("works"), F.count("node").alias("nodes"), F.count_distinct("reference").alias("refs"))


def log_week_summary(turns: DataFrame) -> DataFrame:
    """turns(project, week, role) -> counts of each project and week, in all and by role."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return turns.groupBy("project", "week").agg(F.count("*").alias("n"), F.count_if(user).alias("n_user"), F.count_if(assistant).alias("n_assistant"), F.count_if(~F.coalesce(user | assistant, F.lit(False))).alias("n_other"))


def structural_counts(pages: DataFrame, tags: tuple[str, ...], html: str = "html") -> DataFrame:
    """pages with n_<tag>, how often each tag is opened."""
    return pages.withColumns({f"n_{t}": F.regexp_count(html, F.lit(f"<{t}[ >]")) for t in tags})


def log_line_counts(logs: DataFrame, marks: dict[str, str], text: str = "text") -> DataFrame:
    """logs with a count of the lines that begin with each mark."""
    return logs.withColumns({name: F.regexp_count(text, F.lit(rf"(?m)^{mark}")).cast("long") for name, mark in marks.items()})


def latest_assessment(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, at).alias(value))


def dense_reordinal(nodes: DataFrame, keep: Column) -> DataFrame:
    """The kept nodes of each document, numbered from 0 without gaps."""
    return nodes.where(keep).withColumn("ordinal", (F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1).cast("long"))


def sibling_pointer(tags: DataFrame) -> DataFrame:
    """tags(page_id, p, tag) with a pointer `/tag[n]` that counts equal tags of a page in order."""
    nth = F.row_number().over(W.partitionBy("page_id", "tag").orderBy("p"))
    return tags.withColumn("pointer", F.concat(F.lit("/"), "tag", F.lit("["), nth, F.lit("]")))


def key_papers(papers: DataFrame, scores: DataFrame, most: int = 20) -> DataFrame:
    """papers(doc_id), scores(doc_id, score): the best by score, ties by id."""
    return papers.select("doc_id").join(scores, "doc_id").orderBy(F.desc("score"), "doc_id").limit(most)


def main_document(files: DataFrame, rank: Column) -> DataFrame:
    """files(work, file, size): the main file of each work: least rank, then largest, then first by name."""
    return files.groupBy("work").agg(F.min_by("file", F.struct(rank.alias("r"), (-F.col("size")).alias("s"), F.lower(F.col("file").cast("string")).alias("f"))).alias("file"))


def main_by_includes(files: DataFrame) -> DataFrame:
    """files(work, file, text): the main TeX file of each work: of those with a document class the one that includes most files, then the longest, then the first by name."""
    r = files.where(F.contains("text", F.lit("\\documentclass"))).withColumn("n", F.regexp_count("text", F.lit(r"\\(?:input|include)\{")))
    return r.groupBy("work").agg(F.min_by("file", F.struct((-F.col("n")).alias("n"), (-F.length("text")).alias("size"), F.lower(F.col("file").cast("string")).alias("f"))).alias("file"), F.max("n").alias("includes"))


def tables_of(works: DataFrame, cells: DataFrame, order: list[str], text: Column) -> DataFrame:
    """works(work), cells(work, ...) -> the texts of each work's cells in order."""
    rows = works.join(cells, "work").withColumn("text", text)
    return rows.groupBy("work").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda c: c["text"]).alias("cells"))


def reference_ids(properties: Column, schema: str = "reference_ids array<string>") -> Column:
    """The reference ids in an edge's JSON properties."""
    return F.from_json(properties, schema)["reference_ids"]


def metadata_assertions(papers: DataFrame, paper: str, fields: list[str], sources: Column, main: Column, pdf: Column) -> DataFrame:
    """papers -> one row for each field with a value: paper, field, value, source_kind, source_path, confidence, selected, id.

    sources maps fields to where their value came from (`kind` or `kind:detail`; tex if not named); values of a PDF point to that
    file, others to the main one. Fields must be known to A.CONFIDENCE. Arrays are joined by `; `; null and empty values are skipped.
    """
    kinds = dict(papers.dtypes)
    text = {f: F.array_join(f, "; ") if kinds[f].startswith("array") else F.col(f).cast("string") for f in fields}
    entry = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text[f].alias("value"), F.substring_index(F.coalesce(sources[f], F.lit("tex")), ":", 1).alias("source_kind")) for f in fields]))
    rows = papers.select(F.col(paper).alias("paper"), main.alias("main"), pdf.alias("pdf"), entry.alias("e")).select("paper", "main", "pdf", "e.*").where("value is not null and value <> ''")
    path = F.when(F.col("source_kind") == "pdf", F.coalesce("pdf", "main")).otherwise(F.col("main"))
    out = rows.select("paper", "field", "value", "source_kind", path.alias("source_path"), A.confidence(F.col("field")).alias("confidence"), F.lit(True).alias("selected"))
    return out.withColumn("id", T.stable_id("metadata-assertion", F.col("paper"), F.col("field"), F.col("value"), F.col("source_kind"), F.col("source_path")))
