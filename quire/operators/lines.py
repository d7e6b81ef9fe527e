"""Operators over text lines: columns doc_id, pos, line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def classify_log(lines: DataFrame) -> DataFrame:
    """Build-log lines that say something: kind and detail (points too wide, the undefined key, the message)."""
    x = F.col("line")
    key = F.nullif(F.regexp_extract(x, r"`(.+?)\s*'", 1), F.lit(""))
    undefined = x.contains("undefined")
    kind = (
        F.when(x.startswith("!"), "fatal")
        .when(x.rlike(r"Overfull \\[hv]box"), "overfull")
        .when(x.rlike(r"Underfull \\[hv]box"), "underfull")
        .when(x.contains("Citation") & undefined, "undefined_citation")
        .when(x.contains("Reference") & undefined, "undefined_reference")
        .when(x.contains("LaTeX Warning:"), "info")
    )
    detail = F.when(F.col("kind") == "overfull", F.coalesce(F.nullif(F.regexp_extract(x, r"\(([0-9.]+)pt too wide\)", 1), F.lit("")), F.lit("?"))).when(F.col("kind").startswith("undefined"), F.coalesce(key, F.lit("?")))
    return lines.withColumn("kind", kind).where("kind is not null").withColumn("detail", detail)


def tag_balance(lines: DataFrame) -> DataFrame:
    """(doc_id, env, n_begin, n_end) of environments that are not opened as often as closed: one pass, counts meet as partial sums."""
    tags = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"\\((?:begin|end)\{[^}]*)\}"))).alias("t"))
    split = tags.select("doc_id", F.substring_index("t", "{", 1).alias("way"), F.substring_index("t", "{", -1).alias("env"))
    return split.groupBy("doc_id", "env").agg(F.count_if(F.col("way") == "begin").alias("n_begin"), F.count_if(F.col("way") == "end").alias("n_end")).where("n_begin <> n_end")


def error_context(lines: DataFrame, is_error) -> DataFrame:
    """Error lines with the first `l.<n>` of the next four lines and the last `(*.tex` of the ten before."""
    order = W.partitionBy("doc_id").orderBy("pos")
    at = F.nullif(F.regexp_extract("line", r"l\.([0-9]+)", 1), F.lit(""))
    file = F.nullif(F.regexp_extract("line", r"\(([^ \t]+\.tex)", 1), F.lit(""))
    out = lines.withColumns({"line_no": F.first(at, True).over(order.rowsBetween(1, 4)), "file": F.last(file, True).over(order.rowsBetween(-10, -1))})
    return out.where(is_error).select("doc_id", "pos", "line_no", "file")


def regions(lines: DataFrame, is_heading) -> DataFrame:
    """(doc_id, region, heading, body): the lines from each heading to the next; what stands before the first heading is region 0."""
    order = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("h", is_heading).withColumn("region", F.sum(F.col("h").cast("int")).over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("pos", "line")))), lambda s: s["line"]), "\n")
    return marked.groupBy("doc_id", "region").agg(F.max(F.when(F.col("h"), F.col("line"))).alias("heading"), body.alias("body"))


def repeated_margins(lines: DataFrame, page: str, doc: str, edge: int = 2, longest: int = 120, share: int = 2) -> DataFrame:
    """Lines of pages of a document without running heads and feet: of the first and last `edge` non-empty lines under
    `longest` characters, those on at least max(2, pages // share) pages are removed wherever they stand."""
    full = lines.where(F.trim("line") != "")
    up, down = W.partitionBy(page).orderBy("pos"), W.partitionBy(page).orderBy(F.desc("pos"))
    edges = full.withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)}).where((F.least("a", "b") <= edge) & (F.length(F.trim("line")) < longest))
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    often = edges.select(doc, page, F.trim("line").alias("bare")).distinct().groupBy(doc, "bare").agg(F.count("*").alias("n")).join(pages, doc)
    bad = often.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / share))).select(doc, "bare")
    return lines.withColumn("bare", F.trim("line")).join(bad, [doc, "bare"], "left_anti").drop("bare")
