"""Line dedup by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.plans.materialize import written

RATIO = 0.1
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits that stand for a line without its outer spaces (two seeds: the second hash covers a prefix byte)."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("x"), F.xxhash64(F.lit(1), bare).alias("y"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, bad): for each host the keys of its lines that stand on at least min_pages of its pages and on more than `ratio` of them.

    A host has at most (distinct lines a page) / ratio such lines on average, so the list of one host is bounded.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = written(pages.groupBy("host").agg(F.count("*").alias("pages")), "hosts")  # as a table: the join can split a host of many lines
    per_page = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))).alias("key"))
    counts = per_page.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") > F.col("pages") * F.lit(ratio))
    return often.groupBy(counts["host"]).agg(F.collect_set("key").alias("bad"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of `text`, and n_lines, n_dropped added.

    Pages are rows; a line counts once a page, compared without outer spaces; blank lines never count
    and are never dropped. Null hosts form one site of their own. A null text stays null with 0 lines; an
    empty text has one blank line. Repeated rows are pages of their own. All other columns stay, whatever their names; columns
    named n_lines or n_dropped are replaced.
    """
    # a table of known size: Spark sees whether it can be sent to the texts instead of moving them
    marks = written(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host).alias("site"), F.col(text).alias("body"))
    joined = rows.join(marks, rows["site"].eqNullSafe(marks["host"]), "left")
    bad = F.coalesce("bad", F.array().cast("array<struct<x:bigint,y:bigint>>"))
    kept = F.filter(_lines(F.col("body")), lambda x: (F.trim(x) == "") | ~F.array_contains(bad, _key(x)))
    out = joined.withColumn("kept", F.when(F.size(bad) > 0, kept).otherwise(_lines(F.col("body"))))
    n_lines = F.when(F.col("body").isNull(), 0).otherwise(F.size(_lines(F.col("body"))))
    out = out.withColumns({"n_lines": n_lines, "n_dropped": F.when(F.col("body").isNull(), 0).otherwise(n_lines - F.size("kept"))})
    new = {text: F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("body")), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")}
    return out.select(*[new.pop(c).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns], *[v.alias(c) for c, v in new.items()])


SQL = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
p AS (SELECT source, trim(line) AS k, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
b AS (SELECT p.source, p.k FROM p JOIN t USING (source) WHERE n >= 5 AND n > pages * 0.1),
m AS (SELECT l.doc_id, l.line, l.pos, b.k IS NOT NULL AS bad FROM l LEFT JOIN b ON l.source = b.source AND trim(l.line) = b.k)
SELECT doc_id, count(*)::INT AS n_lines, (count(*) FILTER (WHERE bad))::INT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS text
FROM m GROUP BY doc_id
"""
