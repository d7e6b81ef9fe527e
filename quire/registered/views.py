"""Tables in the roles that the operators expect, and the same in SQL.

A document is a paper: its first line is the title, its second the abstract, each line a content node, each
run of five lines a section headed by its first line. An event is an audit event of tenant user_id % 10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.text import once
from quire.plans.session import table

SECTION_LINES = 5


def papers(spark: SparkSession, d: str) -> DataFrame:
    t = F.split("text", "\n", -1)
    return table(spark, d, "documents").select("doc_id", "source", "lang", "text", F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("title"), F.coalesce(F.get(t, F.lit(1)), F.lit("")).alias("abstract"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Built within a row, without moving lines."""

    def cut(lines: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / SECTION_LINES).cast("int")), lambda k: F.struct(k.alias("ordinal"), F.slice(lines, k * SECTION_LINES + 1, F.lit(SECTION_LINES)).alias("body")))

    part = once(F.split("text", "\n", -1), cut)
    out = table(spark, d, "documents").select("doc_id", "source", F.explode(part).alias("s"))
    return out.select("doc_id", "source", "s.ordinal", F.get("s.body", F.lit(0)).alias("heading"), F.array_join("s.body", "\n").alias("content"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("purchase", "view"), "forwarded").when(F.col("event_type") == "error", "failed").otherwise("rejected")
    return table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("tenant"), F.col("user_id").alias("key"), "event_type", kind.alias("outcome"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("long").alias("bytes"))


PAPERS = "papers AS (SELECT doc_id, source, lang, text, string_split(text, chr(10))[1] AS title, coalesce(string_split(text, chr(10))[2], '') AS abstract FROM documents)"
NODES = "nodes AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"
SECTIONS = NODES + ", sections AS (SELECT doc_id, source, (pos // 5)::INT AS ordinal, string_agg(line, chr(10) ORDER BY pos) AS content, arg_min(line, pos) AS heading FROM nodes GROUP BY 1, 2, 3)"
AUDIT = "audit AS (SELECT event_id, ts, user_id % 10 AS tenant, user_id AS key, event_type, CASE WHEN event_type IN ('purchase', 'view') THEN 'forwarded' WHEN event_type = 'error' THEN 'failed' ELSE 'rejected' END AS outcome, value AS latency, CAST(json_extract(props, '$.k') AS BIGINT) AS bytes FROM events)"
