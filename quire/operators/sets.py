"""Dedup, anti-joins and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T


def exact_dedup(docs: DataFrame, key: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed -> kept): of equal contents the least key stays. Only hashes and keys are grouped."""
    marks = docs.select(F.col(key).alias("_k"), F.sha2(content, 256).alias("_h"))
    least = marks.groupBy("_h").agg(F.min("_k").alias("kept"), F.count("*").alias("_n")).where("_n > 1").select("_h", "kept")
    removed = marks.join(least, "_h").where("_k <> kept").select(F.col("_k").alias("removed"), "kept")
    return docs.join(removed.select("removed"), docs[key] == removed["removed"], "left_anti"), removed


def first_by_hash(rows: DataFrame, group: list[str], content: Column, position: str) -> DataFrame:
    """The first row by position of each content within its group."""
    marked = rows.withColumn("_h", F.sha2(content, 256))
    w = W.partitionBy(*group, "_h").orderBy(position)
    return marked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_h")


def record_dedup(rows: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """Records that are equal as JSON of the sorted fields: the first stays."""
    marked = rows.withColumn("_h", T.canonical_digest(F.struct(*sorted(fields))))
    return marked.withColumn("_n", F.row_number().over(W.partitionBy("_h").orderBy(*order))).where("_n = 1").drop("_n", "_h")


def missing_citations(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """Citation keys of drafts(text) that known(key) lacks."""
    return drafts.select(F.explode(T.cite_keys(F.col("text"))).alias("key")).distinct().join(known, "key", "left_anti")


def not_yet_ingested(feed: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    return feed.join(corpus.select(key), key, "left_anti").dropDuplicates([key])


def unanalyzed_weeks(logs: DataFrame, done: DataFrame) -> DataFrame:
    """The earliest week of each project that is not done."""
    return logs.join(done, ["project", "week"], "left_anti").groupBy("project").agg(F.min("week").alias("week"))


def upsert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def upsert_update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def idempotent_ops(ops: DataFrame) -> DataFrame:
    """(actor, op, key): seen once, a replay (one digest) or a conflict."""
    g = ops.groupBy("actor", "op", "key").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    return g.select("actor", "op", "key", "n", F.when(F.col("n") == 1, "first").when(F.col("lo") == F.col("hi"), "replay").otherwise("conflict").alias("status"))


def interest_merge(old: DataFrame, new: DataFrame, removed: list[str] | None = None) -> DataFrame:
    """By category in lower case: keywords of old then new, distinct in any case with the first spelling, and the larger max_results."""
    rows = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    rows = rows.select(F.lower("category").alias("cat"), "side", "at", "max_results", F.explode("keywords").alias("kw"))
    if removed:
        rows = rows.where(~F.col("cat").isin(*[r.lower() for r in removed]))
    first = rows.groupBy("cat", F.lower("kw").alias("low")).agg(F.min(F.struct("side", "at", "kw")).alias("f"), F.max("max_results").alias("m"))
    return first.groupBy("cat").agg(F.transform(F.array_sort(F.collect_list("f")), lambda s: s["kw"]).alias("keywords"), F.max("m").alias("max_results"))
