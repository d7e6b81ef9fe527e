"""Joins that fill and compare, and the aggregates and windows of usage and corpus reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import accounting as A
from quire.operators import matching as M


def citation_contexts(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """mentions(ref, ...) of edges(src, reference_ids) that list the reference: the list is exploded, so the join is an equality."""
    return mentions.join(edges.select("src", F.explode("reference_ids").alias("ref")), "ref").distinct()


def resolve_cascade(refs: DataFrame, papers: DataFrame, partial: float | None = 95.0) -> DataFrame:
    """refs(ref_id, title, doi) -> (ref_id, work, level): by DOI, else by fuzzy title (see resolve_refs_fuzzy), else unresolved."""
    by_doi = M.resolve_refs_doi(refs, papers).groupBy("ref_id").agg(F.min("work").alias("work")).withColumn("level", F.lit("doi"))
    rest = refs.join(by_doi.select("ref_id"), "ref_id", "left_anti")
    by_title = M.resolve_refs_fuzzy(rest, papers, partial=partial).select("ref_id", "work", F.lit("title").alias("level"))
    none = rest.join(by_title.select("ref_id"), "ref_id", "left_anti").select("ref_id", F.lit(None).cast("long").alias("work"), F.lit("unresolved").alias("level"))
    return by_doi.unionByName(by_title).unionByName(none)


def resolution_levels(resolved: DataFrame) -> DataFrame:
    counts = resolved.groupBy("level").agg(F.count("*").alias("n"))
    return counts.select("level", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))


def merge_sources(primary: DataFrame, fallback: DataFrame, fields: tuple[str, ...] = ("venue", "year"), wins: tuple[str, ...] = ("year",)) -> DataFrame:
    """primary(doc_id, content, fields) filled from fallback(doc_id, f_content, f_<field>).

    Empty fields are filled; of the fields in `wins` the fallback's value is taken where it has one; its content wins if
    longer by max(500, 20 %). conflicts maps each field in which both have different values to the value that lost.
    """
    m = primary.join(fallback.withColumn("has_fallback", F.lit(True)), "doc_id", "left")
    more = F.length("f_content") > F.length("content") + F.greatest(F.lit(500.0), F.length("content") * 0.2)
    none = {c: F.col(c).isNull() | (F.col(c).cast("string") == "") for f in fields for c in (f, f"f_{f}")}
    value = {f: F.when(none[f"f_{f}"], F.col(f)).otherwise(F.col(f"f_{f}")) if f in wins else F.when(none[f], F.col(f"f_{f}")).otherwise(F.col(f)) for f in fields}
    lost = [F.when(~none[f] & ~none[f"f_{f}"] & (F.col(f) != F.col(f"f_{f}")), F.struct(F.lit(f).alias("key"), F.col(f if f in wins else f"f_{f}").cast("string").alias("value"))) for f in fields]
    return m.select(
        "doc_id",
        *[value[f].alias(f) for f in fields],
        F.when(more, F.col("f_content")).otherwise(F.col("content")).alias("content"),
        F.when(more, "fallback").otherwise("primary").alias("content_from"),
        F.map_from_entries(F.filter(F.array(*lost), lambda x: x.isNotNull())).alias("conflicts"),
        F.coalesce("has_fallback", F.lit(False)).alias("has_fallback"),
    )


def apply_metadata(papers: DataFrame, meta: DataFrame, fields: list[str], overwrite: bool = False) -> DataFrame:
    """Fills fields from meta's m_<field> (all of them if overwrite) and lists what was filled."""
    m = papers.join(meta, "doc_id", "left")
    takes = {f: F.col(f"m_{f}").isNotNull() & (F.lit(True) if overwrite else F.col(f).isNull()) for f in fields}
    filled = F.filter(F.array(*[F.when(takes[f], F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    out = m.withColumns({"filled": filled} | {f"n_{f}": F.when(takes[f], F.col(f"m_{f}")).otherwise(F.col(f)) for f in fields})
    return out.drop(*fields, *[f"m_{f}" for f in fields]).withColumnsRenamed({f"n_{f}": f for f in fields})


def dominates(pairs: DataFrame, items: DataFrame, axes: list[str]) -> DataFrame:
    """(source, target, dominates): the target is at least as good on all axes and better on one."""
    s = items.select(F.col("id").alias("source"), *[F.col(a).alias(f"s_{a}") for a in axes])
    t = items.select(F.col("id").alias("target"), *[F.col(a).alias(f"t_{a}") for a in axes])
    all_at, one_over = F.lit(True), F.lit(False)
    for a in axes:
        all_at = all_at & (F.col(f"t_{a}") >= F.col(f"s_{a}"))
        one_over = one_over | (F.col(f"t_{a}") > F.col(f"s_{a}"))
    return pairs.join(s, "source").join(t, "target").select("source", "target", (all_at & one_over).alias("dominates"))


def compare_runs(run: DataFrame, baseline: DataFrame) -> DataFrame:
    return run.join(baseline.withColumnRenamed("value", "base"), "metric").select("metric", F.round(F.col("value") - F.col("base"), 4).alias("diff"))


def active_members(principals: DataFrame, active_teams: DataFrame) -> DataFrame:
    """Principals without a team, or whose team is active."""
    alone = principals.where("team is null")
    return alone.unionByName(principals.join(active_teams, "team", "left_semi").select(*alone.columns))


def route_health(routes: DataFrame, backends: DataFrame, fresh_from: Column) -> DataFrame:
    """The first thing that is wrong with each route's backend, or healthy."""
    reason = F.when(F.col("status").isNull(), "no_backend").when(F.col("status") == "failed", "backend_failed").when(~F.col("ready"), "not_ready").when(F.col("probed_at") < fresh_from, "stale_probe").when(~F.col("version_ok"), "version_mismatch").otherwise("healthy")
    return routes.join(backends, "backend", "left").withColumn("reason", reason)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def top_tags(rows: DataFrame, most: int) -> DataFrame:
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def citation_edges(refs: DataFrame) -> DataFrame:
    """One edge for each (src, dst): best confidence, references in order, distinct evidence."""
    return refs.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_list("reference_id")).alias("reference_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def edge_references(refs: DataFrame) -> DataFrame:
    """(src, dst, place, reference_id, confidence): the references of each edge as rows in order from 0, each once with its best confidence; an edge may have any number."""
    best = refs.groupBy("src", "dst", "reference_id").agg(F.max("confidence").alias("confidence"))
    place = (F.row_number().over(W.partitionBy("src", "dst").orderBy("reference_id")) - 1).alias("place")
    return best.select("src", "dst", place, "reference_id", "confidence")


def section_text(nodes: DataFrame, keep: Column, most: int = 20_000) -> DataFrame:
    """The kept nodes of each (doc_id, ordinal) in order, joined by blank lines, cut to `most`; null if none is kept."""
    parts = F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "line"))))
    text = F.left(F.array_join(F.transform(parts, lambda s: s["line"]), "\n\n"), F.lit(most))
    return nodes.groupBy("doc_id", "ordinal").agg(F.when(F.size(parts) > 0, text).alias("text"))


def term_counts(rows: DataFrame, pattern: str = "[a-zA-Z]{2,}") -> DataFrame:
    return rows.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def char_budget(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes while the characters before them stay under the budget; the last is cut and marked."""
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    n = nodes.withColumn("before", F.coalesce(F.sum(F.length("line")).over(w), F.lit(0))).where(F.col("before") < most)
    return n.withColumns({"text": F.left("line", (F.lit(most) - F.col("before")).cast("int")), "truncated": F.col("before") + F.length("line") > most})


def admitted_requests(events: DataFrame, limit: int, seconds: int, slots: int | None = None) -> DataFrame:
    """The first `limit` requests of a tenant in each fixed window are admitted; the rest learn when to come back.

    A window is cut into `slots` equal times: requests are numbered within a slot and moved by the counts of the slots before,
    so a busy tenant's window is many tasks. By default slots follow the root of the events, at least 64: neither a slot nor the list of slots
    of a window grows with all events.
    """
    slots = slots or max(64, math.isqrt(events.count()))
    us, start = A.micros(F.col("ts")), A.window_start(F.col("ts"), seconds)
    key = ["tenant", "start", "slot"]
    cut = events.withColumn("start", start).withColumn("slot", F.floor((us - F.col("start")) * slots / (seconds * 1_000_000)).cast("int"))
    counts = cut.groupBy(*key).agg(F.count("*").alias("n"))
    before = counts.select(*key, F.coalesce(F.sum("n").over(W.partitionBy("tenant", "start").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = cut.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("ts", "event_id")))
    out = local.join(before, key).withColumn("n", F.col("n") + F.col("before")).drop("slot", "before")
    return out.withColumns({"admitted": F.col("n") <= limit, "remaining": A.remaining(F.lit(limit), F.col("n")).cast("long"), "retry_after": F.when(F.col("n") > limit, A.retry_after(us, F.col("start") + seconds * 1_000_000))})


def timeline(rows: DataFrame, year: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each year with the year's count; counts and first rows are partial aggregates, joined on the year."""
    totals = rows.groupBy(year).agg(F.count("*").alias("total"))
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(year).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return first.join(totals, year)


def top_formulas(rows: DataFrame, most: int) -> DataFrame:
    """Labels count 10, length up to 5, display environments 3."""
    score = F.col("label").isNotNull().cast("int") * 10 + F.least(F.length("latex") / 20, F.lit(5.0)) + F.col("env").isin("equation", "align", "gather").cast("int") * 3
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("score", score).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
