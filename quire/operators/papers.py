"""Filters, lookups and paging over papers, sections and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def list_papers(papers: DataFrame, year: int | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page ordered by year (newest first, unknown last), title, id; limit is held to 1..200."""
    rows = papers if year is None else papers.where(F.col("year") == year)
    return rows.orderBy(F.desc_nulls_last("year"), "title", "paper_id").offset(offset).limit(max(1, min(200, limit)))


def keyword_score(title: Column, abstract: Column, sections: Column, word: str) -> Column:
    """10 for the title, 5 for the abstract; sections add 1 if there is such a base, else up to 3. All compared in lower case."""
    w = word.lower()
    base = F.lower(title).contains(w).cast("int") * 10 + F.lower(abstract).contains(w).cast("int") * 5
    n = F.size(F.filter(sections, lambda s: F.lower(s).contains(w)))
    return F.when(base == 0, F.least(F.lit(3), n)).otherwise(base + (n > 0).cast("int"))


def outline(sections: DataFrame, doc_id: int) -> DataFrame:
    return sections.where(F.col("doc_id") == doc_id).orderBy("ordinal")


def select_section(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc_id, key): the section whose id is the key, else the first by ordinal that has it as ordinal, title (any case) or role."""
    met = sections.join(wanted, "doc_id")
    key = F.lower("key")
    rank = F.when(F.col("section_id") == F.col("key"), 0).when((F.col("ordinal").cast("string") == F.col("key")) | (F.lower("heading") == key) | (F.col("role") == key), 1)
    best = W.partitionBy("doc_id", "key").orderBy("rank", "ordinal")
    return met.withColumn("rank", rank).where("rank is not null").withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "rank")


def section_span(sections: DataFrame, start: int, span: int) -> DataFrame:
    """The next `span` (1..10) sections of each paper from ordinal `start`."""
    order = W.partitionBy("doc_id").orderBy("ordinal")
    return sections.where(F.col("ordinal") >= start).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(1, min(10, span))).drop("n")


def passage_scope(passages: DataFrame, paper: int | None = None, section: str | None = None) -> DataFrame:
    """Passages of a paper, of sections whose role is the text or whose title holds it (any case)."""
    if paper is not None:
        passages = passages.where(F.col("doc_id") == paper)
    if section is not None:
        passages = passages.where((F.col("role") == section) | F.lower("heading").contains(section.lower()))
    return passages


def audit_range(events: DataFrame, start: str, end: str, tenant: int | None = None) -> DataFrame:
    """Events of a half-open UTC range of at most 31 days."""
    import datetime as dt

    a, b = (dt.datetime.fromisoformat(x).replace(tzinfo=dt.UTC) for x in (start, end))
    if not dt.timedelta(0) < b - a <= dt.timedelta(days=31):
        raise ValueError("the range must be positive and at most 31 days")
    rows = events.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows if tenant is None else rows.where(F.col("tenant") == tenant)


def tool_decision(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """calls(tool, capabilities, tenant, writes) x catalog(tool, needs, tenants): one of five outcomes, denied unless all holds."""
    met = calls.join(catalog, "tool", "left")
    decision = (
        F.when(F.col("needs").isNull(), "unknown_tool")
        .when(~F.array_contains("capabilities", F.col("needs")), "missing_capability")
        .when(~F.array_contains("tenants", F.col("tenant")), "tenant_denied")
        .when(F.col("writes") & ~F.array_contains("capabilities", F.lit("workspace")), "workspace_write_denied")
        .otherwise("allowed")
    )
    return met.withColumn("decision", decision).drop("needs", "tenants")


def key_status(revoked_at: Column, expires_at: Column, now: Column) -> Column:
    return F.when(revoked_at.isNotNull(), "revoked").when(expires_at <= now, "expired").otherwise("active")


def retention(events: DataFrame, now: str, days: int = 180) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def keyset_page(rows: DataFrame, order: list[tuple[str, bool]], cursor: tuple | None, limit: int) -> DataFrame:
    """A page after the cursor's row: order is (column, descending). One row more than `limit` tells that another page follows."""
    if cursor is not None:
        past = F.lit(False)
        for k in range(len(order)):
            same = F.lit(True)
            for (c, _), v in zip(order[:k], cursor[:k], strict=True):
                same = same & (F.col(c) == v)
            c, down = order[k]
            past = past | (same & (F.col(c) < cursor[k] if down else F.col(c) > cursor[k]))
        rows = rows.where(past)
    return rows.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(limit + 1)


def cursor_of(*parts: Column) -> Column:
    """An opaque text for a row's order key: URL-safe base64 of the parts joined by U+001F."""
    return F.translate(F.base64(F.concat_ws("\u001f", *[p.cast("string") for p in parts]).cast("binary")), "+/", "-_")
