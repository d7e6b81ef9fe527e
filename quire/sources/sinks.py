"""Writers: build-scoped projections, manifests, reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quire.operators import jobs as J


def write_projection(df: DataFrame, path: str, build_id: str) -> None:
    """Adds an immutable projection of one build: only this build's partition is written over."""
    df.withColumn("build_id", F.lit(build_id)).write.partitionBy("build_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_manifest(graded: DataFrame, path: str) -> None:
    """CSV of the kept rows, sorted by id."""
    graded.where("tier <> 'failed'").drop("reasons").orderBy(graded.columns[0]).write.mode("overwrite").csv(path, header=True)


def failed_rows(graded: DataFrame) -> DataFrame:
    return graded.where("tier = 'failed'").select(graded.columns[0], F.concat_ws(";", "reasons").alias("reasons"))


def write_failed(graded: DataFrame, path: str) -> None:
    failed_rows(graded).orderBy(graded.columns[0]).write.mode("overwrite").csv(path, header=True)


def write_scores(papers: DataFrame, scores: DataFrame, key: str, path: str, build_id: str) -> None:
    """Scores or tags put on the paper rows as a new build; the old one stays as it is."""
    taken = [c for c in scores.columns if c != key]
    write_projection(papers.drop(*taken).join(scores, key, "left"), path, build_id)


def write_notes(papers: DataFrame, path: str) -> None:
    """Markdown notes, one text record a paper, partitioned by source; papers(doc_id, title, abstract, source)."""
    note = J.render_note(F.col("title"), F.split("title", " "), F.col("abstract"), F.col("doc_id").cast("string"))
    papers.select("source", note.alias("value")).write.partitionBy("source").mode("overwrite").option("lineSep", "\n\n---\n\n").text(path)


def sync_report(papers: DataFrame, day: str) -> DataFrame:
    """papers(category, title, status) -> one Markdown report a category: synced titles, then errors, each in order of title."""
    ok, bad = (F.array_sort(F.collect_list(F.when(c, F.concat(F.lit("- "), "title")))) for c in (F.col("status") == "ok", F.col("status") != "ok"))
    g = papers.groupBy("category").agg(ok.alias("ok"), bad.alias("bad"))
    errors = F.when(F.size("bad") > 0, F.concat(F.lit("\n\n## Errors\n"), F.array_join("bad", "\n"))).otherwise("")
    return g.select("category", F.concat(F.lit(f"# {day}: "), "category", F.lit("\n\n## Synced ("), F.size("ok"), F.lit(")\n"), F.array_join("ok", "\n"), errors).alias("report"))


def write_sync_report(papers: DataFrame, day: str, path: str) -> None:
    """The reports of `sync_report` as one text file a category, in folders of its name.

    Lines of a category are sorted by the shuffle and written one after another, so a report of any length takes no array; only
    the number of its titles is counted before.
    """
    ok = F.col("status") == "ok"
    counts = papers.groupBy("category").agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("bad"))
    head = F.array(F.concat(F.lit(f"# {day}: "), "category"), F.lit(""), F.concat(F.lit("## Synced ("), "n", F.lit(")")))
    tail = F.when(F.col("bad") > 0, F.array(F.lit(""), F.lit("## Errors"))).otherwise(F.array().cast("array<string>"))
    fixed = counts.select("category", F.lit(0).alias("part"), F.posexplode(head).alias("place", "value")).unionByName(counts.select("category", F.lit(2).alias("part"), F.posexplode(tail).alias("place", "value")))
    rows = papers.select("category", F.when(ok, 1).otherwise(3).alias("part"), F.lit(0).alias("place"), F.concat(F.lit("- "), "title").alias("value"))
    # the writer needs rows by category; sorted by it first, they stay in the order given here
    rows.unionByName(fixed).repartition("category").sortWithinPartitions("category", "part", "place", "value").select("category", "value").write.partitionBy("category").mode("overwrite").text(path)


def new_turns(turns: DataFrame, logged: DataFrame) -> DataFrame:
    """turns(project, week, session, seq, ...) beyond the number that logged(project, week, session) already holds for the session and week."""
    keys = ["project", "week", "session"]
    n = F.row_number().over(W.partitionBy(*keys).orderBy("seq"))
    have = logged.groupBy(*keys).agg(F.count("*").alias("have"))
    return turns.withColumn("n", n).join(have, keys, "left").where(F.col("n") > F.coalesce("have", F.lit(0))).drop("n", "have")


def append_week_log(turns: DataFrame, logged: DataFrame, path: str) -> None:
    new_turns(turns, logged).write.partitionBy("project", "week").mode("append").json(path)
