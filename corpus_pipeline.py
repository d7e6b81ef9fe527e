"""Documents through the stages of a training-data pipeline, each stage a table.

Language ID drops what it rejects, line dedup rewrites texts, near-dedup keeps one document of each
group, mixing repeats or leaves out documents, and the last stage turns texts into piece ids.
ORACLE_SQL is None: compression and hashed orders have no SQL form; tests/llm compares with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import langid, lines, mixing, pieces, simhash
from quire.plans.materialize import passing, written


def _carried(docs: DataFrame, *more: str) -> DataFrame:
    """docs as one struct `row`, and the columns that a stage reads, so that its own columns replace none of docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found with enough margin; the dictionaries are learned from labelled rows of docs outside the held-out fold."""
    held = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    return langid.identify(_carried(docs, "text"), langid.learn(docs.where(~held))).where("accepted").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(_carried(docs, "source", "text"))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of texts with a 5-word Jaccard similarity of 0.8 or more: the least doc_id (null last), then the least hash of the text, then of the row."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    found = written(simhash.resembling(docs), "components")
    kept = written(found.groupBy("component").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_key"), "kept")
    same = ["doc_id", "text_key"]
    # rows whose doc_id names one row alone are told by it: those that go are listed, so texts need not be moved where the list is short
    unclear = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "unclear")
    clear = found.join(unclear, found["doc_id"].eqNullSafe(unclear["doc_id"]), "left_anti")
    gone = written(clear.join(kept, same, "left_anti").select("doc_id"), "gone")
    alone = docs.where("doc_id is not null").join(unclear.where("doc_id is not null"), "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    odd = docs.join(unclear, docs["doc_id"].eqNullSafe(unclear["doc_id"]), "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("key"))
    odd = odd.withColumn("h", F.xxhash64(F.to_json("row")))  # maps have no hash
    odd = odd.join(kept, odd["row.doc_id"].eqNullSafe(kept["doc_id"]) & odd["key"].eqNullSafe(kept["text_key"]), "left_semi")
    return alone.unionByName(odd.groupBy("row.doc_id", "key").agg(F.min_by("row", "h").alias("row")).select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it: one row for every pass that takes at least half its words, so a source's share holds to a document."""
    return mixing.times(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.encode(docs, keep=("doc_id",))
    best = F.get("nbest", F.lit(0))
    return found.select("doc_id", best["n_pieces"].alias("n_pieces"), best["score"].alias("score"), best["sha256"].alias("ids_sha256"), "ids", "nbest")


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has made on its way goes when its result is written, and that when the next one's is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with passing(spark) as made:
            docs = written(stage(spark, docs, sf_dir), name)
            result = made.pop()
            made += [last] if last else []
            last = result
    return docs
