"""The numbered queries, each over its whole table, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import ann, binary, bpe, factors, langid, lines, mixing, negatives, pieces, runs, simhash, urls, warc
from quire.plans.session import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), n=4, ids=False)
    best = F.get("nbest", F.lit(0))
    return found.select("doc_id", best["n_pieces"].alias("n_pieces"), best["score"].alias("score"), best["sha256"].alias("ids_sha256"), "nbest", "round_trip")


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", binary.sign_code(F.col("embedding")).alias("code"))
    return binary.search(rows, F.col("vec_id") % 100 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), labels)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)[0]


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.factored(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the checksum of its id repeats a part of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    asked = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    asked = asked.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return asked.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(planted_repeats(table(spark, sf_dir, "documents")))
    # runs come by start, then period, so the first of equal exponents stays
    most = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "most.start", "most.length", "most.period", F.expr("most.length * 1000 div most.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").where(sound).select("vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(256 * c)).alias("vector"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_hard_negatives": op12_hard_negatives, "op11_periodic_runs": op11_periodic_runs, "op13_bpe": op13_bpe, "op9_substrings": op9_substrings, "op2_hamming_topk": op2_hamming_topk, "op5_nearest": op5_nearest, "op4_url_filter": op4_url_filter, "op10_warc": op10_warc, "op1_sentencepiece": op1_sentencepiece, "op3_simhash": op3_simhash, "op6_mixing": op6_mixing, "op7_line_dedup": op7_line_dedup, "op8_langid": op8_langid}
ORACLE = {"op12_hard_negatives": negatives.SQL, "op9_substrings": factors.SQL, "op2_hamming_topk": binary.SQL, "op7_line_dedup": lines.SQL, "op10_warc": warc.SQL}
