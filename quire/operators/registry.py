"""Data-quality reports, and a registry of builds and snapshots kept as small tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T


def validate_manifest(rows: DataFrame, required: list[str], key: str = "paper_id") -> DataFrame:
    """(rule, value, n): missing columns, empty required values, repeated and unsafe ids; an empty report means a sound manifest."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    text = F.col(key).cast("string")
    repeated = rows.groupBy(text.alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("rule"), "value", "n")
    unsafe = rows.where(~T.is_safe_id(text)).groupBy(text.alias("value")).agg(F.count("*").alias("n")).select(F.lit("unsafe").alias("rule"), "value", "n")
    out = repeated.unionByName(unsafe)
    for c in required:
        out = out.unionByName(rows.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").groupBy(F.lit(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit("empty").alias("rule"), "value", "n"))
    return out


def verify_artifacts(files: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """files(key, content) against manifest(key, size_bytes, sha256): the first fault of each file: missing, size, sha256. Contents are digested where they are read.

    Where the manifest has canonical_sha256, contents are also read as XML: no_xml, and canonical if the digest of the canonical form differs.
    """
    known = "canonical_sha256" in manifest.columns
    form = T.canonical_xml(F.decode("content", "UTF-8")) if known else F.lit(None).cast("string")
    seen = files.select(key, F.octet_length("content").alias("_size"), F.sha2("content", 256).alias("_sha"), F.sha2(form, 256).alias("_form"))
    j = manifest.join(seen, key, "left")
    fault = F.when(F.col("_sha").isNull(), "missing").when(F.col("_size") != F.col("size_bytes"), "size").when(F.col("_sha") != F.col("sha256"), "sha256")
    if known:
        fault = fault.when(F.col("_form").isNull(), "no_xml").when(F.col("_form") != F.col("canonical_sha256"), "canonical")
    return j.select(key, fault.alias("fault")).where("fault is not null")


def check_constraints(rows: DataFrame, checks: dict[str, Column], unique: list[list[str]], foreign: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): rows that break row checks, keys that repeat, and rows whose foreign key is unknown."""
    flat = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
    out = flat.unpivot([], list(checks), "rule", "n")
    for cols in unique:
        twice = rows.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
        out = out.unionByName(twice.select(F.lit("unique:" + ",".join(cols)).alias("rule"), "n"))
    for c, known in foreign.items():
        lost = rows.where(F.col(c).isNotNull()).join(known, c, "left_anti").agg(F.count("*").alias("n"))
        out = out.unionByName(lost.select(F.lit(f"foreign:{c}").alias("rule"), "n"))
    return out


def config_hash(kind: str, config: dict) -> str:
    return hashlib.sha256(json.dumps([kind, config], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def sealed_build(registry: DataFrame, release: str, kind: str, digest: str) -> str | None:
    """The sealed build of this release, kind and configuration, if the job was done before."""
    hit = registry.where((F.col("release") == release) & (F.col("kind") == kind) & (F.col("config_hash") == digest) & (F.col("status") == "sealed")).orderBy("build_id").first()
    return hit["build_id"] if hit else None


def validate_builds(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(kind, build_id), or wanted(snapshot, kind, build_id) for many sets -> the violations of each set of builds: unknown, not sealed, of another kind, release or relational parent."""
    many = "snapshot" in wanted.columns
    j = (wanted if many else wanted.withColumn("snapshot", F.lit(""))).join(registry.withColumnRenamed("kind", "real_kind"), "build_id", "left")
    base = j.where("kind = 'relational'").groupBy("snapshot").agg(F.max("build_id").alias("base"), F.max("release").alias("base_release"))
    fault = (
        F.when(F.col("real_kind").isNull(), "unknown")
        .when(F.col("status") != "sealed", "not_sealed")
        .when(F.col("real_kind") != F.col("kind"), "wrong_kind")
        .when(F.col("release") != F.col("base_release"), "other_release")
        .when((F.col("kind") != "relational") & (F.col("parent") != F.col("base")), "other_parent")
    )
    return j.join(base, "snapshot", "left").select(*wanted.columns, fault.alias("fault")).where("fault is not null")


def create_snapshot(registry: DataFrame, wanted: DataFrame, snapshot: str) -> DataFrame:
    """The rows that pin a snapshot to its builds; unsound sets raise ValueError."""
    faults = validate_builds(registry, wanted).orderBy("kind").take(5)
    if faults:
        raise ValueError("; ".join(f"{r['kind']} {r['build_id']}: {r['fault']}" for r in faults))
    return wanted.withColumn("snapshot", F.lit(snapshot))


def read_as_of(projection: DataFrame, snapshots: DataFrame, channels: DataFrame, channel: str, kind: str) -> DataFrame:
    """A projection's rows of the build that the channel's snapshot pins; build_id is a partition column, so only that build is read."""
    pinned = channels.where(F.col("channel") == channel).join(snapshots.where(F.col("kind") == kind), "snapshot").select("build_id")
    return projection.join(pinned, "build_id", "left_semi")


def readiness(snapshots: DataFrame, counts: DataFrame, needed: list[str]) -> DataFrame:
    """counts(build_id, n) -> for each needed kind of the active snapshot its rows and whether it is ready, empty or missing."""
    spark = snapshots.sparkSession
    kinds = spark.createDataFrame([(k,) for k in needed], "kind string")
    j = kinds.join(snapshots, "kind", "left").join(counts, "build_id", "left")
    return j.select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("build_id").isNull(), "missing").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("ready").alias("state"))
