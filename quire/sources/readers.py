"""Readers: files to typed rows, with schemas stated and broken records left out or told apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import text as T

MANIFEST = "paper_id string, title string, size_bytes long, sha256 string, quality_tier string"
PARSED = """paper_id string, title string, authors array<string>, year int, venue string, arxiv_id string, doi string, slug string, abstract string,
sections array<struct<heading:string,level:int,content:string,position:int>>, formulas array<struct<latex:string,label:string,env_type:string>>,
citations array<string>, bibliography array<struct<ref_key:string,title:string,authors:array<string>,year:int,doi:string>>"""
LOG = "ts string, week string, session string, role string, text string, project string"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is dropped (columns go by position)."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE")


def read_parsed_docs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file, nested rows; files that are not such JSON are left out."""
    rows = spark.read.json(path, schema=PARSED + ", _corrupt string", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return rows.where("_corrupt is null and paper_id is not null").drop("_corrupt")


def read_week_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in <project>/week-*.jsonl, files or folders of files; malformed lines are dropped, and a missing project is the folder's name."""
    rows = spark.read.json(f"{path}/*/week-*.jsonl", schema=LOG, mode="DROPMALFORMED")
    return rows.withColumn("project", F.coalesce("project", F.regexp_extract(F.input_file_name(), r"/([^/]+)/week-[^/]*\.jsonl", 1))).where("text is not null")


def read_documents_xml(spark: SparkSession, path: str) -> DataFrame:
    """Whole XML files as (path, content, sha256)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("sha256"))


def read_arxiv_atom(spark: SparkSession, path: str) -> DataFrame:
    """Atom feed files -> (title, authors, year, arxiv_id without version, abstract, pdf_url), parsed where they are read."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        a = "{http://www.w3.org/2005/Atom}"
        for p in parts:
            rows = []
            for content in p["content"]:
                try:
                    root = ET.fromstring(bytes(content))
                except ET.ParseError:
                    continue
                for e in root.iter(f"{a}entry"):
                    text = {n: " ".join((e.findtext(f"{a}{n}") or "").split()) for n in ("title", "published", "id", "summary")}
                    pdf = next((x.get("href") for x in e.iter(f"{a}link") if x.get("title") == "pdf"), None)
                    rows.append((text["title"], [" ".join((n.text or "").split()) for n in e.iter(f"{a}name")], text["published"], text["id"], text["summary"], pdf))
            yield pd.DataFrame(rows, columns=["title", "authors", "published", "id", "abstract", "pdf_url"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "title string, authors array<string>, published string, id string, abstract string, pdf_url string")
    year = F.nullif(F.substring("published", 1, 4), F.lit("")).try_cast("int")
    return raw.select("title", "authors", year.alias("year"), F.regexp_extract("id", r"([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?$", 1).alias("arxiv_id"), "abstract", "pdf_url")


def read_innovation_facts(spark: SparkSession, path: str) -> DataFrame:
    """Records of a text file of facts, one a line -> (kind, id, year, line, core, a, b, c, source, target).

    Lines look like `paper id year`, `innovation id line core year a b c`, `cites source target`, `replaces source target`; other lines are left out.
    """
    x = F.trim("value")
    kind = F.regexp_extract(x, r"^(paper|innovation|cites|replaces)\s", 1)
    parts = F.split(x, r"\s+")

    def at(i: int):
        return F.get(parts, F.lit(i))

    r = spark.read.text(path).withColumn("kind", kind).where("kind <> ''")
    inn, edge = F.col("kind") == "innovation", F.col("kind").isin("cites", "replaces")
    return r.select(
        "kind",
        F.when(~edge, at(1)).alias("id"),
        F.when(inn, at(4)).when(~edge, at(2)).try_cast("int").alias("year"),
        F.when(inn, at(2)).alias("line"),
        F.when(inn, at(3)).alias("core"),
        *[F.when(inn, at(5 + i)).try_cast("int").alias(n) for i, n in enumerate(("a", "b", "c"))],
        F.when(edge, at(1)).alias("source"),
        F.when(edge, at(2)).alias("target"),
    )


def clean_turns(rows: DataFrame, user: int = 500, assistant: int = 2000) -> DataFrame:
    """(role, text) turns of user and assistant: cleaned, cut by role, empty ones dropped."""
    text = T.log_clean(F.col("text"))
    cut = F.when(F.col("role") == "user", F.left(text, F.lit(user))).otherwise(F.left(text, F.lit(assistant)))
    return rows.where(F.col("role").isin("user", "assistant")).withColumn("text", cut).where("text <> ''")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Chat JSON lines whose content is a text or a list of typed parts; only text parts count."""
    raw = spark.read.text(path).select(F.get_json_object("value", "$.role").alias("role"), F.get_json_object("value", "$.content").alias("c"))
    parts = F.from_json("c", "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), " ")
    return clean_turns(raw.select("role", F.when(F.col("c").startswith("["), joined).otherwise(F.col("c")).alias("text")).where("text is not null"))
