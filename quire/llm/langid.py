"""Language identification by compression.

A lower-cased text is encoded with zstandard once per language, each time against a raw-content dictionary of
that language; the language whose dictionary gives the fewest bytes wins. Long texts are encoded
whole, in independent blocks, so that the dictionary counts as much at the end of a text as at its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.plans.session import small_batches

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Bytes of a language's dictionary at most, labelled texts sampled for it at most, characters of a piece of such a text, and languages at most.
DICT_BYTES, SAMPLE_TEXTS, PIECE, LANGUAGES = 98_304, 96, 256, 1_000
BLOCK_BYTES = 2_048
#: Compression level, and the shortest match: with short ones the sizes of short texts tie less often.
LEVEL, MIN_MATCH = 6, 3
#: A text is rejected if the runner-up is not larger by this share.
MARGIN = 0.004


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """One dictionary per language from labelled rows: at most `sample` texts a language, the least by a hash of doc_id.

    Whole texts are cut into pieces; first one piece of each text is taken, then a second, each time the least by a hash, until
    DICT_BYTES are filled. The sample is bounded by these parameters whatever the input's size. Rows without
    doc_id, lang, text or letters teach nothing. More than LANGUAGES languages raise an error, none is left out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).where("doc_id is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return {}
    # hashes are uniform: below this bound a language has eight times the sample (or all rows), so that few rows are ranked however many there are
    bounds = [(name, int(-(2**63) + min(1.0, 8 * sample / n) * (2**64 - 2**11))) for name, n in sorted(sizes.items())]
    bound = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    some = rows.withColumn("h", F.xxhash64("doc_id")).join(bound, "lang").where((F.col("h") <= F.col("bound")) & F.regexp_like("text", F.lit(r"\p{L}")))
    texts = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("r") <= sample)
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
    parts = texts.select("lang", "r", F.posexplode(F.transform(starts, lambda i: F.lower(F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE))))).alias("at", "part"))
    parts = parts.withColumn("turn", F.row_number().over(W.partitionBy("lang", "r").orderBy(F.xxhash64("part", "at"), "at"))).where(F.col("turn") <= DICT_BYTES // PIECE)
    order = F.row_number().over(W.partitionBy("lang").orderBy("turn", "r"))
    out: dict[str, bytes] = {}
    for r in parts.withColumn("order", order).where(F.col("order") <= DICT_BYTES // PIECE).select("lang", "order", "part").orderBy("lang", "order").collect():
        out[r["lang"]] = (out.get(r["lang"], b"") + r["part"].encode("utf-8", "replace") + b"\n")[:DICT_BYTES]
    return out


class Classifier:
    """The compressors of one Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.coders = []
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        for name, content in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append((name, zstandard.ZstdCompressor(compression_params=params, dict_data=d)))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "replace")
        total = [0] * len(self.coders)
        for at in range(0, len(raw), BLOCK_BYTES):
            block = raw[at : at + BLOCK_BYTES]
            for k, (_, coder) in enumerate(self.coders):
                total[k] += len(coder.compress(block))
        return total

    def classify(self, text) -> tuple[str, float]:
        """Language and margin: the share by which the runner-up is larger than the least, 0 to 1."""
        if not isinstance(text, str) or not self.coders or not LETTER.search(text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return self.coders[0][0], 1.0
        ranked = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best, second = sizes[ranked[0]], sizes[ranked[1]]
        return self.coders[ranked[0]][0], (second - best) / second if second else 0.0


def predicted(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """struct<lang_pred, score> of a text column; the dictionaries (bounded by DICT_BYTES a language) travel with the function."""

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(dictionaries)
        for s in texts:
            yield pd.DataFrame([model.classify(t) for t in s], columns=["lang_pred", "score"])

    return of(text)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and accepted added (existing columns of these names are replaced).

    lang_pred is a learned language, or `und` with score 0 if the text is null or has no letter (or
    nothing was learned). accepted is false for `und` and where the margin is below `margin`. Ties go to
    the first language by name. Null values in other columns, repeated rows and empty tables pass through.
    """
    small_batches(docs.sparkSession)
    taken, name = {c.lower() for c in docs.columns}, "_found"
    while name in taken:
        name += "_"
    marked = docs.withColumn(name, predicted(F.col(f"`{text}`"), dictionaries))
    return marked.withColumns({"lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}).withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= margin)).drop(name)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (null: null)."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(3))
