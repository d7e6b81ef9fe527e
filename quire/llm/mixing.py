"""Mixing sources to target weights with a low-discrepancy schedule.

Slot t of the schedule takes the golden-ratio point frac((t + 1) / phi) and maps it through the
cumulative target shares to a source; the slot's rank within its source names a block. Each source is
its documents in a hashed order, laid end to end and repeated, cut into blocks of equally many words.
Ranks and word offsets are prefix sums over bounded chunks, so no source is ordered in one task.
"""

from __future__ import annotations

import math
from decimal import Context, Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.plans.materialize import written

#: Source weights by code point order, repeating; the share of all words that the mix takes; the most times a source's size.
WEIGHTS, SHARE, REPEATS = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK_WORDS = 128
#: Slots of a schedule chunk at least, and bits of a document's hash that name its chunk at least; both follow the root of the rows, so that neither a chunk nor the list of chunks grows with all rows.
SLOT_CHUNK, CHUNK_BITS = 1024, 6
#: The golden ratio's fraction in exact arithmetic: the point of slot t is that of its high and low 26 bits added, so it stays exact for very long schedules.
GOLDEN = (Decimal(5).sqrt(Context(prec=60)) - 1) / 2
_LOW, _HIGH = float(GOLDEN), float(GOLDEN * 2**26 % 1)


def words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _point(t: Column) -> Column:
    """frac(t / golden ratio)."""
    low, high = F.pmod(t, F.lit(2**26)).cast("double"), F.shiftright(t, 26).cast("double")
    return F.pmod(F.pmod(low * F.lit(_LOW), F.lit(1.0)) + F.pmod(high * F.lit(_HIGH), F.lit(1.0)), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size) -> the same with target: share of all words split by weight, capped at repeats times the size, the excess shared again until none is above.

    The fixed point is a water level: sources in order of cap / weight fill up while the level that the
    rest would get is above theirs. One row a source, so the ordered sums run over the list of sources alone.
    """
    by_code = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))) + 1).cast("int")))
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(repeats)).withColumn("full_at", F.col("cap") / F.col("w"))
    every = W.partitionBy()
    before = W.orderBy("full_at", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    at = capped.withColumn("level", level)
    # the first source, in this order, that its level does not fill sets the level of itself and all after it
    final = at.withColumn("final", F.min(F.when(F.col("full_at") > F.col("level"), F.col("full_at"))).over(every))
    rest = final.withColumn("water", F.max(F.when(F.col("full_at") == F.col("final"), F.col("level"))).over(every))
    return rest.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("full_at") < F.col("final")), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("water"))).alias("target"))


def schedule(aims: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(source, target) -> (slot, source, rank): the low-discrepancy order of blocks; rank counts a source's slots from 0.

    Slots are dealt by range; ranks are counted within chunks of slots and moved by the sum of the chunks before.
    """
    spark = aims.sparkSession
    by_code = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    shares = aims.where("target > 0").select("source", F.when(F.row_number().over(by_code) == F.count("*").over(W.partitionBy()), F.lit(1.0)).otherwise(F.sum("target").over(by_code) / F.sum("target").over(W.partitionBy())).alias("upto"), F.row_number().over(by_code).alias("k"))
    total = aims.agg(F.sum("target")).first()[0] or 0.0
    n = round(total / block)
    size = max(SLOT_CHUNK, math.isqrt(n))
    # the unit interval is cut into bins, more than sources; a slot meets the few sources of its bin
    bins = max(1024, 4 * aims.count())
    spans = shares.withColumn("lo", F.coalesce(F.lag("upto").over(W.orderBy("k")), F.lit(0.0)))
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.floor(F.least(F.col("upto"), F.lit(1.0)) * bins)))).select("bin", "lo", "upto", "source")
    slots = spark.range(0, n, 1, max(1, min(4096, -(-n // 65_536)))).select(F.col("id").alias("slot"), _point(F.col("id") + 1).alias("u"))
    met = slots.withColumn("bin", F.floor(F.col("u") * bins)).join(binned, "bin")
    found = met.where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("upto"))).select("slot", "source")
    chunked = found.withColumn("chunk", F.floor(F.col("slot") / size))
    counts = chunked.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    starts = counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("s"), F.col("chunk").alias("c"), "base")
    local = chunked.withColumn("r", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1)
    return local.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select("slot", "source", (F.col("base") + F.col("r")).alias("rank"))


def laid_out(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, key, source, size, copy, ...) -> with start: the document's first word in its source's hashed order.

    Prefix sums within (source, chunk of hashes), moved by the sum of the source's chunks before. Chunks are ranges
    of the hash, so how many there are does not change the order.
    """
    bits = max(CHUNK_BITS, docs.count().bit_length() // 2)
    marked = docs.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "key", "copy")).withColumn("_c", F.shiftright("_h", 64 - bits))
    sums = marked.groupBy("source", "_c").agg(F.sum("size").alias("n"))
    bases = sums.select(F.col("source").alias("_s"), F.col("_c").alias("_k"), F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("size").over(W.partitionBy("source", "_c").orderBy("_h", "doc_id", "key", "copy").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = marked.withColumn("_in", inner)
    return local.join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_k"))).withColumn("start", F.col("_base") + F.col("_in")).drop("_h", "_c", "_s", "_k", "_base", "_in")


def pieces(docs: DataFrame, aims: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, doc_id, key, size, copy, copies, pass, first, n): in slot order, the word ranges of documents that the mix reads (first from 0)."""
    slots = written(schedule(aims, block).select(F.col("source").alias("_s"), F.col("rank").alias("_r"), "slot"), "schedule")
    # the schedule gives each source so many blocks; what lies behind them is not read
    blocks = slots.groupBy("_s").agg(F.count("*").alias("_blocks"))
    placed = laid_out(docs).join(blocks, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    twice = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(REPEATS) - 1)))).withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    reach = twice.where(F.col("at") < F.col("_blocks") * block)
    cut = reach.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    lo, hi = F.greatest(F.col("at"), F.col("rank") * block), F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block)
    ranges = cut.select("source", "doc_id", "key", "size", "copy", "copies", "pass", "rank", (lo - F.col("at")).alias("first"), (hi - lo).alias("n"))
    return ranges.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_r"))).select("slot", "source", "doc_id", "key", "size", "copy", "copies", "pass", "first", "n")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(taken, pieces) of a document table.

    taken: doc_id, key (the XXH64 of the text), copy, source, size, source_size, target, taken, one row a document. Null or word-free
    texts have size 0 and are never taken. Null sources form one source, last in order. Rows that repeat a
    doc_id, source and text are told apart by `copy` (0, 1, ...) and count as documents of their own; other columns are left aside.
    An empty table gives empty tables. A source misses its target by the schedule's discrepancy alone, a few blocks.
    """
    body = F.col(text).cast("string")
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("key"), F.col(source).alias("source"), words(body).alias("size"))
    sized = written(sized.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("_n")).select("doc_id", "key", "source", "size", F.col("_n").alias("copies"), F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("copy")), "sizes")
    aims = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    told = sized.join(aims.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    read = pieces(told.drop("target"), aims, block)
    sums = read.groupBy("doc_id", "key", "copy", "source").agg(F.sum("n").alias("taken")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_n"), F.col("copy").alias("_k"), F.col("source").alias("_s"), "taken")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("copy") == F.col("_k")) & (F.col("key") == F.col("_n")) & F.col("source").eqNullSafe(F.col("_s"))
    return told.join(sums, same, "left").select("doc_id", "key", "copy", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), read


def times(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """docs with every row as often as the mix reads it: once for each pass that takes at least half its words. The columns stay as they are.

    Rows of equal doc_id, source and text share what is read of them evenly, the first by a hash of the row one more.
    """
    _, read = mix(docs, doc_id, source, text, block)
    passes = read.groupBy("doc_id", "key", "source", "size", "copy", "copies", "pass").agg(F.sum("n").alias("n")).where(F.col("n") * 2 >= F.col("size"))
    sums = passes.groupBy("doc_id", "key", "source", "copies").agg(F.count("*").alias("times"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.col(text).cast("string")).alias("k"), F.col(source).alias("s"))
    met = row.join(sums, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")) & F.col("s").eqNullSafe(F.col("source"))).select("row", "d", "k", "s", "times", "copies")
    alone, several = met.where("copies = 1"), met.where("copies > 1")
    nth = F.row_number().over(W.partitionBy("d", "k", "s").orderBy(F.xxhash64(F.to_json("row"))))  # maps have no hash
    several = several.withColumn("nth", nth).withColumn("times", (F.floor(F.col("times") / F.col("copies")) + (F.col("nth") <= F.col("times") % F.col("copies")).cast("int")).cast("long"))
    both = alone.select("row", "times").unionByName(several.where("times > 0").select("row", "times"))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass")).select("row.*")
