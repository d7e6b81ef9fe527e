"""Session settings every query relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch at most, and the setting's name.
BATCH_BYTES, BATCHES = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

SETTINGS = {
    BATCHES: str(BATCH_BYTES),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cpus: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName("quire")
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_batches(spark: SparkSession) -> None:
    """A batch between Spark and its Python workers holds at most BATCH_BYTES, however long its texts are, as a batch is held whole on both sides.

    `local_session` has this setting; a session of another making that allows more gets it from here on.
    """
    size = str(spark.conf.get(BATCHES, "64m")).lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size[-1:], 1)
    if not 0 < int(size.rstrip("kmg") or 0) * unit <= BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
