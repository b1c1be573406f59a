"""Row-local work on reads that keep arriving, with the same column functions as batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.quality import illumina_bin
from helixmill.operators.validate import problem


def arriving(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of reads as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def cleaned(reads: DataFrame, key: str = "read_idx", at: str = "loaded_at", late: str = "14 days") -> DataFrame:
    """First delivery of each read within the watermark, with carriage returns off, ``problem`` and binned qualities."""
    once = reads.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    text = once.withColumns({c: F.regexp_replace(c, "\r\\z", "") for c in ("id", "seq", "qual")})
    return text.withColumn("problem", problem()).withColumn("binned", illumina_bin("qual"))


def run_totals(reads: DataFrame, at: str = "loaded_at", window: str = "1 day") -> DataFrame:
    """Reads and bases per run and window of delivery."""
    return reads.groupBy(F.window(at, window).alias("w"), "run_id").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases")).select(F.col("w.start").alias("from_time"), "run_id", "reads", "bases")
