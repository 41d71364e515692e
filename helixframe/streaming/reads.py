"""Running statistics of reads that come in as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.scratch import ship
from helixframe.sources import fastx


def running_stats(spark: SparkSession, folder: str, form: str = "fastq") -> DataFrame:
    """A streaming table with one row for each file: reads, clean ones, and the longest."""
    ship(spark)
    rows = fastx.stream(spark, folder, form)
    return rows.groupBy("file").agg(F.count("*").alias("num_reads"), F.count(F.when(~seq.has_n(F.col("seq")), 1)).alias("num_clean"), F.max(F.length("seq")).alias("max_len"))
