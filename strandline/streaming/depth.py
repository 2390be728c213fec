"""Read depth of a stream of alignments, and new variants met with known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depth_by_time(reads: DataFrame, time: str, late: str, span: str, width: int, least_mapq: int = 10) -> DataFrame:
    """Reads by reference, bin and time window; a window is given out when ``late`` has passed its end.

    Rows of duplicates and of low quality don't count. State is one count a window, reference
    and bin, dropped with the watermark.
    """
    kept = reads.where((F.col("mapq") >= least_mapq) & ~F.col("is_dup")).withWatermark(time, late)
    bins = kept.groupBy(F.window(time, span), "ref", F.floor(F.col("beg") / width).alias("bin"))
    out = bins.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("orientation") == "PLUS").alias("watson"), F.count_if(F.col("orientation") == "MINUS").alias("crick"))
    return out.select(F.col("window.start").alias("window_beg"), "ref", "bin", "total", "watson", "crick")


def first_of_each(variants: DataFrame, time: str, late: str, key: list[str]) -> DataFrame:
    """Each variant once while the watermark remembers it."""
    return variants.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
