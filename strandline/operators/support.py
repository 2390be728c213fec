"""Aggregates of read support: depth, breakpoints, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_depth(reads: DataFrame, width: int, bins: DataFrame, least_mapq: int = 0, skip_duplicates: bool = True) -> DataFrame:
    """Reads in total and by strand for each bin of ``bins`` (ref, bin), zero where there are none."""
    good = reads.where(F.col("mapq") >= least_mapq)
    good = good.where(~F.col("is_dup")) if skip_duplicates else good
    found = good.groupBy("ref", F.floor(F.col("beg") / width).alias("bin")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("orientation") == "PLUS").alias("watson"), F.count_if(F.col("orientation") == "MINUS").alias("crick")
    )
    return bins.join(found, ["ref", "bin"], "left").fillna(0, ["total", "watson", "crick"])


def modal_position(events: DataFrame, by: list[str], pos: str) -> DataFrame:
    """The most frequent position, the smallest of several: by, position, n."""
    counts = events.groupBy(*by, F.col(pos).alias("position")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg"), "position")).alias("best")).select(*by, F.col("best.position").alias("position"), (-F.col("best.neg")).alias("n"))


def failed(**tests: Column) -> Column:
    """Names of the filters whose test isn't true, in order of naming."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in tests.items()]))


def mutation_origin(tumour: Column, normal: Column, least: int, least_normal: int) -> Column:
    return (
        F.when((tumour >= least) & (normal >= least_normal), "germline")
        .when(tumour >= least, "somatic-tumour")
        .when(normal >= least_normal, "somatic-normal")
    )


def variation_percent(x: str) -> Column:
    """Population standard deviation in percent of the mean."""
    return F.stddev_pop(x) / F.avg(x) * 100


def median_member(events: DataFrame, by: list[str], size: str, ties: list[str]) -> DataFrame:
    """The upper-median event of each group by size."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(size, *ties))
    return events.withColumn("rank__", rank).withColumn("n__", F.count(F.lit(1)).over(w)).where(F.col("rank__") == F.ceil((F.col("n__") - 1) / 2) + 1).drop("rank__", "n__")


def breakpoint(events: DataFrame, by: list[str], pos: str) -> DataFrame:
    """by, position, n: the best supported position; of several the nearest to the median of all, then the smallest."""
    middle = events.groupBy(*by).agg(F.floor(F.median(pos)).alias("middle"))
    counts = events.groupBy(*by, F.col(pos).alias("position")).agg(F.count(F.lit(1)).alias("n")).join(middle, by)
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.abs(F.col("position") - F.col("middle")).alias("apart"), "position")).alias("x"))
    return best.select(*by, F.col("x.position").alias("position"), (-F.col("x.neg")).alias("n"))


def supported_pairs(pairs: DataFrame, reads: DataFrame, key: str, least: int, least_percent: float) -> DataFrame:
    """Pairs of clusters (a, b, read_name) that share enough reads, and enough of both clusters' reads: a, b, n_reads."""
    total = reads.groupBy(key).agg(F.count_distinct("read_name").alias("total"))
    n = pairs.groupBy("a", "b").agg(F.count_distinct("read_name").alias("n_reads")).where(F.col("n_reads") >= least)
    for side in ("a", "b"):
        n = n.join(total.select(F.col(key).alias(side), F.col("total").alias(f"of_{side}")), side)
    return n.where((F.col("n_reads") * 100 >= least_percent * F.col("of_a")) & (F.col("n_reads") * 100 >= least_percent * F.col("of_b"))).select("a", "b", "n_reads")


#: 0.975 quantiles of Student's t for 1 to 9 degrees of freedom.
T_975 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157]


def t_quantile(df: str) -> str:
    """SQL of the 0.975 quantile of Student's t: the fixed values, and from 10 degrees of freedom on the normal one corrected by powers of 1 / df."""
    z = 1.959963985
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    series = " + ".join([f"{z}e0", *[f"{x:.9f}e0 / power({df}, {k})" for k, x in enumerate(terms, 1)]])
    return "CASE " + " ".join(f"WHEN {df} = {k} THEN {x}e0" for k, x in enumerate(T_975, 1)) + f" ELSE {series} END"


def mean_position(events: DataFrame, by: list[str], pos: str) -> DataFrame:
    """by, position (the mean, cut off), and the 95 % confidence interval's begin and end relative to it."""
    s = events.groupBy(*by).agg(F.floor(F.avg(pos)).alias("position"), F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp(pos), F.lit(0.0)).alias("sd"))
    wide = F.when(F.col("n") > 1, F.floor(F.expr(t_quantile("(n - 1)")) * F.col("sd") / F.sqrt("n"))).otherwise(0).cast("long")
    return s.select(*by, "position", (-wide).alias("ci_beg"), wide.alias("ci_end"))
