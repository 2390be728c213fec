"""Tests on variants of single cells: enrichment, clustering, haplotype bias, all without random state of a task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def binomial_enrichment(counts: DataFrame, by: list[str], n: str, length: str) -> DataFrame:
    """Adds expected, z and log2_enrichment of counts when a group's variants fall by length.

    The limit of many random placements: a binomial's mean and deviation.
    """
    w = Window.partitionBy(*by)
    share = F.col(length) / F.sum(length).over(w)
    total = F.sum(n).over(w)
    mean, std = total * share, F.sqrt(total * share * (1 - share))
    return counts.withColumn("expected", mean).withColumn("z", F.try_divide(F.col(n) - mean, std)).withColumn("log2_enrichment", F.when((F.col(n) > 0) & (mean > 0), F.log2(F.col(n) / mean)))


def _log_factorial(n: str) -> str:
    """ln n!: looked up below 16, else by Stirling's series, whose next term is under 3e-12 there; no sum over 1 to n."""
    n = f"CAST({n} AS DOUBLE)"
    small = ", ".join(f"{math.lgamma(k + 1)!r}D" for k in range(16))
    series = f"({n} + 0.5D) * ln({n}) - {n} + {math.log(2 * math.pi) / 2!r}D + (1 / 12D - (1 / 360D - 1 / 1260D / {n} / {n}) / {n} / {n}) / {n}"
    return f"CASE WHEN {n} < 16 THEN element_at(array({small}), CAST(greatest({n}, 0D) AS INT) + 1) ELSE {series} END"


def fisher_exact(a: str, b: str, c: str, d: str) -> Column:
    """Two-sided p of the table (a b; c d): the sum over tables as unlikely, or more, with the same margins."""
    r1, r2, c1 = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    low, high = f"greatest(0, {c1} - {r2})", f"least({r1}, {c1})"
    terms = [f"({r1} - x)", f"({c1} - x)", f"({r2} - {c1} + x)", "x"]
    weight = f"transform(sequence(CAST({low} AS INT), CAST({high} AS INT)), x -> -({' + '.join(map(_log_factorial, terms))}))"
    p = f"transform(array({weight}), l -> transform(array(array_max(l)), m -> transform(l, y -> exp(y - m)))[0])[0]"
    here = f"CAST({a} - {low} AS INT)"
    return F.expr(f"transform(array({p}), p -> aggregate(filter(p, y -> y <= p[{here}] * (1 + 1e-7D)), 0D, (s, y) -> s + y) / aggregate(p, 0D, (s, y) -> s + y))[0]")


def shuffled(svs: DataFrame, ref_length: Column, seed: int, copies: int = 1, key: str = "sv_id", by: list[str] | None = None) -> DataFrame:
    """Variants placed anew without overlap, their lengths kept, ``copies`` times; adds ``copy``.

    The variants of a group (``by``, else the chromosome) and copy take their turns in random order; each
    gets one of the places where it still fits, all equally likely, or goes if there is none. The
    generator's seed is a hash of seed, copy and group, so a lost task gives the same places again.
    """
    by, names = by or ["chrom"], svs.columns
    first = [key, "beg", "end_pos"]
    row = F.struct(*first, *[c for c in names if c not in first and c not in by])
    groups = svs.withColumn("n__", ref_length).groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows__"), F.max("n__").alias("n__"))
    groups = groups.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).repartition(*by, "copy")

    def starts(lengths, n, seed):
        import numpy as np

        rng = np.random.default_rng(seed % (1 << 64))
        at = [None] * len(lengths)
        beg, end = np.array([0]), np.array([n or 0])  # what is free
        for i in rng.permutation(len(lengths)):
            if lengths[i] is None:
                continue
            length = max(lengths[i], 0)
            room = np.maximum(end - beg - length, 0)
            upto = np.cumsum(room)
            if upto[-1] > 0:
                x = rng.integers(upto[-1])
                k = np.searchsorted(upto, x, side="right")
                at[i] = int(beg[k] + x - upto[k] + room[k])
                beg, end = np.insert(beg, k + 1, at[i] + length), np.insert(end, k, at[i])
        return at

    lengths = F.transform("rows__", lambda r: (r["end_pos"] - r["beg"]).cast("long"))
    at = F.udf(starts, "array<long>")(lengths, F.col("n__").cast("long"), F.xxhash64(F.lit(seed), "copy", *by))
    placed = groups.withColumn("at__", at).select(*by, "copy", F.inline(F.arrays_zip("rows__", "at__"))).where("at__ IS NOT NULL")
    new = {"beg": F.col("at__"), "end_pos": F.col("at__") + F.col("rows__.end_pos") - F.col("rows__.beg")}
    return placed.select(*[c if c in by else new.get(c, F.col(f"rows__.{c}")).alias(c) for c in names], "copy")


def ks_distance(values: DataFrame, by: list[str], value: str, is_first: str) -> DataFrame:
    """Greatest distance of two samples' distributions by group, with both sizes and the asymptotic p."""
    g = values.groupBy(*by, value).agg(F.count_if(F.col(is_first)).alias("x"), F.count_if(~F.col(is_first)).alias("y"))
    w = Window.partitionBy(*by)
    run = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = g.select(*by, F.sum("x").over(w).alias("n_x"), F.sum("y").over(w).alias("n_y"), (F.sum("x").over(run) / F.nullif(F.sum("x").over(w), F.lit(0)) - F.sum("y").over(run) / F.nullif(F.sum("y").over(w), F.lit(0))).alias("d"))
    out = d.groupBy(*by).agg(F.max("n_x").alias("n_x"), F.max("n_y").alias("n_y"), F.max(F.abs("d")).alias("distance"))
    lam = "sqrt(n_x * n_y / (n_x + n_y)) * distance"
    tail = f"least(1D, 2 * aggregate(sequence(1, 100), 0D, (s, k) -> s + (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * pow({lam}, 2))))"
    return out.withColumn("p", F.expr(f"CASE WHEN {lam} < 0.2 THEN 1D ELSE {tail} END"))


def _gaps(svs: DataFrame, by: list[str], more: list[str]) -> DataFrame:
    after = F.lead("beg").over(Window.partitionBy(*by, *more).orderBy("beg", "sv_id"))
    return svs.select(*by, (after - F.col("end_pos")).alias("gap")).where("gap IS NOT NULL").withColumn("gap", F.greatest("gap", F.lit(1)))


def gap_clustering(svs: DataFrame, by: list[str], ref_length: Column, seed: int, copies: int = 100) -> DataFrame:
    """by, n, distance, p and score: whether gaps between variants are smaller than in random placements without overlap.

    score is -log2 of the observed median gap over the random one (gaps of 1 at least).
    """
    own = _gaps(svs, by, []).withColumn("seen", F.lit(True))
    placed = _gaps(shuffled(svs, ref_length, seed, copies, by=by), by, ["copy"]).withColumn("seen", F.lit(False))
    both = own.unionByName(placed)
    medians = both.groupBy(*by).agg(F.median(F.when(F.col("seen"), F.col("gap"))).alias("m"), F.median(F.when(~F.col("seen"), F.col("gap"))).alias("r"))
    ks = ks_distance(both, by, "gap", "seen")
    return ks.join(medians, by).select(*by, F.col("n_x").alias("n"), "distance", "p", (-F.log2(F.col("m") / F.col("r"))).alias("score"))


def random_chromosome(key: str, lengths: dict[str, int], seed: int) -> Column:
    """A chromosome for each row, as likely as it is long; the same for the same key and seed. ``lengths`` has a genome's few contigs."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    total, upto, out = sum(lengths.values()), 0, None
    for name, n in lengths.items():
        upto += n
        out = F.when(u < upto / total, name) if out is None else out.when(u < upto / total, name)
    return out.otherwise(list(lengths)[-1])
