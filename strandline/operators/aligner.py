"""Seed and chain of sequences to targets, where no aligner has been run: hits as a table.

The index is the targets' k-mers, those of too many places left out, as aligners do. Queries meet it by a
join on the k-mer; matches on one diagonal with small gaps are a hit. For more distant hits, read an
aligner's PAF, PSL or SAM instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kmers(seqs: DataFrame, name: str, pos: str, k: int) -> DataFrame:
    """name, pos (0-based) and k of every k-mer; a sequence is passed once."""
    return seqs.select(name, F.posexplode(F.expr(f"regexp_extract_all(seq, '(?=(.{{{k}}}))', 1)")).alias(pos, "k"))


def seed_hits(queries: DataFrame, targets: DataFrame, k: int = 24, max_gap: int = 10, least_seeds: int = 5, most_places: int = 50) -> DataFrame:
    """q_name, t_name, q_beg, q_end, t_beg, t_end, n_seeds of forward hits; ``queries`` and ``targets`` have q_name or t_name, and seq.

    ``most_places``: k-mers that the targets have more often aren't seeds.
    """
    index = kmers(targets, "t_name", "t_pos", k)
    rare = index.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_places).select("k")
    seeds = kmers(queries, "q_name", "q_pos", k).join(index.join(rare, "k"), "k").select("q_name", "t_name", (F.col("q_pos") - F.col("t_pos")).cast("long").alias("d"), F.col("q_pos").cast("long").alias("q_pos"))
    w = Window.partitionBy("q_name", "t_name", "d").orderBy("q_pos")
    new = F.when(F.col("q_pos") - F.lag("q_pos").over(w) <= max_gap, 0).otherwise(1)
    runs = seeds.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hits = runs.groupBy("q_name", "t_name", "d", "run").agg(F.min("q_pos").alias("q_beg"), (F.max("q_pos") + k).alias("q_end"), F.count(F.lit(1)).alias("n_seeds"))
    hits = hits.where(F.col("n_seeds") >= least_seeds)
    return hits.select("q_name", "t_name", "q_beg", "q_end", (F.col("q_beg") - F.col("d")).alias("t_beg"), (F.col("q_end") - F.col("d")).alias("t_end"), "n_seeds")
