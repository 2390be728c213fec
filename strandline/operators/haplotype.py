"""Haplotypes in long form: (sample, position, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diagnostic_scores(haplotypes: DataFrame) -> DataFrame:
    """1 less the share of the samples that have the value at the position."""
    w = Window.partitionBy("position")
    same = F.count(F.lit(1)).over(Window.partitionBy("position", "status"))
    return haplotypes.withColumn("score", 1 - same / F.count(F.lit(1)).over(w))


def compare(targets: DataFrame, refs: DataFrame) -> DataFrame:
    """(target, reference, score in 0..1): agreeing less disagreeing scores over shared positions, of all of the reference's."""
    top = refs.groupBy(F.col("sample_id").alias("ref_id")).agg(F.sum("score").alias("top"))
    t = targets.select(F.col("sample_id").alias("target_id"), "position", F.col("status").alias("t_status"))
    r = refs.select(F.col("sample_id").alias("ref_id"), "position", "status", "score")
    sums = t.join(r, "position").groupBy("target_id", "ref_id").agg(F.sum(F.when(F.col("t_status") == F.col("status"), F.col("score")).otherwise(-F.col("score"))).alias("sum"))
    return sums.join(top, "ref_id").select("target_id", "ref_id", F.round((F.try_divide("sum", "top") + 1) / 2, 2).alias("score"))


def assign(scores: DataFrame, least_log: float = 0.08) -> DataFrame:
    """The reference of the only best score, if log2 of its ratio to the next score is enough."""
    w = Window.partitionBy("target_id")
    ranked = scores.withColumn("best", F.max("score").over(w))
    out = ranked.groupBy("target_id").agg(
        F.max("best").alias("best"), F.count_if(F.col("score") == F.col("best")).alias("n_best"), F.min(F.when(F.col("score") == F.col("best"), F.col("ref_id"))).alias("ref_id"), F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("second")
    )
    ok = (F.col("n_best") == 1) & (F.col("second") > 0) & (F.round(F.log2(F.try_divide("best", "second")), 2) >= least_log)
    return out.select("target_id", F.when(ok, F.col("ref_id")).alias("assigned"), "best", "second")


def informative(haplotypes: DataFrame) -> DataFrame:
    """Without the positions at which all samples agree."""
    told = haplotypes.groupBy("position").agg(F.min("status").alias("a"), F.max("status").alias("b")).where("a <> b").select("position")
    return haplotypes.join(told, "position", "left_semi")


def _profiles(haplotypes: DataFrame) -> DataFrame:
    """sample_id and profile, all its positions with their values."""
    return haplotypes.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("position", "status"))).alias("profile"))


def assign_to_others(haplotypes: DataFrame, least_log: float = 0.08) -> DataFrame:
    """``assign`` of every sample to one of all others (target_id, assigned, best, second), by profiles instead of samples.

    Samples of one profile score alike, against all others and as references: profiles are compared, each as
    often as it occurs. Only a sample's own profile has one reference less, the sample itself, so it counts
    where another sample has it too, under the least other name.
    """
    named = _profiles(haplotypes)
    groups = named.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first"))
    others = named.join(groups, "profile").where("sample_id > first").groupBy("first").agg(F.min("sample_id").alias("next"))
    groups = groups.join(others, "first", "left").drop("profile")
    first = groups.select(F.col("first").alias("sample_id"))
    # scores are those of all samples; one sample stands for its profile
    scored = diagnostic_scores(haplotypes).join(first, "sample_id", "left_semi")
    scores = compare(haplotypes.join(first, "sample_id", "left_semi"), scored)
    refs = groups.select(F.col("first").alias("ref_id"), "n", "next")
    rows = scores.join(refs, "ref_id").withColumn("own", F.col("target_id") == F.col("ref_id")).where("NOT own OR n > 1")
    rows = rows.withColumn("n", F.col("n") - F.col("own").cast("int"))
    w = Window.partitionBy("target_id")
    is_best = F.col("score") == F.col("best")
    per = rows.withColumn("best", F.max("score").over(w)).groupBy("target_id").agg(
        F.max("best").alias("best"),
        F.sum(F.when(is_best, F.col("n"))).alias("n_best"),
        F.min(F.when(is_best & ~F.col("own"), F.col("ref_id"))).alias("other_id"),
        F.max(F.when(is_best & F.col("own"), F.col("next"))).alias("next"),
        F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("second"),
    )
    members = named.join(groups.join(named.select(F.col("sample_id").alias("first"), "profile"), "first").select("profile", "first"), "profile").select(F.col("sample_id").alias("member"), F.col("first").alias("target_id"))
    ok = (F.col("n_best") == 1) & (F.col("second") > 0) & (F.round(F.log2(F.try_divide("best", "second")), 2) >= least_log)
    # of a profile's members all but the first have the first as their least namesake
    same = F.when(F.col("next").isNotNull(), F.when(F.col("member") == F.col("target_id"), F.col("next")).otherwise(F.col("target_id")))
    return members.join(per, "target_id").select(F.col("member").alias("target_id"), F.when(ok, F.least("other_id", same)).alias("assigned"), "best", "second")
