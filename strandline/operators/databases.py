"""Reference sequences and call sets put together for annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import vcf
from . import interval_join as J


def transduction_records(rows: DataFrame) -> DataFrame:
    """A record for each transduced piece (``td_seqs``: comma-separated), numbered from 1 on; rows without any give none."""
    parts = rows.where("td_n > 0").select("id", F.posexplode(F.split("td_seqs", ",")).alias("i", "seq"))
    return parts.select(F.concat_ws("_", "id", (F.col("i") + 1).cast("string")).alias("seq_id"), "seq")


def consensus_records(seqs: DataFrame, families: DataFrame) -> DataFrame:
    """consensus|family|subfamily without the tail of A's; ``seqs`` are named subfamily#..., ``families`` has subfamily and family."""
    named = seqs.select(F.substring_index("seq_id", "#", 1).alias("subfamily"), "seq").join(families, "subfamily")
    return named.select(F.concat_ws("|", F.lit("consensus"), "family", "subfamily").alias("seq_id"), F.regexp_replace("seq", "[Aa]+$", "").alias("seq"))


def transduced_records(windows: DataFrame, contigs: DataFrame, chunk: int) -> DataFrame:
    """transduced|family|cytoband|ref:beg-end and the genome's bases there.

    ``contigs`` holds the genome in chunks (ref, chunk, seq) of a fixed length, so a window meets a few rows
    of bounded size, whatever the contig's length.
    """
    rows = windows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("td_beg") / chunk), F.floor((F.col("td_end") - 1) / chunk))))
    rows = rows.join(contigs, ["ref", "chunk"])
    at = F.col("chunk") * chunk
    beg, end = F.greatest(F.col("td_beg") - at, F.lit(0)), F.least(F.col("td_end") - at, F.lit(chunk))
    rows = rows.withColumn("part", F.substring("seq", (beg + 1).cast("int"), (end - beg).cast("int")))
    whole = rows.groupBy("family", "cytoband", "ref", "td_beg", "td_end").agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    name = F.concat_ws("|", F.lit("transduced"), "family", "cytoband", F.concat(F.col("ref"), F.lit(":"), F.col("td_beg").cast("string"), F.lit("-"), F.col("td_end").cast("string")))
    return whole.select(name.alias("seq_id"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("seq"))


def type_label(itype: Column, family: Column) -> Column:
    """ITYPE, with the family where there is one."""
    return F.concat_ws("-", itype, family)


def known_insertions(variants: DataFrame, buffer: int) -> DataFrame:
    """Called insertions as intervals with their labels, for joins."""
    return variants.select("ref", (F.col("pos") - buffer).alias("beg"), (F.col("pos") + buffer).alias("end_pos"), "label")


def annotated_with(calls: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key and the labels of known insertions at a call's place, without pairs."""
    at = ("ref", "beg", "end_pos")
    return J.labels_met(calls, known, [key], at, at, "label")


def majority(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and the most frequent value, the first by name of several, with its count."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg"), value)).alias("x")).select(*by, F.col(f"x.{value}").alias(value), (-F.col("x.neg")).alias("n"))


def call_lines(calls: DataFrame, info: dict[str, Column], flags: set[str] = frozenset()) -> Column:
    """VCF lines of calls: begin as position, INFO keys in order."""
    return vcf.line("ref", "beg", F.lit("."), F.lit("N"), F.concat(F.lit("<"), F.col("sv_type"), F.lit(">")), F.lit("."), F.lit("PASS"), vcf.info_text(info, flags))


def consensus_bases(rows: DataFrame, by: list[str]) -> DataFrame:
    """The majority base at each place of aligned sequences (by, place, base), joined; gaps ('-') that win are left out."""
    best = majority(rows, [*by, "place"], "base")
    return best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "base"))).alias("b")).select(*by, F.array_join(F.filter(F.transform("b", lambda x: x["base"]), lambda x: x != "-"), "").alias("consensus"))
