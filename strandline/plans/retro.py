"""Insertions of mobile elements from their hits: one row a variant, in layers that each read the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import monomers as M
from ..functions import sequence as S
from ..operators import chain as K
from ..operators import interval_join as J

#: Percent of an insert that must be resolved, by family where it differs.
LEAST_RESOLVED = 75
LEAST_RESOLVED_SVA = 50
#: Chains of hits to consensus and reference.
CHAIN_DISTANCE = 300
CHAIN_OVERLAP = 25


def candidates(variants: DataFrame) -> DataFrame:
    """variant_ord, strand and tail of inserts with a poly(A) tail or a poly(T) head, not both, that aren't homopolymers."""
    rows = variants.select("variant_ord", F.upper("alt").alias("seq"))
    rows = rows.withColumn("rc", S.reverse_complement("seq")).withColumns({"a": S.poly_tail("seq"), "t": S.poly_tail("rc")})
    rows = rows.where(F.col("a").isNotNull() != F.col("t").isNotNull())
    rows = rows.select("variant_ord", "seq", F.when(F.col("a").isNotNull(), "+").otherwise("-").alias("strand"), F.coalesce("a", "t").alias("tail"))
    return rows.where(~M.homopolymer("tail", "seq")).select("variant_ord", "strand", F.length("seq").cast("long").alias("ins_len"), (F.col("tail.end") - F.col("tail.beg")).alias("tail_len"))


def merged_hits(consensus: DataFrame, reference: DataFrame, max_percent: float = 10) -> DataFrame:
    """Hits to the consensus, then those to the reference that no consensus hit of their insert covers by max_percent.

    Both have q_name, hit_ord, q_beg, q_end, ...; adds ``src``, 0 for consensus, and the order ``ord``.
    """
    c = consensus.select(*[F.col(x).alias(f"{x}_c") for x in ("q_name", "q_beg", "q_end")])
    rest = J.anti_overlap(reference, c, ["q_name", "hit_ord"], ("q_name", "q_beg", "q_end"), ("q_name_c", "q_beg_c", "q_end_c"), max_percent, width=1 << 16)
    both = consensus.withColumn("src", F.lit(0)).unionByName(rest.withColumn("src", F.lit(1)))
    return both.withColumn("ord", F.col("src").cast("long") * (1 << 40) + F.col("hit_ord"))


def family(families: Column) -> Column:
    """Of the distinct families of a chain: SVA before others, a single one, else all of them joined."""
    return F.when(F.array_contains(families, "SVA"), "SVA").when(F.size(families) >= 1, F.array_join(F.array_sort(families), "-"))


def features(chains: DataFrame) -> DataFrame:
    """q_name and what the layers read of a chain: coverage, families, templates, hits by source."""
    of = lambda s: F.filter("chain", lambda x: x["src"] == s)
    return chains.select(
        "q_name",
        K.coverage(length=F.element_at("chain", 1)["q_len"]).alias("cov"),
        F.array_distinct(F.transform(of(0), lambda x: x["family"])).alias("families"),
        F.array_distinct(F.transform(of(1), lambda x: x["t_name"])).alias("loci"),
        F.element_at("chain", -1)["src"].alias("last_src"),
        F.element_at("chain", 1)["src"].alias("first_src"),
        K.conformation().alias("conformation"),
        "chain",
    )


def insertion_type(families: str = "families", loci: str = "loci", cov: str = "cov") -> Column:
    """orphan: one locus, no element, resolved well; solo, partnered and chimera by the element's families."""
    n, m = F.size(families), F.size(loci)
    several = (n > 1) & ~F.array_contains(families, "SVA")
    return F.when((n == 0) & (m == 1) & (F.col(cov) >= LEAST_RESOLVED), "orphan").when(several, "chimera").when((n >= 1) & (m == 0), "solo").when((n >= 1) & (m >= 1), "partnered")


def reject_reason(itype: str = "itype", fam: str = "family", resolved: str = "perc_resolved") -> Column:
    """Why a typed insertion fails, null if it passes; chimeras need not be resolved."""
    least = F.when(F.col(fam) == "SVA", LEAST_RESOLVED_SVA).otherwise(LEAST_RESOLVED)
    return (
        F.when(F.col(itype).isNull(), "UNK")
        .when((F.col(itype) != "chimera") & (F.col(resolved) < least), "PERC_RESOLVED")
        .when(F.col(fam) == "HERVK", "HERVK")
    )


def at_own_site(chain: str, chrom: str, pos: str, window: int) -> Column:
    """Whether a hit to the reference lies within ``window`` of the insertion's own place."""
    return F.exists(chain, lambda x: (x["src"] == 1) & (x["t_name"] == F.col(chrom)) & I.overlaps(x["t_beg"], x["t_end"], F.col(pos) - window, F.col(pos) + window))


def annotate(variants: DataFrame, consensus: DataFrame, reference: DataFrame, window: int = 1000) -> DataFrame:
    """variant_ord, itype, family, strand, cov, perc_resolved, conformation, failed: every candidate with hits."""
    hits = merged_hits(consensus, reference)
    carry = ["strand", "t_name", "t_beg", "t_end", "t_len", "q_len", "family", "src"]
    f = features(K.chain(hits, "q_name", "q_beg", "q_end", "ord", carry, CHAIN_DISTANCE, CHAIN_OVERLAP))
    rows = candidates(variants).join(variants.select("variant_ord", "chrom", "pos"), "variant_ord").join(f, F.col("variant_ord") == F.col("q_name"))
    rows = rows.withColumns({"itype": insertion_type(), "family": family(F.col("families"))})
    rows = rows.withColumn("perc_resolved", F.when(F.col("itype") == "chimera", 0.0).otherwise(F.least(F.col("cov") + F.col("tail_len") * 100 / F.col("ins_len"), F.lit(100.0))))
    own = at_own_site("chain", "chrom", "pos", window)
    failed = F.coalesce(reject_reason(), F.when((F.col("itype") == "partnered") & own, "OWN_SITE"))
    return rows.select("variant_ord", "itype", "family", "strand", "cov", "perc_resolved", "conformation", failed.alias("failed"))
