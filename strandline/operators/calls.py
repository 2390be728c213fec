"""Verdicts on clusters and chains as columns: kinds of variants, mobile elements, mechanisms, tandem repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Families whose reads on both sides make a solo insertion.
ELEMENTS = ["L1", "Alu", "SVA"]
#: Fixed value: the repeat class of a poly(A) tail.
TAIL = "Simple_repeat"
#: Codes of substitutions, from 1 on in this order.
SUBSTITUTIONS = ["A->T", "A->G", "A->C", "T->A", "T->G", "T->C", "G->A", "G->T", "G->C", "C->A", "C->T", "C->G"]


def sv_type(types: Column, spanned: Column | None = None) -> Column:
    """Kind of variant from the set of a cluster's event types; clips on both sides need ``spanned`` for an insertion."""
    has = lambda t: F.array_contains(types, t)
    right, left, n = has("RIGHT-CLIPPING"), has("LEFT-CLIPPING"), F.size(types)
    both = F.when(F.coalesce(spanned, F.lit(False)), "INS").otherwise("INS_noOverlap") if spanned is not None else F.lit("INS_noOverlap")
    return F.when(has("INS") & ~has("DEL"), "INS").when(has("DEL") & ~has("INS"), "DEL").when((n == 2) & right & left, both).when((n == 1) & (right | left), "BND")


def majority_identity(mates: DataFrame, by: list[str]) -> DataFrame:
    """For each cluster, the identity that most mates of an orientation have: plus_id, plus_src, minus_id, minus_src.

    ``mates`` has orientation, identity and src (a transduction's source element with its end, null for others).
    Ties go by name.
    """
    n = mates.where("identity IS NOT NULL").groupBy(*by, "orientation", "identity", "src").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*by, "orientation").agg(F.min(F.struct((-F.col("n")).alias("n"), "identity", F.coalesce("src", F.lit("")).alias("src"))).alias("x"))
    side = lambda o, c: F.max(F.when(F.col("orientation") == o, F.nullif(F.col(f"x.{c}"), F.lit(""))))
    return best.groupBy(*by).agg(*[side(o, c).alias(f"{o.lower()}_{k}") for o in ("PLUS", "MINUS") for c, k in (("identity", "id"), ("src", "src"))])


def insertion_by_mates(plus: str = "plus_id", minus: str = "minus_id", plus_src: str = "plus_src", minus_src: str = "minus_src") -> tuple[Column, Column]:
    """(identity, type) of an insertion by what the mates on both sides are."""
    p, m, ps, ms = map(F.col, (plus, minus, plus_src, minus_src))
    both, agree = p.isNotNull() & m.isNotNull(), F.col(plus) == F.col(minus)
    n_src = ps.isNotNull().cast("int") + ms.isNotNull().cast("int")
    tail = (p == TAIL) | (m == TAIL)
    rest = F.when(p == TAIL, m).otherwise(p)
    same = F.when(n_src == 0, F.when(p.isin(*ELEMENTS, TAIL), "TD0").otherwise("PSD")).when(n_src == 1, "TD1").when(ps == ms, "TD2").otherwise("UNRESOLVED-TD")
    with_tail = F.when(rest.isin(*ELEMENTS), F.when(n_src > 0, "TD2").otherwise("TD0-TD1")).otherwise("PSD")
    kind = F.when(both & agree, same).when(both & tail, with_tail).when(both, "UNDEFINED").when(p.isNotNull() | m.isNotNull(), "RG")
    identity = F.when(both & agree, F.when((p == TAIL) & (n_src == 0), "pA").otherwise(p)).when(both & tail, rest).when(both, F.concat_ws("_", p, m)).otherwise(F.coalesce(p, m))
    return identity, kind


def element_lengths(chain: str = "chain", strand: str = "strand") -> Column:
    """struct(beg, end, len, is_full, trunc5, trunc3, inversion) of a chain's hits over one consensus."""
    beg, end = F.array_min(F.transform(chain, lambda h: h["t_beg"])), F.array_max(F.transform(chain, lambda h: h["t_end"]))
    size = F.element_at(chain, 1)["t_len"]
    turned = F.filter(chain, lambda h: h["strand"] != F.col(strand))
    inversion = F.when(F.size(turned) > 0, F.aggregate(turned, F.lit(0).cast("long"), lambda a, h: a + h["t_end"] - h["t_beg"]))
    return F.struct(beg.alias("beg"), end.alias("end"), (end - beg).alias("len"), ((end - beg) * 100 >= size * 95).alias("is_full"), beg.alias("trunc5"), (size - end).alias("trunc3"), inversion.alias("inversion"))


def mechanism(cov: Column, trunc3: Column, tail: Column) -> Column:
    """TPRT with a tail and little lost at the 3' end, EI without a tail and much lost, else unknown."""
    little = F.coalesce(trunc3 <= 100, F.lit(True))
    return F.when(little & tail, "TPRT").when((cov >= 95) & ~little & ~tail, "EI").otherwise("unknown")


def hexamer_calls(calls: DataFrame, strand: Column, seq_len: Column, within: int = 300) -> DataFrame:
    """Repeat calls that may be a hexamer: rich in C and T near the begin, or in G and A near the end of the other strand."""
    plus = (strand == "+") & (F.col("beg") < within) & (F.col("perc_c") > 50) & (F.col("perc_t") > 20)
    minus = (strand == "-") & (seq_len - F.col("end") < within) & (F.col("perc_g") > 50) & (F.col("perc_a") > 20)
    return calls.where((plus | minus) & (F.length("tr_seq") > 10))


def without_span(seq: str, beg: str, end: str) -> Column:
    """A sequence without [beg, end)."""
    return F.expr(f"concat(left({seq}, CAST({beg} AS INT)), substring({seq}, CAST({end} + 1 AS INT)))")


def substitution_code(ref: Column, alt: Column) -> Column:
    """1 to 12 by the two bases, null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SUBSTITUTIONS)), F.concat(ref, F.lit("->"), alt)), F.lit(0).cast("long")).cast("int")


def status(ref: Column, alt: Column) -> Column:
    """What a haplotype has at a place: a substitution's code, '-' and the lost bases, '+' and the inserted ones."""
    lost = F.when((F.length(ref) > F.length(alt)) & ref.startswith(alt), F.concat(F.lit("-"), ref))
    return F.coalesce(substitution_code(ref, alt).cast("string"), lost, F.when((F.length(alt) > F.length(ref)) & alt.startswith(ref), F.concat(F.lit("+"), alt)))


def dense_windows(svs: DataFrame, by: list[str], width: int, least: int = 4) -> DataFrame:
    """Windows with enough variants whose median gap is not positive: by, win, n, median_gap."""
    w = Window.partitionBy(*by, "win").orderBy("beg", "sv_id")
    rows = svs.withColumn("win", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor(F.col("end_pos") / width))))
    rows = rows.withColumn("gap", F.lead("beg").over(w) - F.col("end_pos"))
    return rows.groupBy(*by, "win").agg(F.count(F.lit(1)).alias("n"), F.median("gap").alias("median_gap")).where((F.col("n") >= least) & (F.col("median_gap") <= 0))
