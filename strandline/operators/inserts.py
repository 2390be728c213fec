"""What an insert's chain of hits says of it: transductions, templated and nested parts, structures, kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from . import chain as K
from . import interval_join as J

#: Repeat classes whose expansion is a kind of insertion.
EXPANDING = ["Low_complexity", "Simple_repeat", "Satellite", "telo", "centr", "acro"]


def coordinates(chain: str, with_strand: bool = False) -> Column:
    """name:begin-end of a chain's hits, comma-separated; with _strand if asked."""
    one = lambda x: F.concat(x["t_name"], F.lit(":"), x["t_beg"].cast("string"), F.lit("-"), x["t_end"].cast("string"), *([F.lit("_"), x["strand"]] if with_strand else []))
    return F.array_join(F.transform(chain, one), ",")


def unaligned_end(chains: DataFrame, key: str, side: str) -> DataFrame:
    """key, free_beg, free_end: the insert's part before the first hit of its chain (5), or behind the last one (3)."""
    first, last = F.element_at("chain", 1), F.element_at("chain", -1)
    free = (F.lit(0).cast("long"), first["beg"]) if side == "5" else (last["end"], last["q_len"])
    return chains.select(key, free[0].alias("free_beg"), free[1].alias("free_end"))


def transductions(free: DataFrame, reference: DataFrame, key: str, order: str, carry: list[str], least_len: int = 10, least_percent: float = 25) -> DataFrame:
    """key, n, coords and percent of the transduction in an unaligned end: the chain of the reference's hits that touch it.

    ``free`` has key, free_beg and free_end; shorter ends, and chains that cover too little of it, have none.
    """
    long = free.where(F.col("free_end") - F.col("free_beg") >= least_len)
    met = reference.join(long, key).where(I.overlaps("q_beg", "q_end", "free_beg", "free_end"))
    chains = K.chain(met, key, "q_beg", "q_end", order, carry, 10, 25).join(long, key)
    beg, end = F.element_at("chain", 1)["beg"], F.element_at("chain", -1)["end"]
    percent = I.overlap_length("free_beg", "free_end", beg, end) / (F.col("free_end") - F.col("free_beg")) * 100
    return chains.withColumn("percent", percent).where(F.col("percent") >= least_percent)


def templated(chains: DataFrame, chrom: str, pos: str, reach: int = 50_000) -> DataFrame:
    """Adds temp5, temp3 and temp_in: coordinates of hits next to the insertion's own place, at the chain's ends or inside."""
    near = lambda x: (x["t_name"] == F.col(chrom)) & I.overlaps(x["t_beg"], x["t_end"], F.col(pos) - reach, F.col(pos) + reach)
    show = lambda x: F.concat(x["t_name"], F.lit(":"), x["t_beg"].cast("string"), F.lit("-"), x["t_end"].cast("string"))
    n = F.size("chain")
    first, last = F.element_at("chain", 1), F.element_at("chain", -1)
    inner = F.filter(F.slice("chain", F.lit(2), F.greatest(n - 2, F.lit(0))), near)
    return chains.withColumns({"temp5": F.when(near(first), show(first)), "temp3": F.when((n > 1) & near(last), show(last)), "temp_in": F.when(F.size(inner) > 0, show(F.element_at(inner, -1)))})


def own_locus_duplications(hits: DataFrame, key: str, order: str, carry: list[str], chrom: str, pos: str, reach: int = 1000, least_percent: float = 50, least_mapq: int = 0) -> DataFrame:
    """key, dup_type and coords of inserts whose hits at their own locus chain up to enough of them."""
    near = hits.where((F.col("t_name") == F.col(chrom)) & (F.col("mapq") >= least_mapq) & I.overlaps("t_beg", "t_end", F.col(pos) - reach, F.col(pos) + reach))
    chains = K.chain(near, key, "q_beg", "q_end", order, carry, 10, 25)
    return chains.where(K.coverage(length=F.element_at("chain", 1)["q_len"]) >= least_percent).select(key, K.duplication_type().alias("dup_type"), coordinates("chain", True).alias("coords"))


def nested(chains: DataFrame, key: str, family, least_percent: float = 80) -> DataFrame:
    """key, families, coords and mapqs of ends that a consensus covers well, up to its own end."""
    whole = (K.coverage(length=F.element_at("chain", 1)["q_len"]) > least_percent) & ~K.conformation().endswith("TRUN")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("chain", family))), ",")
    return chains.where(whole).select(key, families.alias("families"), coordinates("chain").alias("coords"), F.array_join(F.transform("chain", lambda x: x["mapq"].cast("string")), ",").alias("mapqs"))


def decorated(conformation: Column, td5: Column, td3: Column, nested_family: Column, temp5: Column, temp3: Column, tail: Column, hexamer: Column | None = None) -> Column:
    """A structure with what lies around it, from the inside out: hexamer, transductions, nested and templated parts, tail."""
    opt = lambda when, x: F.when(F.coalesce(when, F.lit(False)), x).otherwise("")
    many = lambda x, n: F.repeat(F.lit(x), F.coalesce(n, F.lit(0)).cast("int"))
    head = opt(hexamer, "Hexamer+") if hexamer is not None else F.lit("")
    return F.concat(opt(temp5, "TEMPLATED+"), many("TD+", td5), head, conformation, many("+POLYA+TD", td3), F.coalesce(F.concat(F.lit("+POLYA+"), nested_family), F.lit("")), opt(temp3, "+TEMPLATED"), opt(tail, "+POLYA"))


def feature_order(chain: str, feature) -> Column:
    """The distinct features of a chain's hits in order, joined by +."""
    return F.array_join(F.array_distinct(F.transform(chain, feature)), "+")


def feature_span(chain: str, feature, name: str) -> Column:
    """struct(beg, end, len) from the first to the last hit of a feature, null without one."""
    mine = F.filter(chain, lambda x: feature(x) == name)
    beg, end = F.element_at(mine, 1)["beg"], F.element_at(mine, -1)["end"]
    return F.when(F.size(mine) > 0, F.struct(beg.alias("beg"), end.alias("end"), (end - beg).alias("len")))


def strand_by_alignment(chain: str = "chain") -> Column:
    """The strand of the hit that ends last on its template, the first of several."""
    best = F.reduce(chain, F.element_at(chain, 1), lambda a, x: F.when(x["t_end"] > a["t_end"], x).otherwise(a))
    return best["strand"]


def infer_strand(tail: Column, by_alignment: Column) -> Column:
    """The tail's strand before the alignment's."""
    return F.coalesce(tail, by_alignment)


def duplication_share(calls: DataFrame, hits: DataFrame, key: str, buffer: int = 100, least: float = 40) -> DataFrame:
    """key, percent and is_dup: hits of an insert at its own call's place, as a share of the insert."""
    n = I.overlap_length(F.col("beg") - buffer, F.col("end_pos") + buffer, "t_beg", "t_end")
    met = calls.join(hits, key).where((F.col("t_name") == F.col("ref")) & (n > 0))
    out = met.groupBy(key).agg(F.least(F.sum(n * 100 / F.col("q_len")), F.lit(100.0)).alias("percent"))
    out = calls.select(key).join(out, key, "left").fillna(0.0, ["percent"])
    return out.withColumn("is_dup", F.col("percent") >= least)


def repeat_share(hits: DataFrame, repeats: DataFrame, wanted: DataFrame, key: str, least: float = 40) -> DataFrame:
    """key, percent and is_expansion: the share of an insert that hits repeats of the classes at its own place (``wanted``: key, family)."""
    met = J.interval_join(hits, repeats, ("t_name", "t_beg", "t_end"), ("r_ref", "r_beg", "r_end"))
    met = met.join(wanted.where(F.col("family").isin(EXPANDING)).withColumnRenamed("family", "r_family"), [key, "r_family"])
    out = met.groupBy(key).agg(F.least(F.sum(I.overlap_length("t_beg", "t_end", "r_beg", "r_end") * 100 / F.col("q_len")), F.lit(100.0)).alias("percent"))
    return out.withColumn("is_expansion", F.col("percent") >= least)


def pseudogene_share(hits: DataFrame, exons: DataFrame, key: str, order: str) -> DataFrame:
    """key, n_exons, percent and genes: of each hit the exon that it shares most with, summed over an insert."""
    hits = hits.select(key, order, "t_name", "t_beg", "t_end", "q_len")
    best = J.best_overlap(hits, exons, [key, order], ("t_name", "t_beg", "t_end"), ("x_ref", "x_beg", "x_end"), ties=["x_beg", "gene"])
    n = I.overlap_length("t_beg", "t_end", "x_beg", "x_end")
    return best.groupBy(key).agg(F.count(F.lit(1)).alias("n_exons"), F.least(F.sum(n * 100 / F.col("q_len")), F.lit(100.0)).alias("percent"), F.array_sort(F.collect_set("gene")).alias("genes"))


def interspersed(tail_percent: Column, repeat: Column, transduced: Column, least_tail: float = 70) -> Column:
    """Kind of an interspersed insertion: a bare tail, then by what its chain's hits match."""
    return F.when(tail_percent >= least_tail, "poly(A/T)").when(repeat & transduced, "partnered").when(transduced, "orphan").when(repeat, "solo")


def insertion_kind(expansion: Column, duplication: Column, interspersed_kind: Column, pseudogene: Column, viral: Column) -> Column:
    """The first kind in order of priority that holds."""
    return F.when(expansion, "expansion").when(duplication, "duplication").when(interspersed_kind.isNotNull(), interspersed_kind).when(pseudogene, "pseudogene").when(viral, "viral").otherwise("unknown")


def lenient(cov: Column, families: Column, least: float, unknown: list[str]) -> Column:
    """Type of an insert by its repeats' chain alone: unknown if too little is covered or its only family is not an element."""
    one = F.size(families) == 1
    return F.when(cov < least, "UNK").when(one & families[0].isin(unknown), "UNK").when(one, "solo").otherwise("chimera")


def resolved_percent(itype: Column, ins_len: Column, element: Column, tails: Column, others: list[Column], transduced: list[Column]) -> Column:
    """Share of an insert that is explained: its element, tails (comma-separated lengths) and other parts; of a partnered one also
    what it transduced; null lengths count nothing, an unknown type explains nothing."""
    total = lambda c: F.coalesce(F.aggregate(F.split(c, ","), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")), F.lit(0).cast("long"))
    n = F.coalesce(element, F.lit(0)) + total(tails)
    for x in others:
        n = n + F.coalesce(x, F.lit(0))
    more = F.lit(0).cast("long")
    for x in transduced:
        more = more + total(x)
    return F.when(itype == "UNK", 0.0).otherwise((n + F.when(itype == "partnered", more).otherwise(0)) / ins_len * 100)
