"""Filters of clusters, metaclusters and annotated insertions: predicates that are true where one passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from . import interval_join as J

#: Identities of transductions.
TRANSDUCTIONS = ["TD1", "TD2", "partnered", "orphan"]
#: Structures of complete insertions, by family (SVA: any other).
CANONICAL = {
    "L1": [
        "FOR+POLYA",
        "TRUN+FOR+POLYA",
        "TRUN+REV+DEL+FOR+POLYA",
        "TRUN+REV+DUP+FOR+POLYA",
        "TRUN+REV+BLUNT+FOR+POLYA",
        "FOR+POLYA+TD+POLYA",
        "TRUN+FOR+POLYA+TD+POLYA",
        "TRUN+REV+DEL+FOR+POLYA+TD+POLYA",
        "TRUN+REV+DUP+FOR+POLYA+TD+POLYA",
        "TRUN+REV+BLUNT+FOR+POLYA+TD+POLYA",
        "TD+FOR+POLYA",
        "REV+DEL+FOR+POLYA",
    ],
    "Alu": ["TRUN+FOR+POLYA", "FOR+POLYA"],
    "SVA": [
        "Hexamer+Alu-like+VNTR+SINE-R+POLYA",
        "Alu-like+VNTR+SINE-R+POLYA",
        "VNTR+SINE-R+POLYA",
        "SINE-R+POLYA",
        "Hexamer+Alu-like+VNTR+SINE-R+POLYA+TD+POLYA",
        "Alu-like+VNTR+SINE-R+POLYA+TD+POLYA",
        "VNTR+SINE-R+POLYA+TD+POLYA",
        "SINE-R+POLYA+TD+POLYA",
        "TD+Hexamer+Alu-like+VNTR+SINE-R+POLYA",
        "MAST2+VNTR+SINE-R+POLYA",
        "MAST2+VNTR+SINE-R+POLYA+TD+POLYA",
        "TD+MAST2+VNTR+SINE-R+POLYA",
    ],
}


def canonical(family: Column, conformation: Column) -> Column:
    """Whether a structure is one that its family's complete insertions have."""
    return F.when(family == "L1", conformation.isin(CANONICAL["L1"])).when(family == "Alu", conformation.isin(CANONICAL["Alu"])).otherwise(conformation.isin(CANONICAL["SVA"]))


def identified(identity: Column, by_sequence: Column | None = None) -> Column:
    """An identity is known; with long reads (``by_sequence``) only that of the sequence counts."""
    return identity.isNotNull() if by_sequence is None else F.coalesce(by_sequence != "", F.lit(False))


def source_chromosome(src_id: Column) -> Column:
    """The chromosome of a source element's cytoband."""
    return F.regexp_extract(src_id, "^([^pq]*)", 1)


def not_from_own_chromosome(ref: Column, identity: Column, src_id: Column, tail: Column, chromosome: str = "6") -> Column:
    """False for transductions on a chromosome from a source there without a tail."""
    own = (ref == chromosome) & F.coalesce(identity.isin(TRANSDUCTIONS), F.lit(False)) & (source_chromosome(src_id) == ref)
    return ~(own & ~tail)


def enough_insert_size(size: Column, least: int) -> Column:
    return (size == 0) | (F.abs(size) > least)


def pile_tests(events: DataFrame, by: list[str]) -> DataFrame:
    """by, n, spread (reads aren't piled up: the cluster is longer than its shortest read) and various (more than two
    read coordinates); clusters of one event pass."""
    out = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("end_pos") - F.min("beg")).alias("range"),
        F.min(F.abs(F.abs("q_end") - F.abs("q_beg"))).alias("least"),
        F.size(F.array_union(F.collect_set("q_beg"), F.collect_set("q_end"))).alias("places"),
    )
    one = F.col("n") == 1
    return out.select(*by, "n", (one | (F.col("range") > F.col("least"))).alias("spread"), (one | (F.col("places") > 2)).alias("various"))


def reciprocal_range(events: DataFrame, by: list[str], max_percent: float = 40) -> DataFrame:
    """by, percent and passes: the share of a cluster on which its plus and its minus part overlap."""
    side = lambda o, f, c: f(F.when(F.col("orientation") == o, F.col(c)))
    parts = events.groupBy(*by).agg(
        F.min("beg").alias("b"), F.max("end_pos").alias("e"), *[side(o, f, c).alias(f"{o[0].lower()}{c[0]}") for o in ("PLUS", "MINUS") for f, c in ((F.min, "beg"), (F.max, "end_pos"))]
    ).where("pb IS NOT NULL AND mb IS NOT NULL")
    shared = F.when(I.reciprocal("mb", "me", "pb", "pe", 1), I.overlap_length("mb", "me", "pb", "pe")).otherwise(0)
    percent = F.coalesce(shared / F.nullif(F.col("e") - F.col("b"), F.lit(0)) * 100, F.lit(0.0))
    return parts.select(*by, F.round(percent, 6).alias("percent"), (percent <= max_percent).alias("passes"))


def not_on_subfamily(repeats: Column, family: str = "L1", subtype: str = "L1PA", least: int = 150) -> Column:
    """No repeat of the subtype within the distance; ``repeats``: array of struct(family, subfamily, distance)."""
    has = F.exists(repeats, lambda r: r["family"] == family)
    return ~(has & F.exists(repeats, lambda r: r["subfamily"].contains(subtype) & (r["distance"] <= least)))


def off_subfamily(near: DataFrame, key: str, family: str = "L1", subtype: str = "L1PA", least: int = 150) -> DataFrame:
    """key and passes, as ``not_on_subfamily``, from a row a repeat (family, subfamily, distance): two flags a call instead of lists of repeats."""
    has = F.coalesce(F.bool_or(F.col("family") == family), F.lit(False))
    young = F.coalesce(F.bool_or(F.col("subfamily").contains(subtype) & (F.col("distance") <= least)), F.lit(False))
    return near.groupBy(key).agg((~(has & young)).alias("passes"))


def mate_regions(events: DataFrame, by: list[str]) -> DataFrame:
    """by, reads (distinct), mate_ref, and the interval of the mates' begins."""
    return events.groupBy(*by, "mate_ref").agg(F.count_distinct("read_name").alias("reads"), F.min("mate_beg").alias("mates_beg"), F.max("mate_beg").alias("mates_end"))


def specific_mates(events: DataFrame, reads: DataFrame, by: list[str], threshold: float = 0.95, buffer: int = 200) -> DataFrame:
    """by, mate_ref, reads, proper and passes: discordant reads to properly paired ones around their mates."""
    regions = mate_regions(events, by)
    proper = reads.where("proper").select(F.col("ref").alias("p_ref"), F.col("beg").alias("p_beg"), F.col("end_pos").alias("p_end"), F.col("read_name").alias("p_name"))
    key = [*by, "mate_ref"]
    met = J.interval_join(regions, proper, ("mate_ref", "mates_beg", "mates_end"), ("p_ref", "p_beg", "p_end"), buffer=buffer).groupBy(*key).agg(F.count_distinct("p_name").alias("proper"))
    out = regions.join(met, key, "left").withColumn("proper", F.coalesce("proper", F.lit(0)).cast("long"))
    return out.select(*key, "reads", "proper", ((F.col("proper") == 0) | (F.col("reads") > threshold * F.col("proper"))).alias("passes"))


def normal_share(calls: DataFrame, reads: DataFrame, key: str, max_percent: float = 20) -> DataFrame:
    """key, reads, events (those that aren't proper pairs) and passes, of the normal sample's reads over a call."""
    r = reads.where("normal").select(F.col("ref").alias("r_ref"), F.col("beg").alias("r_beg"), F.col("end_pos").alias("r_end"), F.col("proper").alias("r_proper"), F.col("mapq").alias("r_mapq"))
    met = J.interval_join(calls.select(key, "ref", "beg", "end_pos"), r, ("ref", "beg", "end_pos"), ("r_ref", "r_beg", "r_end"))
    sums = met.groupBy(key).agg(F.count(F.lit(1)).alias("reads"), F.count_if(~F.col("r_proper") & (F.col("r_mapq") >= 1)).alias("events"))
    out = calls.select(key).join(sums, key, "left").fillna(0, ["reads", "events"])
    return out.withColumn("passes", F.col("events") * 100 <= max_percent * F.col("reads"))


def region(beg: str, end: str) -> tuple[Column, Column]:
    """The region around a cluster: 100 on both sides of a point, 50 of an interval, not over the contig's begin."""
    b, e = F.col(beg), F.col(end)
    wide = F.when(b == e, 100).otherwise(50)
    return F.when(b > wide, b - wide).otherwise(b), e + wide


def region_shares(calls: DataFrame, reads: DataFrame, key: str, least_mapq: int = 10, max_low: float = 0.3, max_double: float = 0.15) -> DataFrame:
    """key, reads, low and double clipped ones around a call, and whether both shares are small enough (no reads: they aren't)."""
    beg, end = region("beg", "end_pos")
    around = calls.select(key, "ref", beg.alias("from"), end.alias("to"))
    r = reads.select(F.col("ref").alias("r_ref"), F.col("beg").alias("r_beg"), F.col("end_pos").alias("r_end"), F.col("mapq").alias("r_mapq"), F.col("double_clip").alias("r_double"))
    met = J.interval_join(around, r, ("ref", "from", "to"), ("r_ref", "r_beg", "r_end"))
    sums = met.groupBy(key).agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("r_mapq") < least_mapq).alias("low"), F.count_if("r_double").alias("double"))
    out = calls.select(key).join(sums, key, "left").fillna(0, ["reads", "low", "double"])
    some = F.col("reads") > 0
    return out.select(key, "reads", "low", "double", (some & (F.col("low") < max_low * F.col("reads"))).alias("mapq_ok"), (some & (F.col("double") < max_double * F.col("reads"))).alias("clips_ok"))


def on_targets(rows: DataFrame, ref: str, targets: list[str]) -> DataFrame:
    return rows.where(F.col(ref).isin(targets))


def outside(points: DataFrame, ranges: DataFrame, point: tuple[str, str, str], range_cols: tuple[str, str, str], key: list[str], buffer: int = 10_000) -> DataFrame:
    """Rows whose interval is in none of the ranges, widened by the buffer."""
    met = J.interval_join(points, ranges, point, range_cols, buffer=buffer).select(*key).distinct()
    return points.join(met, key, "left_anti")


def without(events: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """Events that are not among the removed ones."""
    return events.join(removed.select(*key), key, "left_anti")


def untraced_as_solo(rows: DataFrame) -> DataFrame:
    """A partnered insertion whose first 3' source is unknown is solo: its last tail stays, its transduction goes."""
    unknown = F.split("td_coord", ",")[0] == "UNK"
    last = lambda c: F.element_at(F.split(c, ","), -1)
    new = {
        "itype": F.when(unknown, "solo").otherwise(F.col("itype")),
        **{c: F.when(unknown, last(c)).otherwise(F.col(c)) for c in ("tail_len", "tail_seq")},
        "conformation": F.when(unknown, F.split("conformation", r"\+TD\+POLYA")[0]).otherwise(F.col("conformation")),
        **{c: F.when(~unknown, F.col(c)) for c in ("td_n", "td_len", "td_coord", "td_seq")},
    }
    return rows.withColumns({c: F.when(F.col("td_coord").isNull(), F.col(c)).otherwise(x) for c, x in new.items()})


def own_site_as_templated(rows: DataFrame, reach: int = 1000) -> DataFrame:
    """A single 5' transduction from the insertion's own site is a templated end; the type is open unless there is a 3' one."""
    spot = F.regexp_extract("td5_coord", r"^(.*):(\d+)-(\d+)$", 1)
    at = lambda k: F.expr(f"try_cast(regexp_extract(td5_coord, '^(.*):(\\\\d+)-(\\\\d+)$', {k}) AS BIGINT)")
    own = (F.col("itype") == "partnered") & (F.col("td5_n") <= 1) & (spot == F.col("chrom"))
    own = F.coalesce(own & I.overlaps(F.col("pos") - reach, F.col("pos") + reach, at(2), at(3)), F.lit(False))
    return rows.withColumn("own__", own).withColumns({
        "itype": F.when(F.col("own__") & F.col("td_coord").isNull(), "UNK").otherwise(F.col("itype")),
        "temp5_coord": F.when(F.col("own__"), F.col("td5_coord")),
        "temp5_len": F.when(F.col("own__"), F.col("td5_len")),
        "td5_coord": F.when(~F.col("own__"), F.col("td5_coord")),
        "td5_len": F.when(~F.col("own__"), F.col("td5_len")),
        "td5_n": F.when(~F.col("own__"), F.col("td5_n")),
    }).drop("own__")


def resolved(itype: Column, family: Column, percent: Column, least: float = 75, least_sva: float = 50) -> Column:
    """Enough of an insert is explained; chimeras need not be."""
    return (itype == "chimera") | (percent >= F.when(family == "SVA", least_sva).otherwise(least))


def hexamer_fits(hexamer: Column, family: Column, itype: Column) -> Column:
    """A hexamer is in an SVA, or in an insert whose own element isn't told."""
    return ~hexamer | (family == "SVA") | itype.isin("PSD", "orphan")


def supporting_clippings(clusters: DataFrame, clips: DataFrame, buffer: int) -> DataFrame:
    """ref, cluster, side, n: of the clippings around a cluster the larger side's; all PLUS reads point right, all MINUS ones left.

    ``clusters``: ref, cluster, b, e, plus, minus; ``clips``: r_ref, r_beg, side.
    """
    k = clusters.withColumn("from", F.greatest(F.col("b") - buffer, F.lit(0)))
    met = J.interval_join(k, clips.withColumn("r_end", F.col("r_beg")), ("ref", "from", "e"), ("r_ref", "r_beg", "r_end"))
    met = met.where((~F.col("plus") | (F.col("side") == "right")) & (~F.col("minus") | (F.col("side") == "left")))
    n = met.groupBy("ref", "cluster", "side").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("ref", "cluster").agg(F.min(F.struct((-F.col("n")).alias("neg"), "side")).alias("x")).select("ref", "cluster", F.col("x.side").alias("side"), (-F.col("x.neg")).alias("n"))


def named(calls: DataFrame, annotations: DataFrame, name: str) -> DataFrame:
    """Calls with what an annotator says of their name, null where it says nothing."""
    return calls.join(annotations, name, "left")
