"""Events of reads, bridges and junctions: slices of reads, mates, supplementary alignments, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chain as K


def slice_of(seq: Column, beg: Column, end: Column) -> Column:
    """seq[beg:end], 0-based half-open; an end before the begin gives the empty string."""
    beg = F.greatest(beg, F.lit(0))
    return F.substring(seq, (beg + 1).cast("int"), F.greatest(end - beg, F.lit(0)).cast("int"))


def flank_of_insertion(seq: Column, pos: Column, length: Column, overhang: int) -> Column:
    """struct(seq, pos): an insertion on its read with what lies around it, and where it begins there."""
    room = pos - overhang > 0
    return F.struct(slice_of(seq, F.when(room, pos - overhang).otherwise(0), pos + length + overhang).alias("seq"), F.when(room, F.lit(overhang).cast("long")).otherwise(pos.cast("long")).alias("pos"))


def flank_of_deletion(seq: Column, pos: Column, overhang: int) -> Column:
    return slice_of(seq, pos - overhang, pos + overhang)


def flank_of_clipping(seq: Column, pos: Column, side: Column, overhang: int) -> Column:
    return F.when(side == "left", slice_of(seq, F.lit(0), pos + overhang)).otherwise(slice_of(seq, pos - overhang, F.length(seq)))


def clipped_part(seq: Column, pos: Column, side: Column) -> Column:
    return F.when(side == "left", slice_of(seq, F.lit(0), pos)).otherwise(slice_of(seq, pos, F.length(seq)))


def aligned_part(seq: Column, pos: Column, side: Column) -> Column:
    return F.when(side == "left", slice_of(seq, pos, F.length(seq))).otherwise(slice_of(seq, F.lit(0), pos))


def clipped_interval(beg: Column, end: Column, read_len: Column, reverse: Column, side: Column) -> Column:
    """struct(beg, end) of the clipped piece on the read: behind the aligned part, or before it."""
    behind = reverse == (side == "left")
    zero = F.lit(0).cast("long")
    return F.struct(F.when(behind, end).otherwise(zero).alias("beg"), F.when(behind, read_len).otherwise(beg).alias("end"))


def as_mates(pairs: DataFrame) -> DataFrame:
    """Read and mate change places; names carry the pair's number."""
    return pairs.select(
        "read_ord",
        F.concat_ws("/", "read_name", (F.lit(3) - F.col("pair_no")).cast("string")).alias("name"),
        F.col("mate_ref").alias("ref"),
        F.col("mate_beg").alias("beg"),
        F.col("ref").alias("mate_ref"),
        F.col("beg").alias("mate_beg"),
    )


def supplementary_as_pairs(clips: DataFrame, read_size: int, least_distance: int | None = 5000) -> DataFrame:
    """A pair for each supplementary alignment of a clipping (``sa``: ref,pos,strand,cigar,mapq,nm; ...); near ones on the same reference go."""
    one = F.explode(F.filter(F.split("sa", ";"), lambda x: x != ""))
    rows = clips.withColumn("one", one).withColumn("one", F.split("one", ","))
    plus = F.col("orientation") != "MINUS"
    aligned = read_size - F.col("clip_len")
    beg = F.when(plus, F.col("beg") - aligned).otherwise(F.col("beg"))
    rows = rows.select("read_ord", "ref", beg.alias("beg"), (beg + aligned).alias("end_pos"), "orientation", F.col("one")[0].alias("mate_ref"), F.col("one")[1].cast("long").alias("mate_beg"))
    return rows if least_distance is None else rows.where((F.col("ref") != F.col("mate_ref")) | (F.abs(F.col("mate_beg") - F.col("beg")) >= least_distance))


def partner_share(events: DataFrame, bridge_reads: DataFrame, by: list[str]) -> DataFrame:
    """by and percent of events whose place among their read's alignments is as a junction has it: second over a bridge, else first."""
    rows = events.join(bridge_reads.select("read_name").distinct().withColumn("over", F.lit(True)), "read_name", "left")
    fits = F.col("read_index") == F.when(F.col("over"), 1).otherwise(0)
    return rows.groupBy(*by).agg((F.count_if(fits) * 100 / F.count(F.lit(1))).alias("percent"))


def bridge_support(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, clusters, reads (distinct, in order) and support types of a bridge's supplementary clusters."""
    return parts.groupBy(*by).agg(F.count_distinct("cluster").alias("clusters"), F.count_distinct("read_name").alias("n_reads"), F.array_sort(F.collect_set("read_name")).alias("reads"), F.array_sort(F.collect_set("support")).alias("types"))


def supports_bridge(lengths: DataFrame, by: list[str], least_reads: int, least_percent: float, max_len: int = 10_000, max_cv: float = 40) -> DataFrame:
    """Clusters whose events bridge a gap of about one length: enough reads and share of them, short enough, little spread."""
    cv = F.try_divide(F.stddev_pop("gap"), F.avg("gap")) * 100
    some = lengths.groupBy(*by).agg(F.count_distinct("read_name").alias("reads"), F.count_distinct(F.when(F.col("gap") > 0, F.col("read_name"))).alias("bridging"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("length"), F.coalesce(cv, F.lit(0.0)).alias("cv"))
    ok = (F.col("bridging") >= least_reads) & (F.col("bridging") * 100 >= least_percent * F.col("reads")) & (F.col("length") <= max_len) & (F.col("cv") <= max_cv)
    return some.where(ok)


def junction(ref_a: str, pos_a: str, ref_b: str, pos_b: str) -> tuple[Column, Column]:
    """Coordinates of a junction, and whether it lies on one chromosome."""
    show = F.concat(F.col(ref_a), F.lit(":"), F.col(pos_a).cast("string"), F.lit("-"), F.col(ref_b), F.lit(":"), F.col(pos_b).cast("string"))
    return show, F.when(F.col(ref_a) == F.col(ref_b), "intrachromosomal").otherwise("interchromosomal")


def spanning_order(events: DataFrame, by: list[str], most: int) -> DataFrame:
    """The reads of a junction that are in most of its events, of those the ones with fewest supplementary alignments."""
    from pyspark.sql.window import Window

    reads = events.groupBy(*by, "read_name").agg(F.count(F.lit(1)).alias("hits"), F.min("n_suppl").alias("n_suppl"))
    w = Window.partitionBy(*by).orderBy(F.desc("hits"), "n_suppl", "read_name")
    return reads.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def supports_breakpoints(chain: str, pos_a: Column, pos_b: Column, within: int = 1500) -> Column:
    """Whether a consensus' chain ends and begins again near both breakpoints."""
    first, last = F.element_at(chain, 1), F.element_at(chain, -1)
    beg = F.when(first["strand"] == "+", first["t_end"]).otherwise(first["t_beg"])
    end = F.when(last["strand"] == "+", last["t_beg"]).otherwise(last["t_end"])
    apart = lambda f: F.abs(f(pos_a, pos_b) - f(beg, end)) <= within
    return apart(F.least) & apart(F.greatest)


def complementary_hits(hits: DataFrame, key: str, order: str, carry: list[str], least_gap: int = 50) -> DataFrame:
    """key, n, gap: alignments of a clipped read that continue each other along it, and the longest stretch between two of them."""
    chains = K.chain(hits, key, "q_beg", "q_end", order, carry, 10_000, 20)
    gaps = F.expr("transform(sequence(1, greatest(size(chain) - 1, 1)), i -> CASE WHEN i < size(chain) THEN chain[i].beg - chain[i - 1].end ELSE 0L END)")
    out = chains.select(key, F.size("chain").cast("long").alias("n"), F.array_max(gaps).alias("gap"))
    return out.where((F.col("n") > 1) & (F.col("gap") >= least_gap))


def kmer_complexity(seq: str, k: int) -> Column:
    """Distinct k-mers by all k-mers of a sequence; null if it has none. One pass over the sequence, by a lookahead."""
    return F.expr(f"transform(array(regexp_extract_all({seq}, '(?=(.{{{k}}}))', 1)), x -> CASE WHEN size(x) > 0 THEN size(array_distinct(x)) / size(x) END)[0]")


def flipped(beg: Column, end: Column, length: Column, strand: Column) -> Column:
    """struct(beg, end) of a hit on the query's other strand where it is a reverse hit."""
    back = strand == "-"
    return F.struct(F.when(back, length - end).otherwise(beg).alias("beg"), F.when(back, length - beg).otherwise(end).alias("end"))


def confidence_interval(pos: Column, cipos: Column) -> Column:
    """struct(beg, end) of a position and its confidence offsets ("-5,5"; null: the position alone)."""
    at = lambda k: F.coalesce(F.split(cipos, ",")[k].cast("long"), F.lit(0).cast("long"))
    return F.struct((pos + at(0)).alias("beg"), (pos + at(1)).alias("end"))


def shifted(df: DataFrame, columns: list[str], offset: Column, ref: Column | None = None, ref_col: str = "ref") -> DataFrame:
    """Coordinates of a target region as those of its reference."""
    out = df.withColumns({c: F.col(c) + offset for c in columns})
    return out.withColumn(ref_col, ref) if ref is not None else out


def with_precedence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where both have a key, b's."""
    return a.join(b.select(*keys), keys, "left_anti").unionByName(b)


def low_complexity_share(seq: str, window: int = 16, least_distinct: int = 6) -> Column:
    """Share of a sequence's whole windows in which few different 3-mers occur."""
    w = f"regexp_extract_all({seq}, '.{{{window}}}', 0)"
    few = f"filter({w}, w -> size(array_distinct(transform(sequence(1, {window - 2}), i -> substring(w, i, 3)))) < {least_distinct})"
    return F.expr(f"CASE WHEN length({seq}) >= {window} THEN size({few}) / size({w}) END")


def head_tail_overlap(a: Column, b: Column, least: int, most: int) -> Column:
    """Length of the longest end of a that is a begin of b, 0 below ``least``."""
    n = F.least(F.length(a), F.length(b), F.lit(most))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k >= least) & (F.right(a, k) == F.left(b, k)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def assembled(a: Column, b: Column, least: int = 20, most: int = 250) -> Column:
    """a and b joined at their longest overlap, null without one."""
    k = head_tail_overlap(a, b, least, most)
    return F.when(k > 0, F.concat(a, F.substring(b, k + 1, F.length(b))))
