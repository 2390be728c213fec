"""Queries of the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as V
from ..operators import support as U
from .catalogue import _GAPS, clustered, query

_CASES = lambda *tests: "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({test}, FALSE) THEN '{name}' END" for name, test in tests) + "], lambda x: x IS NOT NULL)"
_OWN = "NOT (ref = '6' AND coalesce(identity IN ('TD1', 'TD2', 'partnered', 'orphan'), FALSE) AND regexp_extract(src_id, '^([^pq]*)', 1) = ref AND NOT has_tail)"


@query(f"SELECT meta_id, {_CASES(('sv_type', 'sv_type IN (chr(73) || chr(78) || chr(83), chr(68) || chr(85) || chr(80))'), ('identity', 'identity IS NOT NULL'), ('own_chromosome', _OWN))} AS failed FROM metas", "metas")
def call_filters(metas):
    """Kind, identity and source of a call."""
    c = F.col
    tests = U.failed(sv_type=c("sv_type").isin("INS", "DUP"), identity=V.identified(c("identity")), own_chromosome=V.not_from_own_chromosome(c("ref"), c("identity"), c("src_id"), c("has_tail")))
    return metas.select("meta_id", tests.alias("failed"))


_PAIR_GAPS = _GAPS.replace("FROM reads", "FROM pairs")


@query(
    _PAIR_GAPS
    + ", p AS (SELECT ref, cluster, q_beg AS q FROM c UNION SELECT ref, cluster, q_end FROM c), k AS (SELECT ref, cluster, count(*) AS places FROM p GROUP BY ref, cluster) SELECT c.ref, CAST(c.cluster AS BIGINT) AS cluster, count(*) AS n, count(*) = 1 OR max(end_pos) - min(beg) > min(abs(abs(q_end) - abs(q_beg))) AS spread, count(*) = 1 OR min(k.places) > 2 AS various FROM c JOIN k ON k.ref = c.ref AND k.cluster = c.cluster GROUP BY c.ref, c.cluster",
    "pairs",
)
def pile_filters(pairs):
    """Clusters whose reads all lie upon each other."""
    return V.pile_tests(clustered(pairs), ["ref", "cluster"])


_RCPL = "greatest(least(me, pe) - greatest(mb, pb) + 1, 0)"


@query(
    _PAIR_GAPS
    + f", s AS (SELECT ref, cluster, min(beg) AS b, max(end_pos) AS e, min(beg) FILTER (WHERE orientation = 'PLUS') AS pb, max(end_pos) FILTER (WHERE orientation = 'PLUS') AS pe, min(beg) FILTER (WHERE orientation = 'MINUS') AS mb, max(end_pos) FILTER (WHERE orientation = 'MINUS') AS me FROM c GROUP BY ref, cluster), t AS (SELECT *, CASE WHEN {_RCPL} * 100 >= (me - mb + 1) AND {_RCPL} * 100 >= (pe - pb + 1) THEN {_RCPL} ELSE 0 END * 100.0::DOUBLE / (e - b) AS percent FROM s WHERE pb IS NOT NULL AND mb IS NOT NULL) SELECT ref, CAST(cluster AS BIGINT) AS cluster, round(coalesce(percent, 0), 6) AS percent, coalesce(percent, 0) <= 40 AS passes FROM t",
    "pairs",
)
def reciprocal_range_filter(pairs):
    """Clusters whose plus and minus parts lie upon each other."""
    return V.reciprocal_range(clustered(pairs), ["ref", "cluster"])


_FAMILY = "CASE bed_id % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'Alu' ELSE 'SVA' END"
_SUB = "CASE bed_id % 3 WHEN 0 THEN concat('L1P', CASE WHEN bed_id % 2 = 0 THEN 'A' ELSE 'B' END, CAST(bed_id % 8 AS VARCHAR)) ELSE 'other' END"
_NEAR = "n AS (SELECT v.id, bed_id, CASE WHEN pos BETWEEN beg AND end_pos THEN 0 ELSE abs(least(pos + 200, end_pos) - greatest(pos - 200, beg) - 200) END AS distance FROM variants v JOIN bed ON chrom = ref AND pos - 200 <= end_pos AND beg <= pos + 200)"


@query(
    f"WITH {_NEAR}, f AS (SELECT id, {_FAMILY} AS family, {_SUB} AS subfamily, distance FROM n) SELECT id, NOT (bool_or(family = 'L1') AND bool_or(contains(subfamily, 'L1PA') AND distance <= 150)) AS passes FROM f GROUP BY id",
    "variants",
    "bed",
)
def subfamily_filter(variants, bed):
    """Calls next to young elements of the family."""
    from .catalogue import repeats_within_buffer

    near = repeats_within_buffer(variants, bed).select("id", F.expr(_FAMILY).alias("family"), F.expr(_SUB.replace("VARCHAR", "STRING")).alias("subfamily"), "distance")
    return V.off_subfamily(near, "id")


_TO_REF = "CASE mate_ref WHEN 'm0' THEN 'click' WHEN 'm1' THEN 'view' WHEN 'm2' THEN 'purchase' WHEN 'm3' THEN 'signup' ELSE mate_ref END"


@query(
    f"WITH p AS (SELECT * REPLACE ({_TO_REF} AS mate_ref) FROM pairs), d AS (SELECT ref, beg // 5000 AS bin, mate_ref, count(DISTINCT read_name) AS reads, min(mate_beg) AS mates_beg, max(mate_beg) AS mates_end FROM p WHERE NOT proper GROUP BY 1, 2, 3), m AS (SELECT d.ref, d.bin, d.mate_ref, count(DISTINCT p.read_name) AS proper FROM d JOIN p ON p.proper AND p.ref = d.mate_ref AND d.mates_beg - 200 <= p.end_pos AND p.beg <= d.mates_end + 200 GROUP BY 1, 2, 3) SELECT d.ref, d.bin, d.mate_ref, reads, coalesce(proper, 0) AS proper, coalesce(proper, 0) = 0 OR reads > 0.95 * proper AS passes FROM d LEFT JOIN m ON m.ref = d.ref AND m.bin = d.bin AND m.mate_ref = d.mate_ref",
    "pairs",
)
def specific_mates_filter(pairs):
    """Discordant reads whose mates lie among properly paired ones."""
    p = pairs.withColumn("mate_ref", F.expr(_TO_REF)).withColumn("bin", F.floor(F.col("beg") / 5000))
    return V.specific_mates(p.where("NOT proper"), p, ["ref", "bin"])


_CALLS = "k AS (SELECT ref, CAST(cluster AS BIGINT) AS cluster, min(beg) AS beg, max(end_pos) AS end_pos FROM c GROUP BY ref, cluster HAVING count(*) >= 2)"


def _calls(pairs):
    k = clustered(pairs).groupBy("ref", "cluster").agg(F.min("beg").alias("beg"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n"))
    return k.where("n >= 2").select(F.concat_ws(":", "ref", "cluster").alias("call"), "ref", "beg", "end_pos")


@query(
    _PAIR_GAPS
    + f", {_CALLS}, m AS (SELECT k.ref || ':' || k.cluster AS call, count(r.read_ord) AS reads, count(*) FILTER (WHERE NOT r.proper AND r.mapq >= 1) AS events FROM k LEFT JOIN pairs r ON r.normal AND r.ref = k.ref AND k.beg <= r.end_pos AND r.beg <= k.end_pos GROUP BY 1) SELECT call, reads, events, events * 100 <= 20 * reads AS passes FROM m",
    "pairs",
)
def normal_share_filter(pairs):
    """Calls that the normal sample has too."""
    return V.normal_share(_calls(pairs), pairs, "call")


@query(
    _PAIR_GAPS
    + f", {_CALLS}, a AS (SELECT ref || ':' || cluster AS call, ref, CASE WHEN beg > CASE WHEN beg = end_pos THEN 100 ELSE 50 END THEN beg - CASE WHEN beg = end_pos THEN 100 ELSE 50 END ELSE beg END AS f, end_pos + CASE WHEN beg = end_pos THEN 100 ELSE 50 END AS t FROM k), m AS (SELECT call, count(r.read_ord) AS reads, count(*) FILTER (WHERE r.mapq < 10) AS low, count(*) FILTER (WHERE r.double_clip) AS double FROM a LEFT JOIN pairs r ON r.ref = a.ref AND a.f <= r.end_pos AND r.beg <= a.t GROUP BY 1) SELECT call, reads, low, double, reads > 0 AND low < 0.3 * reads AS mapq_ok, reads > 0 AND double < 0.15 * reads AS clips_ok FROM m",
    "pairs",
)
def region_filters(pairs):
    """Shares of uncertain and of twice clipped reads around a call."""
    return V.region_shares(_calls(pairs), pairs, "call")


@query("SELECT read_ord FROM pairs p WHERE mate_ref IN ('m1', 'm2', 'm4') AND NOT EXISTS (SELECT 1 FROM zones WHERE zones.ref = mate_ref AND mate_beg - 10000 <= zones.end_pos AND zones.beg <= mate_beg + 10000)", "pairs", "zones")
def mate_position_filter(pairs, zones):
    """Mates or supplementary alignments on target references, away from known regions by 10 kb."""
    p = V.on_targets(pairs, "mate_ref", ["m1", "m2", "m4"]).select("read_ord", F.col("mate_ref").alias("m_ref"), F.col("mate_beg").alias("m_beg"), F.col("mate_beg").alias("m_end"))
    return V.outside(p, zones, ("m_ref", "m_beg", "m_end"), ("ref", "beg", "end_pos"), ["read_ord"]).select("read_ord")


@query("SELECT read_ord, insert_size FROM pairs p WHERE (insert_size = 0 OR abs(insert_size) > 150) AND NOT EXISTS (SELECT 1 FROM reads r WHERE r.is_dup AND r.read_ord = p.read_ord)", "pairs", "reads")
def insert_size_filter(pairs, reads):
    """Discordant reads by insert size, without removed events."""
    return V.without(pairs.where(V.enough_insert_size(F.col("insert_size"), 150)), reads.where("is_dup"), ["read_ord"]).select("read_ord", "insert_size")


@query(
    _PAIR_GAPS + ", s AS (SELECT ref, cluster, count(*) AS n, count(DISTINCT read_name) AS reads, count(DISTINCT read_name) FILTER (WHERE normal) AS normal_reads, stddev_pop(end_pos - beg) / avg(end_pos - beg) * 100 AS cv FROM c GROUP BY ref, cluster) SELECT ref, CAST(cluster AS BIGINT) AS cluster, " + _CASES(("max_cv", "cv <= 15"), ("germline", "normal_reads < 2"), ("min_reads", "reads >= 2")) + " AS failed FROM s",
    "pairs",
)
def cluster_support_filters(pairs):
    """Spread of lengths, distinct reads of the normal sample, distinct reads."""
    k = clustered(pairs).withColumn("len", F.col("end_pos") - F.col("beg")).groupBy("ref", "cluster")
    k = k.agg(F.count_distinct("read_name").alias("reads"), F.count_distinct(F.when(F.col("normal"), F.col("read_name"))).alias("normal_reads"), U.variation_percent("len").alias("cv"))
    return k.select("ref", "cluster", U.failed(max_cv=F.col("cv") <= 15, germline=F.col("normal_reads") < 2, min_reads=F.col("reads") >= 2).alias("failed"))


#: Annotated insertions made of calls: types, families, structures and transductions.
_ANNOTATED = """SELECT meta_id, ref AS chrom, beg AS pos, CASE meta_id % 4 WHEN 0 THEN 'partnered' WHEN 1 THEN 'solo' WHEN 2 THEN 'PSD' ELSE 'orphan' END AS itype,
 CASE meta_id % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'Alu' ELSE 'SVA' END AS family, CASE meta_id % 7 WHEN 0 THEN 'MAST2' ELSE 'GENE' END AS src_gene,
 CASE meta_id % 5 WHEN 0 THEN 'TRUN+FOR+POLYA' WHEN 1 THEN 'FOR+POLYA+TD+POLYA' WHEN 2 THEN 'SINE-R+POLYA' WHEN 3 THEN 'REV+POLYA' ELSE 'VNTR+SINE-R+POLYA+TD+POLYA' END AS conformation,
 CASE WHEN meta_id % 4 = 0 AND meta_id % 8 = 0 THEN 'UNK,UNK' WHEN meta_id % 12 = 4 THEN concat(ref, ':', CAST(beg + 500 AS STRING), '-', CAST(beg + 700 AS STRING)) END AS td_coord,
 CASE WHEN meta_id % 4 = 0 THEN '2' END AS td_n, CASE WHEN meta_id % 4 = 0 THEN '20,30' END AS td_len, CASE WHEN meta_id % 4 = 0 THEN 'ACGT,TTT' END AS td_seq, '12,20' AS tail_len, 'AAAA,AAAAA' AS tail_seq,
 CASE WHEN meta_id % 4 = 0 THEN CASE WHEN meta_id % 16 = 12 THEN concat(ref, ':', CAST(beg + 900 AS STRING), '-', CAST(beg + 990 AS STRING)) ELSE concat('9:', CAST(beg AS STRING), '-', CAST(beg + 90 AS STRING)) END END AS td5_coord,
 CASE WHEN meta_id % 4 = 0 THEN 1 + meta_id % 3 END AS td5_n, CASE WHEN meta_id % 4 = 0 THEN '90' END AS td5_len FROM metas"""


def annotated(metas):
    return metas.sparkSession.sql(_ANNOTATED.replace("FROM metas", "FROM {metas}"), metas=metas)


_LISTS = {k: ", ".join(f"'{x}'" for x in v) for k, v in V.CANONICAL.items()}


@query(
    f"WITH a AS ({_ANNOTATED}) SELECT meta_id, CASE WHEN family = 'L1' THEN conformation IN ({_LISTS['L1']}) WHEN family = 'Alu' THEN conformation IN ({_LISTS['Alu']}) ELSE conformation IN ({_LISTS['SVA']}) END AS canonical, "
    + _CASES(("mast2", "NOT (itype = 'PSD' AND src_gene = 'MAST2')"), ("templated", "NOT (itype = 'PSD' AND meta_id % 6 = 2)"))
    + " AS failed FROM a",
    "metas",
)
def insertion_filters(metas):
    """Pseudogenes of one gene or with templated ends; complete structures."""
    a = annotated(metas)
    psd = F.col("itype") == "PSD"
    failed = U.failed(mast2=~(psd & (F.col("src_gene") == "MAST2")), templated=~(psd & (F.col("meta_id") % 6 == 2)))
    return a.select("meta_id", V.canonical(F.col("family"), F.col("conformation")).alias("canonical"), failed.alias("failed"))


@query(
    f"WITH a AS ({_ANNOTATED}), u AS (SELECT *, coalesce(split_part(td_coord, ',', 1) = 'UNK', FALSE) AS unk FROM a) SELECT meta_id, CASE WHEN unk THEN 'solo' ELSE itype END AS itype, CASE WHEN unk THEN split_part(tail_len, ',', 2) ELSE tail_len END AS tail_len, CASE WHEN unk THEN split_part(conformation, '+TD+POLYA', 1) ELSE conformation END AS conformation, CASE WHEN NOT unk THEN td_coord END AS td_coord, CASE WHEN NOT unk THEN td_n END AS td_n FROM u",
    "metas",
)
def untraced_as_solo(metas):
    """P10: partnered insertions without a known source."""
    return V.untraced_as_solo(annotated(metas)).select("meta_id", "itype", "tail_len", "conformation", "td_coord", "td_n")


@query(
    f"WITH a AS ({_ANNOTATED}), o AS (SELECT *, coalesce(itype = 'partnered' AND td5_n <= 1 AND split_part(td5_coord, ':', 1) = chrom AND pos - 1000 <= CAST(split_part(split_part(td5_coord, ':', 2), '-', 2) AS BIGINT) AND CAST(split_part(split_part(td5_coord, ':', 2), '-', 1) AS BIGINT) <= pos + 1000, FALSE) AS own FROM a) SELECT meta_id, CASE WHEN own AND td_coord IS NULL THEN 'UNK' ELSE itype END AS itype, CASE WHEN own THEN td5_coord END AS temp5_coord, CASE WHEN own THEN td5_len END AS temp5_len, CASE WHEN NOT own THEN td5_coord END AS td5_coord, CASE WHEN NOT own THEN td5_n END AS td5_n FROM o",
    "metas",
)
def own_site_as_templated(metas):
    """5' transductions from the insertion's own site."""
    return V.own_site_as_templated(annotated(metas)).select("meta_id", "itype", "temp5_coord", "temp5_len", "td5_coord", "td5_n")
