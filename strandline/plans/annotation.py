"""Queries of the composed annotation and of the statistics, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import monomers as M
from ..functions import sequence as S
from ..operators import calls as V
from ..operators import cluster as L
from ..operators import statistics as P
from . import retro
from .catalogue import CHAIN_SQL, _GAPS, _TAIL, chained, clustered, query

# sequences --------------------------------------------------------------------------------------

#: Every run of A of 10 bases or more: id, n, beg, e.
_RUNS = (
    _TAIL[: _TAIL.index("SELECT id, CAST(beg AS BIGINT)")]
    .replace("SELECT id, any_value(alt)", "SELECT id, run, any_value(alt)")
    .replace("FROM k WHERE run = 1 GROUP BY id", "FROM k GROUP BY id, run")
    .rstrip()
    + ", o AS (SELECT id, n, beg, e, lead(beg) OVER (PARTITION BY id ORDER BY beg) AS next_beg FROM r WHERE e - beg >= 10)"
)


@query(
    _RUNS + " SELECT v.id, CAST(count(beg) AS BIGINT) AS n_runs, CAST(coalesce(sum(e - beg), 0) AS BIGINT) AS run_bases, CASE count(beg) WHEN 0 THEN 'none' WHEN 1 THEN 'polyA' ELSE 'partnered' END AS tail, CAST(coalesce(sum(next_beg - e), 0) AS BIGINT) AS td_bases FROM (SELECT id FROM variants) v LEFT JOIN o USING (id) GROUP BY v.id",
    "variants",
)
def monomer_td_split(variants):
    """Runs of A and the transduced pieces between them."""
    v = variants.select("id", "alt").withColumn("runs", M.monomers("alt"))
    pieces = M.transduced_pieces("runs")
    return v.select("id", F.size("runs").cast("long").alias("n_runs"), M.total_length("runs").alias("run_bases"), M.tail_type("runs").alias("tail"), F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["beg"]).alias("td_bases"))


# clusters ---------------------------------------------------------------------------------------

_RO = "(least(a.end_pos, b.end_pos) - greatest(a.beg, b.beg) + 1)"


@query(
    f"""WITH RECURSIVE p AS (SELECT a.bed_id AS a, b.bed_id AS b FROM bed a JOIN bed b ON a.ref = b.ref AND a.bed_id <> b.bed_id AND a.beg <= b.end_pos AND b.beg <= a.end_pos
  AND (a.beg = b.beg AND a.end_pos = b.end_pos OR {_RO} * 100.0::DOUBLE / (a.end_pos - a.beg + 1) >= 80 AND {_RO} * 100.0::DOUBLE / (b.end_pos - b.beg + 1) >= 80)),
w AS (SELECT bed_id AS node, bed_id AS reach FROM bed UNION SELECT w.node, p.b FROM w JOIN p ON p.a = w.reach)
SELECT node AS bed_id, min(reach) AS cluster FROM w GROUP BY node""",
    "bed",
)
def reciprocal_clusters(bed):
    """Clusters of intervals that overlap each other by 80 percent."""
    return L.reciprocal_clusters(bed, "bed_id", "ref", "beg", "end_pos", 80)


@query(
    _GAPS
    + """, v AS (SELECT ref, cluster, read_ord, CAST(end_pos - beg AS DOUBLE) AS len FROM c),
x AS (SELECT *, row_number() OVER (PARTITION BY ref, cluster ORDER BY len, read_ord) AS k, count(*) OVER (PARTITION BY ref, cluster) AS n FROM v),
g AS (SELECT a.ref, a.cluster, a.k AS cut, round(sum(CASE WHEN b.k <= a.k THEN b.len END) ** 2 / a.k + sum(CASE WHEN b.k > a.k THEN b.len END) ** 2 / (a.n - a.k), 6) AS gain FROM x a JOIN x b ON a.ref = b.ref AND a.cluster = b.cluster WHERE a.k < a.n GROUP BY a.ref, a.cluster, a.k, a.n),
h AS (SELECT ref, cluster, cut FROM g QUALIFY row_number() OVER (PARTITION BY ref, cluster ORDER BY gain DESC, cut) = 1),
s AS (SELECT a.ref, a.cluster, a.read_ord, a.k, h.cut, avg(abs(a.len - b.len)) FILTER (WHERE (a.k <= h.cut) = (b.k <= h.cut) AND a.k <> b.k) AS w, avg(abs(a.len - b.len)) FILTER (WHERE (a.k <= h.cut) <> (b.k <= h.cut)) AS o FROM x a JOIN h ON h.ref = a.ref AND h.cluster = a.cluster JOIN x b ON b.ref = a.ref AND b.cluster = a.cluster GROUP BY ALL),
q AS (SELECT ref, cluster, avg(CASE WHEN w IS NULL OR greatest(o, w) = 0 THEN 0 ELSE (o - w) / greatest(o, w) END) AS silhouette FROM s GROUP BY 1, 2)
SELECT x.ref, CAST(x.cluster AS BIGINT) AS cluster, x.read_ord, CASE WHEN q.silhouette >= 0.6 AND x.k > h.cut THEN 1 ELSE 0 END AS part, round(q.silhouette, 6) AS silhouette FROM x LEFT JOIN h ON h.ref = x.ref AND h.cluster = x.cluster LEFT JOIN q ON q.ref = x.ref AND q.cluster = x.cluster""",
    "reads",
)
def length_subclusters(reads):
    """A cluster's events split in two by length where the groups stand apart."""
    c = clustered(reads).withColumn("len", (F.col("end_pos") - F.col("beg")).cast("double"))
    s = L.two_groups(c, ["ref", "cluster"], "len", ["read_ord"])
    n = F.count(F.lit(1)).over(L.Window.partitionBy("ref", "cluster"))
    return s.select("ref", "cluster", "read_ord", "part", F.when(n > 1, F.round("silhouette", 6)).alias("silhouette"))


# statistics -------------------------------------------------------------------------------------


@query(
    "WITH n AS (SELECT cell_id, chrom, count(*) AS n, max(end_pos) AS len FROM sv_cells GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER w AS total, len / sum(len) OVER w AS share FROM n WINDOW w AS (PARTITION BY cell_id)) SELECT cell_id, chrom, n, round(total * share, 6) AS expected, round((n - total * share) / nullif(sqrt(total * share * (1 - share)), 0), 6) AS z, round(log2(n / (total * share)), 6) AS log2_enrichment FROM s",
    "sv_cells",
)
def sv_enrichment(svs):
    """Variants of a chromosome against placement by length."""
    n = svs.groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("n"), F.max("end_pos").alias("len"))
    e = P.binomial_enrichment(n, ["cell_id"], "n", "len")
    return e.select("cell_id", "chrom", "n", *[F.round(c, 6).alias(c) for c in ("expected", "z", "log2_enrichment")])


@query(
    """WITH t AS (SELECT cell_id, chrom, count(*) FILTER (WHERE haplo = 'h1') AS a, count(*) FILTER (WHERE haplo = 'h2') AS b FROM sv_cells GROUP BY 1, 2),
m AS (SELECT *, (a + b) // 2 AS c, a + b - (a + b) // 2 AS d FROM t),
x AS (SELECT cell_id, chrom, a, b, u.i AS i, -(lgamma(a + b - u.i + 1) + lgamma(a + c - u.i + 1) + lgamma(d - a + u.i + 1) + lgamma(u.i + 1)) AS l FROM m, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS u(i)),
y AS (SELECT *, exp(l - max(l) OVER (PARTITION BY cell_id, chrom)) AS p FROM x),
z AS (SELECT *, max(p) FILTER (WHERE i = a) OVER (PARTITION BY cell_id, chrom) AS here FROM y)
SELECT cell_id, chrom, a AS h1, b AS h2, round(sum(p) FILTER (WHERE p <= here * (1 + 1e-7)) / sum(p), 6) AS p FROM z GROUP BY ALL""",
    "sv_cells",
)
def haplotype_bias(svs):
    """Fisher's exact test of the haplotypes' counts against half and half."""
    n = svs.groupBy("cell_id", "chrom").agg(F.count_if(F.col("haplo") == "h1").alias("h1"), F.count_if(F.col("haplo") == "h2").alias("h2"))
    # few rows, but each costs its counts: kept apart, as small rows would be put into one task
    n = n.repartition(80, "cell_id", "chrom").withColumn("half", F.expr("(h1 + h2) div 2")).withColumn("rest", F.expr("h1 + h2 - half"))
    return n.select("cell_id", "chrom", "h1", "h2", F.round(P.fisher_exact("h1", "h2", "half", "rest"), 6).alias("p"))


@query(None, "sv_cells")
def gap_clustering(svs):
    """Gaps between variants against seeded random placements (no SQL: the places come from a seed)."""
    return P.gap_clustering(svs, ["cell_id", "chrom"], F.lit(3_006_000), seed=7, copies=20)


@query(
    """WITH s AS (SELECT ref, beg // 5000 AS bin, mapq, end_pos - beg AS size FROM reads), k AS (SELECT *, count(*) OVER (PARTITION BY ref, bin, size) AS k FROM s)
SELECT ref, bin, count(*) AS n, round(avg(mapq), 6) AS mean_mapq, round(avg(CASE WHEN mapq < 20 THEN 100 ELSE 0 END), 6) AS low_perc, first(size ORDER BY k DESC, size) AS read_size FROM k GROUP BY 1, 2""",
    "reads",
)
def region_quality(reads):
    """Quality of a region's reads and their modal size."""
    r = reads.withColumns({"bin": F.floor(F.col("beg") / 5000), "size": F.col("end_pos") - F.col("beg")})
    by_size = r.groupBy("ref", "bin", "size").agg(F.count(F.lit(1)).alias("k"), F.sum("mapq").alias("q"), F.count_if(F.col("mapq") < 20).alias("low"))
    n = F.sum("k")
    return by_size.groupBy("ref", "bin").agg(n.alias("n"), F.round(F.sum("q") / n, 6).alias("mean_mapq"), F.round(F.sum("low") * 100 / n, 6).alias("low_perc"), F.max_by("size", F.struct("k", -F.col("size"))).alias("read_size"))


# mobile elements --------------------------------------------------------------------------------

_ELEMENTS = {"chr1": "L1", "chr2": "Alu", "chr3": "SVA"}
_FAMILY = "CASE t_name WHEN 'chr1' THEN 'L1' WHEN 'chr2' THEN 'Alu' WHEN 'chr3' THEN 'SVA' END"
_MERGED = f"""consensus AS (SELECT *, {_FAMILY} AS family, 0 AS src FROM hits WHERE t_name IN ('chr1', 'chr2', 'chr3')),
reference AS (SELECT *, NULL AS family, 1 AS src FROM hits h WHERE t_name NOT IN ('chr1', 'chr2', 'chr3') AND NOT EXISTS (SELECT 1 FROM consensus k WHERE k.q_name = h.q_name AND k.q_beg <= h.q_end AND h.q_beg <= k.q_end
  AND (least(h.q_end, k.q_end) - greatest(h.q_beg, k.q_beg)) / (h.q_end - h.q_beg + 1) * 100 >= 10)),
merged AS (SELECT * REPLACE (src * 1000 + hit_ord AS hit_ord) FROM (SELECT * FROM consensus UNION ALL SELECT * FROM reference)), """
_CHAINS = CHAIN_SQL.replace("- 10 ", "- 300 ").replace("+ 10 ", "+ 300 ").replace("+ 10\n", "+ 300\n").replace("FROM hits)", "FROM merged)").replace("WITH RECURSIVE ", f"WITH RECURSIVE {_MERGED}", 1)


def _sides(hits):
    fam = F.create_map(*[F.lit(x) for kv in _ELEMENTS.items() for x in kv])[F.col("t_name")]
    rows = hits.withColumn("family", fam)
    return rows.where("family IS NOT NULL"), rows.where("family IS NULL")


@query(
    _CHAINS
    + """, f AS (SELECT m.q_name, (min(c.ce) - min(c.cb)) / 1000 * 100 AS cov, list_sort(list(DISTINCT family) FILTER (WHERE src = 0)) AS fams, count(DISTINCT t_name) FILTER (WHERE src = 1) AS loci FROM m JOIN c USING (q_name) GROUP BY m.q_name)
SELECT q_name, CASE WHEN len(coalesce(fams, [])) = 0 AND loci = 1 AND cov >= 75 THEN 'orphan' WHEN len(fams) > 1 AND NOT list_contains(fams, 'SVA') THEN 'chimera' WHEN len(fams) >= 1 AND loci = 0 THEN 'solo' WHEN len(fams) >= 1 THEN 'partnered' END AS itype,
 CASE WHEN list_contains(fams, 'SVA') THEN 'SVA' WHEN len(fams) >= 1 THEN array_to_string(fams, '-') END AS family, round(cov, 6) AS cov FROM f""",
    "hits",
)
def insertion_types(hits):
    """Type and family of an insert by its hits to consensus and reference."""
    f = retro.features(retro.K.chain(retro.merged_hits(*_sides(hits)), "q_name", "q_beg", "q_end", "ord", ["strand", "t_name", "t_beg", "t_end", "t_len", "q_len", "family", "src"], retro.CHAIN_DISTANCE, retro.CHAIN_OVERLAP))
    return f.select("q_name", retro.insertion_type().alias("itype"), retro.family(F.col("families")).alias("family"), F.round("cov", 6).alias("cov"))


@query(None, "variants", "hits")
def retro_pipeline(variants, hits):
    """The plan from candidates to verdicts."""
    a = retro.annotate(variants, *_sides(hits))
    return a.select("variant_ord", "itype", "family", "strand", F.round("cov", 6).alias("cov"), F.round("perc_resolved", 6).alias("perc_resolved"), "conformation", "failed")


# verdicts ---------------------------------------------------------------------------------------

_TYPES = "element_at(array('INS', 'DEL', 'LEFT-CLIPPING', 'RIGHT-CLIPPING'), CAST(read_ord * 7 % 4 + 1 AS INT))"


@query(
    _GAPS + ", t AS (SELECT ref, cluster, list_sort(list(DISTINCT ['INS', 'DEL', 'LEFT-CLIPPING', 'RIGHT-CLIPPING'][read_ord * 7 % 4 + 1])) AS types FROM c GROUP BY 1, 2) SELECT ref, CAST(cluster AS BIGINT) AS cluster, CASE WHEN list_contains(types, 'INS') AND NOT list_contains(types, 'DEL') THEN 'INS' WHEN list_contains(types, 'DEL') AND NOT list_contains(types, 'INS') THEN 'DEL' WHEN types = ['LEFT-CLIPPING', 'RIGHT-CLIPPING'] THEN 'INS_noOverlap' WHEN types IN (['LEFT-CLIPPING'], ['RIGHT-CLIPPING']) THEN 'BND' END AS sv_type FROM t",
    "reads",
)
def sv_types(reads):
    """Kind of a cluster by its event types."""
    t = clustered(reads).groupBy("ref", "cluster").agg(F.collect_set(F.expr(_TYPES)).alias("types"))
    return t.select("ref", "cluster", V.sv_type(F.col("types")).alias("sv_type"))


@query(
    _GAPS
    + """, i AS (SELECT ref, cluster, orientation, ['L1', 'Alu', 'SVA', 'Simple_repeat', 'gene'][mapq % 5 + 1] AS identity, CASE WHEN mapq % 15 = 0 THEN 'src' || (beg % 2) || '_' || (CASE beg % 3 WHEN 0 THEN '5' ELSE '3' END) ELSE '' END AS src FROM c),
n AS (SELECT ref, cluster, orientation, identity, src, count(*) AS n FROM i GROUP BY ALL),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY ref, cluster, orientation ORDER BY n DESC, identity, src) = 1),
s AS (SELECT ref, cluster, max(identity) FILTER (WHERE orientation = 'PLUS') AS p, max(identity) FILTER (WHERE orientation = 'MINUS') AS m, nullif(max(src) FILTER (WHERE orientation = 'PLUS'), '') AS ps, nullif(max(src) FILTER (WHERE orientation = 'MINUS'), '') AS ms FROM b GROUP BY 1, 2)
SELECT ref, CAST(cluster AS BIGINT) AS cluster,
 CASE WHEN p = m AND p = 'Simple_repeat' AND ps IS NULL AND ms IS NULL THEN 'pA' WHEN p = m THEN p WHEN p = 'Simple_repeat' THEN coalesce(m, p) WHEN m = 'Simple_repeat' THEN coalesce(p, m) ELSE concat_ws('_', p, m) END AS identity,
 CASE WHEN p = m AND ps IS NULL AND ms IS NULL THEN CASE p WHEN 'gene' THEN 'PSD' ELSE 'TD0' END WHEN p = m AND (ps IS NULL OR ms IS NULL) THEN 'TD1' WHEN p = m AND ps = ms THEN 'TD2' WHEN p = m THEN 'UNRESOLVED-TD'
  WHEN p IS NULL OR m IS NULL THEN 'RG' WHEN p <> 'Simple_repeat' AND m <> 'Simple_repeat' THEN 'UNDEFINED' WHEN p = 'gene' OR m = 'gene' THEN 'PSD' WHEN coalesce(ps, ms) IS NOT NULL THEN 'TD2' ELSE 'TD0-TD1' END AS ins_type FROM s""",
    "reads",
)
def mate_insertions(reads):
    """Mobile elements by what the mates on both sides are."""
    identity = F.expr("element_at(array('L1', 'Alu', 'SVA', 'Simple_repeat', 'gene'), CAST(mapq % 5 + 1 AS INT))")
    src = F.when(F.col("mapq") % 15 == 0, F.concat(F.lit("src"), F.col("beg") % 2, F.lit("_"), F.when(F.col("beg") % 3 == 0, "5").otherwise("3")))
    best = V.majority_identity(clustered(reads).withColumns({"identity": identity, "src": src}), ["ref", "cluster"])
    name, kind = V.insertion_by_mates()
    return best.select("ref", "cluster", name.alias("identity"), kind.alias("ins_type"))


@query(
    CHAIN_SQL + ", f AS (SELECT q_name, min(t_beg) AS b, max(t_end) AS e, max(t_len) AS t_len, sum(t_end - t_beg) FILTER (WHERE strand <> '+') AS inv, max(mapq) AS q FROM m GROUP BY 1) SELECT f.q_name, e - b AS retro_len, (e - b) * 100 >= t_len * 95 AS is_full, t_len - e AS trunc3, CAST(inv AS BIGINT) AS inversion, CASE WHEN t_len - e <= 100 AND q >= 40 THEN 'TPRT' WHEN (ce - cb) / 1000 * 100 >= 95 AND t_len - e > 100 AND q < 40 THEN 'EI' ELSE 'unknown' END AS mechanism FROM f JOIN c USING (q_name)",
    "hits",
)
def element_lengths(hits):
    """How much of an element a chain holds, and the mechanism that this speaks for."""
    c = chained(hits).withColumn("plus", F.lit("+")).withColumn("x", V.element_lengths("chain", "plus"))
    cov, tail = (F.element_at("chain", -1)["end"] - F.element_at("chain", 1)["beg"]) / 1000 * 100, F.array_max(F.transform("chain", lambda h: h["mapq"])) >= 40
    return c.select("q_name", F.col("x.len").alias("retro_len"), F.col("x.is_full").alias("is_full"), F.col("x.trunc3").alias("trunc3"), F.col("x.inversion").alias("inversion"), V.mechanism(cov, F.col("x.trunc3"), tail).alias("mechanism"))


@query(
    CHAIN_SQL.replace("<= 25", "<= 80") + ", f AS (SELECT q_name, (max(c.ce) - min(c.cb)) / 1000 * 100 AS cov, count(*) AS n_motifs, string_agg(t_name, ',' ORDER BY i) AS motifs FROM m JOIN c USING (q_name) GROUP BY q_name) SELECT q_name, round(cov, 6) AS cov, n_motifs, motifs FROM f WHERE cov >= 75",
    "hits",
)
def vntr_motifs(hits):
    """Tandem repeats: chains of calls that cover an insert, and their motifs."""
    c = chained(hits, 10, 80).withColumn("cov", (F.element_at("chain", -1)["end"] - F.element_at("chain", 1)["beg"]) / 1000 * 100)
    return c.where("cov >= 75").select("q_name", F.round("cov", 6).alias("cov"), F.size("chain").cast("long").alias("n_motifs"), F.array_join(F.transform("chain", lambda h: h["t_name"]), ",").alias("motifs"))


_CALLS = "SELECT * FROM hits WHERE strand = '+' AND q_beg < 300 AND mapq + 10 > 50 AND 70 - mapq > 20 AND q_end - q_beg > 10 OR strand = '-' AND 1000 - q_end < 300 AND mapq + 10 > 50 AND 70 - mapq > 20 AND q_end - q_beg > 10"


@query(
    CHAIN_SQL.replace("<= 25", "<= 80").replace("FROM hits)", "FROM calls)").replace("WITH RECURSIVE ", f"WITH RECURSIVE calls AS ({_CALLS}), ", 1) + "SELECT q_name, cb AS hex_beg, ce AS hex_end, length(left(repeat('ACGTTGCAAC', 100), cb) || substr(repeat('ACGTTGCAAC', 100), ce + 1)) AS trimmed_len FROM c",
    "hits",
)
def hexamer_trim(hits):
    """Hexamer calls near an end, chained, and the insert without them."""
    rich, poor = F.col("mapq") + 10, 70 - F.col("mapq")
    calls = hits.withColumns({"beg": F.col("q_beg"), "end": F.col("q_end"), "perc_c": rich, "perc_t": poor, "perc_g": rich, "perc_a": poor, "tr_seq": F.repeat(F.lit("C"), (F.col("q_end") - F.col("q_beg")).cast("int"))})
    kept = V.hexamer_calls(calls, F.col("strand"), F.col("q_len")).select(hits.columns)
    c = chained(kept, 10, 80).select("q_name", F.element_at("chain", 1)["beg"].alias("hex_beg"), F.element_at("chain", -1)["end"].alias("hex_end"))
    return c.select("q_name", "hex_beg", "hex_end", F.length(V.without_span("repeat('ACGTTGCAAC', 100)", "hex_beg", "hex_end")).cast("long").alias("trimmed_len"))


@query(
    "WITH s AS (SELECT id, pos, substr(alt, 1, 1) AS r, substr(alt, 2, 1 + variant_ord % 3) AS a FROM variants WHERE length(alt) > 5), t AS (SELECT id, pos, CASE WHEN variant = 0 THEN r ELSE r || a END AS ref, CASE WHEN variant = 1 THEN r WHEN variant = 2 THEN r || a || 'T' ELSE left(a, 1) END AS alt FROM (SELECT *, pos % 3 AS variant FROM s)) SELECT id, pos, coalesce(CASE WHEN list_contains(['A->T', 'A->G', 'A->C', 'T->A', 'T->G', 'T->C', 'G->A', 'G->T', 'G->C', 'C->A', 'C->T', 'C->G'], ref || '->' || alt) THEN CAST(list_position(['A->T', 'A->G', 'A->C', 'T->A', 'T->G', 'T->C', 'G->A', 'G->T', 'G->C', 'C->A', 'C->T', 'C->G'], ref || '->' || alt) AS VARCHAR) END, CASE WHEN length(ref) > length(alt) AND starts_with(ref, alt) THEN '-' || ref END, CASE WHEN length(alt) > length(ref) AND starts_with(alt, ref) THEN '+' || alt END, '0') AS status FROM t",
    "variants",
)
def haplotype_codes(variants):
    """What a haplotype has at a place, 0 for no change."""
    s = variants.where(F.length("alt") > 5).selectExpr("id", "pos", "pos % 3 AS variant", "substring(alt, 1, 1) AS r", "substring(alt, 2, CAST(1 + variant_ord % 3 AS INT)) AS a")
    t = s.selectExpr("id", "pos", "CASE WHEN variant = 0 THEN r ELSE r || a END AS ref", "CASE WHEN variant = 1 THEN r WHEN variant = 2 THEN r || a || 'T' ELSE left(a, 1) END AS alt")
    return t.select("id", "pos", F.coalesce(V.status(F.col("ref"), F.col("alt")), F.lit("0")).alias("status"))


@query(
    "WITH w AS (SELECT chrom, w.w AS win, beg, end_pos, sv_id FROM sv_cells, unnest(range(beg // 50000, end_pos // 50000 + 1)) AS w(w)), g AS (SELECT *, lead(beg) OVER (PARTITION BY chrom, win ORDER BY beg, sv_id) - end_pos AS gap FROM w) SELECT chrom, win, count(*) AS n, median(gap) AS median_gap FROM g GROUP BY 1, 2 HAVING count(*) >= 4 AND median(gap) <= 0",
    "sv_cells",
)
def dense_windows(svs):
    """Windows where variants lie upon each other."""
    return V.dense_windows(svs, ["chrom"], 50_000)
