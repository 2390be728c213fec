"""Queries of events, bridges and junctions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aligner as A
from ..operators import cluster as L
from ..operators import events as E
from .catalogue import CHAIN_SQL, HIT, _GAPS, chained, clustered, query

_PAIR_GAPS = _GAPS.replace("FROM reads", "FROM pairs")
_SLICE = lambda s, b, e: f"substr({s}, CAST(greatest({b}, 0) + 1 AS INT), CAST(greatest({e} - greatest({b}, 0), 0) AS INT))"
_P, _N = "(length(alt) // 3)", "(length(alt) // 4)"


@query(
    f"WITH v AS (SELECT *, CASE WHEN variant_ord % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM variants) SELECT id, md5({_SLICE('alt', f'CASE WHEN {_P} - 50 > 0 THEN {_P} - 50 ELSE 0 END', f'{_P} + {_N} + 50')}) AS ins_seq, CASE WHEN {_P} - 50 > 0 THEN 50 ELSE {_P} END AS ins_pos, md5({_SLICE('alt', f'{_P} - 50', f'{_P} + 50')}) AS del_seq, md5(CASE WHEN side = 'left' THEN {_SLICE('alt', '0', f'{_P} + 50')} ELSE {_SLICE('alt', f'{_P} - 50', 'length(alt)')} END) AS clip_seq, md5(CASE WHEN side = 'left' THEN {_SLICE('alt', '0', _P)} ELSE {_SLICE('alt', _P, 'length(alt)')} END) AS clipped, md5({_SLICE('alt', _P, f'{_P} + {_N}')}) AS insert_seq FROM v",
    "variants",
)
def read_slices(variants):
    """Events and what lies around them, cut from reads."""
    seq, p, n = F.col("alt"), F.floor(F.length("alt") / 3), F.floor(F.length("alt") / 4)
    side = F.when(F.col("variant_ord") % 2 == 0, "left").otherwise("right")
    ins = E.flank_of_insertion(seq, p, n, 50)
    return variants.select("id", F.md5(ins["seq"]).alias("ins_seq"), ins["pos"].alias("ins_pos"), F.md5(E.flank_of_deletion(seq, p, 50)).alias("del_seq"), F.md5(E.flank_of_clipping(seq, p, side, 50)).alias("clip_seq"), F.md5(E.clipped_part(seq, p, side)).alias("clipped"), F.md5(E.slice_of(seq, p, p + n)).alias("insert_seq"))


@query("SELECT read_ord, CASE WHEN double_clip = (orientation = 'PLUS') THEN q_end ELSE 0 END AS beg, CASE WHEN double_clip = (orientation = 'PLUS') THEN 151 ELSE q_beg END AS \"end\" FROM pairs", "pairs")
def clipped_intervals(pairs):
    """where the clipped piece lies on its read."""
    part = E.clipped_interval(F.col("q_beg"), F.col("q_end"), F.lit(151).cast("long"), F.col("double_clip"), F.when(F.col("orientation") == "PLUS", "left").otherwise("right"))
    return pairs.select("read_ord", part["beg"].alias("beg"), part["end"].alias("end"))


@query("SELECT read_ord, read_name || '/' || (3 - pair_no) AS name, mate_ref AS ref, mate_beg AS beg, ref AS mate_ref, beg AS mate_beg FROM pairs", "pairs")
def mates(pairs):
    """mates as reads."""
    return E.as_mates(pairs)


_SA = "concat(CASE WHEN read_ord % 2 = 0 THEN ref ELSE mate_ref END, ',', CAST(mate_beg AS {S}), ',+,60M,', CAST(mapq AS {S}), ',0;', CASE WHEN read_ord % 3 = 0 THEN concat('x,', CAST(beg + 9 AS {S}), ',-,40M,1,0;') ELSE '' END)"


@query(
    f"WITH c AS (SELECT *, {_SA.replace('{S}', 'VARCHAR')} AS sa, read_ord % 60 AS clip_len FROM pairs), e AS (SELECT c.*, split_part(x.x, ',', 1) AS m_ref, CAST(split_part(x.x, ',', 2) AS BIGINT) AS m_beg, CASE WHEN orientation <> 'MINUS' THEN beg - (151 - clip_len) ELSE beg END AS b FROM c, unnest(list_filter(string_split(sa, ';'), lambda y: y <> '')) AS x(x)) SELECT read_ord, ref, b AS beg, b + 151 - clip_len AS end_pos, orientation, m_ref AS mate_ref, m_beg AS mate_beg FROM e WHERE ref <> m_ref OR abs(m_beg - b) >= 5000",
    "pairs",
)
def supplementary_as_pairs(pairs):
    """Supplementary alignments of clippings as discordant pairs."""
    clips = pairs.withColumn("sa", F.expr(_SA.replace("{S}", "STRING"))).withColumn("clip_len", F.col("read_ord") % 60)
    return E.supplementary_as_pairs(clips, 151)


@query(
    _PAIR_GAPS + ", b AS (SELECT DISTINCT read_name FROM pairs WHERE double_clip), s AS (SELECT c.ref, c.cluster, count(*) FILTER (WHERE c.read_ord % 3 = CASE WHEN b.read_name IS NOT NULL THEN 1 ELSE 0 END) * 100 / count(*) AS percent FROM c LEFT JOIN b ON b.read_name = c.read_name GROUP BY c.ref, c.cluster) SELECT ref, CAST(cluster AS BIGINT) AS cluster, round(percent, 6) AS percent FROM s",
    "pairs",
)
def junction_partners(pairs):
    """Events that stand where a junction's would among their read's alignments."""
    events = clustered(pairs).withColumn("read_index", F.col("read_ord") % 3)
    return E.partner_share(events, pairs.where("double_clip"), ["ref", "cluster"]).select("ref", "cluster", F.round("percent", 6).alias("percent"))


@query(
    _PAIR_GAPS + " SELECT mate_ref, count(DISTINCT ref || ':' || cluster) AS clusters, count(DISTINCT read_name) AS n_reads, list_sort(list(DISTINCT read_name)) AS reads, list_sort(list(DISTINCT CASE WHEN proper THEN 'aligned' ELSE 'unaligned' END)) AS types FROM c GROUP BY mate_ref",
    "pairs",
)
def bridge_support(pairs):
    """What supports a bridge."""
    parts = clustered(pairs).withColumns({"cluster": F.concat_ws(":", "ref", "cluster"), "support": F.when(F.col("proper"), "aligned").otherwise("unaligned")})
    return E.bridge_support(parts, ["mate_ref"])


@query(
    "WITH g AS (SELECT ref, beg // 2000 AS bin, read_name, q_beg - 10 AS gap FROM pairs), s AS (SELECT ref, bin, count(DISTINCT read_name) AS reads, count(DISTINCT read_name) FILTER (WHERE gap > 0) AS bridging, avg(gap) FILTER (WHERE gap > 0) AS length, coalesce(stddev_pop(gap) / nullif(avg(gap), 0) * 100, 0) AS cv FROM g GROUP BY 1, 2) SELECT ref, bin, reads, bridging, round(length, 6) AS length FROM s WHERE bridging >= 2 AND bridging * 100 >= 30 * reads AND length <= 10000 AND cv <= 160",
    "pairs",
)
def bridges(pairs):
    """Bridges by the lengths between a read's alignments."""
    g = pairs.select("ref", F.floor(F.col("beg") / 2000).alias("bin"), "read_name", (F.col("q_beg") - 10).alias("gap"))
    return E.supports_bridge(g, ["ref", "bin"], 2, 30, max_cv=160).select("ref", "bin", "reads", "bridging", F.round("length", 6).alias("length"))


@query(
    _PAIR_GAPS + ", k AS (SELECT ref, cluster, mode_beg, read_name FROM (SELECT ref, cluster, min(beg) OVER (PARTITION BY ref, cluster) AS mode_beg, read_name FROM c)), j AS (SELECT DISTINCT a.ref AS ref_a, a.mode_beg AS pos_a, b.ref AS ref_b, b.mode_beg AS pos_b, a.read_name FROM k a JOIN k b ON a.read_name = b.read_name AND (a.ref < b.ref OR a.ref = b.ref AND a.mode_beg < b.mode_beg)) SELECT ref_a || ':' || pos_a || '-' || ref_b || ':' || pos_b AS coord, CASE WHEN ref_a = ref_b THEN 'intrachromosomal' ELSE 'interchromosomal' END AS kind, count(DISTINCT read_name) AS n_reads FROM j GROUP BY ALL HAVING count(DISTINCT read_name) >= 2",
    "pairs",
)
def junctions(pairs):
    """Junctions of clusters that share reads, with coordinates and kind."""
    k = clustered(pairs).withColumn("pos", F.min("beg").over(Window.partitionBy("ref", "cluster"))).select("read_name", "ref", "pos").distinct()
    b = k.select("read_name", F.col("ref").alias("ref_b"), F.col("pos").alias("pos_b"))
    j = k.withColumnsRenamed({"ref": "ref_a", "pos": "pos_a"}).join(b, "read_name").where("ref_a < ref_b OR ref_a = ref_b AND pos_a < pos_b")
    coord, kind = E.junction("ref_a", "pos_a", "ref_b", "pos_b")
    return j.groupBy(coord.alias("coord"), kind.alias("kind")).agg(F.count_distinct("read_name").alias("n_reads")).where("n_reads >= 2")


@query("WITH r AS (SELECT mate_ref, read_name, count(*) AS hits, min(mapq % 5) AS n_suppl FROM pairs GROUP BY 1, 2) SELECT mate_ref, read_name, hits, n_suppl, row_number() OVER (PARTITION BY mate_ref ORDER BY hits DESC, n_suppl, read_name) AS rank FROM r QUALIFY rank <= 3", "pairs")
def spanning_reads(pairs):
    """The reads that span a junction best."""
    out = E.spanning_order(pairs.withColumn("n_suppl", F.col("mapq") % 5), ["mate_ref"], 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(CHAIN_SQL + ", x AS (SELECT q_name, min(CASE WHEN strand = '+' THEN t_end ELSE t_beg END) FILTER (WHERE i = 1) AS a, min(CASE WHEN strand = '+' THEN t_beg ELSE t_end END) FILTER (WHERE i = n) AS b FROM m GROUP BY q_name) SELECT q_name, abs(least(a, b) - 30000) <= 15000 AND abs(greatest(a, b) - 60000) <= 15000 AS supported FROM x", "hits")
def breakpoint_support(hits):
    """Consensus sequences that agree with both breakpoints."""
    return chained(hits).select("q_name", E.supports_breakpoints("chain", F.lit(60000), F.lit(30000), 15000).alias("supported"))


@query(
    CHAIN_SQL.replace("- 10 <= x.q_end + 10", "- 10000 <= x.q_end + 10000").replace("x.q_beg - 10 <= g.ce + 10", "x.q_beg - 10000 <= g.ce + 10000").replace("<= 25", "<= 20")
    + ", x AS (SELECT q_name, n, q_beg - lag(q_end) OVER (PARTITION BY q_name ORDER BY i) AS gap FROM m) SELECT q_name, any_value(n) AS n, max(gap) AS gap FROM x GROUP BY q_name HAVING any_value(n) > 1 AND max(gap) >= 50",
    "hits",
)
def complementary_alignments(hits):
    """Alignments of a read that continue each other around an insert."""
    return E.complementary_hits(hits, "q_name", "hit_ord", HIT)


@query("WITH k AS (SELECT id, length(alt) AS n, substr(alt, CAST(i.i AS INT), 6) AS k FROM variants, unnest(range(1, length(alt) - 4)) AS i(i)), w AS (SELECT id, count(DISTINCT k) / count(*) AS complexity FROM k GROUP BY id) SELECT v.id, round(w.complexity, 6) AS complexity, coalesce(w.complexity >= 0.3, FALSE) AS kept FROM variants v LEFT JOIN w ON w.id = v.id", "variants")
def kmer_complexity(variants):
    """Sequences by the share of distinct k-mers."""
    x = E.kmer_complexity("alt", 6)
    return variants.select("id", F.round(x, 6).alias("complexity"), F.coalesce(x >= 0.3, F.lit(False)).alias("kept"))


@query("WITH w AS (SELECT id, i.i AS i, substr(alt, CAST(16 * i.i + 1 AS INT), 16) AS w FROM variants, unnest(range(0, length(alt) // 16)) AS i(i)), k AS (SELECT id, i, count(DISTINCT substr(w, CAST(j.j AS INT), 3)) AS n FROM w, unnest(range(1, 15)) AS j(j) GROUP BY id, i), s AS (SELECT id, count(*) FILTER (WHERE n < 6) / count(*) AS share FROM k GROUP BY id) SELECT v.id, round(s.share, 6) AS share FROM variants v LEFT JOIN s ON s.id = v.id", "variants")
def simple_repeats(variants):
    """Share of a sequence in windows of low complexity."""
    return variants.select("id", F.round(E.low_complexity_share("alt"), 6).alias("share"))


@query("SELECT q_name, hit_ord, CASE WHEN strand = '-' THEN q_len - q_end ELSE q_beg END AS beg, CASE WHEN strand = '-' THEN q_len - q_beg ELSE q_end END AS \"end\", t_beg + 5000 AS g_beg, t_end + 5000 AS g_end, split_part(t_name, 'chr', 2) AS ref FROM hits", "hits")
def shifted_hits(hits):
    """Query coordinates on the other strand, target coordinates as the reference's."""
    x = E.flipped(F.col("q_beg"), F.col("q_end"), F.col("q_len"), F.col("strand"))
    moved = E.shifted(hits, ["t_beg", "t_end"], F.lit(5000), F.regexp_replace("t_name", "^chr", ""))
    return moved.select("q_name", "hit_ord", x["beg"].alias("beg"), x["end"].alias("end"), F.col("t_beg").alias("g_beg"), F.col("t_end").alias("g_end"), "ref")


@query("SELECT id, CASE WHEN variant_ord % 3 = 0 THEN pos ELSE pos - variant_ord % 20 END AS beg, CASE WHEN variant_ord % 3 = 0 THEN pos ELSE pos + variant_ord % 30 END AS \"end\" FROM variants", "variants")
def confidence_intervals(variants):
    """Positions with their confidence offsets."""
    ci = F.when(F.col("variant_ord") % 3 != 0, F.concat(F.lit("-"), (F.col("variant_ord") % 20).cast("string"), F.lit(","), (F.col("variant_ord") % 30).cast("string")))
    x = E.confidence_interval(F.col("pos"), ci)
    return variants.select("id", x["beg"].alias("beg"), x["end"].alias("end"))


@query(_PAIR_GAPS + ", m AS (SELECT *, row_number() OVER (PARTITION BY ref, cluster, orientation ORDER BY end_pos - beg DESC, read_ord) AS k FROM c) SELECT ref, CAST(cluster AS BIGINT) AS cluster, orientation, read_ord, end_pos - beg AS len FROM m WHERE k = 1", "pairs")
def longest_clipping(pairs):
    """The longest event of each side of a cluster."""
    k = clustered(pairs).groupBy("ref", "cluster", "orientation").agg(F.max(F.struct((F.col("end_pos") - F.col("beg")).alias("len"), (-F.col("read_ord")).alias("o"))).alias("x"))
    return k.select("ref", "cluster", "orientation", (-F.col("x.o")).alias("read_ord"), F.col("x.len").alias("len"))


@query("SELECT read_name, list(ref || ':' || beg || ':' || read_ord ORDER BY ref, beg, read_ord) AS places, list_sort(list(DISTINCT ref)) AS refs FROM reads GROUP BY read_name", "reads")
def events_by_name(reads):
    """Events gathered by name, in order."""
    places = F.transform(F.array_sort(F.collect_list(F.struct("ref", "beg", "read_ord"))), lambda x: F.concat_ws(":", x["ref"], x["beg"].cast("string"), x["read_ord"].cast("string")))
    return reads.groupBy("read_name").agg(places.alias("places"), F.array_sort(F.collect_set("ref")).alias("refs"))


@query("SELECT read_ord, ref, beg, 'pairs' AS src FROM pairs WHERE NOT proper UNION ALL SELECT read_ord, ref, beg, 'reads' AS src FROM reads WHERE read_ord NOT IN (SELECT read_ord FROM pairs WHERE NOT proper)", "reads", "pairs")
def merged_with_precedence(reads, pairs):
    """Two tables by key, the second's rows before the first's."""
    a, b = (x.select("read_ord", "ref", "beg", F.lit(n).alias("src")) for x, n in ((reads, "reads"), (pairs.where("NOT proper"), "pairs")))
    return E.with_precedence(a, b, ["read_ord"])


@query(_GAPS + ", p AS (SELECT ref, CAST(cluster AS BIGINT) AS cluster, beg, end_pos, read_name FROM c), k AS (SELECT *, cluster // 2 AS merged FROM p) SELECT ref, merged, min(beg) AS beg, max(end_pos) AS end_pos, count(*) AS n, count(DISTINCT read_name) AS n_reads FROM k GROUP BY ref, merged", "reads")
def merged_clusters(reads):
    """Clusters put together with the union of their events."""
    k = clustered(reads).withColumn("merged", F.floor(F.col("cluster") / 2))
    return k.groupBy("ref", "merged").agg(F.min("beg").alias("beg"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n"), F.count_distinct("read_name").alias("n_reads"))


_A, _B = "left(alt, CAST(length(alt) * 2 // 3 AS INT))", "substr(alt, CAST(length(alt) * 2 // 3 - least(length(alt) // 3, 60) + 1 AS INT))"


@query(f"WITH s AS (SELECT id, {_A} AS a, {_B} AS b FROM variants), k AS (SELECT id, max(i.i) AS k FROM s, unnest(range(20, 251)) AS i(i) WHERE i.i <= length(a) AND i.i <= length(b) AND right(a, CAST(i.i AS INT)) = left(b, CAST(i.i AS INT)) GROUP BY id) SELECT s.id, coalesce(k.k, 0) AS overlap, md5(CASE WHEN k.k > 0 THEN a || substr(b, CAST(k.k + 1 AS INT)) END) AS seq FROM s LEFT JOIN k ON k.id = s.id", "variants")
def assembled_pairs(variants):
    """Sequences joined where the end of one is the begin of the other."""
    n = F.length("alt")
    cut = F.floor(n * 2 / 3)
    a = F.substring("alt", F.lit(1), cut.cast("int"))
    b = F.substring("alt", (cut - F.least(F.floor(n / 3), F.lit(60)) + 1).cast("int"), n)
    rows = variants.select("id", a.alias("a"), b.alias("b"))
    return rows.select("id", E.head_tail_overlap(F.col("a"), F.col("b"), 20, 250).cast("long").alias("overlap"), F.md5(E.assembled(F.col("a"), F.col("b"))).alias("seq"))


_SEG = "WITH g AS (SELECT cell_id, chrom, beg // 1000 AS seg, min(sv_type) AS sv_type, avg(af) AS af FROM sv_cells GROUP BY 1, 2, 3), n AS (SELECT chrom, seg, sv_type, count(DISTINCT cell_id) AS cells FROM g GROUP BY 1, 2, 3)"


@query(_SEG + " SELECT chrom, seg, sv_type, cells FROM n QUALIFY row_number() OVER (PARTITION BY chrom, seg ORDER BY cells DESC, sv_type) = 1", "sv_cells")
def consensus_segments(svs):
    """The kind of variant that most cells have on a segment of equal coordinates."""
    g = svs.groupBy("cell_id", "chrom", F.floor(F.col("beg") / 1000).alias("seg")).agg(F.min("sv_type").alias("sv_type"))
    n = g.groupBy("chrom", "seg", "sv_type").agg(F.count_distinct("cell_id").alias("cells"))
    return n.groupBy("chrom", "seg").agg(F.min(F.struct((-F.col("cells")).alias("neg"), "sv_type")).alias("x")).select("chrom", "seg", F.col("x.sv_type").alias("sv_type"), (-F.col("x.neg")).alias("cells"))


@query(
    "WITH c AS (SELECT cell_id, chrom, count(*) AS n, count(*) FILTER (WHERE haplo = 'h1') AS h1, count(*) FILTER (WHERE haplo = 'h2') AS h2, median(gap) AS gap FROM (SELECT *, lead(beg) OVER (PARTITION BY cell_id, chrom ORDER BY beg, sv_id) - end_pos AS gap FROM sv_cells) GROUP BY 1, 2), t AS (SELECT cell_id, sum(n) AS total FROM c GROUP BY cell_id) SELECT c.cell_id, chrom, n > 0.25 * total AS enriched, coalesce(gap < 200000, FALSE) AS clustered, coalesce(greatest(h1, h2) >= 0.8 * (h1 + h2), FALSE) AND h1 + h2 > 0 AS biased, n > 0.25 * total AND coalesce(gap < 200000, FALSE) AND greatest(h1, h2) >= 0.8 * (h1 + h2) AND h1 + h2 > 0 AS chromothriptic FROM c JOIN t ON t.cell_id = c.cell_id",
    "sv_cells",
)
def chromothripsis(svs):
    """Chromosomes with many variants, near each other, on one haplotype."""
    w = Window.partitionBy("cell_id", "chrom").orderBy("beg", "sv_id")
    c = svs.withColumn("gap", F.lead("beg").over(w) - F.col("end_pos")).groupBy("cell_id", "chrom")
    c = c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("haplo") == "h1").alias("h1"), F.count_if(F.col("haplo") == "h2").alias("h2"), F.median("gap").alias("gap"))
    return L.chromothriptic(c.join(c.groupBy("cell_id").agg(F.sum("n").alias("total")), "cell_id"))


_READ_NAMES = "CASE WHEN read_ord % 4 = 0 THEN concat('v', CAST(read_ord % 3 AS VARCHAR)) END"


@query(f"WITH v AS (SELECT read_name, min({_READ_NAMES}) AS virus FROM reads GROUP BY 1) SELECT virus, count(*) AS n, count(DISTINCT p.read_name) AS n_reads FROM pairs p JOIN v ON v.read_name = p.read_name AND v.virus IS NOT NULL GROUP BY virus", "reads", "pairs")
def viral_mates(reads, pairs):
    """Discordant reads whose names are among a virus' reads, by virus."""
    v = reads.groupBy("read_name").agg(F.min(F.expr(_READ_NAMES.replace("VARCHAR", "STRING"))).alias("virus")).where("virus IS NOT NULL")
    return pairs.join(v, "read_name").groupBy("virus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("read_name").alias("n_reads"))


_K = 24


@query(
    f"WITH y AS (SELECT variant_ord, 256 * j AS o, substr(alt, CAST(256 * j + 1 AS INT), 256 + {_K - 1}) AS y FROM variants, unnest(range(0, length(alt) // 256 + 1)) AS u(j)), q AS (SELECT variant_ord, o + i.i AS q_pos, substr(y, CAST(i.i + 1 AS INT), {_K}) AS k FROM y, unnest(range(0, length(y) - {_K - 1})) AS i(i)), t AS (SELECT t_name, i.i AS t_pos, substr(seq, CAST(i.i + 1 AS INT), {_K}) AS k FROM targets, unnest(range(0, length(seq) - {_K - 1})) AS i(i)), f AS (SELECT k FROM t GROUP BY k HAVING count(*) <= 50), s AS (SELECT variant_ord, t_name, q_pos - t_pos AS d, q_pos FROM q JOIN t ON t.k = q.k JOIN f ON f.k = t.k), n AS (SELECT *, CASE WHEN q_pos - lag(q_pos) OVER (PARTITION BY variant_ord, t_name, d ORDER BY q_pos) <= 10 THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY variant_ord, t_name, d ORDER BY q_pos) AS run FROM n) SELECT variant_ord AS q_name, t_name, min(q_pos) AS q_beg, max(q_pos) + {_K} AS q_end, min(q_pos) - d AS t_beg, max(q_pos) + {_K} - d AS t_end, count(*) AS n_seeds FROM g GROUP BY variant_ord, t_name, d, run HAVING count(*) >= 5",
    "variants",
    "targets",
)
def seed_hits(variants, targets):
    """Hits of sequences to targets by seeds on one diagonal."""
    return A.seed_hits(variants.select(F.col("variant_ord").alias("q_name"), F.col("alt").alias("seq")), targets, k=_K, max_gap=10, least_seeds=5, most_places=50)
