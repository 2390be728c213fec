"""Queries of what an insert's hits say of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain as K
from ..operators import inserts as N
from ..operators import interval_join as J
from .catalogue import CHAIN_SQL, HIT, query


def chains_of(base: str) -> str:
    """The chains' SQL over some of the hits only."""
    return CHAIN_SQL.replace("FROM hits)", "FROM hh)", 1).replace("WITH RECURSIVE r AS", f"WITH RECURSIVE hh AS ({base}), r AS", 1)


def _chain(hits):
    return K.chain(hits, "q_name", "q_beg", "q_end", "hit_ord", HIT, 10, 25)


#: An insert's own place, made of its name.
_CHROM, _POS = "concat('chr', CAST(q_name % 5 + 1 AS {S}))", "(q_name * 7919) % 90000"
_PLACE = f"SELECT *, {_CHROM.replace('{S}', 'VARCHAR')} AS chrom, {_POS} AS pos FROM hits"


def placed(hits):
    return hits.withColumn("chrom", F.expr(_CHROM.replace("{S}", "STRING"))).withColumn("pos", F.expr(_POS))


_COORDS = "string_agg(t_name || ':' || t_beg || '-' || t_end, ',' ORDER BY i)"


def _transductions_sql(side: str) -> str:
    free = "0 AS fb, cb AS fe" if side == "5" else "ce AS fb, 1000 AS fe"
    consensus = chains_of("SELECT * FROM hits WHERE t_name IN ('chr1', 'chr2')")
    consensus = consensus[: consensus.index("m AS (SELECT c.q_name")].rstrip().rstrip(",")
    second = CHAIN_SQL.replace("WITH RECURSIVE r AS", "r2 AS", 1).replace("FROM hits)", "FROM h2)", 1).replace("FROM r WHERE", "FROM r2 WHERE").replace("JOIN r x", "JOIN r2 x").replace("JOIN r ON r.q_name = c.q_name AND r.k", "JOIN r2 r ON r.q_name = c.q_name AND r.k").replace("\ng AS (", "\ng2 AS (").replace("FROM g JOIN", "FROM g2 g JOIN").replace("FROM g QUALIFY", "FROM g2 QUALIFY").replace("\nc AS (", "\nc2 AS (").replace("FROM c, unnest", "FROM c2 c, unnest").replace("\nm AS (", "\nm2 AS (")
    return (
        consensus
        + f", f AS (SELECT q_name, {free} FROM c), h2 AS (SELECT h.* FROM hits h JOIN f ON f.q_name = h.q_name AND fe - fb >= 10 WHERE t_name NOT IN ('chr1', 'chr2') AND q_beg <= fe AND fb <= q_end), "
        + second
        + f", t AS (SELECT c2.q_name, fb, fe, greatest(least(fe, ce) - greatest(fb, cb) + 1, 0) * 100.0::DOUBLE / (fe - fb) AS percent FROM c2 JOIN f ON f.q_name = c2.q_name) SELECT t.q_name, round(any_value(percent), 6) AS percent, count(*) AS n_td, {_COORDS} AS coords, string_agg(CAST(mapq AS VARCHAR), ',' ORDER BY i) AS mapqs FROM t JOIN m2 ON m2.q_name = t.q_name WHERE percent >= 25 GROUP BY t.q_name"
    )


def _transductions(hits, side):
    consensus = hits.where(F.col("t_name").isin("chr1", "chr2"))
    free = N.unaligned_end(_chain(consensus), "q_name", side)
    found = N.transductions(free, hits.where(~F.col("t_name").isin("chr1", "chr2")), "q_name", "hit_ord", HIT)
    mapqs = F.array_join(F.transform("chain", lambda x: x["mapq"].cast("string")), ",")
    return found.select("q_name", F.round("percent", 6).alias("percent"), F.size("chain").cast("long").alias("n_td"), N.coordinates("chain").alias("coords"), mapqs.alias("mapqs"))


@query(_transductions_sql("5"), "hits")
def transductions_5prime(hits):
    """Transductions in the unaligned head of an insert."""
    return _transductions(hits, "5")


@query(_transductions_sql("3"), "hits")
def transductions_3prime(hits):
    """Transductions in the unaligned tail of an insert."""
    return _transductions(hits, "3")


_SHOW = "t_name || ':' || t_beg || '-' || t_end"
_OWN = "t_name = chrom AND t_beg <= pos + 50000 AND pos - 50000 <= t_end"


@query(
    chains_of(_PLACE) + f", n AS (SELECT *, {_OWN} AS own FROM m) SELECT q_name, min({_SHOW}) FILTER (WHERE own AND i = 1) AS temp5, min({_SHOW}) FILTER (WHERE own AND i = n AND n > 1) AS temp3, arg_max({_SHOW}, i) FILTER (WHERE own AND i > 1 AND i < n) AS temp_in FROM n GROUP BY q_name",
    "hits",
)
def templated_parts(hits):
    """Parts that come from next to the insertion itself."""
    chains = _chain(hits).withColumn("chrom", F.expr(_CHROM.replace("{S}", "STRING"))).withColumn("pos", F.expr(_POS))
    return N.templated(chains, "chrom", "pos").select("q_name", "temp5", "temp3", "temp_in")


def _dup_sql(reach: int, mapq: int, least: int) -> str:
    base = f"SELECT * FROM ({_PLACE}) WHERE t_name = chrom AND mapq >= {mapq} AND t_beg <= pos + {reach} AND pos - {reach} <= t_end"
    return chains_of(base) + f" SELECT m.q_name, CASE WHEN bool_or(strand = '+') AND bool_or(strand = '-') THEN 'COMPLEX_DUP' WHEN bool_or(strand = '+') THEN 'DUP' ELSE 'INV_DUP' END AS dup_type, string_agg(t_name || ':' || t_beg || '-' || t_end || '_' || strand, ',' ORDER BY i) AS coords FROM m JOIN c ON c.q_name = m.q_name WHERE (c.ce - c.cb) / 1000 * 100 >= {least} GROUP BY m.q_name"


@query(_dup_sql(20000, 0, 20), "hits")
def own_locus_dup(hits):
    """Tandem duplications by hits at the own locus."""
    return N.own_locus_duplications(placed(hits), "q_name", "hit_ord", HIT, "chrom", "pos", reach=20_000, least_percent=20)


@query(_dup_sql(30000, 10, 25), "hits")
def flank_realigned_dup(hits):
    """Tandem duplications by hits of an insert to its own flanks."""
    return N.own_locus_duplications(placed(hits), "q_name", "hit_ord", HIT, "chrom", "pos", reach=30_000, least_percent=25, least_mapq=10)


_FEATURE = "CASE t_name WHEN 'chr1' THEN 'VNTR' WHEN 'chr2' THEN 'SINE-R' WHEN 'chr3' THEN 'Alu-like' ELSE 'MAST2' END"


def _feature(x):
    return F.when(x["t_name"] == "chr1", "VNTR").when(x["t_name"] == "chr2", "SINE-R").when(x["t_name"] == "chr3", "Alu-like").otherwise("MAST2")


@query(
    chains_of("SELECT * REPLACE (t_end + q_name % 3 * 20 AS t_len) FROM hits WHERE mapq > 0")
    + f", s AS (SELECT *, CASE WHEN strand = '+' THEN 'FOR' ELSE 'REV' END AS part FROM m) SELECT s.q_name, array_to_string(list_sort(list(DISTINCT {_FEATURE})), ',') AS families, {_COORDS} AS coords, string_agg(CAST(mapq AS VARCHAR), ',' ORDER BY i) AS mapqs FROM s JOIN c ON c.q_name = s.q_name WHERE (c.ce - c.cb) / 1000 * 100 > 30 GROUP BY s.q_name HAVING NOT coalesce(min(t_len - t_end) FILTER (WHERE i = n) > 10, FALSE)",
    "hits",
)
def nested_parts(hits):
    """Unaligned ends that another element's consensus explains."""
    near = hits.where("mapq > 0").withColumn("t_len", F.col("t_end") + F.col("q_name") % 3 * 20)
    return N.nested(_chain(near), "q_name", _feature, least_percent=30)


@query(
    CHAIN_SQL
    + f", o AS (SELECT q_name, {_FEATURE} AS f, min(i) AS a1 FROM m GROUP BY ALL), s AS (SELECT q_name, string_agg(f, '+' ORDER BY a1) AS body FROM o GROUP BY q_name), v AS (SELECT q_name, min(q_beg) FILTER (WHERE i = a) AS vb, max(q_end) FILTER (WHERE i = b) AS ve FROM (SELECT *, min(i) FILTER (WHERE t_name = 'chr1') OVER (PARTITION BY q_name) AS a, max(i) FILTER (WHERE t_name = 'chr1') OVER (PARTITION BY q_name) AS b FROM m) GROUP BY q_name), z AS (SELECT q_name, arg_max(strand, t_end * 1000 - i) AS strand FROM m GROUP BY q_name) SELECT s.q_name, (CASE WHEN s.q_name % 11 = 0 THEN 'TEMPLATED+' ELSE '' END) || repeat('TD+', CAST(s.q_name % 3 AS INT)) || (CASE WHEN s.q_name % 4 = 0 THEN 'Hexamer+' ELSE '' END) || body || repeat('+POLYA+TD', CAST(s.q_name % 2 AS INT)) || (CASE WHEN s.q_name % 7 = 0 THEN '+POLYA+Alu' ELSE '' END) || (CASE WHEN s.q_name % 13 = 0 THEN '+TEMPLATED' ELSE '' END) || (CASE WHEN s.q_name % 5 > 0 THEN '+POLYA' ELSE '' END) AS structure, vb AS vntr_beg, ve AS vntr_end, ve - vb AS vntr_len, CASE WHEN s.q_name % 6 = 0 THEN '-' ELSE z.strand END AS strand FROM s JOIN v ON v.q_name = s.q_name JOIN z ON z.q_name = s.q_name",
    "hits",
)
def structures(hits):
    """Structures with their surroundings, spans of a feature, strands."""
    c = chained_all(hits).withColumn("v", N.feature_span("chain", _feature, "VNTR"))
    q = F.col("q_name")
    shown = N.decorated(N.feature_order("chain", _feature), q % 3, q % 2, F.when(q % 7 == 0, "Alu"), q % 11 == 0, q % 13 == 0, q % 5 > 0, q % 4 == 0)
    strand = N.infer_strand(F.when(q % 6 == 0, "-"), N.strand_by_alignment())
    return c.select("q_name", shown.alias("structure"), F.col("v.beg").alias("vntr_beg"), F.col("v.end").alias("vntr_end"), F.col("v.len").alias("vntr_len"), strand.alias("strand"))


def chained_all(hits):
    return _chain(hits)


_LAP = "greatest(least({b}, {d}) - greatest({a}, {c}) + 1, 0)"
_KINDS = (
    f"WITH k AS (SELECT q_name, any_value(chrom) AS ref, any_value(pos) AS beg, any_value(pos) + 300 AS end_pos FROM ({_PLACE}) GROUP BY q_name), "
    f"d AS (SELECT h.q_name, least(sum({_LAP.format(a='k.beg - 100', b='k.end_pos + 100', c='h.t_beg', d='h.t_end')} * 100.0::DOUBLE / q_len), 100) AS percent FROM hits h JOIN k ON k.q_name = h.q_name AND h.t_name = k.ref AND h.t_beg <= k.end_pos + 100 AND k.beg - 100 <= h.t_end GROUP BY h.q_name), "
    "rep AS (SELECT * FROM repeats), "
    "w AS (SELECT DISTINCT k.q_name, rep.family FROM k JOIN rep ON rep.ref = k.ref AND rep.beg <= k.end_pos AND k.beg <= rep.end_pos WHERE rep.family IN ('Low_complexity', 'Simple_repeat', 'Satellite', 'telo', 'centr', 'acro')), "
    f"x AS (SELECT h.q_name, least(sum({_LAP.format(a='h.t_beg', b='h.t_end', c='rep.beg', d='rep.end_pos')} * 100.0::DOUBLE / q_len), 100) AS percent FROM hits h JOIN rep ON rep.ref = h.t_name AND rep.beg <= h.t_end AND h.t_beg <= rep.end_pos JOIN w ON w.q_name = h.q_name AND w.family = rep.family GROUP BY h.q_name), "
    f"b AS (SELECT h.q_name, h.hit_ord, h.q_len, rep.gene_name, {_LAP.format(a='h.t_beg', b='h.t_end', c='rep.beg', d='rep.end_pos')} AS n FROM hits h JOIN rep ON rep.ref = h.t_name AND rep.beg <= h.t_end AND h.t_beg <= rep.end_pos QUALIFY row_number() OVER (PARTITION BY h.q_name, h.hit_ord ORDER BY (least(h.t_end, rep.end_pos) - greatest(h.t_beg, rep.beg)) / (h.t_end - h.t_beg + 1) * 100 DESC, rep.beg, rep.gene_name) = 1), "
    "p AS (SELECT q_name, count(*) AS n_exons, least(sum(n * 100.0::DOUBLE / q_len), 100) AS percent FROM b GROUP BY q_name), "
    "t AS (SELECT q_name, bool_or(t_name = 'chr4') AS rep, bool_or(t_name = 'chr5') AS src FROM hits GROUP BY q_name) "
    "SELECT k.q_name, round(coalesce(d.percent, 0), 6) AS dup_percent, round(coalesce(x.percent, 0), 6) AS expansion_percent, coalesce(p.n_exons, 0) AS n_exons, CASE WHEN coalesce(x.percent, 0) >= 5 THEN 'expansion' WHEN coalesce(d.percent, 0) >= 5 THEN 'duplication' WHEN k.q_name % 17 = 0 THEN 'poly(A/T)' WHEN t.rep AND t.src THEN 'partnered' WHEN t.src THEN 'orphan' WHEN t.rep THEN 'solo' WHEN coalesce(p.percent, 0) >= 10 AND k.q_name % 2 = 0 THEN 'pseudogene' WHEN k.q_name % 3 = 0 THEN 'viral' ELSE 'unknown' END AS kind FROM k LEFT JOIN d ON d.q_name = k.q_name LEFT JOIN x ON x.q_name = k.q_name LEFT JOIN p ON p.q_name = k.q_name JOIN t ON t.q_name = k.q_name"
)


@query(_KINDS, "hits", "repeats")
def insertion_kinds(hits, rep):
    """Expansion, duplication, interspersed, pseudogene, virus, in this order."""
    key = "q_name"
    at = placed(hits)
    calls = at.groupBy(key).agg(F.first("chrom").alias("ref"), F.first("pos").alias("beg")).withColumn("end_pos", F.col("beg") + 300)
    repeats = rep.select(F.col("ref").alias("r_ref"), F.col("beg").alias("r_beg"), F.col("end_pos").alias("r_end"), F.col("family").alias("r_family"))
    wanted = J.interval_join(calls, repeats, ("ref", "beg", "end_pos"), ("r_ref", "r_beg", "r_end")).select(key, F.col("r_family").alias("family")).distinct()
    exons = rep.select(F.col("ref").alias("x_ref"), F.col("beg").alias("x_beg"), F.col("end_pos").alias("x_end"), F.col("gene_name").alias("gene"))
    d = N.duplication_share(calls, hits, key, least=5).select(key, F.col("percent").alias("d"))
    x = N.repeat_share(hits, repeats, wanted, key, least=5).select(key, F.col("percent").alias("x"))
    p = N.pseudogene_share(hits, exons, key, "hit_ord").select(key, "n_exons", F.col("percent").alias("p"))
    t = hits.groupBy(key).agg(F.bool_or(F.col("t_name") == "chr4").alias("rep"), F.bool_or(F.col("t_name") == "chr5").alias("src"))
    rows = d.join(x, key, "left").join(p, key, "left").join(t, key).fillna(0, ["x", "p", "n_exons"])
    q = F.col(key)
    kind = N.insertion_kind(F.col("x") >= 5, F.col("d") >= 5, N.interspersed(F.when(q % 17 == 0, 100).otherwise(0), F.col("rep"), F.col("src")), (F.col("p") >= 10) & (q % 2 == 0), q % 3 == 0)
    return rows.select(key, F.round("d", 6).alias("dup_percent"), F.round("x", 6).alias("expansion_percent"), "n_exons", kind.alias("kind"))
