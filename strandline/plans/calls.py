"""Queries of verdicts on whole insertions, second chances, random placement and supporting clippings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import chain as K
from ..operators import filters as V
from ..operators import inserts as N
from ..operators import interval_join as J
from ..operators import statistics as P
from ..operators import support as U
from .catalogue import _TAIL, CHAIN_SQL, HIT, query
from .events import _PAIR_GAPS
from .filters import _ANNOTATED, _CASES, annotated
from .inserts import _FEATURE, _feature, chains_of

_RESOLVED = "(meta_id * 7 % 101)"


@query(
    f"WITH a AS ({_ANNOTATED}) SELECT meta_id, "
    + _CASES(
        ("resolved", f"itype = 'chimera' OR {_RESOLVED} >= CASE WHEN family = 'SVA' THEN 50 ELSE 75 END"),
        ("own_site", "NOT (itype = 'partnered' AND coalesce(split_part(td_coord, ':', 1) = chrom, FALSE))"),
        ("hexamer", "meta_id % 9 > 0 OR family = 'SVA' OR itype IN ('PSD', 'orphan')"),
        ("herv", "family <> 'Alu' OR meta_id % 8 > 0"),
    )
    + " AS failed FROM a",
    "metas",
)
def insertion_verdicts(metas):
    """What an annotated insertion fails."""
    a = annotated(metas).withColumn("family2", F.when((F.col("family") == "Alu") & (F.col("meta_id") % 8 == 0), "HERVK").otherwise(F.col("family")))
    c = F.col
    tests = U.failed(
        resolved=V.resolved(c("itype"), c("family"), F.expr(_RESOLVED)),
        own_site=~((c("itype") == "partnered") & F.coalesce(F.split_part("td_coord", F.lit(":"), F.lit(1)) == c("chrom"), F.lit(False))),
        hexamer=V.hexamer_fits(c("meta_id") % 9 == 0, c("family"), c("itype")),
        herv=c("family2") != "HERVK",
    )
    return a.select("meta_id", tests.alias("failed"))


@query(f"SELECT v.id, t.\"end\" - t.beg AS tail_len, substr(v.alt, CAST(t.beg + 1 AS INT), CAST(t.\"end\" - t.beg AS INT)) AS tail, substr(v.alt, 1, CAST(t.beg AS INT)) AS trimmed FROM ({_TAIL}) t JOIN variants v ON v.id = t.id WHERE t.is_tail", "variants")
def trimmed_tails(variants):
    """a tail and what remains of the insert without it."""
    run = S.poly_tail("alt")
    rows = variants.withColumn("run", run).where("run IS NOT NULL")
    t = S.without_tail("alt", F.col("run"), F.lit("+"))
    return rows.select("id", (F.col("run.end") - F.col("run.beg")).alias("tail_len"), t["tail"].alias("tail"), t["rest"].alias("trimmed"))


def _wide(sql: str) -> str:
    return sql.replace("- 10 <= x.q_end + 10", "- 300 <= x.q_end + 300").replace("x.q_beg - 10 <= g.ce + 10", "x.q_beg - 300 <= g.ce + 300")


@query(
    _wide(chains_of("SELECT * FROM hits WHERE t_name <> 'chr5'"))
    + f", f AS (SELECT m.q_name, (min(c.ce) - min(c.cb)) / 1000 * 100 AS cov, list_sort(list(DISTINCT {_FEATURE})) AS fams FROM m JOIN c ON c.q_name = m.q_name GROUP BY m.q_name) SELECT q_name, round(cov, 6) AS cov, array_to_string(fams, '-') AS family, CASE WHEN cov < 40 THEN 'UNK' WHEN len(fams) = 1 AND fams[1] = 'MAST2' THEN 'UNK' WHEN len(fams) = 1 THEN 'solo' ELSE 'chimera' END AS itype FROM f",
    "hits",
)
def lenient_calls(hits):
    """A second chance, by the repeats' hits alone: one element or several, enough resolved."""
    chains = K.chain(hits.where("t_name <> 'chr5'"), "q_name", "q_beg", "q_end", "hit_ord", HIT, 300, 25)
    families = F.array_sort(F.array_distinct(F.transform("chain", _feature)))
    cov = K.coverage(length=F.element_at("chain", 1)["q_len"])
    return chains.select("q_name", F.round(cov, 6).alias("cov"), F.array_join(families, "-").alias("family"), N.lenient(cov, families, 40, ["MAST2"]).alias("itype"))


@query(
    "WITH u AS (SELECT cell_id, ('0x' || substr(md5('7:' || sv_id), 1, 8))::BIGINT / 4294967296 AS u FROM sv_cells), p AS (SELECT cell_id, CASE WHEN u < 0.1 THEN 'chr1' WHEN u < 0.3 THEN 'chr2' WHEN u < 0.6 THEN 'chr3' ELSE 'chr4' END AS chrom FROM u) SELECT cell_id, chrom, count(*) AS n FROM p GROUP BY ALL",
    "sv_cells",
)
def random_chromosomes(svs):
    """Variants dealt to chromosomes at random, as often as these are long."""
    return svs.select("cell_id", P.random_chromosome("sv_id", {"chr1": 1, "chr2": 2, "chr3": 3, "chr4": 4}, seed=7).alias("chrom")).groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("n"))


@query(
    _PAIR_GAPS
    + ", k AS (SELECT ref, CAST(cluster AS BIGINT) AS cluster, min(beg) AS b, max(end_pos) AS e, bool_and(orientation = 'PLUS') AS plus, bool_and(orientation = 'MINUS') AS minus FROM c GROUP BY ref, cluster), m AS (SELECT k.ref, k.cluster, CASE WHEN r.orientation = 'PLUS' THEN 'right' ELSE 'left' END AS side, count(*) AS n FROM k JOIN reads r ON r.ref = k.ref AND greatest(k.b - 200, 0) <= r.beg AND r.beg <= k.e AND (NOT k.plus OR r.orientation = 'PLUS') AND (NOT k.minus OR r.orientation = 'MINUS') GROUP BY ALL) SELECT ref, cluster, side, n FROM m QUALIFY row_number() OVER (PARTITION BY ref, cluster ORDER BY n DESC, side) = 1",
    "reads",
    "pairs",
)
def supporting_clippings(reads, pairs):
    """The larger group of clippings around a cluster, on the side that its reads point to."""
    from .catalogue import clustered

    k = clustered(pairs).groupBy("ref", "cluster").agg(F.min("beg").alias("b"), F.max("end_pos").alias("e"), F.bool_and(F.col("orientation") == "PLUS").alias("plus"), F.bool_and(F.col("orientation") == "MINUS").alias("minus"))
    return V.supporting_clippings(k, reads.select(F.col("ref").alias("r_ref"), F.col("beg").alias("r_beg"), F.when(F.col("orientation") == "PLUS", "right").otherwise("left").alias("side")), 200)


@query("SELECT meta_id, a.gene_name AS gene, CASE WHEN a.gene_name IS NOT NULL THEN 'exonic' END AS region FROM metas m LEFT JOIN (SELECT ref, beg, min(gene_name) AS gene_name FROM bed GROUP BY 1, 2) a ON a.ref = 'chr' || m.ref AND a.beg = m.beg", "metas", "bed")
def gene_annotation(metas, bed):
    """A gene annotator's verdict on each call, joined by its coordinates' name."""
    name = F.concat_ws(":", "ref", F.col("beg").cast("string"))
    known = bed.groupBy("ref", "beg").agg(F.min("gene_name").alias("gene")).select(name.alias("name"), "gene", F.lit("exonic").alias("region"))
    return V.named(metas.withColumn("name", F.concat(F.lit("chr"), "ref", F.lit(":"), F.col("beg").cast("string"))), known, "name").select("meta_id", "gene", "region")


@query(
    "WITH o AS (SELECT *, lag(end_pos) OVER w AS pe, lag(sv_type) OVER w AS pt, lead(beg) OVER w AS nb, lead(sv_type) OVER w AS nt FROM sv_cells WINDOW w AS (PARTITION BY cell_id, chrom ORDER BY beg, sv_id)) SELECT sv_id, coalesce(pt = 'dup' AND beg - pe <= 500000, FALSE) AS dup_before, coalesce(nt = 'dup' AND nb - end_pos <= 500000, FALSE) AS dup_after FROM o WHERE sv_type = 'del'",
    "sv_cells",
)
def adjacent_duplications(svs):
    """Deletions with a duplication next to them on either side."""
    from ..operators import cluster as L

    return L.adjacent(svs, ["cell_id", "chrom"], "del", "dup", 500_000)


@query(
    CHAIN_SQL
    + """, s AS (SELECT *, CASE WHEN strand = '+' THEN 'FOR' ELSE 'REV' END || '(' || (q_end - q_beg) || ',' || t_beg || '-' || t_end || ')' AS part, t_beg - lag(t_beg) OVER w AS back, t_beg - lag(t_end) OVER w AS gap FROM m WINDOW w AS (PARTITION BY q_name ORDER BY i))
SELECT q_name, (CASE WHEN min(t_beg) FILTER (WHERE i = 1) > 10 THEN 'TRUN(' || min(t_beg) FILTER (WHERE i = 1) || ',0-' || min(t_beg) FILTER (WHERE i = 1) || ')+' ELSE '' END)
  || string_agg((CASE WHEN i = 1 THEN '' WHEN back < 0 THEN 'JUMP(' || back || ')+' WHEN gap = 0 THEN 'BLUNT(NA)+' WHEN gap > 0 THEN 'DEL(' || gap || ')+' ELSE 'DUP(' || -gap || ')+' END) || part, '+' ORDER BY i)
  || (CASE WHEN min(t_len - t_end) FILTER (WHERE i = n) > 10 THEN '+TRUN(' || min(t_len - t_end) FILTER (WHERE i = n) || ',' || min(t_end) FILTER (WHERE i = n) || '-' || min(t_len) FILTER (WHERE i = n) || ')' ELSE '' END) AS conformation FROM s GROUP BY q_name""",
    "hits",
)
def conformation_extended(hits):
    """conformations with lengths and places."""
    return K.chain(hits, "q_name", "q_beg", "q_end", "hit_ord", HIT, 10, 25).select("q_name", K.conformation_extended().alias("conformation"))


@query(
    _PAIR_GAPS
    + ", n AS (SELECT ref, cluster, end_pos AS position, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT ref, cluster, floor(median(end_pos)) AS middle FROM c GROUP BY ALL) SELECT n.ref, CAST(n.cluster AS BIGINT) AS cluster, position, n FROM n JOIN m ON m.ref = n.ref AND m.cluster = n.cluster QUALIFY row_number() OVER (PARTITION BY n.ref, n.cluster ORDER BY n DESC, abs(position - middle), position) = 1",
    "pairs",
)
def breakpoints(pairs):
    """The breakpoint of a cluster of clippings, ties by the median."""
    from .catalogue import clustered

    return U.breakpoint(clustered(pairs), ["ref", "cluster"], "end_pos")


@query(
    _PAIR_GAPS
    + ", k AS (SELECT DISTINCT ref || ':' || cluster AS k, read_name FROM c), t AS (SELECT k, count(*) AS total FROM k GROUP BY k), j AS (SELECT a.k AS a, b.k AS b, count(*) AS n_reads FROM k a JOIN k b ON a.read_name = b.read_name AND a.k < b.k GROUP BY ALL HAVING count(*) >= 2) SELECT a, b, n_reads FROM j JOIN t x ON x.k = a JOIN t y ON y.k = b WHERE n_reads * 100 >= 30 * x.total AND n_reads * 100 >= 30 * y.total",
    "pairs",
)
def supported_junctions(pairs):
    """Clusters that share enough reads, as a number and of both."""
    from .catalogue import clustered

    k = clustered(pairs).select(F.concat_ws(":", "ref", F.col("cluster").cast("string")).alias("k"), "read_name").distinct()
    both = k.withColumnRenamed("k", "a").join(k.withColumnRenamed("k", "b"), "read_name").where("a < b")
    return U.supported_pairs(both, k, "k", 2, 30)


@query(
    f"WITH a AS ({_ANNOTATED}) SELECT meta_id, round(((meta_id % 300) + 32 + CASE WHEN meta_id % 2 = 0 THEN meta_id % 17 ELSE 0 END + CASE WHEN itype = 'partnered' THEN coalesce(list_sum(list_transform(string_split(td_len, ','), lambda x: CAST(x AS BIGINT))), 0) + coalesce(CAST(td5_len AS BIGINT), 0) ELSE 0 END) / 700 * 100, 6) AS percent FROM a",
    "metas",
)
def resolved_percents(metas):
    """How much of an insert its parts explain."""
    x = annotated(metas)
    m = F.col("meta_id")
    return x.select("meta_id", F.round(N.resolved_percent(F.col("itype"), F.lit(700), m % 300, F.col("tail_len"), [F.when(m % 2 == 0, m % 17)], [F.col("td_len"), F.col("td5_len")]), 6).alias("percent"))


@query("WITH h AS (SELECT sample_id, position, status + sample_id % (position % 3 + 1) AS status FROM haplotypes) SELECT * FROM h WHERE position IN (SELECT position FROM h GROUP BY position HAVING count(DISTINCT status) > 1)", "haplotypes")
def informative_positions(haplotypes):
    """Positions at which samples differ."""
    from ..operators import haplotype as H

    return H.informative(haplotypes.withColumn("status", F.expr("status + sample_id % (position % 3 + 1)"))).select("sample_id", "position", "status")


@query(
    _PAIR_GAPS + f", s AS (SELECT ref, CAST(cluster AS BIGINT) AS cluster, CAST(floor(avg(beg)) AS BIGINT) AS position, count(*) AS n, coalesce(stddev_samp(beg), 0) AS sd FROM c GROUP BY ref, cluster), w AS (SELECT *, CAST(CASE WHEN n > 1 THEN floor(({U.t_quantile('(n - 1)')}) * sd / sqrt(n)) ELSE 0 END AS BIGINT) AS wide FROM s) SELECT ref, cluster, position, -wide AS ci_beg, wide AS ci_end FROM w",
    "pairs",
)
def mean_positions(pairs):
    """Mean positions with their confidence intervals."""
    from .catalogue import clustered

    return U.mean_position(clustered(pairs), ["ref", "cluster"], "beg")
