"""Queries that write a format and read it again, and of reference sequences put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import databases as D
from ..sources import reads as A
from ..sources import tables as T
from ..sources import vcf
from ..storage import scratch
from .catalogue import query


def written(lines, name: str = "value") -> str:
    """Path of a text with these lines."""
    at = scratch(lines.sparkSession)
    lines.select(F.col(name).alias("value")).write.text(at)
    return at


def tabbed(*columns):
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, int) else c).cast("string") for c in columns])


@query("SELECT CAST(q_name AS VARCHAR) AS q_name, CAST(q_len AS INT) AS q_len, CAST(q_beg AS INT) AS q_beg, CAST(q_end AS INT) AS q_end, strand, t_name, CAST(t_len AS INT) AS t_len, CAST(t_beg AS INT) AS t_beg, CAST(t_end AS INT) AS t_end, CAST(t_end - t_beg AS INT) AS nb_matches, CAST(t_end - t_beg AS INT) AS block_len, mapq FROM hits", "hits")
def paf_read(hits):
    """Hits written as PAF and read again."""
    n = F.col("t_end") - F.col("t_beg")
    lines = hits.select(tabbed("q_name", "q_len", "q_beg", "q_end", "strand", "t_name", "t_len", "t_beg", "t_end", n, n, "mapq", F.lit("tp:A:P")).alias("value"))
    return T.read_paf(hits.sparkSession, written(lines)).drop("ord")


@query("SELECT ref, CAST(beg AS INT) AS beg, CAST(end_pos AS INT) AS \"end\", gene_name FROM bed WHERE ref IN ('chr1', 'chr2')", "bed")
def bed_read(bed):
    """Intervals written as BED with a header and read again, for some references."""
    at = scratch(bed.sparkSession)
    T.write_bed(bed.withColumnRenamed("end_pos", "end"), at, ["gene_name"])
    return T.read_bed(bed.sparkSession, at, refs=["chr1", "chr2"])


@query("SELECT chrom, CAST(pos AS INT) AS pos, id, ref_allele AS ref, '<INS>' AS alt, CAST(length(alt) AS VARCHAR) AS ins_len, CASE WHEN length(alt) > 500 THEN 'true' END AS long, CASE WHEN variant_ord % 2 = 0 THEN '0/1' ELSE '1/1' END AS gt_a, '0/0' AS gt_b, CAST(variant_ord % 50 AS VARCHAR) AS dp_a FROM variants", "variants")
def vcf_read(variants):
    """Variants with genotypes written as VCF and read again."""
    spark, at = variants.sparkSession, scratch(variants.sparkSession)
    info = F.map_filter(F.create_map(F.lit("INS_LEN"), F.length("alt").cast("string"), F.lit("LONG"), F.when(F.length("alt") > 500, "true")), lambda _, v: v.isNotNull())
    gt = lambda call, depth: F.create_map(F.lit("GT"), call, F.lit("DP"), depth)
    a = gt(F.when(F.col("variant_ord") % 2 == 0, "0/1").otherwise("1/1"), (F.col("variant_ord") % 50).cast("string"))
    rows = variants.select("chrom", F.col("pos").cast("int").alias("pos"), "id", F.col("ref_allele").alias("ref"), F.lit("<INS>").alias("alt"), F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"), F.create_map(F.lit("a"), a, F.lit("b"), gt(F.lit("0/0"), F.lit("0"))).alias("gt"))
    header = vcf.Header()
    header.contigs.update({f"chr{k}": 100_000 for k in range(1, 6)})
    header.info.update({"INS_LEN": ("1", "Integer", "length"), "LONG": ("0", "Flag", "over 500 bases")})
    header.format.update({"GT": ("1", "String", "genotype"), "DP": ("1", "Integer", "depth")})
    header.samples.extend(["a", "b"])
    vcf.write_variants(rows, header, at)
    got = vcf.read_variants(spark, at)
    return got.select("chrom", "pos", "id", "ref", "alt", F.col("info")["INS_LEN"].alias("ins_len"), F.col("info")["LONG"].alias("long"), F.col("gt")["a"]["GT"].alias("gt_a"), F.col("gt")["b"]["GT"].alias("gt_b"), F.col("gt")["a"]["DP"].alias("dp_a"))


@query("SELECT '@' || id || CASE WHEN variant_ord % 2 = 0 THEN ' d' ELSE '' END || chr(10) || alt || chr(10) || '+' || chr(10) || repeat(chr(CAST(33 + variant_ord % 40 AS INT)), CAST(length(alt) AS INT)) AS record FROM variants", "variants")
def fastq_records(variants):
    """FASTQ records with qualities as text."""
    q = T.phred(F.array_repeat(F.col("variant_ord") % 40, F.length("alt").cast("int")))
    rows = variants.select(F.col("id").alias("seq_id"), F.when(F.col("variant_ord") % 2 == 0, "d").otherwise("").alias("description"), F.col("alt").alias("seq"), q.alias("qual"))
    return rows.select(T.fastq_record().alias("record"))


@query("SELECT 'exonic' AS region, gene_name AS gene, ref || ':' || beg AS name FROM bed", "bed")
def annovar_read(bed):
    """A gene annotator's input, its output read and joined by name."""
    at = bed.select("ref", "beg", F.col("end_pos").alias("end"), F.concat(F.col("ref"), F.lit(":"), F.col("beg").cast("string")).alias("name"), "gene_name")
    lines = at.select(F.concat_ws("\t", F.lit("exonic"), "gene_name", T.annovar_line()).alias("value"))
    return T.read_annovar(bed.sparkSession, written(lines))


@query("SELECT CAST(q_name AS VARCHAR) AS q_name, t_name, CAST(q_beg AS INT) AS q_beg, round((q_end - q_beg) / q_len * 100, 6) AS align_perc FROM hits WHERE (q_end - q_beg) / q_len * 100 >= 10", "hits")
def psl_read(hits):
    """PSL written and read, hits that cover enough of their query."""
    n = F.col("q_end") - F.col("q_beg")
    lines = hits.select(tabbed(n, 0, 0, 0, 0, 0, 0, 0, "strand", "q_name", "q_len", "q_beg", "q_end", "t_name", "t_len", "t_beg", "t_end", 1, n, "q_beg", "t_beg").alias("value"))
    got = T.psl_coverage(T.read_psl(hits.sparkSession, written(lines))).where("align_perc >= 10")
    return got.select("q_name", "t_name", "q_beg", F.round("align_perc", 6).alias("align_perc"))


@query("WITH h AS (SELECT CAST(q_name AS VARCHAR) AS q_name, list_sort(list(DISTINCT t_name)) AS t FROM hits GROUP BY 1) SELECT 'read' || q_name AS q_name, string_agg('chr:' || x.x, ';' ORDER BY x.x) AS added FROM h, unnest(t) AS x(x) GROUP BY q_name", "hits")
def psl_targets(hits):
    """The targets of each query, as additions to a clipping's supplementary alignments."""
    named = T.psl_targets(hits.withColumn("q_name", F.col("q_name").cast("string")))
    clips = hits.select(F.col("q_name").cast("string").alias("q_name")).distinct()
    return clips.join(named, "q_name").select(F.concat(F.lit("read"), "q_name").alias("q_name"), F.array_join(F.transform("t_names", lambda t: F.concat(F.lit("chr:"), t)), ";").alias("added"))


@query("SELECT ref AS seq_id, CAST(beg AS INT) AS beg, CAST(end_pos AS INT) AS \"end\", 'ACG' AS motif_seq, CAST(end_pos - beg AS INT) AS tr_len FROM bed", "bed")
def trf_read(bed):
    """Tandem-repeat calls read from blocks by sequence."""
    call = F.concat_ws(" ", (F.col("beg") + 1).cast("string"), (F.col("end_pos") + 1).cast("string"), F.lit("3 2.5 3 99 0 50 20 30 30 20 1.9 ACG ACGACG . ."))
    # blocks of a sequence in several parts, each under its own name line: no row or task holds a whole sequence
    parts = bed.select("ref", F.pmod(F.xxhash64("bed_id"), F.lit(64)).alias("part"), F.lit(1).alias("o"), call.alias("value"))
    heads = parts.select("ref", "part", F.lit(0).alias("o"), F.concat(F.lit("@"), F.col("ref")).alias("value")).distinct()
    lines = heads.unionByName(parts).repartition("ref", "part").sortWithinPartitions("ref", "part", "o")
    return T.read_trf(bed.sparkSession, written(lines)).select("seq_id", "beg", "end", "motif_seq", "tr_len")


@query("SELECT substr(chrom, 4) AS ref, CAST(beg AS INT) AS beg, CAST(cell_id AS VARCHAR) AS cell, sv_type AS type1, haplo AS haplo1, af FROM sv_cells", "sv_cells")
def cells_read(svs):
    """Single-cell calls written and read, names split into type and haplotype."""
    line = tabbed("chrom", "beg", "end_pos", F.lit("s"), "cell_id", F.lit("1010"), F.lit("1.0"), 3, F.concat_ws("_", "sv_type", "haplo"), F.lit("2020"), F.lit(""), F.lit(""), F.lit("1.5"), F.lit("0.5"), "af")
    got = T.read_cells(svs.sparkSession, written(svs.select(line.alias("value"))))
    return got.select("ref", "beg", "cell", "type1", "haplo1", "af")


@query("SELECT ref, max(end_pos) AS length FROM bed GROUP BY ref", "bed")
def index_read(bed):
    """Contigs and their lengths from an index."""
    rows = bed.groupBy("ref").agg(F.max("end_pos").alias("n"))
    return T.read_index(bed.sparkSession, written(rows.select(tabbed("ref", "n", 7, 60, 61).alias("value"))))


@query("SELECT bed_id, src_end, CASE WHEN (src_end = 3) = (bed_id % 2 = 0) THEN end_pos - 10 ELSE greatest(beg - 500, 0) END AS td_beg, CASE WHEN (src_end = 3) = (bed_id % 2 = 0) THEN end_pos + 500 ELSE beg + 10 END AS td_end FROM bed, (SELECT unnest([5, 3]) AS src_end)", "bed")
def transduced_windows(bed):
    """Where a source element's transductions come from."""
    src = bed.select("bed_id", "beg", F.col("end_pos").alias("end"), F.when(F.col("bed_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    return T.transduced_windows(src, 500, 10).select("bed_id", "src_end", "td_beg", "td_end")


_CLIP, _INS, _DEL = "(read_ord % 90)", "(30 + read_ord % 60)", "(40 + read_ord % 30)"


def _sam(pairs):
    n = {k: F.expr(v) for k, v in (("c", _CLIP), ("i", _INS), ("d", _DEL))}
    cigar = F.concat(F.when(n["c"] > 0, F.concat(n["c"].cast("string"), F.lit("S"))).otherwise(""), F.lit("60M"), n["i"].cast("string"), F.lit("I40M"), n["d"].cast("string"), F.lit("D30M"))
    flag = 1 + F.when(F.col("proper"), 2).otherwise(0) + F.when(F.col("orientation") == "MINUS", 16).otherwise(0) + F.when(F.col("double_clip"), 1024).otherwise(0)
    size = n["c"] + n["i"] + 130
    sa = F.when(F.col("read_ord") % 5 == 0, "\tSA:Z:x,100,-,20S50M,30,0;y,7,+,60M10S,9,1;").otherwise("")
    line = F.concat(tabbed("read_name", flag, "ref", F.col("beg") + 1, "mapq", cigar, "mate_ref", F.col("mate_beg") + 1, "insert_size", F.repeat(F.lit("A"), size.cast("int")), F.repeat(F.lit("I"), size.cast("int"))), sa)
    return A.read_sam(pairs.sparkSession, written(pairs.select(line.alias("value"))))


@query(
    f"WITH u AS (SELECT * FROM pairs WHERE mapq >= 10 AND NOT double_clip), e AS (SELECT 'INS' AS type, ref, beg + 60 AS beg, beg + 60 AS e, {_INS} AS length, orientation FROM u WHERE {_INS} >= 50 UNION ALL SELECT 'DEL', ref, beg + 100, beg + 100 + {_DEL}, {_DEL}, orientation FROM u WHERE {_DEL} >= 50 UNION ALL SELECT 'CLIPPING', ref, beg, beg, {_CLIP}, orientation FROM u WHERE {_CLIP} >= 50 UNION ALL SELECT 'DISCORDANT', ref, beg, beg + 130 + {_DEL}, 130 + {_DEL}, orientation FROM u WHERE NOT proper) SELECT type, ref, beg, e AS \"end\", length, CASE WHEN orientation = 'MINUS' THEN '-' ELSE '+' END AS orientation FROM e",
    "pairs",
)
def sam_events(pairs):
    """Every event in the usable reads of a SAM text."""
    return A.events(A.usable(_sam(pairs))).select("type", "ref", "beg", "end", "length", "orientation")


@query(f"SELECT read_name, ref, beg, beg + 130 + {_DEL} AS \"end\", CASE WHEN orientation = 'MINUS' THEN '-' ELSE '+' END AS strand FROM pairs", "pairs")
def sam_intervals(pairs):
    """Alignments as intervals on the reference."""
    return A.blocks(_sam(pairs)).select("read_name", "ref", F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end"), "strand")


@query(f"SELECT read_name AS seq_id, repeat(CASE WHEN orientation = 'MINUS' THEN 'T' ELSE 'A' END, CAST({_CLIP} + {_INS} + 130 AS INT)) AS seq FROM pairs", "pairs")
def sam_fastq(pairs):
    """Reads as they were sequenced."""
    return A.fastq(_sam(pairs)).select("seq_id", "seq")


@query("SELECT read_name, x.ref, x.pos, x.e AS \"end\", x.strand, x.qb AS q_beg, x.qe AS q_end FROM pairs, (VALUES ('x', 99, 149, '-', 0, 50), ('y', 6, 66, '+', 0, 60)) AS x(ref, pos, e, strand, qb, qe) WHERE read_ord % 5 = 0", "pairs")
def sam_supplementary(pairs):
    """the alignments that SA tags name."""
    out = A.supplementary(_sam(pairs))
    return out.select("read_name", "ref", "pos", "end", "strand", F.col("q_beg").cast("int").alias("q_beg"), F.col("q_end").cast("int").alias("q_end"))


@query(f"SELECT read_name AS q_name, {_CLIP} + {_INS} + 130 AS q_len, CASE WHEN orientation = 'MINUS' THEN 0 ELSE {_CLIP} END AS q_beg, CASE WHEN orientation = 'MINUS' THEN 0 ELSE {_CLIP} END + {_INS} + 130 AS q_end, CASE WHEN orientation = 'MINUS' THEN '-' ELSE '+' END AS strand, ref AS t_name, beg AS t_beg, beg + 130 + {_DEL} AS t_end, mapq FROM pairs", "pairs")
def sam_as_paf(pairs):
    """Alignments as PAF rows."""
    return A.as_paf(_sam(pairs)).select("q_name", "q_len", "q_beg", "q_end", "strand", "t_name", F.col("t_beg").cast("long").alias("t_beg"), F.col("t_end").cast("long").alias("t_end"), F.col("mapq").cast("long").alias("mapq"))


# sequences put together ----------------------------------------------------------------------------


_PIECES = "CASE variant_ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END"


@query(f"WITH t AS (SELECT id, {_PIECES} AS n, [left(alt, 10), right(alt, 12)] AS s FROM variants) SELECT id || '_' || i.i AS seq_id, s[i.i] AS seq FROM t, unnest(range(1, n + 1)) AS i(i)", "variants")
def transduction_records(variants):
    """A record for each transduced piece."""
    n = F.expr(_PIECES)
    rows = variants.select("id", n.alias("td_n"), F.when(n == 2, F.concat_ws(",", F.expr("left(alt, 10)"), F.expr("right(alt, 12)"))).otherwise(F.expr("left(alt, 10)")).alias("td_seqs"))
    return D.transduction_records(rows)


@query("SELECT 'consensus|' || (CASE variant_ord % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'Alu' ELSE 'SVA' END) || '|sub' || variant_ord AS seq_id, regexp_replace(alt || repeat('A', CAST(variant_ord % 4 AS INT)) || 'a', '[Aa]+$', '') AS seq FROM variants", "variants")
def consensus_records(variants):
    """Consensus sequences named by family, without tails."""
    seqs = variants.select(F.concat(F.lit("sub"), F.col("variant_ord").cast("string"), F.lit("#x")).alias("seq_id"), F.concat("alt", F.repeat(F.lit("A"), (F.col("variant_ord") % 4).cast("int")), F.lit("a")).alias("seq"))
    fam = variants.select(F.concat(F.lit("sub"), F.col("variant_ord").cast("string")).alias("subfamily"), F.when(F.col("variant_ord") % 3 == 0, "L1").when(F.col("variant_ord") % 3 == 1, "Alu").otherwise("SVA").alias("family"))
    return D.consensus_records(seqs, fam)


@query(
    "WITH g AS (SELECT chrom AS ref, string_agg(alt, '' ORDER BY variant_ord) AS s FROM variants GROUP BY 1), w AS (SELECT ref, bed_id % 500 * 10 AS b, bed_id % 500 * 10 + 150 AS e FROM bed GROUP BY ALL) SELECT 'transduced|L1|c' || w.ref || '|' || w.ref || ':' || b || '-' || e AS seq_id, substr(s, CAST(b + 1 AS INT), 150) AS seq FROM w JOIN g ON g.ref = w.ref WHERE length(s) > b",
    "bed",
    "variants",
)
def transduced_records(bed, variants):
    """The genome's bases beyond source elements, from chunks of contigs."""
    g = variants.groupBy(F.col("chrom").alias("ref")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant_ord", "alt"))), lambda x: x["alt"]), "").alias("s"))
    chunks = g.where("length(s) > 0").select("ref", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("s") - 1) / 1000))).alias("chunk"), "s").select("ref", "chunk", F.substring("s", (F.col("chunk") * 1000 + 1).cast("int"), F.lit(1000)).alias("seq"))
    b = F.col("bed_id") % 500 * 10
    w = bed.select("ref", b.alias("td_beg"), (b + 150).alias("td_end"), F.lit("L1").alias("family"), F.concat(F.lit("c"), F.col("ref")).alias("cytoband")).distinct()
    return D.transduced_records(w, chunks, 1000).where("seq <> ''")


@query("WITH k AS (SELECT DISTINCT meta_id, identity || CASE WHEN sv_type = 'INS' THEN '-' || sv_type ELSE '' END AS label, ref, beg FROM metas WHERE identity IS NOT NULL) SELECT m.meta_id, list_sort(list(DISTINCT k.label)) AS labels FROM metas m JOIN k ON k.ref = m.ref AND k.beg - 5 <= m.end_pos AND m.beg <= k.beg + 5 GROUP BY m.meta_id", "metas")
def known_insertions(metas):
    """Called insertions as a table of intervals with labels, joined to calls."""
    known = metas.where("identity IS NOT NULL").select("ref", F.col("beg").alias("pos"), D.type_label(F.col("identity"), F.when(F.col("sv_type") == "INS", F.col("sv_type"))).alias("label"))
    return D.annotated_with(metas, D.known_insertions(known, 5), "meta_id")


@query("SELECT concat_ws(chr(9), ref, beg, '.', 'N', '<' || sv_type || '>', '.', 'PASS', concat_ws(';', 'SVTYPE=' || sv_type, 'ITYPE=' || identity, 'SRCID=' || CASE WHEN identity IN ('TD1', 'TD2') THEN src_id END, 'LEN=' || (end_pos - beg), CASE WHEN has_tail THEN 'POLYA' END)) AS line FROM metas WHERE sv_type = 'INS'", "metas")
def insertion_lines(metas):
    """Metaclusters as VCF lines."""
    info = {"SVTYPE": F.col("sv_type"), "ITYPE": F.col("identity"), "SRCID": F.when(F.col("identity").isin("TD1", "TD2"), F.col("src_id")), "LEN": F.col("end_pos") - F.col("beg"), "POLYA": F.col("has_tail")}
    return metas.where("sv_type = 'INS'").select(D.call_lines(metas, info, {"POLYA"}).alias("line"))


@query("WITH n AS (SELECT ref, orientation, identity, count(*) AS n FROM metas WHERE identity IS NOT NULL GROUP BY ALL) SELECT ref, orientation, identity, n FROM n QUALIFY row_number() OVER (PARTITION BY ref, orientation ORDER BY n DESC, identity) = 1", "metas")
def majority_identities(metas):
    """The identity that most members have."""
    return D.majority(metas, ["ref", "orientation"], "identity")


@query("SELECT '>' || id || chr(10) || alt AS record FROM variants WHERE variant_ord % 4 = 0 AND variant_ord % 3 = 1", "variants")
def inserts_of_a_family(variants):
    """Sequences of the insertions of one type and family as FASTA records."""
    rows = variants.withColumns({"itype": F.when(F.col("variant_ord") % 4 == 0, "solo").otherwise("partnered"), "family": F.when(F.col("variant_ord") % 3 == 1, "Alu").otherwise("L1")})
    return rows.where("itype = 'solo' AND family = 'Alu'").select(T.fasta_record("id", "alt").alias("record"))


@query(
    "WITH b AS (SELECT chrom, i.i AS place, substr(alt, CAST(i.i AS INT), 1) AS base FROM variants, unnest(range(1, length(alt) + 1)) AS i(i)), n AS (SELECT chrom, place, base, count(*) AS n FROM b GROUP BY ALL), w AS (SELECT chrom, place, base FROM n QUALIFY row_number() OVER (PARTITION BY chrom, place ORDER BY n DESC, base) = 1) SELECT chrom, md5(string_agg(base, '' ORDER BY place)) AS consensus FROM w GROUP BY chrom",
    "variants",
)
def consensus_sequences(variants):
    """The majority base at each place of aligned sequences."""
    rows = variants.where("length(alt) > 0").select("chrom", F.posexplode(F.split("alt", "")).alias("place", "base")).where("base <> ''")
    return D.consensus_bases(rows, ["chrom"]).select("chrom", F.md5("consensus").alias("consensus"))
