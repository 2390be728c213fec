"""Readers and writers on small hand-made files."""

import glob

import pytest
from pyspark.sql import functions as F

from strandline.sources import reads, tables


@pytest.fixture()
def put(tmp_path):
    def write(text):
        at = tmp_path / f"f{len(list(tmp_path.iterdir()))}"
        at.write_text(text)
        return str(at)

    return write


def text_of(folder):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{folder}/part-*")))


def test_sequences(spark, put, tmp_path):
    f = tables.read_fasta(spark, put(">a one\nACG\nTT\n>b\n\n>c|x\nA"))
    assert sorted(map(tuple, f.collect())) == [("a", "ACGTT"), ("b", ""), ("c|x", "A")]
    tables.write_fasta(f.where("seq_id = 'a'"), str(tmp_path / "o"))
    assert text_of(tmp_path / "o") == ">a\nACGTT\n"
    q = spark.createDataFrame([("r", "d", "AC", "II"), ("s", None, "A", "!")], "seq_id string, description string, seq string, qual string")
    assert [r[0] for r in q.select(tables.fastq_record()).collect()] == ["@r d\nAC\n+\nII", "@s\nA\n+\n!"]
    assert spark.range(1).select(tables.phred(F.array(F.lit(0), F.lit(40)))).first()[0] == "!I"
    assert tuple(tables.read_index(spark, put("chr1\t100\t6\t60\t61\n")).first()) == ("chr1", 100)


def test_intervals(spark, put, tmp_path):
    b = tables.read_bed(spark, put("#ref beg end name geneName\nchr1 1 5 EXON G1\nchr2\t3\t9\tEXON\tG2\n\nbad\n"))
    assert b.columns == ["ref", "beg", "end", "name", "geneName"]
    assert sorted(map(tuple, b.collect())) == [("chr1", 1, 5, "EXON", "G1"), ("chr2", 3, 9, "EXON", "G2")]
    assert tables.read_bed(spark, put("chr1 1 5\nchr2 1 2 x\n"), ["chr2"]).collect()[0].name == "x"
    tables.write_bed(b, str(tmp_path / "o"), ["name"])
    assert text_of(tmp_path / "o") == "#ref\tbeg\tend\tname\nchr1\t1\t5\tEXON\nchr2\t3\t9\tEXON\n"
    assert b.where("beg = 1").select(tables.annovar_line()).first()[0] == "chr1\t1\t5\t0\t0\tcomments: EXON"
    assert tuple(tables.read_annovar(spark, put("exonic\tG1\tchr1\t1\t5\t0\t0\tcomments: n1\n")).first()) == ("exonic", "G1", "n1")
    s = spark.createDataFrame([("1", 100, 200, "+"), ("1", 100, 200, "-")], "ref string, beg int, end int, strand string")
    got = {(r.strand, r.src_end, r.td_beg, r.td_end) for r in tables.transduced_windows(s, 50, 10).collect()}
    assert got == {("+", 3, 190, 250), ("+", 5, 50, 110), ("-", 3, 50, 110), ("-", 5, 190, 250)}


def test_alignments_and_repeats(spark, put):
    hit = "q 100 0 50 + t 900 5 55 50 50 60"
    p = tables.read_paf(spark, put(f"# c\n{hit}\n{hit} tp:A:P\nq 1 2\n"))
    assert p.count() == 2 and p.first().mapq == 60 and p.first().t_name == "t"
    row = "50 0 0 0 0 0 0 0 + q 100 10 60 chr1 900 5 55 1 50, 10, 5,"
    x = tables.read_psl(spark, put(f"psLayout version 3\n\n{row}\n"))
    assert x.count() == 1 and tables.psl_coverage(x).first().align_perc == 50 and tables.psl_targets(x).first().t_names == ["chr1"]
    call = "11 30 2 10.0 2 90 5 40 50 50 0 0 1.0 AC ACACACACACACACACACAC G T"
    t = tables.read_trf(spark, put(f"@v1_chr1:5 more\n{call}\n{call}\n@v2\n"))
    assert [(r.seq_id, r.beg, r.end, r.tr_len, r.motif_seq) for r in t.collect()] == [("v1_chr1:5", 10, 29, 19, "AC")] * 2
    c = tables.read_cells(spark, put("chrom\tx\nchr3\t1\t9\ts\tc\tst\t1\t4\tdel_h1\tk\tdup\tk\t2.5\t1\t0.5\n")).first()
    assert (c.ref, c.type1, c.haplo1, c.type2, c.haplo2, c.af) == ("3", "del", "h1", "dup", None, 0.5)


SAM = """@HD\tVN:1.6
r1\t0\tchr1\t101\t60\t4S6M3I2M2D4M\t*\t0\t0\tGGGGAAAAAATTTCCGGGG\t*\tSA:Z:chr2,51,-,10M9S,30,0;
r2\t16\tchr1\t11\t60\t5M10N5M6H\t=\t400\t0\tAACCGTTTTT\tABCDEFGHIJ
r3\t1\tchr1\t11\t5\t4M\tchr5\t400\t0\tACGT\t!!!!
r4\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*
"""


def test_reads(spark, put):
    r = reads.read_sam(spark, put(SAM), "TUMOUR")
    assert [(x.read_name, x.pos, x.end, x.reverse) for x in r.orderBy("read_name").collect()][:3] == [("r1", 100, 114, False), ("r2", 10, 30, True), ("r3", 10, 14, False)]
    assert [x.read_name for x in reads.usable(r).collect()] == ["r1", "r2"]
    got = {(x.type, x.beg, x.end, x.length, x.side, x.insert_seq) for x in reads.events(reads.usable(r, 0), 4, 2).collect()}
    assert got == {("INS", 106, 106, 3, None, "TTT"), ("DEL", 108, 110, 2, None, None), ("CLIPPING", 100, 100, 4, "left", "GGGG"), ("CLIPPING", 30, 30, 6, "right", None), ("DISCORDANT", 10, 14, 4, None, None)}
    s = reads.supplementary(r).collect()
    assert [(x.ref, x.pos, x.end, x.q_beg, x.q_end) for x in s] == [("chr2", 50, 60, 9, 19)]
    assert {x.seq_id: (x.seq, x.qual) for x in reads.fastq(r).collect()}["r2"] == ("AAAAACGGTT", "JIHGFEDCBA")
    assert [(x.beg, x.end) for x in reads.blocks(r.where("read_name = 'r2'")).collect()] == [(10, 15), (25, 30)]


def test_repeats_across_splits(spark, put):
    call = "{} 30 2 10.0 2 90 5 40 50 50 0 0 1.0 AC ACACACACACACACACACAC G T"
    text = "".join(f"@s{k} x@y\n" + "".join(call.format(i + 1) + "\n" for i in range(40 * k)) for k in range(8))
    at = put("no name\n" + text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    try:
        assert spark.read.text(at).rdd.getNumPartitions() > 8
        rows = tables.read_trf(spark, at)
        got = sorted((r.seq_id, r.beg, r.ord) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f"s{k}", i, i) for k in range(8) for i in range(40 * k))
