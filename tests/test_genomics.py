"""The genomic queries against their SQL in DuckDB, and sources and edge cases by hand."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions import intervals as I
from strandline.functions import sequence as S
from strandline.plans import annotation, catalogue  # noqa: F401
from strandline.sources import vcf

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rows = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in rows.description]
    want = sorted(str([plain(dict(zip(names, r))[c]) for c in sorted(names)]) for r in rows.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want


def test_entry_module_stands_alone(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_complementary(spark):
    df = spark.createDataFrame([(0, 100, 121, 200), (0, 100, 120, 200), (0, 100, 80, 180), (0, 100, 50, 150), (200, 300, 100, 195)], "a long, b long, c long, d long")
    got = [r[0] for r in df.select(I.complementary("a", "b", "c", "d", 10, 25)).collect()]
    assert got == [None, "RIGHT", "RIGHT", None, "LEFT"]


def test_complementary_all_pairs(spark, tmp_path):
    # (custkey, orderkey, totalprice): the view's interval is key * 131 % 90000, a 500th of the price long
    orders = [(i % 2 * 5, i * 97, float(400_000 * (i % 9 + 1))) for i in range(1, 90)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    bed = [(c % 5, k * 131 % 90_000, k * 131 % 90_000 + int(p / 500), k) for c, k, p in orders]
    want = {}
    for ra, ba, ea, ka in bed:
        for rb, bb, eb, kb in bed:
            n = max(min(ea, eb) - max(ba, bb) + 1, 0)
            if ra == rb and ka < kb and ba - 5000 <= eb + 5000 and bb - 5000 <= ea + 5000 and n * 4 <= ea - ba + 1 and n * 4 <= eb - bb + 1:
                key = (int(n > 0), "LEFT" if ba > bb else "RIGHT")
                want[key] = want.get(key, 0) + 1
    got = catalogue.QUERIES["complementary_all_pairs"](spark, str(tmp_path)).collect()
    assert {(r.meets, r.side): r.n for r in got} == want and len(want) == 4


def test_every_sample_is_assigned(spark):
    sf = "/root/testdata/sf0.001"
    samples = {r.sample_id for r in catalogue.QUERIES["haplotype_scores"](spark, sf).collect()}
    got = catalogue.QUERIES["haplotype_assign_all"](spark, sf).collect()
    assert {r.target_id for r in got} == samples and len(got) == len(samples) > 1
    assert all(r.assigned != r.target_id for r in got)


def test_tail(spark):
    seqs = ["C" * 20 + "A" * 10, "C" * 14 + "A" * 12, "A" * 30, "CCC", "", "C" * 20 + "A" * 15 + "G" * 51]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").withColumn("run", S.tail_monomer("s"))
    assert [r[0] and tuple(r[0]) for r in df.select("run").collect()] == [(20, 30), (14, 26), (0, 30), None, None, (20, 36)]
    assert [r[0] is not None for r in df.select(S.tail_only(F.col("run"), "s")).collect()] == [True, False, False, False, False, True]


def test_tsd_at_both_ends(spark):
    def search(target, insert):
        target, insert, bad, n = target.upper(), insert.upper(), 0, 0
        for a, b in zip(target, insert):
            bad += a != b
            if bad > 2:
                break
            n += 1
        n = 0 if n <= 3 else n
        return insert[:n], n, insert[n:]

    head, tail, body = "ACGTTGCAAC", "GGATCCATTA", "T" * 60
    rows = [
        ("C" * 41, "C" * 31 + tail, body + tail),  # at the tail alone
        (head + "C" * 31, "G" * 31 + tail, head + body + tail),
        (head + "C" * 31, "G" * 41, head.lower() + body),
        (head[:3] + "G" * 38, "C" * 38 + tail[-3:], head[:3] + body + tail[-3:]),
        ("ACGTACGT", "TTTTACGT", "ACGTACGT"),  # the head takes all of it
        ("A" * 41, "A" * 41, "A" * 50),
        ("A" * 41, "", ""),
    ]
    got = [tuple(r.t) for r in spark.createDataFrame(rows, "d string, u string, s string").select(S.tsd_both("d", "u", "s").alias("t")).collect()]
    want = []
    for d, u, s in rows:
        seq, down, rest = search(d, s)
        seq_up, up, rest = search(u[::-1], rest[::-1])
        want.append((down, up, down + up, seq_up[::-1] + seq, rest[::-1]))
    assert got == want and want[0][1] >= 10 and want[1][0] >= 10 <= want[1][1]


def test_vcf_round_trip(spark, tmp_path):
    text = '##fileformat=VCFv4.2\n##contig=<ID=chr1,length=1000>\n##INFO=<ID=X,Number=1,Type=String,Description="a, b">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\nchr1\t20\tv2\tN\tACGT\t.\tPASS\tX=a=b;FLAG\tGT:DP\t0/1:3\nchr1\t10\tv1\tN\tA\t.\tPASS\t.\tGT\t1/1\n'
    (tmp_path / "a.vcf").write_text(text)
    header = vcf.read_header(spark, str(tmp_path / "a.vcf"))
    assert header.contigs == {"chr1": 1000} and header.info["X"][2] == "a, b" and header.samples == ["s1"]
    rows = vcf.read_variants(spark, str(tmp_path / "a.vcf"))
    v = {r.id: r for r in rows.collect()}
    assert v["v2"].info == {"X": "a=b", "FLAG": "true"} and v["v2"].gt == {"s1": {"GT": "0/1", "DP": "3"}}
    vcf.write_variants(rows, header, str(tmp_path / "out"))
    again = vcf.read_variants(spark, str(tmp_path / "out"))
    assert [r.id for r in again.collect()] == ["v1", "v2"]
    assert {r.id: (r.info, r.gt) for r in again.collect()} == {k: (r.info, r.gt) for k, r in v.items()}
