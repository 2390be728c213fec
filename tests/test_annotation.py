"""Operators of the composed annotation against brute force and by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import monomers as M
from strandline.operators import cluster as L
from strandline.operators import statistics as P
from strandline.operators.components import components
from strandline.plans import retro
from strandline.streaming import depth


def test_monomers(spark):
    seqs = ["", None, "A" * 12, "C" * 30, "ACGT" * 5 + "A" * 20 + "CCGGCCGG" + "A" * 15 + "CG", "A" * 9]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, alt string")
    got = {r.i: r.m for r in df.withColumn("m", M.monomers("alt")).collect()}
    runs = lambda i: [(x.beg, x.end) for x in got[i]]
    assert got[1] is None and runs(0) == runs(3) == runs(5) == [] and runs(2) == [(0, 12)]
    assert all("C" not in seqs[4][b + 2 : e - 2] for b, e in runs(4)) and len(runs(4)) == 2
    d = df.where("i = 4").withColumn("m", M.monomers("alt")).withColumn("none", F.expr("filter(m, x -> false)"))
    row = d.select(M.tail_type("m").alias("t"), M.transduced_pieces("m").alias("p"), M.strand("m", "none").alias("s"), F.size(M.near_an_end("m", "alt")).alias("k")).first()
    assert (row.t, len(row.p), row.s, row.k) == ("partnered", 1, "+", 2)


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_reciprocal_clusters(spark):
    rows = [(1, "a", 0, 99), (2, "a", 10, 109), (3, "a", 20, 119), (4, "a", 0, 99), (5, "a", 50, 500), (6, "b", 0, 99), (7, "b", 300, 300)]
    e = spark.createDataFrame(rows, "k long, ref string, beg long, end long")
    got = {r.k: r.cluster for r in L.reciprocal_clusters(e, "k", "ref", "beg", "end", 85).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}


@pytest.mark.parametrize("percent", [15, 60, 80, 97])
def test_reciprocal_roots(percent):
    import numpy as np

    rng = np.random.default_rng(percent)
    for n, most in ((1, 5), (150, 300), (250, 4000), (200, 40)):
        lo = rng.integers(-most, most * 3, n)
        lo, hi = np.unique(np.stack((lo, lo + rng.integers(0, most, n))), axis=1)
        size, want = hi - lo + 1, np.arange(len(lo))
        shared = np.minimum.outer(hi, hi) - np.maximum.outer(lo, lo) + 1
        edges = np.argwhere((shared > 0) & (shared / size[:, None] * 100 >= percent) & (shared / size[None] * 100 >= percent))
        for _ in range(len(lo)):
            before = want.copy()
            np.minimum.at(want, edges[:, 0], want[edges[:, 1]])
            if (before == want).all():
                break
        for step in (1 << 22, 7):
            got = L._reciprocal_roots(lo, hi, percent, step)
            assert len(np.unique(got)) == len(np.unique(want)) == len(np.unique(np.stack((got, want)), axis=1).T)


def test_reciprocal_clusters_over_tiles(spark):
    # chains across the edges of tiles and of classes of length; keys fall from left to right in one
    rows = [(i, "a", i * 10, i * 10 + 99) for i in range(4000)] + [(9000 - i, "b", 0, int(50 * 1.1**i)) for i in range(60)] + [(9500, "c", 5, 2), (9501, None, 0, 9), (9502, "c", 5, 2)]
    e = spark.createDataFrame(rows, "k long, ref string, beg long, end long")
    got = {r.k: r.cluster for r in L.reciprocal_clusters(e, "k", "ref", "beg", "end", 85).collect()}
    assert got == {k: 0 if r == "a" else 8941 if r == "b" else k for k, r, *_ in rows}


def test_reciprocal_clusters_without_pairs(spark):
    # 90,000 distinct intervals that nearly all overlap each other by 80 percent: four thousand million pairs
    e = spark.range(90_000).selectExpr("id AS k", "'a' AS ref", "id % 300 AS beg", "10000 + id DIV 300 AS end")
    got = L.reciprocal_clusters(e, "k", "ref", "beg", "end", 80)
    assert (got.count(), got.where("cluster = 0").count()) == (90_000, 90_000)


def test_two_groups(spark):
    rows = [("x", i, v) for i, v in enumerate([10, 11, 12, 90, 91, 95])] + [("y", i, v) for i, v in enumerate([5, 5, 5])] + [("z", 0, 7)]
    out = L.two_groups(spark.createDataFrame(rows, "c string, i int, v int"), ["c"], "v", ["i"])
    got = {(r.c, r.i): r.part for r in out.collect()}
    assert [got["x", i] for i in range(6)] == [0, 0, 0, 1, 1, 1] and not any(p for (c, _), p in got.items() if c != "x")


@pytest.mark.parametrize("a,b,c,d", [(3, 1, 2, 2), (0, 5, 5, 0), (10, 2, 3, 15), (0, 0, 0, 0)])
def test_fisher(spark, a, b, c, d):
    weight = lambda x: math.comb(a + b, x) * math.comb(c + d, a + c - x)
    terms = [weight(x) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
    want = sum(t for t in terms if t <= weight(a)) / sum(terms)
    got = spark.createDataFrame([(a, b, c, d)], "a long, b long, c long, d long").select(P.fisher_exact("a", "b", "c", "d")).first()[0]
    assert got == pytest.approx(want)


def test_fisher_on_large_counts(spark):
    import time

    table = a, b, c, d = 40_000, 39_500, 39_750, 39_750
    rows, began = spark.createDataFrame([table], "a long, b long, c long, d long"), time.time()
    got = rows.select(P.fisher_exact("a", "b", "c", "d")).first()[0]
    weight = lambda x: -sum(math.lgamma(n + 1) for n in (a + b - x, a + c - x, d - a + x, x))
    logs = [weight(x) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
    top = max(logs)
    terms = [math.exp(v - top) for v in logs]
    want = sum(t for t in terms if t <= terms[a - max(0, a - d)] * (1 + 1e-7)) / sum(terms)
    assert math.isclose(got, want, rel_tol=1e-6)
    assert time.time() - began < 60  # a sum over 1 to n for each term took hours


def test_placements(spark):
    svs = spark.createDataFrame([(i, "c", i * 3, i * 3 + 2) for i in range(40)], "sv_id long, chrom string, beg long, end_pos long")
    s = P.shuffled(svs, F.lit(10_000), 1, 3)
    assert s.count() == 120 and s.where("beg < 0 OR end_pos > 10000 OR end_pos - beg <> 2").count() == 0
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, P.shuffled(svs, F.lit(10_000), 1, 3).collect()))
    r = P.gap_clustering(svs, ["chrom"], F.lit(10_000), 1, 20).first()
    assert r.n == 39 and r.p < 0.05 and r.score > 3


def test_placements_do_not_overlap(spark):
    svs = spark.createDataFrame([(i, f"c{i % 2}", 0, 10 + i % 5) for i in range(400)], "sv_id long, chrom string, beg long, end_pos long")
    places = {}
    for r in P.shuffled(svs, F.lit(2_000), 1, 3).collect():
        assert 0 <= r.beg and r.end_pos <= 2_000 and r.end_pos - r.beg == 10 + r.sv_id % 5
        places.setdefault((r.chrom, r.copy), []).append((r.beg, r.end_pos))
    assert len(places) == 6 and len({tuple(sorted(p)) for p in places.values()}) == 6
    for p in places.values():
        p.sort()
        assert all(a[1] <= b[0] for a, b in zip(p, p[1:]))
        # variants go only once no gap holds them
        assert len(p) < 200 and max(b - a for a, b in zip([0] + [e for _, e in p], [b for b, _ in p] + [2_000])) <= 14
    # lengths fill a half: gaps between random places have a median of several bases
    one = spark.createDataFrame([(i, "c", i * 20, i * 20 + 10) for i in range(100)], "sv_id long, chrom string, beg long, end_pos long")
    gaps = P._gaps(P.shuffled(one, F.lit(2_000), 1, 50), ["chrom"], ["copy"])
    assert gaps.select(F.median("gap")).first()[0] >= 5


HIT = "q_name long, hit_ord int, q_len long, q_beg long, q_end long, strand string, t_name string, t_len long, t_beg long, t_end long, family string"


def test_retro(spark):
    body = "".join(random.Random(1).choice("CGT") for _ in range(960))
    v = spark.createDataFrame([(i, "chr1", 5000, body + "A" * 40) for i in range(4)] + [(4, "chr1", 1, "A" * 200), (5, "chr1", 1, body)], "variant_ord long, chrom string, pos long, alt string")
    assert sorted(r.variant_ord for r in retro.candidates(v).collect()) == [0, 1, 2, 3]
    hit = lambda q, o, b, e, t, f, tb=0: (q, o, 1000, b, e, "+", t, 6000, tb, tb + e - b, f)
    cons = spark.createDataFrame([hit(0, 0, 0, 950, "L1", "L1"), hit(1, 0, 0, 500, "L1", "L1"), hit(3, 0, 0, 300, "HERVK", "HERVK")], HIT)
    ref = spark.createDataFrame([hit(0, 0, 100, 900, "chr9", None), hit(1, 0, 505, 950, "chr1", None, 4800), hit(2, 0, 0, 900, "chr7", None)], HIT)
    got = {r.variant_ord: (r.itype, r.family, r.failed) for r in retro.annotate(v, cons, ref).collect()}
    assert got == {0: ("solo", "L1", None), 1: ("partnered", "L1", "OWN_SITE"), 2: ("orphan", None, None), 3: ("solo", "HERVK", "PERC_RESOLVED")}


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:05", "c1", 10, 60, False, "PLUS"), ("2024-01-01 00:00:50", "c1", 90, 60, False, "MINUS"), ("2024-01-01 00:00:51", "c1", 90, 5, False, "PLUS"), ("2024-01-01 02:00:00", "c2", 1, 60, False, "PLUS")]
    df = spark.createDataFrame(rows, "ts string, ref string, beg long, mapq int, is_dup boolean, orientation string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = depth.depth_by_time(stream, "ts", "10 minutes", "1 minute", 1000).writeStream.format("memory").queryName("depth").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.ref, r.bin, r.total, r.watson, r.crick) for r in spark.table("depth").collect()] == [("c1", 0, 2, 1, 1)]


def test_assign_to_others_by_profiles(spark):
    from strandline.operators import haplotype as H

    random.seed(5)
    few = [[(p, random.randrange(3)) for p in range(5) if random.random() < 0.8] for _ in range(9)]
    for copies in (9, 30):  # some profiles once, most several times
        rows = [(i, p, v) for i in range(copies) for p, v in few[i % 9 if i < 9 else i % 4]]
        h = spark.createDataFrame(rows, "sample_id long, position int, status int")
        want = H.assign(H.compare(h, H.diagnostic_scores(h)).where("target_id <> ref_id"))
        got = H.assign_to_others(h)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # 2000 samples of one profile: 4 million pairs before, one now
    same = spark.range(2000).selectExpr("id AS sample_id", "explode(array(0, 1)) AS position", "0 AS status").unionByName(spark.createDataFrame([(-1, 0, 1)], "sample_id long, position int, status int"))
    got = H.assign_to_others(same)
    assert got.count() == 2001
    assert H._profiles(same).select("profile").distinct().count() == 2
