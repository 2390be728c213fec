"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.plans import annotation, calls, catalogue, events, filters, formats, inserts  # noqa: F401

SF = "/root/testdata/sf0.001"
MODULES = (calls, events, filters, formats, inserts)
NAMES = [n for n in catalogue.QUERIES if any(getattr(m, n, None) is not None and getattr(m, n).__module__ == m.__name__ for m in MODULES)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


@pytest.mark.parametrize("name", [*NAMES, "overlap_totals", "interval_join", "gap_clusters", "bin_clusters", "sv_adjacent_groups", "reciprocal_clusters", "mate_insertions"])
def test_query_against_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(([r[c] for c in names] for r in df.collect()), key=repr)
    out = con.execute(catalogue.ORACLES[name])
    at = [d[0] for d in out.description]
    assert sorted(at) == names
    want = sorted(([r[at.index(c)] for c in names] for r in out.fetchall()), key=repr)
    assert len(got) == len(want) and all(map(same, got, want))


def test_long_intervals_use_levels(spark):
    from strandline.operators import interval_join as J

    a = spark.createDataFrame([("x", i * 10, i * 10 + 5) for i in range(600)] + [("x", 5, 10_000_000), ("x", 0, 0), ("x", 9, 3)], "ref string, beg long, e long")
    b = spark.createDataFrame([("x", i * 7, i * 7 + 3) for i in range(600)] + [("x", 100, 9_000_000), ("y", 0, 9)], "ref_b string, beg_b long, e_b long")
    assert J._shape(a, b, ("ref", "beg", "e"), ("ref_b", "beg_b", "e_b"), 0)[1] > 0
    got = J.interval_join(a, b, ("ref", "beg", "e"), ("ref_b", "beg_b", "e_b")).collect()
    left, right = a.collect(), b.collect()
    want = {(x.beg, x.e, y.beg_b, y.e_b) for x in left for y in right if x.ref == y.ref_b and x.beg <= x.e and x.beg <= y.e_b and y.beg_b <= x.e}
    assert len(got) == len(want) and {tuple(r[c] for c in ("beg", "e", "beg_b", "e_b")) for r in got} == want


@pytest.mark.parametrize("longest", [30, 9000])
def test_best_overlap_without_pairs(spark, longest):
    import random

    from strandline.operators import interval_join as J

    random.seed(longest)
    some = lambda n, most: [(random.choice("xy"), b := random.randrange(300), b + random.choice([0, 3, random.randrange(-2, 30), random.randrange(most)]), i) for i in range(n)]
    left, right = some(300, longest), random.sample(some(250, longest), 250)
    a = spark.createDataFrame(left, "ref string, beg long, e long, i long")
    b = spark.createDataFrame(right, "ref_b string, beg_b long, e_b long, j long")
    sides = ("ref", "beg", "e"), ("ref_b", "beg_b", "e_b")
    want, none = {}, set()
    for ref, s, e, i in left:
        met = [(-(min(e, y) - max(s, x)), x, j) for r, x, y, j in right if r == ref and s <= e and x <= y and x <= e and s <= y]
        if met:
            want[i] = min(met)
        if not met or -min(met)[0] / (e - s + 1) * 100 < 40:
            none.add(i)
    best = J.best_overlap(a, b, ["i"], *sides, ties=["beg_b", "j"])
    got = best.collect()
    assert len(got) == len(want) and {r.i: (-(min(r.e, r.e_b) - max(r.beg, r.beg_b)), r.beg_b, r.j) for r in got} == want
    assert {r.i for r in J.anti_overlap(a, b, ["i"], *sides, 40).collect()} == none
    old = J.most_shared
    try:
        J.most_shared = lambda *x, **y: old(*x, **{**y, "share": 20})
        assert {r.i for r in J.best_overlap(a, b, ["i"], *sides, ties=["beg_b", "j"]).collect()} == set(want)
    finally:
        J.most_shared = old


def test_totals_and_flags_without_pairs(spark):
    for name in ("interval_join", "interval_top1", "interval_anti_join", "subfamily_filter"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert "collect_list" not in plan.lower() if name == "subfamily_filter" else "bin_b__" not in plan


def test_scans_across_tiles(spark):
    from strandline.operators import cluster as L

    rows = spark.createDataFrame([("x", p, k) for k, p in enumerate([1, 5, 9, 30, 31, 64, 70, 100, 101, 300, 302])] + [("y", 3, 50)], "ref string, beg long, k long")
    want = {r.k: r.cluster for r in L.gap_clusters(rows, ["ref"], "beg", 10, ["k"]).collect()}
    for tile in (1, 8, 33):
        assert {r.k: r.cluster for r in L.gap_clusters(rows, ["ref"], "beg", 10, ["k"], tile=tile).collect()} == want
    assert want == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 4, 8: 4, 9: 5, 10: 5, 50: 1}


def test_no_machine_local_folder_on_a_cluster(monkeypatch, spark):
    from strandline import storage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_tables_are_removed(spark):
    from strandline import storage

    at = storage.scratch(spark)
    spark.range(3).write.parquet(at)
    assert os.path.exists(at.removeprefix("file://"))
    storage._made[:] = [x for x in storage._made if x[1] == at]
    assert storage.remove_tables() == 1 and not os.path.exists(at.removeprefix("file://"))


def test_labels_without_pairs(spark):
    import random

    from strandline.operators import interval_join as J

    random.seed(11)
    some = lambda n, most: [(random.choice(["x", "y", None]), b := random.randrange(-50, 3000), b + random.choice([0, random.randrange(-2, 30), random.randrange(most)])) for _ in range(n)]
    calls = [(*x, i // 2) for i, x in enumerate([*some(300, 60), ("x", 0, 90_000)])]
    known = [(*x, random.choice(["p", "q", "r", None])) for x in [*some(200, 400), ("y", 5, 80_000)]]
    a, b = spark.createDataFrame(calls, "ref string, beg long, e long, i long"), spark.createDataFrame(known, "k_ref string, k_beg long, k_end long, label string")
    want = {}
    for r, s, e, i in calls:
        met = [n for q, x, y, n in known if q == r and r and s <= e and x <= y and s <= y and x <= e]
        if met:
            want[i] = sorted({*want.get(i, []), *met} - {None})
    sides = ("ref", "beg", "e"), ("k_ref", "k_beg", "k_end")
    for share in (100_000, 20):
        got = J.labels_met(a, b, ["i"], *sides, "label", share).collect()
        assert len(got) == len(want) and {r.i: r.labels for r in got} == want
    # a pile of n calls and n known intervals made n squared pairs
    pile = spark.range(1 << 17).select(F.lit("x").alias("ref"), (F.col("id") % 9).alias("beg"), (F.col("id") % 9 + 5).alias("e"), F.col("id").alias("i"))
    many = pile.select(F.col("ref").alias("k_ref"), F.col("beg").alias("k_beg"), F.col("e").alias("k_end"), (F.col("i") % 3).cast("string").alias("label"))
    assert J.labels_met(pile, many, ["i"], *sides, "label").where("labels = array('0', '1', '2')").count() == 1 << 17
