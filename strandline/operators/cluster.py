"""Clustering by position: ordered scans as windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut
from .components import components

#: Positions of a tile of a scan.
TILE = 1 << 20


def scan_groups(rows: DataFrame, by: list[str], pos: str, ties: list[str], joins: Callable[[Callable, Callable], Column], carry: list[str], name: str, tile: int) -> DataFrame:
    """Numbers the groups of an ordered scan: a row goes on with the group of the row before it if ``joins(before, here)``.

    The scan runs inside tiles of a group's positions; the tiles are then stitched by their first and last
    rows, so a contig is spread over many tasks, and one task sees a row a tile at most.
    """
    rows = rows.withColumn("tile__", F.floor(F.col(pos) / tile))
    w = Window.partitionBy(*by, "tile__").orderBy(pos, *ties)
    rows = rows.withColumn("new__", F.when(joins(lambda c: F.lag(c).over(w), F.col), 0).otherwise(1))
    rows = rows.withColumn("local__", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(*dict.fromkeys([pos, *ties, *carry]))
    tiles = rows.groupBy(*by, "tile__").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.max("local__").alias("n"))
    over = Window.partitionBy(*by).orderBy("tile__")
    goes_on = F.when(joins(lambda c: F.lag("last").over(over).getField(c), lambda c: F.col("first").getField(c)), 1).otherwise(0)
    tiles = tiles.withColumn("on__", goes_on)
    upto = F.sum(F.col("n") - F.col("on__")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    tiles = tiles.select(*by, "tile__", (upto - F.col("n")).alias("offset__"))
    return rows.join(tiles, [*by, "tile__"]).withColumn(name, F.col("local__") + F.col("offset__")).drop("tile__", "new__", "local__", "offset__")


def gap_clusters(events: DataFrame, by: list[str], pos: str, max_dist: int, ties: list[str], name: str = "cluster", tile: int = TILE) -> DataFrame:
    """Number of the cluster in its group: a new one where the gap to the event before exceeds max_dist."""
    return scan_groups(events, by, pos, ties, lambda before, here: here(pos) - before(pos) <= max_dist, [], name, tile)


def bin_clusters(events: DataFrame, by: list[str], beg: str, end: str, width: int, max_dist: int, least: int) -> DataFrame:
    """Whole bins joined while adjacent and near: by, cluster, beg, end, n (``least`` events or more).

    Events that cross a bin's edge belong to no bin of this width.
    """
    inside = events.where(F.floor(F.col(beg) / width) == F.floor(F.col(end) / width)).withColumn("bin", F.floor(F.col(beg) / width))
    bins = inside.groupBy(*by, "bin").agg(F.min(beg).alias("first_beg"), F.max(end).alias("last_end"), F.count(F.lit(1)).alias("n"))
    near = lambda before, here: (here("bin") == before("bin") + 1) & (here("first_beg") - before("last_end") <= max_dist)
    runs = scan_groups(bins, by, "bin", [], near, ["first_beg", "last_end"], "cluster", TILE)
    return runs.groupBy(*by, "cluster").agg(F.min("first_beg").alias("beg"), F.max("last_end").alias("end"), F.sum("n").alias("n")).where(F.col("n") >= least)


def adjacent_groups(svs: DataFrame, by: list[str], max_dist: int, ties: list[str], af_diff: float | None = 0.30, same: list[str] = (), tile: int = TILE) -> DataFrame:
    """Neighbours joined while the gap is at most max_dist and they agree as asked; adds ``grp``."""

    def joins(before, here):
        join = here("beg") - before("end_pos") <= max_dist
        if af_diff is not None:
            join &= F.abs(here("af") - before("af")) <= af_diff
        for c in same:
            join &= here(c) == before(c)
        return join

    return scan_groups(svs, by, "beg", ties, joins, ["end_pos", *(["af"] if af_diff is not None else []), *same], "grp", tile)


def tumbling(svs: DataFrame, by: list[str], width: int, least: int) -> DataFrame:
    """Windows of a width that have ``least`` intervals or more; an interval counts in each that it touches."""
    rows = svs.withColumn("win", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor(F.col("end_pos") / width))))
    return rows.groupBy(*by, "win").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def gaps_between(ivals: DataFrame, by: list[str], length: Column) -> DataFrame:
    """The complement of intervals on [0, length), also before the first and after the last: by, beg, end."""
    w = Window.partitionBy(*by).orderBy("beg", "end_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = ivals.select(*by, F.coalesce(F.max("end_pos").over(w), F.lit(0)).alias("gap_beg"), F.col("beg").alias("gap_end"))
    after = ivals.groupBy(*by).agg(F.max("end_pos").alias("gap_beg")).select(*by, "gap_beg", length.cast("long").alias("gap_end"))
    return before.unionByName(after).where("gap_beg < gap_end")


def _linked(root, a, b):
    """The least place that each place is linked to, where a and b are linked as well; ``root`` points to lesser places or to itself."""
    import numpy as np

    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _reciprocal_roots(lo, hi, percent: float, step: int = 1 << 22):
    """A number for each of distinct intervals, the same for those that reciprocal overlaps connect.

    Intervals that begin near each other and are about as long are a cell, and all of a cell overlap each
    other enough. So cells are linked, not intervals: by one interval of each, and only
    where that doesn't link them by pairs of theirs. Cells that are linked already make no pairs.
    """
    import numpy as np

    share = percent / 100
    size = hi - lo + 1

    def linked(x, y):
        n = np.minimum(hi[x], hi[y]) - np.maximum(lo[x], lo[y]) + 1
        return (n > 0) & (n / size[x] * 100 >= percent) & (n / size[y] * 100 >= percent)

    near = min(max((1 - share) / (1 + share), 0) * 0.98, 0.3)
    loose = 0.999 * min(share, 0.95)
    grow = max(near, 0.02)
    k = np.floor(np.log(size) / np.log1p(grow)).astype(np.int64)
    wide = lambda k: np.maximum((1 + grow) ** k * grow, 1)
    j = np.floor(lo / wide(k)).astype(np.int64)
    order = np.lexsort((hi, lo, j, k))
    new = np.concatenate(([True], (k[order][1:] != k[order][:-1]) | (j[order][1:] != j[order][:-1])))
    if near < grow:  # at so high a percentage each interval is a cell
        new[:] = True
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order))
    ck, cj = k[order[head]], j[order[head]]
    box = lambda f, x: f.reduceat(x[order], head)
    lo0, lo1, hi1, least = box(np.minimum, lo), box(np.maximum, lo), box(np.maximum, hi), box(np.minimum, size)
    span = int(cj.max() - cj.min()) + 3
    code = (ck - ck.min()) * span + (cj - cj.min()) + 1
    root = np.arange(len(head))

    def spread(first, n):
        """Each place as often as n says, and the numbers from first on."""
        at = np.repeat(np.arange(len(n)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[at]

    def parts(n):
        upto, begin = np.cumsum(n), 0
        while begin < len(n):
            end = max(int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + step, side="right")), begin + 1)
            yield slice(begin, end)
            begin = end

    left = []
    for dk in range(int(np.ceil(np.log(1 / loose) / np.log1p(grow))) + 2):
        to = ck + dk
        reach = (1 - loose) * (1 + grow) ** (to + 1) + 1
        low, high = (np.clip(np.floor(x / wide(to)), cj.min() - 1, cj.max() + 1).astype(np.int64) - cj.min() + 1 for x in (lo0 - reach, lo1 + reach))
        first = np.searchsorted(code, (to - ck.min()) * span + low, side="left")
        n = np.searchsorted(code, (to - ck.min()) * span + high, side="right") - first
        for some in parts(n):
            a, b = spread(first[some], n[some])
            a += some.start
            ok = a < b
            a, b = a[ok], b[ok]
            most = np.minimum(hi1[a], hi1[b]) - np.maximum(lo0[a], lo0[b]) + 1
            ok = most >= loose * np.maximum(least[a], least[b])
            a, b = a[ok], b[ok]
            ok = linked(order[head[a]], order[head[b]])
            root = _linked(root, a[ok], b[ok])
            apart = root[a] != root[b]
            left.append(np.stack((a[apart], b[apart])))
    a, b = np.concatenate(left, axis=1)
    apart = root[a] != root[b]
    a, b = a[apart], b[apart]
    count = tail - head
    for some in parts(count[a] * count[b]):
        x, y = a[some], b[some]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        at, member = spread(np.zeros(len(x), np.int64), count[x] * count[y])
        ok = linked(order[head[x[at]] + member // count[y[at]]], order[head[y[at]] + member % count[y[at]]])
        root = _linked(root, x[at[ok]], y[at[ok]])
    found = np.empty(len(order), np.int64)
    found[order] = np.repeat(root, count)
    return found


def reciprocal_clusters(events: DataFrame, key: str, ref: str, beg: str, end: str, least_percent: float, buffer: int = 0) -> DataFrame:
    """(key, cluster): events that overlap each other by a share of both lengths, and what they connect, are one cluster.

    The cluster is named by its least key; an event that meets no other, or is no interval, is its own cluster.
    The result doesn't depend on the events' order.

    Events are dealt to tiles by length and begin, those near an edge to the tiles beyond it as well. A task
    connects a tile without writing pairs; then the tiles' clusters are connected by the events that they share.
    """
    loose, factor = 0.999 * min(least_percent / 100, 0.95), 4
    rows = events.select(F.col(key).alias("key"), F.col(ref).alias("ref"), (F.col(beg) - buffer).cast("long").alias("lo"), (F.col(end) + buffer).cast("long").alias("hi"))
    rows = rows.withColumn("good", F.coalesce(F.col("ref").isNotNull() & (F.col("lo") <= F.col("hi")), F.lit(False)))
    size = F.col("hi") - F.col("lo") + 1
    step = lambda n: F.floor(F.log(n) / F.log(F.lit(float(factor))) + 1e-9).cast("int")
    # a pair meets in the tile of its longer length and greater begin
    wide = lambda k: F.greatest(F.pow(F.lit(float(factor)), k + 3), F.lit(float(1 << 14)))
    reach = lambda k: (1 - loose) * F.pow(F.lit(float(factor)), k + 1) * 1.001 + 1
    dealt = rows.where("good").withColumn("k", F.explode(F.sequence(step(size), step(size / loose + 1))))
    dealt = dealt.withColumn("tile", F.explode(F.sequence(F.floor(F.col("lo") / wide(F.col("k"))), F.floor((F.col("lo") + reach(F.col("k"))) / wide(F.col("k"))))))
    own = (F.col("k") == step(size)) & (F.col("tile") == F.floor(F.col("lo") / wide(F.col("k"))))
    again = (step(size / loose + 1) > step(size)) | (F.floor((F.col("lo") + reach(step(size))) / wide(step(size))) > F.floor(F.col("lo") / wide(step(size))))
    dealt = dealt.select("key", "ref", "k", "tile", "lo", "hi", own.alias("own"), again.alias("again"))

    def connect(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys = table.column("key").combine_chunks()
        by_key = pc.array_sort_indices(keys).to_numpy()
        rank = np.empty(len(keys), np.int64)
        rank[by_key] = np.arange(len(keys))
        lo, hi, own, again = (table.column(c).to_numpy() for c in ("lo", "hi", "own", "again"))
        order = np.lexsort((rank, hi, lo))
        new = np.concatenate(([True], (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])))
        heads = order[new]  # the least key of each interval
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        root = _reciprocal_roots(lo[heads], hi[heads], least_percent)
        least = np.full(len(heads), len(order))
        np.minimum.at(least, root, rank[heads])
        name = by_key[least[root]]
        mine, shared = np.flatnonzero(own), np.flatnonzero(again[heads])
        at, to = np.concatenate((mine, heads[shared])), np.concatenate((name[place[mine]], name[shared]))
        kind = np.repeat([True, False], [len(mine), len(shared)])
        return pa.table({"key": keys.take(pa.array(at)), "root": keys.take(pa.array(to)), "event": kind})

    type_ = events.schema[key].dataType.simpleString()
    found = cut(dealt.groupBy("ref", "k", "tile").applyInArrow(connect, f"key {type_}, root {type_}, event boolean"))
    roots = components(found.where("NOT event").select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    named = found.where("event").select("key", "root").join(roots, "root", "left").select("key", F.coalesce("whole", "root").alias("cluster"))
    return named.unionByName(rows.where("NOT good").select("key", F.col("key").alias("cluster"))).withColumnRenamed("key", key)


def two_groups(events: DataFrame, by: list[str], value: str, ties: list[str], least_silhouette: float = 0.60) -> DataFrame:
    """Adds ``part``: 0 and 1 where a cluster's values split into two groups well enough, else 0 for all.

    On a line, the best two groups are a cut of the sorted values, so all cuts are weighed
    by running sums: the one of least squared error is taken (ties: the first), and kept
    if its mean silhouette, from the same sums, reaches the limit. Exact, no seeds.
    """
    w = Window.partitionBy(*by).orderBy(value, *ties)
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    v = F.col(value).cast("double")
    r = events.withColumns({"k__": F.row_number().over(w), "s__": F.sum(v).over(run), "n__": F.count(F.lit(1)).over(whole), "t__": F.sum(v).over(whole)})
    gain = F.when(F.col("k__") < F.col("n__"), F.col("s__") ** 2 / F.col("k__") + (F.col("t__") - F.col("s__")) ** 2 / (F.col("n__") - F.col("k__")))
    r = r.withColumn("gain__", gain).withColumn("cut__", F.max(F.when(F.col("gain__").isNotNull(), F.struct(F.round("gain__", 6), -F.col("k__")))).over(whole))
    r = r.withColumn("cut__", -F.col("cut__")["col2"]).withColumn("low__", F.max(F.when(F.col("k__") == F.col("cut__"), F.col("s__"))).over(whole))
    first = F.col("k__") <= F.col("cut__")
    size = F.when(first, F.col("cut__")).otherwise(F.col("n__") - F.col("cut__"))
    other = F.col("n__") - size
    before, total = F.when(first, F.col("k__")).otherwise(F.col("k__") - F.col("cut__")), F.when(first, F.col("low__")).otherwise(F.col("t__") - F.col("low__"))
    upto = F.when(first, F.col("s__")).otherwise(F.col("s__") - F.col("low__"))
    within = (v * before - upto + (total - upto) - v * (size - before)) / F.nullif(size - 1, F.lit(0))
    across = F.abs(F.col("t__") - total - v * other) / F.nullif(other, F.lit(0))
    score = F.when(size == 1, 0.0).otherwise(F.coalesce((across - within) / F.nullif(F.greatest(across, within), F.lit(0.0)), F.lit(0.0)))
    r = r.withColumn("score__", score).withColumn("silhouette", F.avg("score__").over(whole))
    good = F.col("cut__").isNotNull() & (F.col("silhouette") >= least_silhouette)
    return r.withColumn("part", F.when(good & ~first, 1).otherwise(0)).drop("k__", "s__", "n__", "t__", "gain__", "cut__", "low__", "score__")


def chromothriptic(chromosomes: DataFrame, least_share: float = 0.25, max_gap: int = 200_000, least_bias: float = 0.8) -> DataFrame:
    """enriched, clustered, biased and their conjunction for each cell's chromosome (n, total, gap, h1, h2)."""
    phased = F.col("h1") + F.col("h2")
    enriched = F.col("n") > least_share * F.col("total")
    near = F.coalesce(F.col("gap") < max_gap, F.lit(False))
    biased = (F.greatest("h1", "h2") >= least_bias * phased) & (phased > 0)
    return chromosomes.select("cell_id", "chrom", enriched.alias("enriched"), near.alias("clustered"), biased.alias("biased"), (enriched & near & biased).alias("chromothriptic"))


def adjacent(svs: DataFrame, by: list[str], kind: str, beside: str, max_dist: int) -> DataFrame:
    """sv_id of variants of a kind, and whether one of the other kind is the next before or after, near enough."""
    w = Window.partitionBy(*by).orderBy("beg", "sv_id")
    before = (F.lag("sv_type").over(w) == beside) & (F.col("beg") - F.lag("end_pos").over(w) <= max_dist)
    after = (F.lead("sv_type").over(w) == beside) & (F.lead("beg").over(w) - F.col("end_pos") <= max_dist)
    no = F.lit(False)
    rows = svs.withColumns({f"{beside}_before": F.coalesce(before, no), f"{beside}_after": F.coalesce(after, no)})
    return rows.where(F.col("sv_type") == kind).select("sv_id", f"{beside}_before", f"{beside}_after")
