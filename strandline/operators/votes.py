"""Votes of a query's intervals for the names that they meet."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _winners(query, s, e, ref, x, y, at, name, n_names: int, step: int = 1 << 21):
    """For each query from 0 on (rows sorted by it) that meets any: its number, the name met most, the least of several, and how often. Pairs are made for some queries at a time and not kept."""
    import numpy as np

    base = min(int(x.min()), int(s.min())) - 1
    span = max(int(y.max()), int(e.max())) - base + 2
    sides, level = [], np.floor(np.log2(y - x + 1) / 2).astype(int)
    for k in np.unique(level):  # by length, so few candidates end before a row begins
        some = np.flatnonzero(level == k)
        some = some[np.argsort(at[some] * span + x[some] - base, kind="stable")]
        place, longest = at[some] * span + x[some] - base, int((y[some] - x[some]).max())
        lo = np.searchsorted(place, ref * span + np.maximum(s - base - longest, 0))
        hi = np.searchsorted(place, ref * span + e - base, side="right")
        sides.append((lo, np.maximum(hi - lo, 0), y[some], name[some]))
    begins = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1], [True])))
    upto = np.concatenate(([0], np.cumsum(sum(n for _, n, _, _ in sides))))[begins]
    found, k = [], 0
    while k < len(begins) - 1:
        last = max(int(np.searchsorted(upto, upto[k] + step, side="right")) - 1, k + 1)
        a, b = begins[k], begins[last]
        votes = []
        for lo, n, ends, names in sides:
            size = n[a:b]
            row = np.repeat(np.arange(a, b), size)
            met = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + lo[row]
            ok = ends[met] >= s[row]
            votes.append((query[row[ok]] - query[a]) * n_names + names[met[ok]])
        votes = np.concatenate(votes)
        if len(votes):
            votes = np.sort(votes.astype(np.int32) if int(votes.max()) < 1 << 31 else votes)
            head = np.flatnonzero(np.concatenate(([True], votes[1:] != votes[:-1])))
            n = np.diff(np.append(head, len(votes)))
            q, g = np.divmod(votes[head].astype(np.int64), n_names)
            first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            most = int(n.max())
            best = np.minimum.reduceat((most - n) * n_names + g, first)
            found.append(np.stack((q[first] + query[a], best % n_names, most - best // n_names)))
        k = last
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


#: Levels that are kept: counts that a name must reach at a row.
LEVELS = (1, 2, 3, 4, 5, 6, 8, 11, 16, 23, 32, 45, 64)


def _corners(x, y, name, reach: int):
    """level, X, Y, next, name: a row [s, e] of ``reach`` positions at most meets a name ``level`` times or more where X <= e < next and s <= Y, for one of the name's corners.

    Of a name's intervals by begin, the level-th greatest end so far is a running maximum of what the level before pushes out. What no row can reach any more is dropped.
    """
    import numpy as np

    order = np.lexsort((x, name))
    x, z, name = x[order], y[order], name[order]
    low = int(min(x.min(), z.min())) - reach - 1
    span, level = int(z.max()) - low + 1, 1
    found = []
    while len(x) and level <= LEVELS[-1]:
        own = np.concatenate(([True], name[1:] != name[:-1]))
        lift = (np.cumsum(own) - 1) * span
        top = np.maximum.accumulate(z + lift) - lift
        before = np.where(own, low, np.concatenate(([low], top[:-1])))
        if level in LEVELS:
            k = np.flatnonzero((z > before) & (z >= x - reach))
            following = np.full(len(k), np.iinfo(np.int64).max)
            following[:-1] = np.where(name[k[1:]] == name[k[:-1]], x[k[1:]], following[:-1])
            found.append((level, x[k], z[k], following, name[k]))
        z = np.minimum(z, before)
        some = z >= x - reach
        x, z, name, level = x[some], z[some], name[some], level + 1
    return [f for f in found if len(f[1])]


def _bounds(corners, n_names: int, span: int, reach: int, cells: int = 1 << 26):
    """A table of names by tiles, the width of a tile, and what its entries stand for: the most times a row that begins in a tile can meet a name."""
    import numpy as np

    wide = max(-(-span // max(cells // n_names, 1)), reach // 8 + 1)
    across = span // wide + 1
    table = np.zeros(n_names * across, np.uint8)
    most = [0]
    for k, (level, cx, cy, _, name) in enumerate(corners):
        most.append(corners[k + 1][0] - 1 if k + 1 < len(corners) else level if level < LEVELS[-1] else np.iinfo(np.int32).max)
        first, last = np.maximum(cx - reach, 0) // wide, cy // wide
        at, n = name * across + first, last - first + 1
        while len(at):  # tile by tile
            table[at] = k + 1
            at, n = at[n > 1] + 1, n[n > 1] - 1
    return table, wide, across, np.array(most)


def _counted(name, s, e, first, x, y, begins, ends, span: int, few: int = 64):
    """How many intervals of a name meet [s, e]: those of a name with few are all looked at."""
    import numpy as np

    n = first[name + 1] - first[name]
    total = np.empty(len(name), np.int64)
    i = np.flatnonzero(n <= few)
    size = n[i]
    offset = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(first[name[i]] - offset, size)
    ok = (x[at] <= np.repeat(e[i], size)) & (y[at] >= np.repeat(s[i], size))
    total[i] = np.add.reduceat(ok, offset, dtype=np.int64) if len(i) else 0
    i = np.flatnonzero(n > few)
    total[i] = np.searchsorted(begins, name[i] * span + e[i], side="right") - np.searchsorted(ends, name[i] * span + s[i])
    return total


def _best(query, s, e, ref, x, y, at, name, n_names: int, many: int = 12, step: int = 1 << 17):
    """As ``_winners``, without its pairs: names are looked at by how often they are met by one row, the highest level first.

    Names below a level at each of a query's m rows have m * (level - 1) votes at most, so a query whose best has more is done. Names that
    reach it only by several rows of that level are looked for at as many rows fewer, and counted only if the bounds of the others' tiles let them reach it.
    Queries of more rows than ``many`` or with a row far longer than most are left to ``_winners``.
    """
    import numpy as np

    base = min(int(x.min()), int(s.min()))
    reach = int(min((e - s).max(), 8 * np.median(e - s) + 1024))
    gap = max(int(y.max()), int(e.max())) - base + reach + 2
    x, y, s, e = at * gap + x - base, at * gap + y - base, ref * gap + s - base, ref * gap + e - base
    begin = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    m = np.diff(np.append(begin, len(query)))
    group = np.repeat(np.arange(len(begin)), m)
    odd = (m > many) | (np.maximum.reduceat(e - s, begin) > reach)
    found = []
    if odd.any():
        rows = odd[group]
        none = np.zeros(len(x), np.int64)
        found.append(_winners(query[rows], s[rows], e[rows], none[:1].repeat(rows.sum()), x, y, none, name, n_names))
    span = max(int(y.max()), int(e.max())) + 2
    begins, ends = np.sort(name * span + x), np.sort(name * span + y)
    kind = np.int32 if span < 1 << 30 else np.int64
    s_, e_ = s.astype(kind), e.astype(kind)
    by = np.argsort(name, kind="stable")
    own = np.searchsorted(name[by], np.arange(n_names + 1)), x[by].astype(kind), y[by].astype(kind), begins, ends, span
    corners = _corners(x, y, name, reach)
    table, wide, across, most = _bounds(corners, n_names, span, reach)
    tile = s // wide
    best = np.where(odd, np.iinfo(np.int64).max // 2, 0)
    steps, last_level = [], None
    for level, cx, cy, following, cn in reversed(corners):
        # the first names first: of names with as many votes the others lose, so they are looked for with one more
        edges = [0, n_names // 32, n_names // 6, n_names] if len(cx) * reach > 32 * span else [0, n_names]
        for low, high in zip(edges[:-1], edges[1:]):
            some = (cn >= low) & (cn < high)
            if some.any():
                steps.append((level, last_level, low, cx[some], cy[some], following[some], cn[some]))
        last_level = level
    for level, above, low, cx, cy, following, cn in steps:
        least = best // n_names + (n_names - 1 - best % n_names <= low)  # votes that a name of these needs
        open_ = ~odd if above is None else m * (above - 1) >= least
        need = np.ones(len(m), np.int64) if above is None else np.maximum(-((m * (level - 1) - least) // (above - level)), 1)
        rows = np.flatnonzero(open_[group])
        if not len(rows):
            continue
        following = np.minimum(following, span).astype(kind)
        reaches = cy - cx
        edges = np.unique(np.quantile(reaches, np.linspace(0, 1, 5)[1:], method="higher"))
        sides = []
        for k in range(len(edges)):  # by how far a corner reaches, so few candidates end before a row begins
            part = np.flatnonzero(np.searchsorted(edges, reaches) == k)
            part = part[np.argsort(cx[part], kind="stable")]
            px = cx[part]
            lo = np.searchsorted(px, s[rows] - edges[k])
            sides.append((lo, np.maximum(np.searchsorted(px, e[rows], side="right") - lo, 0), cy[part].astype(kind), following[part], cn[part]))
        size = sum(n for _, n, _, _, _ in sides)
        if (need > 1).any():
            g = group[rows]
            by = np.lexsort((size, g))
            head = np.concatenate(([True], g[1:] != g[:-1]))
            rank = np.empty(len(g), np.int64)
            rank[by] = np.arange(len(g)) - np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
            take = rank <= m[g] - need[g]
            rows, size = rows[take], size[take]
            sides = [(lo[take], n[take], *rest) for lo, n, *rest in sides]
        upto, k = np.cumsum(size), 0
        while k < len(rows):
            last = max(int(np.searchsorted(upto, (upto[k - 1] if k else 0) + step, side="right")), k + 1)
            got_row, got_name = [], []
            for lo, n, py, after, names in sides:
                n = n[k:last]
                mine = np.repeat(np.arange(k, last), n)
                place = np.arange(len(mine)) + np.repeat(lo[k:last] - np.cumsum(n) + n, n)
                ok = (py[place] >= np.repeat(s_[rows[k:last]], n)) & (after[place] > np.repeat(e_[rows[k:last]], n))
                got_row.append(rows[mine[ok]])
                got_name.append(names[place[ok]])
            row, g = np.concatenate(got_row), np.concatenate(got_name)
            k = last
            of = group[row]
            several, want, close = m[of], least[of], above == level + 1
            votes = most[table[g * across + tile[row]]].astype(np.int64) if above is None else np.full(len(row), above - 1)
            i = np.flatnonzero(several > 1)
            for j in range(1, int(several.max(initial=0))):  # as long as the rows left could bring a name up to the best
                more = several[i] - j
                some = (more > 0) & (votes[i] + more * (most[-1] if above is None else above - 1) >= want[i])
                i = i[some]
                first = begin[of[i]]
                bound = most[table[g[i] * across + tile[first + (row[i] - first + j) % several[i]]]]
                votes[i] += bound if above is None else np.minimum(bound, above - 1)
            keep = (votes >= want) & (votes * n_names + n_names - 1 - g > best[of])
            row, g, of, several = row[keep], g[keep], of[keep], several[keep]
            if not len(row):
                continue
            # one level below the last, its row meets a name so often, or the name has been counted
            total = np.full(len(row), level if close else 0)
            i = np.flatnonzero(several > close)
            for j in range(int(close), int(several.max())):
                i = i[several[i] > j]
                first = begin[of[i]]
                other = first + (row[i] - first + j) % several[i]
                total[i] += _counted(g[i], s_[other], e_[other], *own)
            np.maximum.at(best, of, total * n_names + n_names - 1 - g)
    done = np.flatnonzero(~odd & (best > 0))
    found.append(np.stack((query[begin[done]], n_names - 1 - best[done] % n_names, best[done] // n_names)))
    return np.concatenate(found, axis=1)


def most_met(a: DataFrame, b: DataFrame, key: str, name: str, a_cols, b_cols, share: int = 1_500_000) -> DataFrame:
    """key, name, n: the name whose intervals of b a key's rows meet most often, the first of several.

    Names on one reference are voted for there, with that reference's rows; names on several references, with all rows. A reference's keys are
    dealt to tasks of about ``share`` rows of the largest reference, and its intervals to each of them: no pair is shuffled.
    """
    (ar, ab, ae), (br, bb, be) = a_cols, b_cols
    pick = lambda df, c, r, s, e: df.select(F.col(c).alias("name"), F.col(r).alias("ref"), F.col(s).cast("long").alias("s"), F.col(e).cast("long").alias("e")).where("s <= e AND ref IS NOT NULL")
    rows, known = pick(a, key, ar, ab, ae), pick(b, name, br, bb, be)
    most = rows.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    spread = known.groupBy("name").agg(F.min("ref").alias("low"), F.max("ref").alias("high")).where("low <> high").select(F.col("name").alias("wide"), F.lit(True).alias("spread"))
    alone, apart = rows.select("name", F.col("ref").alias("shard"), F.lit(None).cast("string").alias("ref"), "s", "e"), lambda df: df.select("name", F.lit(None).cast("string").alias("shard"), F.col("ref").cast("string").alias("ref"), "s", "e")
    if some := not spread.isEmpty():
        known = known.join(spread, F.col("name").eqNullSafe(F.col("wide")), "left")
        known = known.where("spread IS NULL").select("name", F.col("ref").alias("shard"), F.lit(None).cast("string").alias("ref"), "s", "e").unionByName(apart(known.where("spread")))
        alone = alone.unionByName(apart(rows))
    else:
        known = known.select("name", F.col("ref").alias("shard"), F.lit(None).cast("string").alias("ref"), "s", "e")
    parts = max(math.ceil((most[1 if some else 0] or 0) / share), 1)
    rows = alone.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def vote(given, known):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys = given.column("name").combine_chunks().dictionary_encode(null_encoding="encode")
        column = known.column("name").combine_chunks()
        names = column.unique().drop_null()
        names = names.take(pc.sort_indices(names))
        found = np.zeros((3, 0), np.int64)
        if len(given) and len(known):
            refs = known.column("ref").combine_chunks().unique()
            place = lambda t: pc.fill_null(pc.index_in(t.column("ref").combine_chunks(), refs), len(refs)).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(column, names), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            query = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(query, kind="stable")
            s, e, ref = (x[order] for x in (given.column("s").to_numpy(), given.column("e").to_numpy(), place(given)))
            found = _best(query[order], s, e, ref, known.column("s").to_numpy(), known.column("e").to_numpy(), place(known), code, len(names) + 1)
        best = pa.array(found[1], mask=found[1] == len(names))
        return pa.table({"key": keys.dictionary.take(pa.array(found[0])), "best": names.take(best), "n": found[2]})

    types = f"key {a.schema[key].dataType.simpleString()}, best {b.schema[name].dataType.simpleString()}, n long"
    voted = rows.groupBy("shard", "part").cogroup(known.groupBy("shard", "part")).applyInArrow(vote, types)
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("best").isNull().alias("last"), "best"))
    return voted.groupBy(F.col("key").alias(key)).agg(first.alias("first")).select(key, F.col("first.best").alias(name), (-F.col("first.n")).alias("n"))
