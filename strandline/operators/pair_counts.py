"""Counts over all pairs of intervals, without the pairs: a task counts a tile by sorted positions and bits of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _below(values, lo, hi, bound):
    """How many of ``values`` (from 0 on) at the places lo up to hi (without hi) are less than a bound, for arrays of lo, hi and bound."""
    import numpy as np

    total = np.zeros(len(lo), np.int64)
    hi = np.maximum(lo, hi)
    for bit in reversed(range(max(int(values.max(initial=0)), int(bound.max(initial=0))).bit_length())):
        one = (values >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        a, b, up = zeros[lo], zeros[hi], (bound >> bit & 1).astype(bool)
        total += np.where(up, b - a, 0)
        lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        values = np.concatenate((values[~one], values[one]))
    return total


def _limit(size, percent: float, least: bool):
    """The least length that is that percentage of a size at least, or the greatest that is at most."""
    import numpy as np

    n = np.floor(size * (percent / 100)).astype(np.int64)
    if least:
        n = np.maximum(n - 1, 1)
        for _ in range(3):
            n += n / size * 100 < percent
        return n
    n += 1
    for _ in range(3):
        n -= n / size * 100 > percent
    return n


def _reciprocal_pairs(lo, hi, own, percent: float) -> int:
    """Twice the pairs of an own interval and one that is shorter, and the ordered pairs with one of its length, itself included.

    Of the intervals y not longer than x and T long at least, T what x needs, those meet x enough that
    end at its begin + T - 1 or behind and don't begin behind its end - T + 1; none fails in both ways.
    """
    import numpy as np

    size = hi - lo + 1
    b, e, n = lo[own], hi[own], size[own]
    need = _limit(n, percent, True)
    sizes = np.unique(size)
    total = 0
    for pos, from_ in ((hi, b + need - 1), (lo, e - need + 2)):
        order = np.argsort(pos, kind="stable")
        rank = np.searchsorted(sizes, size[order])
        first, last = np.searchsorted(pos[order], from_), np.full(len(b), len(order))
        below = lambda v, first=first, last=last, rank=rank: int(_below(rank, first, last, np.searchsorted(sizes, v)).sum())
        found = below(n) + below(n + 1) - 2 * below(need)
        total += found if pos is hi else -found
    return total


def reciprocal_pairs(ivals: DataFrame, ref: str, beg: str, end: str, percent: float) -> DataFrame:
    """ref and how many pairs of its intervals overlap each other by a percentage of both lengths.

    An interval is counted in the tile of its length and begin, where all that are not longer than it and can meet it enough are dealt as well.
    """
    loose, factor = 0.999 * min(percent / 100, 0.95), 4
    rows = ivals.select(F.col(ref).alias("ref"), F.col(beg).cast("long").alias("lo"), F.col(end).cast("long").alias("hi")).where("lo <= hi AND ref IS NOT NULL")
    size = F.col("hi") - F.col("lo") + 1
    step = lambda n: F.floor(F.log(n) / F.log(F.lit(float(factor))) + 1e-9).cast("int")
    wide = F.greatest(F.pow(F.lit(float(factor)), F.col("k") + 3), F.lit(float(1 << 14)))
    reach = F.pow(F.lit(float(factor)), F.col("k") + 1) * 1.001 + 1
    dealt = rows.withColumn("k", F.explode(F.sequence(step(size), step(size / loose + 1))))
    dealt = dealt.withColumn("tile", F.explode(F.sequence(F.floor((F.col("lo") - reach) / wide), F.floor((F.col("lo") + reach) / wide))))
    dealt = dealt.withColumn("own", (F.col("k") == step(size)) & (F.col("tile") == F.floor(F.col("lo") / wide)))

    def count(table):
        import pyarrow as pa

        lo, hi, own = (table.column(c).to_numpy() for c in ("lo", "hi", "own"))
        return pa.table({"ref": table.column("ref")[:1], "n": [_reciprocal_pairs(lo, hi, own, percent) - int(own.sum())]})

    type_ = ivals.schema[ref].dataType.simpleString()
    return dealt.groupBy("ref", "k", "tile").applyInArrow(count, f"ref {type_}, n long").groupBy("ref").agg((F.sum("n") / 2).cast("long").alias("n"))


def overlapping_pairs(ivals: DataFrame, ref: str, beg: str, end: str, tile: int = 1 << 14) -> DataFrame:
    """ref, n and shared: how many pairs of its intervals overlap, and the sum of the positions they share, by how many cover each position."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rows = ivals.select(F.col(ref).alias("ref"), F.col(beg).cast("long").alias("lo"), F.col(end).cast("long").alias("hi")).where("lo <= hi AND ref IS NOT NULL")
    at = lambda pos, begins, ends: rows.select("ref", pos.alias("pos"), F.lit(begins).cast("long").alias("nb"), F.lit(ends).cast("long").alias("ne"))
    ends = at(F.col("lo"), 1, 0).unionByName(at(F.col("hi") + 1, 0, 1)).groupBy("ref", "pos").agg(F.sum("nb").alias("nb"), F.sum("ne").alias("ne"))
    ends = ends.withColumn("tile", F.floor(F.col("pos") / tile)).withColumn("d", F.col("nb") - F.col("ne"))
    over = Window.partitionBy("ref").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.groupBy("ref", "tile").agg(F.sum("d").alias("d")).select("ref", "tile", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("n0"))
    w = Window.partitionBy("ref", "tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = ends.withColumn("after", F.sum("d").over(w)).join(before, ["ref", "tile"])
    rows = rows.select("ref", wide("pos").alias("pos"), wide("nb").alias("nb"), (F.col("after") + F.col("n0")).alias("after"), (F.col("after") + F.col("n0") - F.col("d")).alias("was"), (F.col("after") + F.col("n0") - F.col("nb")).alias("open"))
    both = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("long")
    met = F.sum((F.col("nb") * F.col("open")).cast("decimal(38,0)")) + F.sum((F.col("nb") * (F.col("nb") - 1) / 2).cast("decimal(38,0)"))
    shared = F.sum((F.col("pos") * (both("was") - both("after")).cast("decimal(19,0)")).cast("decimal(38,0)"))
    return rows.withColumns({"pos": F.col("pos").cast("decimal(18,0)"), "nb": F.col("nb").cast("decimal(18,0)"), "open": F.col("open").cast("decimal(18,0)")}).groupBy("ref").agg(met.cast("long").alias("n"), shared.cast("long").alias("shared"))


def _running(flags):
    """How many flags are set before each place, and in all."""
    import numpy as np

    counts = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=counts[1:])
    return counts


def _split(up, starts, *arrays):
    """The rows without a bit before those with it, in their order; blocks stay together, each in two at most. starts: where the blocks begin."""
    import numpy as np

    zeros, order = _running(~up), np.concatenate((np.flatnonzero(~up), np.flatnonzero(up)))
    of = zeros[starts]
    starts = np.concatenate((of, zeros[-1] + starts - of))
    return starts[np.append(starts[1:] != starts[:-1], starts[-1] < len(up))], *(x.take(order) for x in arrays)


def _ordered_pairs(values, given, starts):
    """How many pairs of a given row and another of its block have the lesser value in the other one, by whether the given one comes first or last."""
    import numpy as np

    rows = values * 2 + given
    most = int(rows.max(initial=0))
    rows = rows.astype(np.int32) if most < 1 << 31 else rows
    found = np.zeros(2, np.int64)
    for bit in reversed(range(1, most.bit_length())):
        up, given = (rows & 1 << bit) != 0, (rows & 1) != 0
        above = up & given
        low, high, places = _running(~(up | given)), _running(above), np.append(starts, len(rows))
        begun, highs = low[places].astype(np.int64), np.diff(high[places]).astype(np.int64)
        last = int(low.take(np.flatnonzero(above)).sum(dtype=np.int64)) - int((begun[:-1] * highs).sum())
        found += (int((np.diff(begun) * highs).sum()) - last, last)
        starts, rows = _split(up, starts, rows)
    return found


def _contained_pairs(at, to, given):
    """How many pairs of a given row (at, to) and another one have the other's ``at`` behind it and its ``to`` not behind it, by which one comes first.

    A pair is counted at the first bit in which the two ``at`` differ, with those that reach across it alone.
    """
    import numpy as np

    found, starts, at, to = np.zeros(2, np.int64), np.zeros(1, np.int64), at - at.min(), to - to.min()
    if max(at.max(), to.max()) < 1 << 29:
        at, to = at.astype(np.int32), to.astype(np.int32)
    least, most = -1, int(to.max()) + 1
    for bit in reversed(range(int(at.max()).bit_length())):
        up = (at & 1 << bit) != 0
        x, y = given & ~up, ~given & up
        last, first = np.maximum.reduceat(np.where(x, to, least), starts), np.minimum.reduceat(np.where(y, to, most), starts)
        sizes = np.diff(starts, append=len(at))
        reach = (x & (to >= np.repeat(first, sizes))) | (y & (to <= np.repeat(last, sizes)))
        n = np.diff(_running(reach)[np.append(starts, len(at))])
        first, n = first[n > 0], n[n > 0]
        if len(n):
            reach = np.flatnonzero(reach)
            found += _ordered_pairs(to[reach] + given[reach] - np.repeat(first, n), given[reach], np.cumsum(n) - n)
        starts, at, to, given = _split(up, starts, at, to, given)
    return found


def _small_pairs(p, upto, seen, a, q, ask, gap: int, least: int = 0):
    """Of the pairs of an x (begin p, upto, id) and a y (a, end q, id): those apart by ``gap`` at most and those with a <= p <= q <= upto, each with x's id less and greater.

    The latter are those with p <= q <= upto but for those with p < a; with ``least``, q is that far behind p at least, and all upto and a are.
    """
    import numpy as np

    if not len(p) or not len(q):
        return 0, 0, 0, 0

    def counts(x_first: bool):
        both = (lambda x, y: np.concatenate((x, y))) if x_first else (lambda x, y: np.concatenate((y, x)))
        ids = both(seen, ask)
        order = np.argsort(ids, kind="stable")
        ids, given, one = ids[order], both(np.ones(len(p), bool), np.zeros(len(q), bool))[order], np.zeros(1, np.int64)
        low, size = q.min(), q.max() - q.min() + 1
        before = lambda bound: _ordered_pairs(both(np.clip(bound - low, 0, size), q - low)[order], given, one)
        to = both(upto, q)[order]
        begun = before(p + least)
        found = [begun - before(p - gap) if gap else np.zeros(2, np.int64), before(upto + 1) - begun - _contained_pairs(both(p, a)[order], to, given)]
        # of two that share an id, an interval and itself are never a pair
        twice = (ids[2:] == ids[:-2]).any() or ((ids[1:] == ids[:-1]) & (given[1:] != given[:-1]) & np.where(given[1:], to[:-1] <= to[1:], to[1:] <= to[:-1])).any()
        return found, twice

    found, twice = counts(False)
    other = counts(True)[0] if twice else found
    return tuple(int(n) for x, y in zip(found, other) for n in (x[0], y[1]))


def complementary_pairs(ivals: DataFrame, key: str, ref: str, beg: str, end: str, gap: int, percent: float, tile: int = 1 << 15) -> DataFrame:
    """meets, side, n: how many pairs of a reference's intervals lie apart by ``gap`` at most or share at most a percentage (under 100) of either's length, by
    whether they share any and by the side of the lesser key's interval on which the other one lies.

    Such a pair's intervals begin and end in the same order: the earlier one, y, is counted in the tile of its end, the later one, x, is dealt to all tiles of ends that it can follow.
    Pairs that share more than ``tile`` positions are counted in wider tiles, by the length that they share, so an interval is in few of them however long it is.
    """
    rows = ivals.select(F.col(ref).alias("ref"), F.col(key).alias("id"), F.col(beg).cast("long").alias("lo"), F.col(end).cast("long").alias("hi")).where("lo <= hi AND ref IS NOT NULL AND id IS NOT NULL")
    over: Column = F.floor((F.col("hi") - F.col("lo") + 1) * (percent / 100)) + 2
    wide: Column = F.pow(F.lit(4.0), F.col("k")) * tile
    least = F.when(F.col("k") == 0, -gap).otherwise(wide / 4)
    follows = F.sequence(F.floor((F.col("lo") + least) / wide), F.floor((F.col("lo") + F.least(over, wide)) / wide))
    dealt = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log(4.0, over / tile)).cast("int")))))
    dealt = dealt.withColumn("tile", F.explode(F.array_union(follows, F.array(F.floor(F.col("hi") / wide)))))

    def count(table):
        import numpy as np
        import pyarrow as pa

        k, at = table.column("k")[0].as_py(), table.column("tile")[0].as_py()
        wide, least = tile * 4**k, tile * 4**k // 4 if k else 0
        lo, hi, id_ = (table.column(c).to_numpy() for c in ("lo", "hi", "id"))
        most = np.minimum(_limit(hi - lo + 1, percent, False), wide)
        given = most > least if k else np.ones(len(lo), bool)
        asks = given & (hi // wide == at)
        p, q = lo[given], hi[asks]
        found = _small_pairs(p, p - 1 + most[given], id_[given], q + 1 - most[asks], q, id_[asks], 0 if k else gap, least)
        return pa.table({"meets": np.array([0, 0, 1, 1], np.int32), "side": ["LEFT", "RIGHT"] * 2, "n": np.array(found, np.int64)})

    return dealt.groupBy("ref", "k", "tile").applyInArrow(count, "meets int, side string, n long").groupBy("meets", "side").agg(F.sum("n").alias("n")).where("n > 0")
