"""Counts over all pairs against brute force."""

import pytest

from strandline.operators import pair_counts as C


@pytest.mark.parametrize("most,percent,gap", [(40, 60, 30), (40, 85, 0), (3000, 30, 400), (9, 25, 5)])
def test_pair_counts(most, percent, gap):
    import numpy as np

    rng = np.random.default_rng(most + percent)
    for n in (1, 2, 60, 200):
        lo = rng.integers(-most, most * 4, n)
        hi, ids = lo + rng.integers(0, most, n), rng.integers(0, n, n)
        size, near, small = hi - lo + 1, 0, [0, 0, 0, 0]
        for a in range(n):
            for b in range(n):
                shared = min(hi[a], hi[b]) - max(lo[a], lo[b]) + 1
                near += a < b and shared > 0 and shared / size[a] * 100 >= percent and shared / size[b] * 100 >= percent
                if ids[a] < ids[b] and shared > -gap and max(shared, 0) / size[a] * 100 <= percent and max(shared, 0) / size[b] * 100 <= percent:
                    small[2 * (shared > 0) + (lo[a] <= lo[b])] += 1
        assert (C._reciprocal_pairs(lo, hi, np.ones(n, bool), percent) - n) / 2 == near
        limit = C._limit(size, percent, False)
        assert [*C._small_pairs(lo, lo - 1 + limit, ids, hi + 1 - limit, hi, ids, gap)] == small


def test_all_pairs_of_many(spark):
    # 400,000 intervals make eighty thousand million pairs
    rows = spark.range(400_000).selectExpr("id", "'a' AS ref", "id DIV 2 * 10 + id % 2 * 4 AS beg", "id DIV 2 * 10 + id % 2 * 4 + 4 AS e")
    got = C.complementary_pairs(rows, "id", "ref", "beg", "e", 1, 25, tile=1 << 12).collect()
    # [0, 4] and [4, 8] share a fifth; [4, 8] and [10, 14] lie two apart
    assert [tuple(r) for r in got] == [(1, "RIGHT", 200_000)]
    pile = spark.range(400_000).selectExpr("'a' AS ref", "id % 7 AS beg", "id % 7 + 100 AS e")
    assert C.reciprocal_pairs(pile, "ref", "beg", "e", 60).first().n == C.overlapping_pairs(pile, "ref", "beg", "e").first().n == 400_000 * 399_999 // 2


def test_long_intervals_are_in_few_tiles(spark):
    # by narrow tiles alone, each would be in a hundred million of them
    size, rows = 10**12, []
    for k in range(60):
        first, shared = k * 3 * size, (50, 3 * size // 10, size // 2)[k % 3]
        rows += [(2 * k + k % 2, "a", first, first + size - 1), (2 * k + 1 - k % 2, "a", first + size - shared, first + 2 * size - shared - 1)]
    got = C.complementary_pairs(spark.createDataFrame(rows, "id long, ref string, beg long, e long"), "id", "ref", "beg", "e", 5, 40, tile=1 << 12).collect()
    # two of three share 40 % at most, and each second one's ids are turned
    assert {tuple(r) for r in got} == {(1, "RIGHT", 20), (1, "LEFT", 20)}
