"""Votes against brute force."""

from collections import Counter

import pytest

from strandline.operators import votes as V


@pytest.mark.parametrize("step", [1 << 21, 40])
def test_winners(step):
    import numpy as np

    rng = np.random.default_rng(7)
    query, s, x = np.sort(rng.integers(0, 40, 150)), rng.integers(-100, 900, 150), rng.integers(-100, 900, 300)
    e, y = s + rng.integers(0, 60, 150), x + rng.integers(0, 300, 300) * rng.integers(0, 2, 300)
    ref, at, name = rng.integers(0, 3, 150), rng.integers(0, 2, 300), rng.integers(0, 9, 300)
    want = {}
    for q in set(query.tolist()):
        n = Counter(int(name[j]) for i in np.flatnonzero(query == q) for j in range(300) if ref[i] == at[j] and s[i] <= y[j] and x[j] <= e[i])
        if n:
            want[q] = min((-v, k) for k, v in n.items())
    got = V._winners(query, s, e, ref, x, y, at, name, 9, step)
    assert {q: (-n, k) for q, k, n in got.T.tolist()} == want and got.shape[1] == len(want)


@pytest.mark.parametrize(("seed", "longest", "spread"), [(k, n, w) for k, (n, w) in enumerate([(30, 400), (30, 4000), (300, 900), (300, 20_000), (5, 60), (1, 30)] * 3)])
def test_best_without_pairs(seed, longest, spread):
    import numpy as np

    rng = np.random.default_rng(seed)
    a, b, names = 300, 2000 if seed % 3 else 150, (3, 40, 400)[seed % 3]
    query, s, x = np.sort(rng.integers(0, (20, 90, 290)[seed // 6], a)), rng.integers(-100, spread, a), rng.integers(-100, spread, b)
    e, y = s + rng.integers(0, 60, a), x + rng.integers(0, longest, b) * rng.integers(0, 2, b)
    e[:2] += 20_000 * (seed % 2)  # far longer than the others
    ref, at, name = rng.integers(0, 3, a), rng.integers(0, 2, b), rng.integers(0, names, b)
    want = V._winners(query, s, e, ref, x, y, at, name, names)
    got = V._best(query, s, e, ref, x, y, at, name, names, step=1 << (20 if seed % 2 else 8))
    assert sorted(got.T.tolist()) == sorted(want.T.tolist()) and got.shape[1] > 10


def test_most_met_over_references(spark):
    import random

    random.seed(5)
    # some names lie on several references, some on one, some are missing
    hits = [(random.choice([1, 2, 3, 4, 5, None]), random.choice(["x", "y", "z", None]), s := random.randrange(500), s + random.randrange(-3, 40)) for _ in range(60)]
    ivals = [(random.choice(["x", "y"]), s := random.randrange(500), s + random.randrange(-3, 60), g) for g in ["a", "b", None] for _ in range(30)] + [("xy"[g % 2], s := random.randrange(500), s + 50, f"g{g}") for g in range(30) for _ in range(4)]
    votes = {}
    for q, r, s, e in hits:
        for c, x, y, g in ivals:
            if r == c and s <= e and x <= y and s <= y and x <= e:
                votes.setdefault(q, Counter())[g] += 1
    want = {q: min((-n, g is None, g or "") for g, n in v.items()) for q, v in votes.items()}
    for more in ([], [("x", 5, 5, "h"), ("x", 6, 6, "h")]):
        for drop in (set(), {"a", "b", None}):
            some = [v for v in ivals + more if v[3] not in drop]
            a, b = spark.createDataFrame(hits, "q long, r string, s long, e long"), spark.createDataFrame(some, "c string, x long, y long, g string")
            got = {v.q: (-v.n, v.g is None, v.g or "") for v in V.most_met(a, b, "q", "g", ("r", "s", "e"), ("c", "x", "y"), share=20).collect()}
            if not drop and not more:
                assert got == want
            else:
                again = {}
                for q, r, s, e in hits:
                    for c, x, y, g in some:
                        if r == c and s <= e and x <= y and s <= y and x <= e:
                            again.setdefault(q, Counter())[g] += 1
                assert got == {q: min((-n, g is None, g or "") for g, n in v.items()) for q, v in again.items()}
