"""The neighbour search leaves out what boxes rule out, and finds what a plain search finds."""

import numpy as np

from huntlake.operators import knn


def plain(x, donors, k):
    dist = knn._distances(x, donors)
    at = np.argsort(dist, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(dist, at, 1)
    return near, np.where(np.isfinite(near), at, -1)


def test_nearest_equals_plain_search_and_measures_few_pairs(monkeypatch):
    draw = np.random.default_rng(3)
    donors = draw.integers(0, 1000, (20_000, 4)).astype(float)
    x = draw.integers(0, 1000, (50, 4)).astype(float)
    x[::3, 2] = np.nan
    want, measured = plain(x, donors, 5), []
    distances = knn._distances
    monkeypatch.setattr(knn, "_distances", lambda a, b: measured.append(len(a) * len(b)) or distances(a, b))
    got = knn.nearest(x, np.full(len(x), np.inf), donors, 5)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert sum(measured) < len(x) * len(donors) / 5


def test_nearest_with_gaps_ties_infinities_and_a_radius():
    draw = np.random.default_rng(4)
    donors = draw.integers(0, 4, (1500, 5)).astype(float)
    x = draw.integers(0, 4, (200, 5)).astype(float)
    donors[draw.random(donors.shape) < 0.2], x[draw.random(x.shape) < 0.3] = np.nan, np.nan
    donors[:20, 1], x[:5, 1] = np.inf, np.inf
    with np.errstate(invalid="ignore"):
        want, got = plain(x, donors, 5), knn.nearest(x, np.full(len(x), np.inf), donors, 5)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        assert (knn.nearest(x, want[0][:, 2], donors, 5)[1][:, :3] == want[1][:, :3]).all()


def test_cells_and_leaves_give_what_brute_force_gives(spark):
    draw = np.random.default_rng(5)
    x = draw.integers(0, 40, (900, 4)).astype(float)
    x[draw.random(x.shape) < 0.1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    out = {r[0]: r[1:] for r in knn.impute_knn(spark.createDataFrame(rows, "id int, a double, b double, c double, d double"), list("abcd"), "id", 3, 40).collect()}
    vectors, first, times = np.unique(np.nan_to_num(x, nan=-1), axis=0, return_index=True, return_counts=True)
    order = np.argsort(first)
    donors, times = x[first[order]], times[order]
    for i, j in zip(*np.nonzero(np.isnan(x) & ~np.isnan(x).all(1)[:, None])):
        has = np.flatnonzero(~np.isnan(donors[:, j]))
        dist = knn._distances(x[i:i + 1], donors[has])[0]
        near = has[np.argsort(dist, kind="stable")][:3]
        assert abs(out[i][j] - np.repeat(donors[near, j], times[near])[:3].mean()) < 1e-9
