import numpy as np
import pytest

from helixframe.operators import density


def parts_of(near):
    """The component of each row of a matrix of what is near."""
    part = np.arange(len(near))
    while True:
        least = np.where(near | np.eye(len(near), dtype=bool), part, len(near)).min(1)
        if (least == part).all():
            return part
        part = least


def brute(x, min_size, samples):
    """Clusters from above: at each height the components of what is nearer, of all pairs."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(samples, n) - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None]).round(9)
    lam = lambda h: 1 / h if h > 0 else 1e12

    def walk(rows, birth):
        """(mass, chosen clusters) of a component that is a cluster from `birth` on."""
        mass, rows, own = 0.0, np.array(rows), list(rows)
        while True:
            sub = m[np.ix_(rows, rows)]
            h = heaviest(sub)
            part = parts_of(sub < h)
            parts = [rows[part == p] for p in np.unique(part)]
            big = [p for p in parts if len(p) >= min_size]
            mass += (len(rows) if len(big) != 1 else len(rows) - len(big[0])) * (lam(h) - birth)
            if len(big) == 1:
                rows = big[0]
                continue
            below = [walk(p, lam(h)) for p in big]
            rest = sum(b[0] for b in below)
            if birth and mass >= rest:
                return mass, [own]
            return rest, [c for b in below for c in b[1]]

    def heaviest(sub):
        levels = np.unique(sub[~np.eye(len(sub), dtype=bool)])
        lo, hi = 0, len(levels) - 1  # the lowest height that joins all
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if not parts_of(sub <= levels[mid]).any() else (mid + 1, hi)
        return levels[lo]

    return {frozenset(int(i) for i in c) for c in walk(np.arange(n), 0.0)[1]} if n >= max(2, min_size) else set()


def clusters(spark, x, most=density.RANGE, **more):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    rows = density.density_clusters(df, "vec_id", "embedding", most=most, **more).collect()
    assert len(rows) == len(x)
    found = {}
    for r in rows:
        found.setdefault(r.cluster, set()).add(r.vec_id)
    found.pop(-1, None)
    assert [min(found[c]) for c in sorted(found)] == sorted(min(f) for f in found.values())
    return {frozenset(f) for f in found.values()}


@pytest.mark.parametrize("most", [density.RANGE, 24])
def test_clusters_are_those_of_all_pairs(spark, most):
    rng = np.random.RandomState(5)
    groups = [rng.normal(c, s, size=(k, 3)) for c, s, k in ((0, 0.4, 60), (2.5, 0.3, 30), (6, 1.0, 40), (6.5, 0.1, 12), (-5, 2.0, 30))]
    x = np.vstack([*groups, np.repeat(rng.normal(9, 1, size=(2, 3)), 30, axis=0), np.repeat(rng.normal(-9, 1, size=(4, 3)), 3, axis=0)])  # with equal rows
    want = brute(x, 5, 5)
    assert len(want) > 5 and clusters(spark, x, most, min_size=5) == want


def test_clusters_of_a_table_beyond_the_former_bound(spark):
    rng = np.random.RandomState(6)
    centres = rng.normal(0, 50, size=(21, 4))
    x = np.vstack([c + rng.normal(0, 0.5, size=(1000, 4)) for c in centres])
    found = clusters(spark, x, most=6000, min_size=300)
    assert len(found) == 21 and all(len({i // 1000 for i in f}) == 1 for f in found)


def test_small_tables_and_null_vectors(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, None), (3, [1.0])], "vec_id long, embedding array<double>")
    for some in (df, df.filter("vec_id = 1"), df.filter("vec_id = 2"), df.limit(0)):
        assert {(r.vec_id, r.cluster) for r in density.density_clusters(some, "vec_id", "embedding").collect()} == {(r.vec_id, -1) for r in some.collect()}
