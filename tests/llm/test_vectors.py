"""Vector dedup and nearest neighbours against brute force, and their edge cases."""

import math

import numpy as np
import pytest

from doctables.llm import multiindex, permindex

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, v string, cells int"


def frame(spark, rows):
    plain = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "z", 3) for i, v in rows]
    return spark.createDataFrame(plain, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    out = [(i * 2, centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.15, 0.25])) for i in range(500)]
    out += [(2000 + i, rng.normal(size=16)) for i in range(300)]
    out += [(3000 + i, centres[0]) for i in range(200)]  # one very common vector
    out += [(4000, centres[1] * 1e30), (4001, centres[1] * 1e-30)]
    odd = [(5000, None), (5001, []), (5002, np.zeros(16)), (5003, [math.nan] * 16), (5004, [None] + [1.0] * 15), (5005, [math.inf] * 16), (5006, [1.0, 2.0])]
    return out + odd + out[:3] + [(None, centres[2])]


def good(rows):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            seen[i] = np.asarray(v, dtype=np.float32).astype(np.float64)
    ids = np.array(sorted(seen))
    x = np.stack([seen[i] for i in ids])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return ids, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_links_equal_brute_force(spark, rows):
    got = multiindex.near_vectors(frame(spark, rows), block=64).collect()
    ids, x = good(rows)
    near = x @ x.T >= 0.9
    component = ids.copy()
    while True:
        lower = np.array([component[near[i]].min() for i in range(len(ids))])
        if (lower == component).all():
            break
        component = lower
    links = dict(zip(ids.tolist(), (near.sum(axis=1) - 1).tolist()))
    of = dict(zip(ids.tolist(), component.tolist()))
    assert len(got) == len(rows)
    agree = 0
    for r in got:
        assert r.n_links <= links.get(r.vec_id, 0)
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
        agree += (r.n_links, r.component_id) == (links.get(r.vec_id, 0), of.get(r.vec_id, r.vec_id))
    assert agree >= 0.97 * len(got)
    assert sum(r.n_links for r in got if r.vec_id in links) >= 0.99 * sum(links[r.vec_id] for r in got if r.vec_id in links)


def test_links_of_few_rows(spark):
    assert multiindex.near_vectors(frame(spark, [])).collect() == []
    got = multiindex.near_vectors(frame(spark, [(5, None), (6, [0.0])])).collect()
    assert sorted(map(tuple, got)) == [(5, 0, 5, True), (6, 0, 6, True)]
    got = multiindex.near_vectors(frame(spark, [(5, [2.0]), (6, [1.0]), (7, [-1.0])])).collect()
    assert sorted(map(tuple, got)) == [(5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]


def test_walk_gives_the_nearest_cells():
    rng = np.random.default_rng(0)
    grid = multiindex.Grid(rng.normal(size=(5, 4)), rng.normal(size=(7, 4)))
    units = rng.normal(size=(20, 8))
    first, second = grid.excess(units)
    for v, cells in enumerate(grid.visits(units, 1.5)):
        sums = (first[v][:, None] ** 2 + second[v][None, :] ** 2).ravel()
        assert set(cells.tolist()) == set(np.flatnonzero(sums <= 1.5**2).tolist())
        assert (np.diff(sums[cells]) >= 0).all() and cells[0] == grid.home(units)[v]


def test_nearest_recall_scores_and_order(spark, rows):
    vectors = frame(spark, rows)
    got = permindex.nearest(vectors, vectors.filter("vec_id % 10 = 0"), block=128).collect()
    ids, x = good(rows)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in [i for i in ids.tolist() if i % 10 == 0]:
        at = int(np.searchsorted(ids, q))
        scores = x @ x[at]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 6)) and q not in [m[1] for m in mine]
        assert all(abs(m[2] - scores[np.searchsorted(ids, m[1])]) < 1e-12 for m in mine)
        assert all(a[2] > b[2] - 1e-12 for a, b in zip(mine, mine[1:]))
        scores[at] = -9
        fifth = np.sort(scores)[-5]
        hits, total = hits + sum(m[2] >= fifth - 1e-12 for m in mine), total + 5
    assert hits >= 0.9 * total
    assert set(found) == {i for i in ids.tolist() if i % 10 == 0}


def test_nearest_of_few_rows(spark):
    none = frame(spark, [])
    assert permindex.nearest(none, none).collect() == []
    some = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)])
    got = permindex.nearest(some, some.filter("vec_id in (0, 4)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_beside_many_near_copies(spark, clustered):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(9000, 64))
    if clustered:
        x = rng.normal(size=(300, 64))[rng.integers(300, size=9000)] + 0.4 * x
    x[:3000] = rng.normal(size=64) + 0.15 * rng.normal(size=(3000, 64))
    x = x.astype(np.float32).astype(np.float64)
    asked = np.arange(0, 9000, 60)
    vectors = spark.createDataFrame(list(zip(range(9000), x.tolist())), "vec_id long, embedding array<double>")
    found = {}
    for r in permindex.nearest(vectors, vectors.filter("vec_id % 60 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = units[asked] @ units.T
    scores[np.arange(len(asked)), asked] = -9
    hits = [len(found[int(q)] & set(np.argsort(-row)[:5].tolist())) / 5 for q, row in zip(asked, scores)]
    inside = asked < 3000
    assert np.mean(np.array(hits)[inside]) >= 0.9 and np.mean(np.array(hits)[~inside]) >= 0.9


@pytest.mark.parametrize("sample", [multiindex.SAMPLE, 600])
@pytest.mark.parametrize("hot", [0, 1500])
def test_rare_links_are_found(spark, hot, sample):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(200, 64))
    off -= (off * x[:200]).sum(axis=1, keepdims=True) * x[:200]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosines = rng.uniform(0.905, 0.95, size=(200, 1))
    x = np.vstack([x, cosines * x[:200] + np.sqrt(1 - cosines**2) * off, rng.normal(size=64) + 0.05 * rng.normal(size=(hot, 64))])
    vectors = spark.createDataFrame(list(zip(range(len(x)), x.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in multiindex.near_vectors(vectors, sample=sample).collect()}
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (units @ units.T >= 0.9).sum(axis=1) - 1
    assert links[:200].min() >= 1
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert all(got[4000 + i].component_id == i and not got[4000 + i].kept for i in range(200))


def test_footrule_equals_the_sum_over_pivots():
    rng = np.random.default_rng(5)
    orders = np.stack([rng.permutation(9)[:6] for _ in range(30)]).astype(np.uint16)
    index = permindex.Orders(orders, 9, 3)
    for own in orders[:5]:
        places = [{p: i for i, p in enumerate(o)} for o in orders.tolist()]
        mine = {p: i for i, p in enumerate(own.tolist())}
        plain = [sum(abs(mine.get(p, 6) - other.get(p, 6)) for p in range(9)) for other in places]
        assert index.footrule(own, np.arange(30)).tolist() == plain
        first = [next((i for i, p in enumerate(own[:3].tolist()) if p in o[:3]), 3) for o in orders.tolist()]
        assert index.sharing(own).tolist() == first


def test_vectors_of_two_lengths(spark):
    rows = [(i, [1.0, i / 100]) for i in range(8)] + [(100 + i, [1.0, i / 100, 0.0]) for i in range(4)] + [(200, [1.0])]
    got = {r.vec_id: tuple(r)[1:] for r in multiindex.near_vectors(frame(spark, rows)).collect()}
    assert got == {
        **{i: (7, 0, i == 0) for i in range(8)}, **{100 + i: (3, 100, i == 0) for i in range(4)}, 200: (0, 200, True)
    }
    vectors = frame(spark, rows)
    found = permindex.nearest(vectors, vectors.filter("vec_id in (0, 100, 200)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found)] == [(0, i, i) for i in range(1, 6)] + [(100, i, 100 + i) for i in range(1, 4)]


@pytest.mark.parametrize("kind", ["plain", "hot"])
def test_few_vectors_are_scored(spark, kind, monkeypatch):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(9000, 64))
    if kind == "hot":
        x[:3000] = rng.normal(size=64) + 0.35 * rng.normal(size=(3000, 64))
    vectors = spark.createDataFrame(list(zip(range(9000), x.tolist())), "vec_id long, embedding array<double>")
    used = []
    plain = permindex._needed
    monkeypatch.setattr(permindex, "_needed", lambda *args: used.append(plain(*args)) or used[-1])
    found = {}
    for r in permindex.nearest(vectors, vectors.filter("vec_id % 60 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, 9000, 60):
        scores = units @ units[q]
        scores[q] = -9
        hits.append(len(found[q] & set(np.argsort(-scores)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.9
    # a query scores about as large a share of all vectors as it passes of the sample
    assert used[0][1] <= 0.1 * permindex.SAMPLE
