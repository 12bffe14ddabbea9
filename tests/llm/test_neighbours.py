import numpy as np
import pytest

from framecv.llm.neighbours import grow_forest, leaf_of, nearest, search_leaves


def exact(rows, asked, k):
    out = {}
    for q, v in asked:
        scores = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in dict(rows).items() if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_all_leaves_give_the_exact_result(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    same = rng.normal(size=6).astype(np.float32).tolist()
    rows += [(1000 + i, same) for i in range(120)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [float("nan")] + [1.0] * 5), (2005, [float("inf")] + [1.0] * 5), (2006, [1.0, 2.0]),
           (None, [1.0] * 6), rows[5]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id bigint, embedding array<float>, rank int")
    out = nearest(df, df.where("vec_id % 20 = 0 or vec_id >= 2000"), k=8, trees=3, sample_rows=128, leaf=16, visits=10_000, block=64)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got: dict = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(rows, [(i, v) for i, v in rows if i % 20 == 0], 8)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, df.where("vec_id = 2"), k=5).orderBy("rank").collect()]
    assert got == [(2, 1, 1, 0.5), (2, 2, 3, 0.5)]
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_search_takes_the_nearest_leaves_first():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(2000, 8))
    forest = grow_forest(points, 4, 50)
    for tree in forest:
        assert np.bincount(leaf_of(tree, points), minlength=tree.leaves).max() <= 50
    q = points[7]
    sides = [t.normals @ q - t.offsets for t in forest]
    first = search_leaves(forest, sides, 4)
    assert sorted(t for t, _ in first) == [0, 1, 2, 3]  # its own leaf in each tree comes first
    assert all(leaf_of(forest[t], points[7:8])[0] == leaf for t, leaf in first)
    everything = search_leaves(forest, sides, 10 ** 6)
    assert len(everything) == len(set(everything)) == sum(t.leaves for t in forest)


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    if kind == "clustered":
        x = rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)] + 0.4 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = nearest(df, df.where("vec_id % 20 = 0"), k=20, sample_rows=1500, leaf=32).collect()
    found: dict = {}
    for r in out:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    near = x[::20] @ x.T
    near[np.arange(len(near)), np.arange(0, 3000, 20)] = -9
    recall = np.mean([len(found[20 * i] & set(np.argsort(-row)[:20].tolist())) / 20 for i, row in enumerate(near)])
    assert recall >= 0.9
