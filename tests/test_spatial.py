import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ecospark.operators import spatial

RNG = np.random.default_rng(7)
SHAPES = {
    "uniform": RNG.random((150, 2)),
    "clustered": np.vstack([RNG.normal(0, 1e-3, (80, 2)), RNG.normal(5, 0.5, (40, 2)), RNG.random((20, 2)) * 20]),
    "line": np.column_stack([np.linspace(0, 1, 40), np.zeros(40)]),
    "lattice": np.array([[i % 7, i // 7] for i in range(49)], float),
    "stray": np.vstack([RNG.random((90, 2)) * 1e-3, [[1e4, 1e4]]]),
}


def frame(spark, p, v=None):
    pdf = pd.DataFrame({"id": range(len(p)), "x": p[:, 0], "y": p[:, 1]})
    if v is not None:
        pdf["v"] = v
    return spark.createDataFrame(pdf)


def square(p):
    return ((p[:, None] - p[None]) ** 2).sum(-1)


def gabriel(p):
    d2, out = square(p), set()
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            s = d2[i] + d2[j]
            s[[i, j]] = np.inf
            if not (s < d2[i, j]).any():
                out.add((i, j))
    return out


@pytest.mark.parametrize("shape", SHAPES)
def test_gabriel_equals_brute_force(spark, shape):
    p = SHAPES[shape]
    got = {(r.src, r.dst) for r in spatial.gabriel_edges(frame(spark, p)).collect()}
    assert got == gabriel(p)


@pytest.mark.parametrize("shape", SHAPES)
def test_knn_equals_brute_force(spark, shape):
    p = SHAPES[shape]
    d2 = square(p)
    np.fill_diagonal(d2, np.inf)
    got = spatial.knn_edges(frame(spark, p), 3).toPandas()
    assert len(got) == 3 * len(p)
    want = np.sort(np.sqrt(d2), axis=1)[:, :3]
    have = np.array(got.sort_values(["src", "d"])["d"]).reshape(len(p), 3)
    np.testing.assert_allclose(have, want)


def moran_numpy(w, z):
    """Moran's I and its one-sided randomisation p-value from a dense weight matrix."""
    n = len(z)
    z = z - z.mean()
    s0, s1 = w.sum(), ((w + w.T) ** 2).sum() / 2
    s2 = ((w.sum(1) + w.sum(0)) ** 2).sum()
    i = n * (z @ w @ z) / (s0 * (z**2).sum())
    b2 = n * (z**4).sum() / (z**2).sum() ** 2
    e = -1 / (n - 1)
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / (
        (n - 1) * (n - 2) * (n - 3) * s0**2
    ) - e * e
    return i, 0.5 * math.erfc((i - e) / math.sqrt(2 * var))


def test_moran(spark):
    p = SHAPES["uniform"]
    v = p[:, 0] + RNG.normal(0, 0.3, len(p))
    df = frame(spark, p, v)
    edges = spatial.gabriel_edges(df)
    w = np.zeros((len(p), len(p)))
    for r in edges.collect():
        w[r.src, r.dst] = w[r.dst, r.src] = 1
    i, pval = moran_numpy(w, v)
    got = spatial.moran(df, edges, "v").head()
    assert got.i == pytest.approx(i) and got.p == pytest.approx(pval, rel=1e-6, abs=1e-12)


def test_isolated_site_is_left_out_of_n(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0), (4, 8.0), (5, 9.0)], "id long, v double")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    got = spatial.moran(df, edges, "v").head()
    assert got.n == 4 and got.s0 == 6.0 and got.expected == pytest.approx(-1 / 3)


@pytest.mark.parametrize("shape", ["uniform", "clustered"])
def test_correlogram_equals_dense_classes(spark, shape, monkeypatch):
    p = SHAPES[shape]
    v = p[:, 0] + RNG.normal(0, 0.5, len(p))
    d = np.sqrt(square(p))
    upper = d[np.triu_indices(len(p), 1)]
    k = math.ceil(math.log2(len(upper)) + 1)
    width = (upper.max() - upper.min()) / k
    cls = np.clip(np.ceil((d - upper.min()) / width), 1, k)
    np.fill_diagonal(cls, 0)
    got = {r["class"]: r for r in spatial.correlogram(frame(spark, p, v), "v").collect()}
    for c in range(1, k + 1):
        w = (cls == c).astype(float)
        keep = w.sum(1) > 0
        if not keep.any():
            assert c not in got
            continue
        w = w[keep][:, keep]
        assert got[c].pairs == w.sum() / 2
        if keep.sum() > 3:
            i, pval = moran_numpy(w / w.sum(1, keepdims=True), v[keep])
            assert got[c].i == pytest.approx(i, abs=1e-9)
            assert got[c].p == pytest.approx(pval, rel=1e-5, abs=1e-10)


def test_correlogram_with_deeper_grids(spark):
    p = RNG.random((1200, 2))
    got = spatial.correlogram(frame(spark, p, p[:, 0]), "v", classes=8)
    assert sum(r.pairs for r in got.collect()) == 1200 * 1199 / 2


def test_diameter(spark):
    for p in SHAPES.values():
        assert spatial.diameter(frame(spark, p).repartition(5)) == pytest.approx(math.sqrt(square(p).max()))


def test_duplicate_locations_keep_the_smallest_id(spark):
    df = spark.createDataFrame([(3, 1.0, 1.0), (2, 1.0, 1.0), (9, 0.0, 0.0)], "id long, x double, y double")
    assert {r.id for r in spatial.points_of(df, "id", "x", "y").collect()} == {2, 9}


def test_diameter_takes_hulls_in_parallel(spark):
    def place(batches):
        from pyspark import TaskContext
        for pdf in batches:
            yield pdf.assign(x=float(TaskContext.get().partitionId()), y=0.0)[["x", "y"]]

    points = spark.range(0, 40, 1, 4).mapInPandas(place, "x double, y double")
    assert spatial.diameter(points) == 3.0


def test_equal_distances_are_one_class(spark):
    triangle = np.array([[0.0, 0.0], [4.0, 0.0], [2.0, 1.0]])
    two = spatial.correlogram(frame(spark, triangle[:2], np.array([1.0, 2.0])), "v").collect()
    assert [(r["class"], r["pairs"], r["lo"], r["hi"]) for r in two] == [(1, 1, 4.0, 4.0)]
    assert spatial.correlogram(frame(spark, triangle[:1], np.array([1.0])), "v").collect() == []


def test_radius_zero_gives_coincident_points(spark):
    df = spark.createDataFrame([(3, 1.0, 1.0), (2, 1.0, 1.0), (9, 0.0, 0.0)], "id long, x double, y double")
    assert [tuple(r) for r in spatial.band_edges(df, 0.0).collect()] == [(2, 3, 0.0)]


def test_pairs_of_cells_cover_every_pair_once(spark):
    for n in (5, 700):
        points = np.random.default_rng(n).random((n, 2))
        points[0] = 1000.0  # a stray point crowds no cell
        levels = spatial.packed_tree(frame(spark, points), "id")
        met, left = spatial.class_pairs(levels, lambda d: F.ceil(d * 10).cast("int"), leaf=1)
        rows = [r for p in met for r in p.where("a <> b").selectExpr("count(*)", "coalesce(sum(a_cnt * b_cnt), 0)").collect()]
        own = sum(r[0] or 0 for p in met for r in p.where("a = b").selectExpr("sum(a_cnt * (a_cnt - 1) div 2)").collect())
        cnt = {r["cell"]: r["cnt"] for r in levels[1].collect()}
        open_ = [(r["a"], r["b"]) for r in left.collect()]
        covered = sum(cnt[a] * (cnt[a] - 1) // 2 if a == b else cnt[a] * cnt[b] for a, b in open_)
        assert sum(r[1] for r in rows) + own + covered == n * (n - 1) / 2
        assert sum(r[0] for r in rows) + len(open_) <= len(cnt) * (len(cnt) + 1) / 2  # no more than all pairs of leaves


def shorelines(n):
    side = np.sort(np.random.default_rng(n).random(n))
    return np.vstack([np.column_stack([side, np.zeros(n)]), np.column_stack([side[::-1], np.full(n, 0.3)])])


def test_gabriel_across_empty_space(spark):
    p = shorelines(60)
    assert {(r.src, r.dst) for r in spatial.gabriel_edges(frame(spark, p)).collect()} == gabriel(p)


def test_gabriel_builds_no_table_in_the_driver(spark, monkeypatch):
    """Pairs look small in files; only levels of up to SENT cells may be broadcast, here none."""
    p, plans = shorelines(40), []
    levels = spatial.packed_tree(spatial.points_of(frame(spark, p), "id", "x", "y"), "x")
    write = spatial.checkpointed

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(spatial, "SENT", 0, raising=False)
    monkeypatch.setattr(spatial, "packed_tree", lambda points, value: levels)
    monkeypatch.setattr(spatial, "checkpointed", planned)
    edges = spatial.gabriel_edges(frame(spark, p))
    assert {(r.src, r.dst) for r in edges.collect()} == gabriel(p)
    plans.append(edges._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [plan for plan in plans if "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan]


@pytest.mark.parametrize("search", ["gabriel", "knn"])
@pytest.mark.parametrize("shape", ["uniform", "shorelines"])
def test_rows_of_a_search_grow_with_the_points(spark, search, shape, monkeypatch):
    rows = []
    write = spatial.checkpointed

    def counted(df):
        done = write(df)
        rows.append(done.count())
        return done

    monkeypatch.setattr(spatial, "checkpointed", counted)
    made = []
    for n in (256, 1024):
        rows.clear()
        p = np.random.default_rng(n).random((n, 2)) if shape == "uniform" else shorelines(n // 2)
        edges = spatial.gabriel_edges(frame(spark, p)) if search == "gabriel" else spatial.knn_edges(frame(spark, p), 5)
        assert edges.count() >= n - 1
        made.append(sum(rows))
    assert made[1] < 6 * made[0]  # four times the points; all pairs would be sixteen times


def test_searches_of_few_points(spark):
    none = frame(spark, np.zeros((1, 2))).where("id < 0")
    one = frame(spark, np.zeros((1, 2)))
    two = frame(spark, np.array([[0.0, 0.0], [3.0, 4.0]]))
    for few in (none, one):
        assert spatial.gabriel_edges(few).collect() == [] and spatial.knn_edges(few, 3).collect() == []
    assert [tuple(r) for r in spatial.gabriel_edges(two).collect()] == [(0, 1, 5.0)]
    assert sorted(tuple(r) for r in spatial.knn_edges(two, 3).collect()) == [(0, 1, 5.0), (1, 0, 5.0)]


def block(p, cells, ids=(0, 0)):
    n = len(p)
    return pa.table({"a": np.full(n, ids[0]), "b": np.full(n, ids[1]), "cell": cells, "x_lo": p[:, 0], "y_lo": p[:, 1], "s": cells * 0.5})


@pytest.mark.parametrize("shape", ["uniform", "lattice", "stray"])
def test_blocks_hand_over_what_all_pairs_would(shape, monkeypatch):
    p = SHAPES[shape]
    compared = []
    weighted = spatial._weighted
    monkeypatch.setattr(spatial, "_weighted", lambda met, values: compared.append(met.size) or weighted(met, values))
    d = np.sqrt(square(p))
    lo, hi, k = d[d > 0].min(), d.max(), 6
    cls = np.clip(np.ceil((d - lo) / ((hi - lo) / k)), 1, k).astype(int)
    np.fill_diagonal(cls, 0)
    pairwise = spatial._Classes(lo, (hi - lo) / k, k, piece=8, wide=3)
    half, cells = len(p) // 2, np.arange(len(p))
    one, two = cells[:half], cells[half:]
    for a, b, ids in ((one, two, (0, 1)), (one[::-1], one[::-1], (0, 0))):
        got = {(r["cell"], r["class"]): (r["cnt"], r["sv"]) for r in pairwise.counts(block(p[a], a, ids), block(p[b], b, ids)).to_pylist()}
        want = {}
        for x, other in ((a, b), (b, a)):
            for i in x:
                for c in range(1, k + 1):
                    met = other[cls[i, other] == c]
                    if len(met):
                        want[i, c] = (len(met), pytest.approx(met.sum() * 0.5))
        assert got == want
    assert compared


def test_pieces_of_one_class_are_not_compared(monkeypatch):
    compared = []
    weighted = spatial._weighted
    monkeypatch.setattr(spatial, "_weighted", lambda met, values: compared.append(met.size) or weighted(met, values))
    side = np.arange(32) / 32
    p = np.array([(x + i / 8, y + j / 8) for x in side[::8] for y in side[::8] for i in range(2) for j in range(2)])
    p = np.vstack([p, p + [50.0, 0.0]])
    cells, n = np.arange(len(p)), len(p) // 2
    pairwise = spatial._Classes(0.0, 10.0, 6, piece=8, wide=2)
    out = pairwise.counts(block(p[:n], cells[:n], (0, 1)), block(p[n:], cells[n:], (0, 1)))
    assert sum(out["cnt"].to_pylist()) == 2 * n * n
    assert sum(compared) < 2 * 2 * n * n  # two classes and both sides would be four times all pairs


def test_pairs_left_carry_the_few_classes_between_them(spark):
    levels = spatial.packed_tree(frame(spark, np.random.default_rng(3).random((700, 2))), "id")
    _, left = spatial.class_pairs(levels, lambda d: F.ceil(d * 20).cast("int"), leaf=1)
    least, mean = left.selectExpr("min(high - low)", "avg(high - low + 1)").head()
    assert least >= 1 and mean < 15  # of 29 classes
