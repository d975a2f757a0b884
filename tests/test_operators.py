"""Operators against brute force on small, awkward inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseloom.functions import scalars
from pulseloom.operators import deltas, embeddings, evaluate, graph, kernels, labels, models, netfeatures, propagation, samples, splits, tsfeatures, windows

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


@pytest.mark.parametrize("width, step", [(90, 30), (30, 30), (10, 3), (7, 10)])
def test_windows_match_a_range_join(spark, width, step):
    rows = [("a", day(n)) for n in (0, 1, 2, 29, 30, 31, 59, 60, 90, 91, 119, 120, 150, 200)] + [("b", day(5)), ("c", day(0)), ("c", day(width))]
    df = spark.createDataFrame(rows, "hashtag string, date date")
    want = set()
    for tag in "abc":
        days = [d for t, d in rows if t == tag]
        end = min(days) + dt.timedelta(days=width)
        while end <= max(days):
            want |= {(tag, d, end) for d in days if end - dt.timedelta(days=width) < d <= end}
            end += dt.timedelta(days=step)
    got = {tuple(r) for r in windows.assign_windows(df, width, step).select("hashtag", "date", "window_end").collect()}
    assert got == want


def test_exposures_and_edges_on_awkward_rows(spark):
    posts = spark.createDataFrame([("p1", "s1", "ann", "Cats", 1000), ("p1", "s1", "ann", "dogs", 1000), ("p2", "s2", "bob", "cats", 9000), ("p3", "s3", "cy", "cats", 500)], "post_id string, shortcode string, author string, hashtag string, post_epoch long")
    comments = spark.createDataFrame([("p1", "s1", "ann", None, 1500), ("p1", "s1", "ann", "ann", 1500), ("p1", "s1", "ann", "bob", 1500), ("p1", "s1", "ann", "bob", 1500), ("p1", "s1", "ann", "cy", 99_999_999), ("p1", "other", "ann", "bob", 1)], "post_id string, shortcode string, author string, commenter string, comment_epoch long")
    lower = posts.withColumn("hashtag", F.lower("hashtag"))
    out = propagation.comment_exposures(lower, comments, 1).collect()
    assert sorted((r.hashtag, r.B, r.exposure_epoch) for r in out) == [("cats", "bob", 1500)] * 2 + [("cats", "cy", 4600)] + [("dogs", "bob", 1500)] * 2 + [("dogs", "cy", 4600)]
    assert {r.exposure_epoch for r in propagation.comment_exposures(lower, comments, 0).collect()} == {1000}
    edges = propagation.propagation_edges(propagation.comment_exposures(lower, comments), propagation.first_adoption(posts)).collect()
    assert [(r.A, r.B, r.first_exposure_epoch, r.B_adopt_epoch) for r in edges] == [("ann", "bob", 1500, 9000)]


def brute_segmentation(v, penalty, min_size, jump):
    n = len(v)
    cuts = [0, *[t for t in range(jump, n, jump) if t >= min_size], n]
    best = {0: (0.0, [])}
    for t in cuts[1:]:
        options = [(best[a][0] + ((v[a:t] - v[a:t].mean()) ** 2).sum() + penalty, a) for a in cuts if a < t and t - a >= min_size and a in best]
        if options:
            c, a = min(options)
            best[t] = (c, best[a][1] + [t])
    return best[n][0] - penalty, best[n][1][:-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=15, max_size=60), st.sampled_from([(7, 5), (2, 1), (3, 4)]), st.sampled_from([1.0, 5.0, 30.0]))
def test_pelt_is_optimal(values, shape, penalty):
    v = np.array(values, float)
    want, _ = brute_segmentation(v, penalty, *shape)
    at = labels.pelt(v, penalty, *shape)
    edges = [0, *at, len(v)]
    cost = sum(((v[a:b] - v[a:b].mean()) ** 2).sum() for a, b in zip(edges[:-1], edges[1:], strict=True)) + penalty * len(at)
    assert abs(cost - want) < 1e-6 and all(b - a >= shape[0] for a, b in zip(edges[:-1], edges[1:], strict=True))


def test_change_points_and_short_series(spark):
    rows = [("a", day(i), 1 if i < 40 else 20) for i in range(80)] + [("b", day(i), i) for i in range(14)] + [("c", day(i), 5) for i in range(40)]
    out = labels.change_points(spark.createDataFrame(rows, "hashtag string, date date, v int"), "v").collect()
    assert [(r.hashtag, r.cp_date) for r in out] == [("a", day(40))]


def test_burst_from_zero_has_an_infinite_ratio(spark):
    means = spark.createDataFrame([("a", day(60), day(30), 30, 50.0, 0.0), ("a", day(90), day(60), 30, 55.0, 50.0)], "hashtag string, window_end date, window_start date, n_rows int, mean_now double, mean_before double")
    cps = spark.createDataFrame([("a", day(30)), ("a", day(60)), ("a", day(61))], "hashtag string, cp_date date")
    out = {r.window_end: r for r in labels.burst_labels(means, cps, "mentions").collect()}
    assert out[day(60)].label_mentions == 1 and math.isinf(out[day(60)].jump_ratio_mentions)
    assert out[day(90)].label_mentions == 0 and out[day(90)].has_cp_inside_boundary_mentions


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=30), st.sampled_from([0.5, 1.0, 2.0]))
def test_peak_count(values, prominence):
    v, n, found = np.array(values, float), len(values), 0
    i = 1
    while i < n - 1:
        j = i
        while j + 1 < n and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j + 1 < n and v[j + 1] < v[i]:
            left, right = [k for k in range(i) if v[k] > v[i]], [k for k in range(j + 1, n) if v[k] > v[i]]
            low_l, low_r = v[(max(left) + 1 if left else 0) : i + 1].min(), v[j : (min(right) if right else n)].min()
            found += v[i] - max(low_l, low_r) >= prominence
        i = j + 1
    assert tsfeatures.peak_count(v, prominence) == found


def ring(n, size, extra):
    u, v = [], []
    for c in range(n):
        base = c * size
        for i in range(size):
            for j in range(i + 1, size):
                u.append(base + i)
                v.append(base + j)
    for a, b in extra:
        u.append(a)
        v.append(b)
    return np.array(u), np.array(v), np.ones(len(u))


def test_communities_find_cliques():
    u, v, w = ring(4, 6, [(0, 6), (6, 12), (12, 18), (18, 0)])
    want = [i // 6 for i in range(24)]
    assert kernels.louvain_labels(24, u, v, w) == want
    label, length = kernels.infomap_labels(24, u, v, w)
    assert label == want
    adj = kernels._adjacency(24, u, v, w)
    assert length < kernels.map_equation(24, adj, [0] * 24) and length < kernels.map_equation(24, adj, list(range(24)))


def test_spectral_row_and_lanczos():
    u, v, w = ring(1, 8, [])
    row = kernels.spectral_row(10, np.r_[u, 8], np.r_[v, 9], np.r_[w, 1.0])
    assert row["n_lcc"] == [8] and row["n_zero"] == [2] and row["lambda2_full"] == [0.0]
    assert abs(row["lambda2"][0] - 8 / 7) < 1e-9 and abs(row["frobenius"][0] ** 2 - 7 * (8 / 7) ** 2) < 1e-9
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 60, 300), rng.integers(0, 60, 300)
    keep = u != v
    u, v, w = u[keep], v[keep], np.ones(keep.sum())
    exact = np.linalg.eigvalsh(kernels._dense_laplacian(60, u, v, w))
    values, vectors = kernels.extremes(60, u, v, w, dense=0)
    assert np.allclose(values, np.r_[exact[:7], exact[-3:]], atol=1e-6)
    assert np.allclose(kernels._dense_laplacian(60, u, v, w) @ vectors, vectors * values, atol=1e-6)


def test_spectral_row_is_the_same_above_the_dense_size():
    rng = np.random.default_rng(1)
    u, v = np.r_[np.arange(1599), rng.integers(0, 1600, 4000)], np.r_[np.arange(1, 1600), rng.integers(0, 1600, 4000)]
    keep = u != v
    u, v = u[keep], v[keep]
    w = rng.random(len(u)) + 0.5
    large, exact = kernels.spectral_row(1600, u, v, w), kernels.spectral_row(1600, u, v, w, dense=1600)
    assert all(abs(large[c][0] - exact[c][0]) < 1e-5 for c in kernels.SPECTRAL)
    # A star of stars has eigenvalues of high multiplicity.
    u, v = np.r_[np.zeros(40, int), np.repeat(np.arange(1, 41), 40)], np.arange(1, 1641)
    large, exact = kernels.spectral_row(1641, u, v, np.ones(1640)), kernels.spectral_row(1641, u, v, np.ones(1640), dense=1641)
    assert all(abs(large[c][0] - exact[c][0]) < 1e-5 for c in kernels.SPECTRAL if not c.startswith("ipr"))


def test_eigenvalues_solve_the_small_problem_rarely(monkeypatch):
    """A basis of some 40 blocks: a dense solve at each of them costs more than the basis itself."""
    at = np.arange(1640).reshape(40, 41)
    u, v = np.r_[at[:, :-1].ravel(), at[:-1].ravel()], np.r_[at[:, 1:].ravel(), at[1:].ravel()]
    w, solve, sizes = np.ones(len(u)), np.linalg.eigh, []
    exact = np.linalg.eigvalsh(kernels._dense_laplacian(1640, u, v, w))
    monkeypatch.setattr(np.linalg, "eigh", lambda x: sizes.append(len(x)) or solve(x))
    values, _ = kernels.extremes(1640, u, v, w)
    assert np.allclose(values, np.r_[exact[:7], exact[-3:]], atol=1e-6)
    assert sizes[-1] >= 200 and len(sizes) < sizes[-1] // 10 * 0.7


def test_spectra_of_large_sparse_graphs_need_few_products(monkeypatch):
    """Eigenvalues that crowd at both ends: a basis of the Laplacian itself takes some hundred products."""
    rng = np.random.default_rng(2)
    n = 2300
    u, v = np.r_[(np.arange(1, n) * rng.random(n - 1)).astype(int), rng.integers(0, n, 600)], np.r_[np.arange(1, n), rng.integers(0, n, 600)]
    w = rng.random(len(u)) + 0.5
    exact, solved = np.linalg.eigvalsh(kernels._dense_laplacian(n, u, v, w)), []
    inner = kernels.times_adjacency

    def counted(*args):
        product = inner(*args)
        return lambda y: solved.append(1) or product(y)

    monkeypatch.setattr(kernels, "times_adjacency", counted)
    values, vectors = kernels.extremes(n, u, v, w)
    assert np.allclose(values, np.r_[exact[:7], exact[-3:]], atol=1e-9) and len(solved) < 40
    assert np.allclose(kernels._dense_laplacian(n, u, v, w) @ vectors, vectors * values, atol=1e-6)


def test_elimination_solves_loops_parallel_edges_and_refuses_dense_graphs():
    rng = np.random.default_rng(3)
    n = 400
    u, v = np.r_[np.zeros(50, int), np.arange(n - 1), rng.integers(0, n, 60)], np.r_[np.arange(1, 51), np.arange(1, n), rng.integers(0, n, 60)]
    x, keep = rng.random(len(u)), u != v
    u, v, x = u[keep], v[keep], x[keep]
    a = np.zeros((n, n))
    np.add.at(a, (np.r_[u, v], np.r_[v, u]), np.r_[x, x])
    d, y = a.sum(1) + 0.1, rng.normal(size=(n, 3))
    args = (n, np.r_[u, v], np.r_[v, u], np.outer(np.r_[x, x], [-1, 1]), np.c_[d, d])
    for sign, solve in zip((-1, 1), kernels.eliminate(*args, small=20), strict=True):
        assert np.allclose((np.diag(d) + sign * a) @ solve(y), y, atol=1e-8)
    assert kernels.eliminate(*args, small=20, most=5) is None


def test_spectral_features_in_a_task_equal_the_joins(spark):
    rng = np.random.default_rng(8)
    rows = [("t", day(90 * k), f"u{a}", f"u{b}", 1 + a % 3, 5) for k in (0, 2, 3) for a, b in sorted({(a, b) for a, b in rng.integers(0, 14 + k, (26, 2)).tolist() if a != b})]
    rows += [("t", day(90), "x", "y", 1, 5), ("s", day(90), "x", "z", 1, 5), ("s", day(90), "y", "z", 2, 5)]  # windows without one projection or both
    df = spark.createDataFrame(rows, "hashtag string, window_end date, source string, target string, weight long, first_exposure_epoch long")
    want = kernels.spectral_features({"bip": df, "proj_a": graph.count_projection(df, "A"), "proj_b": graph.count_projection(df, "B")})
    own = kernels.window_spectral_features(df)
    assert own.dtypes == want.dtypes and "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    order = lambda d: sorted((tuple(r) for r in d.collect()), key=lambda r: (r[0], r[1]))
    assert len(order(own)) == 5
    for a, b in zip(order(own), order(want), strict=True):
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("side", ["A", "B"])
def test_spectra_of_projections_shuffle_no_pairs(spark, side):
    rng = np.random.default_rng(9)
    rows = [("t", day(k), f"u{a}", f"u{b}", 1, 5) for k in range(3) for a, b in sorted({(a, b) for a, b in rng.integers(0, 20, (30, 2)).tolist() if a != b})]
    df = spark.createDataFrame([*rows, ("s", day(0), "x", "y", 1, 5)], "hashtag string, window_end date, source string, target string, weight long, first_exposure_epoch long")
    own, want = kernels.spectral(df, side), kernels.spectral(graph.count_projection(df, side))
    assert own.dtypes == want.dtypes and "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    held, other = ({tuple(r)[:2]: tuple(r)[2:] for r in d.collect()} for d in (own, want))
    assert held.keys() == other.keys() and len(held) == 3
    assert all(x == y or abs(x - y) < 1e-9 for k in held for x, y in zip(held[k], other[k], strict=True))


def test_auto_encoder_separates_cliques():
    u, v, w = ring(3, 10, [(0, 10)])
    z, auc = kernels.gae(30, u, v, w)
    assert z.shape == (30, 8) and auc > 0.7


def test_products_and_absent_pairs_are_exact():
    rng = np.random.default_rng(5)
    n = 300
    u, v = np.r_[np.zeros(299, int), rng.integers(0, n, 2000)], np.r_[np.arange(1, n), rng.integers(0, n, 2000)]  # a hub beyond all layers
    x, y = rng.random(len(u) * 2), rng.normal(size=(n, 4))
    a = np.zeros((n, n))
    np.add.at(a, (np.r_[u, v], np.r_[v, u]), x)
    for block, least in ((1 << 12, 64), (7, 2), (50, 1000)):
        assert np.allclose(kernels.times_adjacency(np.r_[u, v], np.r_[v, u], x, block, least)(y), a @ y)
    p = kernels.absent_sampler(n, u, v, rng)(5000)
    assert len(p) == 5000 and (p[:, 0] < p[:, 1]).all() and (a[p[:, 0], p[:, 1]] == 0).all()
    assert len(np.unique(p, axis=0)) > 4000


@pytest.mark.parametrize("side", ["A", "B"])
def test_projections_in_a_task_equal_the_join(spark, side):
    rng = np.random.default_rng(6)
    pairs = {(f"u{a}", f"u{b}") for a, b in rng.integers(0, 30, (120, 2)).tolist() if a != b}
    rows = [("t", day(0), a, b, 1, 5) for a, b in sorted(pairs)] + [("t", day(1), "x", "y", 1, 5)]  # the second window has no projection
    df = spark.createDataFrame(rows, "hashtag string, window_end date, source string, target string, weight long, first_exposure_epoch long")
    want = {(r.source, r.target, r.weight) for r in graph.count_projection(df, side).collect()}
    own = kernels.per_window(df, lambda ids, u, v, w: {"source": [ids[i] for i in u], "target": [ids[i] for i in v], "weight": w.astype(int)}, "source string, target string, weight long", side)
    assert {(r.source, r.target, r.weight) for r in own.collect()} == want and len(want) > 100
    ids = {x: i for i, x in enumerate(sorted({x for p in pairs for x in p}))}
    u, v = (np.array([ids[p[k]] for p in sorted(pairs)]) for k in (0, 1))
    assert all((x == y).all() for x, y in zip(kernels.project(len(ids), u, v, side), kernels.project(len(ids), u, v, side, block=3), strict=True))


def test_auto_encoder_of_a_projection_lists_no_pairs(spark):
    df = spark.createDataFrame([("t", day(0), f"u{a}", f"x{a // 3 + k}", 1) for a in range(24) for k in range(2)], "hashtag string, window_end date, source string, target string, weight long")
    out = kernels.gae_embeddings(df, "A")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id for r in out.collect()} == {f"u{a}" for a in range(24)} and len({r.link_auc for r in out.collect()}) == 1


def test_auto_encoder_has_no_size_limit():
    u, v, w = ring(220, 10, [(10 * i, 10 * i + 10) for i in range(219)])
    z, auc = kernels.gae(2200, u, v, w)
    assert z.shape == (2200, 8) and np.isfinite(z).all() and auc > 0.9
    # Cliques beyond the 256th node differ as well (nodes with equal neighbourhoods may not).
    assert len(np.unique(z[305::10].round(9), axis=0)) == 190 and np.abs(z).max(1).min() > 1e-3
    z, auc = kernels.gae(12, *ring(1, 12, []))  # a complete graph has no absent pair
    assert z.shape == (12, 8) and auc == 0.5


def test_weighted_clustering_equals_the_cube():
    rng = np.random.default_rng(3)
    u, v = np.triu_indices(25, 1)
    keep = rng.random(len(u)) < 0.3
    u, v, w = u[keep], v[keep], rng.random(keep.sum())
    a = np.zeros((25, 25))
    a[u, v] = a[v, u] = np.cbrt(w)
    k = (a > 0).sum(1)
    local, links = kernels.weighted_clustering(25, u, v, w)
    assert (links == k).all() and np.allclose(local, np.where(k > 1, np.diag(a @ a @ a) / np.maximum(1, k * (k - 1)), 0))


EDGES = "hashtag string, window_end date, source string, target string, weight double"


def test_components_and_triangles(spark):
    e = [("t", day(0), a, b, 1.0) for a, b in ("ab", "bc", "ca", "cd", "xy")] + [("t", day(1), "q", "r", 2.0)]
    df = spark.createDataFrame(e, EDGES)
    assert {(r.window_end, r.id, r.component) for r in kernels.connected_components(df).collect()} == {(day(0), i, "a") for i in "abcd"} | {(day(0), i, "x") for i in "xy"} | {(day(1), i, "q") for i in "qr"}
    assert [(r.u, r.v, r.w) for r in netfeatures.triangles(df).collect()] == [("a", "b", "c")]
    s = {r.window_end: r for r in netfeatures.component_summary(kernels.connected_components(df), 1).collect()}[day(0)]
    assert (s.n_components, s.size_1, s.size_2, s.size_3, s.n_mid) == (2, 4, 2, 0, 1)
    c = {r.window_end: r for r in netfeatures.clustering(df, "g").collect()}
    assert abs(c[day(0)].net_g_transitivity - 0.6) < 1e-9 and day(1) not in c


def test_window_features_equal_the_joins_without_any(spark):
    rng = np.random.default_rng(11)
    rows = sorted({(d, f"u{a}", f"u{b}") for d, a, b in zip(rng.integers(0, 3, 260).tolist(), rng.integers(0, 25, 260).tolist(), rng.integers(0, 30, 260).tolist(), strict=True) if a != b} | {(7, "u90", "u91"), (8, "u90", "u91"), (8, "u92", "u91")})
    df = spark.createDataFrame([("t", day(d), a, b, 2, 5) for d, a, b in rows], "hashtag string, window_end date, source string, target string, weight long, first_exposure_epoch long")
    cluster = lambda c: F.substring(c, 2, 9).cast("int") % 3
    a = graph.count_projection(df, "A")
    labels = graph.node_degrees(a).select("hashtag", "window_end", "id", F.coalesce(cluster("id"), F.lit(-1)).alias("cluster"))
    want = netfeatures.network_features({"bip": df, "proj_a": a, "proj_b": graph.count_projection(df, "B")}, {"proj_a": labels})
    got = netfeatures.window_features(df.withColumn("cluster", F.coalesce(cluster("source"), F.lit(-1))), "cluster")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and dict(want.dtypes) == dict(got.dtypes)
    mine = {r.window_end: r.asDict() for r in got.collect()}
    for r in want.collect():
        for c, x in r.asDict().items():
            y = mine[r.window_end][c]
            assert (x is None) == (y is None) and (x is None or x == y or abs(x - y) < 1e-9), (c, x, y)
    assert len(mine) == 5
    u, v = ring(2, 6, [(0, 6)])[:2]
    assert all((netfeatures.triangle_counts(12, u, v, block) == 10).all() for block in (1, 5, 1 << 20))


def test_second_component(spark):
    u, v, _ = ring(2, 12, [])
    big = [("t", day(0), f"n{a}", f"n{b}", 1.0) for a, b in zip(u, v, strict=True)] + [("t", day(0), "n0", "z", 1.0)]
    row = kernels.second_component(spark.createDataFrame(big, EDGES)).first()
    assert (row.cc2_size, row.cc2_valid, row.cc2_density, row.cc2_mean_degree) == (12, 1, 1.0, 11.0) and abs(row.cc2_clustering - 1) < 1e-9


def test_top_k_by_either_end(spark):
    e = [("t", day(0), "a", x, w) for x, w in zip("bcde", (5.0, 4.0, 4.0, 1.0), strict=True)] + [("t", day(0), "b", "e", 9.0)]
    kept = graph.top_k_edges(spark.createDataFrame(e, EDGES), k=1).collect()
    # d and c are kept by their target role, e's best is b.
    assert {(r.source, r.target) for r in kept} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "e")}


def test_random_walks_follow_edges(spark):
    e = [("t", day(0), a, b, 1.0) for a, b in ("ab", "bc", "cd")]
    walks = embeddings.random_walks(spark.createDataFrame(e, EDGES), walks=2, length=5).collect()
    assert len(walks) == 8
    linked = {frozenset(x) for x in ("ab", "bc", "cd")}
    assert all(len(r.nodes) == 5 and all(frozenset(p) in linked for p in zip(r.nodes[:-1], r.nodes[1:], strict=True)) for r in walks)
    vectors = embeddings.walk_embeddings(embeddings.random_walks(spark.createDataFrame(e, EDGES)), dim=4).collect()
    assert {r.id for r in vectors} == set("abcd") and all(len(r.embedding) == 4 for r in vectors)


def test_random_walks_choose_by_the_hash_and_shuffle_edges_alone(spark):
    rng = np.random.default_rng(8)
    linked = sorted({(f"ü{a}", f"v{b}") for a, b in rng.integers(0, 25, (60, 2)).tolist()})
    df = spark.createDataFrame([("t", day(0), a, b, 1, 5) for a, b in linked], "hashtag string, window_end date, source string, target string, weight long, first_exposure_epoch long")
    found = embeddings.random_walks(df, walks=3, length=4, seed=9, side="A")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    near = {}
    for r in graph.count_projection(df, "A").collect():
        near.setdefault(r.source, set()).add(r.target)
        near.setdefault(r.target, set()).add(r.source)
    keys = [(x, k, n) for x in near for k in (1, 2, 3) for n in (1, 2, 3)]
    rows = spark.createDataFrame(keys, "start string, walk int, n int").withColumn("h", F.xxhash64(F.lit(9), "start", "walk", "n")).collect()
    h = {(r.start, r.walk, r.n): r.h for r in rows}
    want = set()
    for x in near:
        for k in (1, 2, 3):
            path = [x]
            for n in (1, 2, 3):
                choice = sorted(near[path[-1]])
                path.append(choice[h[x, k, n] % len(choice)])
            want.add((f"{x}#{k}", tuple(path)))
    assert {(r.walk, tuple(r.nodes)) for r in found.collect()} == want and len(want) > 30


def test_negative_pairs_are_absent(spark):
    df = spark.createDataFrame([("t", day(0), f"n{i}", f"n{i + 1}", 1.0) for i in range(9)], EDGES)
    got = [(r.source, r.target) for r in graph.absent_pairs(df, 6).collect()]
    assert len(got) == 6 == len(set(got)) and not set(got) & {(f"n{i}", f"n{i + 1}") for i in range(9)} and all(a < b for a, b in got)
    assert sorted(got) == sorted((r.source, r.target) for r in graph.absent_pairs(df, 6).collect())


def test_deltas_reset_on_gaps(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(30), 3.0), ("a", day(90), 0.0), ("a", day(120), 0.0), ("a", day(150), 2.0), ("b", day(150), 5.0)], "hashtag string, window_end date, x double")
    plain = {(r.hashtag, r.window_end): r.d for r in deltas.lag_delta(df, {"x": "d"}).collect()}
    assert plain[("a", day(90))] == -3.0 and plain[("b", day(150))] is None
    gated = {(r.hashtag, r.window_end): r.d for r in deltas.lag_delta(df, {"x": "d"}, mode="relative", gap_days=30).collect()}
    assert (gated[("a", day(30))], gated[("a", day(90))], gated[("a", day(120))], gated[("a", day(150))]) == (2.0, None, 0.0, 1.0)


def test_next_label_skips_nearer_windows(spark):
    f = spark.createDataFrame([("a", day(0), 1.0), ("a", day(30), 2.0), ("b", day(0), 3.0)], "hashtag string, window_end date, ts_x double")
    y = spark.createDataFrame([("a", day(15), 1), ("a", day(30), 0), ("a", day(60), 1), ("b", day(60), 1)], "hashtag string, window_end date, label int")
    assert [(r.hashtag, r.window_end, r.label) for r in samples.next_label_samples(f, y, "label").collect()] == [("a", day(30), 1)]


def test_bins_of_few_rates_and_rare_bins(spark):
    def bins(rates):
        df = spark.createDataFrame([(f"t{i}", float(r)) for i, r in enumerate(rates)], "hashtag string, rate double")
        return splits.strat_bins(df)

    assert {r.bin for r in bins([0.2] * 5).collect()} == {0}
    assert sorted(r.bin for r in bins([0.0, 0.0, 1.0]).collect()) == [0, 0, 1]
    assert sorted(r.bin for r in bins([0.0, 0.5, 1.0]).collect()) == [0, 1, 2]
    assert sorted(r.bin for r in bins([0.0] * 6 + [0.1, 0.5, 0.9]).collect()) == [0] * 7 + [1, 2]  # quartile edges coincide
    assert sorted(r.bin for r in bins([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]).collect()) == [0, 0, 1, 1, 2, 2, 3, 3]
    merged = splits.merge_rare_bins(bins([0.0] * 6 + [0.1, 0.5, 0.9])).collect()
    assert {r.bin for r in merged} == {0}
    folds = splits.group_folds(bins([0.1 * i for i in range(20)]), 5).collect()
    assert len(folds) == 20 and {r.fold for r in folds} == set(range(5))


def test_relaxed_and_error_kinds(spark):
    rows = [("a", dt.date(2024, 3, 31), 1, 0), ("a", dt.date(2024, 2, 29), 0, 1), ("a", dt.date(2024, 6, 30), 0, 1), ("a", dt.date(2024, 9, 1), 1, 0), ("b", dt.date(2024, 1, 1), 1, 1)]
    df = spark.createDataFrame(rows, "hashtag string, window_end date, label int, y_pred int")
    got = {(r.hashtag, r.window_end): (r.match_type, r.relaxed_type) for r in evaluate.relaxed_matches(df).collect()}
    assert got[("a", dt.date(2024, 2, 29))] == ("before", "TP") and got[("a", dt.date(2024, 3, 31))] == ("none", "TN")
    assert got[("a", dt.date(2024, 6, 30))] == ("none", "FP") and got[("a", dt.date(2024, 9, 1))] == ("none", "FN") and got[("b", dt.date(2024, 1, 1))] == ("exact", "TP")
    assert {r.window_end: r.error_type for r in evaluate.false_positives(df).collect()} == {dt.date(2024, 2, 29): "too_early", dt.date(2024, 6, 30): "totally_wrong"}
    assert {r.window_end: r.error_type for r in evaluate.false_negatives(df).collect()} == {dt.date(2024, 3, 31): "too_early", dt.date(2024, 9, 1): "total_miss"}


def test_curves_without_positives(spark):
    df = spark.createDataFrame([(0, 1), (0, 2)], "label int, s int")
    assert evaluate.roc_auc(df, "s").first()[0] is None and evaluate.average_precision(df, "s").first()[0] is None
    assert evaluate.best_threshold(evaluate.threshold_curve(df, "s", [1.0, 2.0]), "f1", constraint=("recall", 0.5)).count() == 0


@pytest.mark.parametrize("name", ["majority", "logistic_regression", "gradient_boosting"])
def test_models_learn(spark, name):
    rng = np.random.default_rng(1)
    rows = [(f"t{i % 20}", day(i), int(x > 0.5), float(x), float("inf") if i % 50 == 0 else float(y), None if i % 7 == 0 else 1.0) for i, (x, y) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame(rows, "hashtag string, window_end date, label int, ts_a double, ts_b double, net_c double")
    columns = samples.feature_columns(df, exclude=["nothing"])
    assert columns == ["ts_a", "ts_b", "net_c"] and samples.feature_columns(df, include=["^ts_"], exclude=["_b$"]) == ["ts_a"]
    out = models.fit_predict(df, df, columns, name)
    assert out.count() == 300
    if name != "majority":
        assert evaluate.roc_auc(out, "y_pred_proba").first()[0] > 0.9


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0, "  #Cats "), (3.0, 2.0, "##dogs")], "a double, b double, t string")
    got = df.select(scalars.ratio(F.col("a"), F.col("b")), scalars.divide(F.col("a"), F.col("b"), 7.0), scalars.normal_tag(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(None, 7.0, "cats"), (1.5, 1.5, "dogs")]
    assert scalars.tag_filter(df.withColumn("hashtag", F.lit("CatsOfX")), ["cats"], contains=True).count() == 2
    assert scalars.tag_filter(df.withColumn("hashtag", F.lit("CatsOfX")), ["cats"]).count() == 0
    ms = spark.createDataFrame([(1_700_000_000_000,), (1_700_000_001_000,)], "e long")
    assert [r.e for r in scalars.to_seconds(ms, "e").collect()] == [1_700_000_000, 1_700_000_001]
    assert scalars.to_seconds(ms.select((F.col("e") / 1000).cast("long").alias("e")), "e").first().e == 1_700_000_000


def test_curves_over_many_scores(spark):
    """Distinct scores in several ranges, ties, missing scores; against sorted rows."""
    rng = np.random.default_rng(5)
    score = np.r_[rng.random(3000), np.repeat(0.25, 50), np.repeat(0.75, 50)]
    label = (rng.random(len(score)) < score).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(score, label, strict=True)], "s double, label int")
    order = np.argsort(-score, kind="stable")
    y, x = label[order], score[order]
    last = np.flatnonzero(np.r_[np.diff(x) != 0, True])
    tp, n = np.cumsum(y)[last], last + 1
    r, p = tp / tp[-1], tp / n
    r0, p0 = np.r_[0, r[:-1]], np.r_[1, p[:-1]]
    ap, area = ((r - r0) * p).sum(), ((r - r0) * (p + p0) / 2).sum()
    less = (score[label == 1][:, None] > score[label == 0][None, :]) + 0.5 * (score[label == 1][:, None] == score[label == 0][None, :])
    assert abs(evaluate.roc_auc(df, "s").first()[0] - less.mean()) < 1e-12
    assert abs(evaluate.average_precision(df, "s").first()[0] - ap) < 1e-12
    got = evaluate.pr_area(df, "s").first()
    assert abs(got.pr_area - area) < 1e-12 and got.n_points == len(last)
    assert evaluate.pr_area(df.where("false"), "s").first().pr_area is None


def test_absent_pairs_of_dense_graphs(spark):
    every = [(a, b) for a in "abcdefgh" for b in "abcdefgh" if a < b]
    gone = {("a", "c"), ("b", "h"), ("d", "e")}
    rows = [("t", day(0), a, b, 1.0) for a, b in every if (a, b) not in gone] + [("t", day(1), a, b, 1.0) for a, b in every]
    rows += [("t", day(2), f"n{i}", f"n{i + 1}", 1.0) for i in range(60)]
    got = graph.absent_pairs(spark.createDataFrame(rows, EDGES), 5).collect()
    assert {(r.source, r.target) for r in got if r.window_end == day(0)} == gone
    assert not [r for r in got if r.window_end == day(1)]
    path = {(r.source, r.target) for r in got if r.window_end == day(2)}
    assert len(path) == 5 and all(a < b and abs(int(a[1:]) - int(b[1:])) > 1 for a, b in path)


def test_pooled_vectors(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(40, 4))
    df = spark.createDataFrame([("t", day(0), f"n{i}", x.tolist()) for i, x in enumerate(z)], "hashtag string, window_end date, id string, embedding array<double>")
    r = embeddings.pooled(df, ["hashtag", "window_end"], 4).first()
    norms, cov = np.linalg.norm(z, axis=1), z.T @ z / 40
    eigen, p = np.sort(np.linalg.eigvalsh(cov))[::-1], norms / norms.sum()
    want = {"mean_norm": norms.mean(), "std_norm": norms.std(), "energy": (z**2).sum(), "norm_entropy": -(p * np.log(p)).sum(), "norm_p25": np.percentile(norms, 25), "pca1": eigen[0], "pca3": eigen[2],
            "global_std": z.std(), "l2_mean": np.linalg.norm(z.mean(0)), "l2_std": np.linalg.norm(z.std(0)), "cov_frob": np.linalg.norm(cov), "mean_dim2": z[:, 2].mean(), "std_dim3": z[:, 3].std()}
    q = eigen / eigen.sum()
    want["effective_rank"] = np.exp(-(q * np.log(q)).sum())
    assert all(abs(r[c] - x) < 1e-9 for c, x in want.items())
    scores = np.array([[x.pc1, x.pc2, x.pc3] for x in embeddings.window_components(df).orderBy(F.expr("int(substring(id, 2))")).collect()])
    assert np.allclose(np.abs(scores), np.abs((z - z.mean(0)) @ np.linalg.svd(z - z.mean(0))[2][:3].T))


def test_walk_embeddings_by_graph(spark):
    u, v, _ = ring(2, 8, [(0, 8)])
    rows = [("t", day(d), f"n{a:02}", f"n{b:02}", 1.0) for d in (0, 1) for a, b in zip(u, v, strict=True)]
    df = spark.createDataFrame(rows, EDGES)
    vectors = embeddings.walk_embeddings(embeddings.random_walks(df))
    got = {(r.window_end, r.id): r.embedding for r in vectors.collect()}
    assert len(got) == 32 and all(len(x) == 16 and np.isfinite(x).all() for x in got.values())
    again = {(r.window_end, r.id): r.embedding for r in embeddings.walk_embeddings(embeddings.random_walks(df.repartition(3))).collect()}
    assert got == again
    f = {r.window_end: r for r in embeddings.walk_features(vectors, df, kernels.connected_components(df)).collect()}[day(1)]
    assert (f.emb_graph_n_nodes, f.emb_graph_n_components, f.emb_graph_n_edges) == (16, 1, 57) and abs(f.emb_mean_norm - f.emb_mean_global / np.log(16)) < 1e-12 and f.emb_delta_sv1 is not None


def test_skip_gram_puts_neighbours_together():
    rng = np.random.default_rng(0)
    walks = [[int(x) for x in rng.integers(0, 10, 10) + side * 10] for side in (0, 1) for _ in range(800)]
    z = embeddings.skip_gram(walks, 20)
    z /= np.linalg.norm(z, axis=1)[:, None]
    near, far = z[:10] @ z[:10].T, z[:10] @ z[10:].T
    assert near[~np.eye(10, dtype=bool)].mean() > far.mean() + 0.2


def test_graph_sample(spark):
    u, v, _ = ring(1, 12, [])
    df = spark.createDataFrame([("t", day(0), f"n{a}", f"n{b}", 1.0) for a, b in zip(u, v, strict=True)], EDGES)
    kept = graph.sampled_nodes(df, 5).collect()
    assert len(kept) == 10 and len({x for r in kept for x in (r.source, r.target)}) == 5


def test_nested_folds_choose_thresholds_on_unseen_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(f"t{i:02}", day(d), int(x > 0.3), float(x), float(rng.normal())) for i in range(30) for d, x in enumerate(rng.normal(size=6))]
    samples = spark.createDataFrame(rows, "hashtag string, window_end date, label int, ts_a double, ts_b double")
    folds = splits.group_folds(spark.createDataFrame([(f"t{i:02}", i % 2) for i in range(30)], "hashtag string, bin int"), 3)
    got = models.nested_cv(samples, folds, ["ts_a", "ts_b"], "logistic_regression", 3).collect()
    assert sorted(r.fold for r in got) == [0, 1, 2] and all(0.1 <= r.threshold <= 0.9 and r.roc_auc > 0.95 for r in got)
    assert all(r.threshold == 0.5 or round(r.threshold * 100 * 3) == pytest.approx(r.threshold * 100 * 3, abs=1e-6) for r in got)  # a mean of three grid points


def test_nested_folds_leave_no_plan_of_all_fits(spark):
    """The plan that the driver holds at the end reads three finished rows, not the samples again for each model and metric."""
    rows = [(f"t{i:02}", day(d), (i + d) % 2, float((i + d) % 2), float(i)) for i in range(12) for d in range(4)]
    samples = spark.createDataFrame(rows, "hashtag string, window_end date, label int, ts_a double, ts_b double")
    folds = splits.group_folds(spark.createDataFrame([(f"t{i:02}", i % 2) for i in range(12)], "hashtag string, bin int"), 3)
    plan = models.nested_cv(samples, folds, ["ts_a", "ts_b"], "majority", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("LogicalRDD") == 3


def test_interpretability(spark):
    u, v, _ = ring(1, 4, [(3, 4 + i) for i in range(10)])
    df = spark.createDataFrame([("t", day(0), f"n{a:02}", f"n{b:02}", 1.0) for a, b in zip(u, v, strict=True)], EDGES)
    degree = np.bincount(np.r_[u, v])
    # The first component is the degree itself; only ten nodes have a time.
    vectors = spark.createDataFrame([("t", day(0), f"n{i:02}", [float(10 * d), 0.0]) for i, d in enumerate(degree)], "hashtag string, window_end date, id string, embedding array<double>")
    nodes = spark.createDataFrame([("t", day(0), f"n{i:02}", 100 + i if i < 10 else 0) for i in range(14)], "hashtag string, window_end date, id string, ts long")
    got = {(r.component, r.statistic): r for r in embeddings.interpretability(vectors, df, df.withColumn("w", F.lit(2.0)), nodes).collect()}
    assert {s for _, s in got} == {"degree", "recency_degree"}
    assert got[1, "degree"].n == 14 and got[1, "degree"].rho == pytest.approx(1) and got[1, "recency_degree"].rho == pytest.approx(1)
    assert got[3, "degree"].rho is None


def test_distance_agreement_takes_all_pairs(spark):
    """More nodes than any sample of the measure; an id in two rows makes no pair with itself, a pair with a missing vector has no distance."""
    rng = np.random.default_rng(13)
    ids = [*range(620), 3, 7]
    a = rng.normal(size=(len(ids), 5))
    b = a + rng.normal(size=a.shape)
    kind = "label int, id long, embedding array<float>"
    rows = [[(1, i, None if i == gap else x.tolist()) for i, x in zip(ids[:620], z, strict=False)] for z, gap in ((a, 11), (b, 12))]
    left = spark.createDataFrame([*rows[0], *((1, i, z.tolist()) for i, z in zip(ids[620:], a[620:], strict=True)), (2, 1, [1.0, 0.0])], kind)
    right = spark.createDataFrame([*rows[1], (2, 1, [1.0, 0.0])], kind)
    got = embeddings.distance_agreement(left.repartition(3), right, "id", ["label"]).collect()
    b[620:] = b[[3, 7]]

    def distances(z, gap):
        z = (z.astype(np.float32).astype(float).T / np.linalg.norm(z.astype(np.float32).astype(float), axis=1)).T
        d = 1 - z @ z.T
        d[gap], d[:, gap] = np.nan, np.nan
        return d

    i, j = np.triu_indices(len(ids), 1)
    differ = np.array(ids)[i] != np.array(ids)[j]
    x, y = distances(a, 11)[i, j][differ], distances(b, 12)[i, j][differ]
    full = ~np.isnan(x) & ~np.isnan(y)
    want = np.cov(x[full], y[full], bias=True)[0, 1] / (np.nanstd(x) * np.nanstd(y))
    assert [(r.label, r.n_pairs) for r in got] == [(1, differ.sum())] and abs(got[0].agreement - want) < 1e-9


def _same(want, got, keys):
    assert dict(want.dtypes) == dict(got.dtypes)
    mine, rows = {tuple(r[k] for k in keys): r for r in got.collect()}, want.collect()
    assert len(mine) == len(rows) > 1
    for r in rows:
        for c, x in r.asDict().items():
            y = mine[tuple(r[k] for k in keys)][c]
            assert (x is None) == (y is None) and (x is None or x == y or abs(x - y) < 1e-7), (c, x, y)


def test_interpretability_in_one_task_equals_the_joins(spark):
    rng = np.random.default_rng(13)
    exposed = [("t" if a % 5 else "s", f"u{a:02}", f"u{b:02}", 86400 * d + a) for a, b, d in zip(rng.integers(0, 20, 260).tolist(), rng.integers(10, 40, 260).tolist(), rng.integers(0, 200, 260).tolist(), strict=True) if a != b]
    exposed = spark.createDataFrame(exposed, "hashtag string, A string, B string, exposure_epoch long")
    adoption = spark.createDataFrame([(h, f"u{a:02}", 3 + 1000 * a) for h in "st" for a in range(0, 20, 3)], "hashtag string, user string, first_post_epoch long")  # others' adoption is unknown
    edges = graph.bipartite_edges(exposed)
    weighted = graph.recency_weights(edges.withColumn("epoch", F.col("first_exposure_epoch")), mode="first")
    want = embeddings.score_correlations(embeddings.gae_components(edges), edges, weighted, graph.bipartite_nodes(edges, adoption, exposed))
    timed = graph.bipartite_edges(graph.first_times(exposed, adoption), more=("source_ts", "target_ts"))
    got = embeddings.window_interpretability(timed)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "Aggregate" not in plan.split("FlatMapGroupsInPandas")[0]
    _same(want, got, ("hashtag", "window_end", "component", "statistic"))
    assert {r.statistic for r in got.collect()} == {"degree", "recency_degree", "first_seen"}


def test_batches_of_skip_grams_add_what_meets():
    rng = np.random.default_rng(14)
    bounds = np.cumsum(np.r_[rng.random(50), np.zeros(5), rng.random(3) * 1e-9, rng.random(50)])
    bounds /= bounds[-1]
    x = np.r_[rng.random(5000), 0.0, bounds[:-1], np.nextafter(1, 0)]
    assert (embeddings._sampler(bounds)(x) == np.searchsorted(bounds, x, "right")).all()
    for n in (7, 90, 5000):
        to, at, more = rng.random((n, 4)), rng.integers(0, n, 40), rng.random((40, 4))
        want = to.copy()
        np.add.at(want, at, more)
        embeddings._add_rows(to, at, to[at], more)
        assert np.allclose(to, want, atol=1e-14)


def test_features_of_embeddings_in_one_task(spark):
    """The fused kernels give what the operators that they join give, and train once."""
    rng = np.random.default_rng(12)
    pairs = sorted({(d, f"u{a:02}", f"u{b:02}") for d, a, b in zip(rng.integers(0, 2, 160).tolist(), rng.integers(0, 20, 160).tolist(), rng.integers(10, 40, 160).tolist(), strict=True) if a != b} | {(5, "x", "y")})
    df = spark.createDataFrame([("t", day(d), a, b, 1, 5 + 86400 * i) for i, (d, a, b) in enumerate(pairs)], "hashtag string, window_end date, source string, target string, weight long, first_exposure_epoch long")
    roles = [(d, x, r) for d, x, r in sorted({(d, p[k], r) for d, *p in pairs for k, r in ((0, "influencer"), (1, "audience"))})]
    nodes = spark.createDataFrame([("t", day(d), x, r, 7 + i) for i, (d, x, r) in enumerate(roles)], "hashtag string, window_end date, id string, partition string, ts long")
    vectors = kernels.gae_embeddings(df)
    keys = ("hashtag", "window_end")
    got = embeddings.window_role_features(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    _same(embeddings.role_features(vectors, nodes, df), got, keys)
    weighted = graph.recency_weights(df.withColumn("epoch", F.col("first_exposure_epoch")), mode="first")
    got = embeddings.score_correlations(embeddings.gae_components(df), df, weighted, nodes)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    _same(embeddings.interpretability(vectors, df, weighted, nodes), got, (*keys, "component", "statistic"))
    a = graph.count_projection(df, "A")
    got = embeddings.window_walk_features(df, side="A")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    _same(embeddings.walk_features(embeddings.walk_embeddings(embeddings.random_walks(a)), a, kernels.connected_components(a)), got, keys)
