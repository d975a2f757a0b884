import duckdb
import numpy as np

from pulseloom.llm import mtree

from . import edge


def brute(rows, k=20, every=20):
    clean = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        clean.append((i, tuple(int(np.floor(64 * x)) for x in v)))
    out = []
    for q, x in sorted(set(clean)):
        if q % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in clean if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_query_and_sql(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{edge.SF}/embeddings.parquet").collect()]
    out = mtree.op4_mtree_top_k(spark, edge.SF)
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{edge.SF}/embeddings.parquet'")
    assert sorted(con.sql(mtree.ORACLE).fetchall()) == got


def test_many_small_trees_and_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=5), 1)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(150)]  # copies: ties and a crowded pivot
    rows += [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (None, [1.0] * 5), (2000, None), (2001, [1.0, float("nan"), 0.0, 0.0, 0.0]), (2002, [None, 1.0]), (2003, [float("inf")]), (2004, []), (2020, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    vectors = mtree.clean(df)
    for cfg in (mtree.MTreeConfig(), mtree.MTreeConfig(k=3, tree_rows=40, query_rows=7, page=8)):
        got = mtree.top_inner_products(spark, vectors, vectors.where("vec_id % 20 = 0"), cfg)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, cfg.k)
    none = vectors.where("false")
    assert mtree.top_inner_products(spark, none, none).count() == 0


def test_tree_prunes():
    """On clustered vectors a search computes few scores, and the result stays exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 60
    raw = np.floor(np.repeat(centres, 50, 0) + rng.normal(size=(2000, 16)) * 3)
    peak = float((raw * raw).sum(1).max())
    tree = mtree.MTree(np.arange(2000), raw, peak, 32)
    seen = 0

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal seen
            seen += len(self)
            return np.asarray(self) @ other

    tree.raw = raw.view(Counted)
    for q in range(0, 2000, 100):
        s = raw @ raw[q]
        want = sorted(((int(-s[i]), i) for i in range(2000) if i != q))[:20]
        assert tree.search(raw[q], q, 20, -np.inf) == [(-a, i) for a, i in want]
    assert seen < 20 * 2000 * 0.5


def test_queries_share_a_page_visit():
    """Where little can be pruned, products grow with pages and rounds, not with queries times pages; results, ties and floors stay exact."""
    rng = np.random.default_rng(5)
    raw = np.floor(rng.normal(size=(1500, 12)) * 3)
    raw[300:500] = raw[7]  # ties
    tree = mtree.MTree(np.arange(1500), raw, float((raw * raw).sum(1).max()), 32)
    calls = 0

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal calls
            calls += 1
            return np.asarray(self) @ other

    tree.raw = raw.view(Counted)
    queries = np.arange(0, 1500, 5)
    scores = raw[queries] @ raw.T
    floor = np.where(queries % 2, -np.inf, np.sort(scores, axis=1)[:, -8])
    who, ids, got = tree.search_many(raw[queries], queries, 20, floor)
    assert calls < 12 * len(tree.pages)
    for r, q in enumerate(queries.tolist()):
        want = sorted((-scores[r, i], i) for i in range(1500) if i != q)[:20]
        found = list(zip((-got[who == r]).tolist(), ids[who == r].tolist(), strict=True))
        above = [w for w in want if -w[0] >= floor[r]]
        assert found[: len(above)] == above and (floor[r] > -np.inf or found == want)
