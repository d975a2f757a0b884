"""Exact top-k inner products by best-first search in M-trees.

With M the largest norm, x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0); the
squared distance is then |q|^2 + M^2 - 2<q, x>, so the nearest are those with the
largest inner product, and the metric bounds of an M-tree hold.

Vectors are dealt to trees by their nearest pivot; a crowded pivot (copies of one
vector, say) is split into several trees of bounded size. A tree's pages hold
entries with a routing object, a covering radius and the distance to the parent;
the search takes pages by their lower bound and skips, by |d(q, parent) -
d(entry, parent)| - radius, entries whose distance then needn't be computed.
Every query first searches the tree with the best bound; its k-th score then
decides which other trees can hold a better or equal one, and it goes to just
these. Queries meet trees in blocks of bounded size, and a tree's page meets all
queries of a round that take it in one matrix product. Scores are integers.

Bounded by construction: pivots and tree statistics (rows / tree_rows vectors)
are all that is broadcast; a group is one tree and one block of queries.

Cases: null vectors, null ids, and vectors with null or non-finite components
take no part; shorter vectors count as padded with zeros; a query's own rows are
those with its vec_id; rows that repeat both id and vector count once as a query
and each as a candidate; ties go to the smaller vec_id; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table


@dataclass(frozen=True)
class MTreeConfig:
    k: int = 20
    tree_rows: int = 8192  # vectors of a tree, twice that at most
    query_rows: int = 8192  # queries of a block
    page: int = 128  # entries of a page
    together: int = 2048  # queries that search a tree side by side


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of usable rows."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(lens), dim))
    rows = np.repeat(np.arange(len(lens)), lens)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


class MTree:
    """A bulk-loaded M-tree over augmented vectors; pages of at most `page` entries."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, peak: float, page: int):
        self.ids, self.raw, self.peak, self.page = ids, raw, peak, page
        self.points = np.hstack([raw, np.sqrt(np.maximum(peak - (raw * raw).sum(1), 0.0))[:, None]])
        #: A page: (leaf, members or child pages, their routing objects, radii, distances to the parent's routing object)
        self.pages: list[tuple] = []
        self.root = self._load(np.arange(len(ids)), None)[0] if len(ids) else -1

    def _load(self, own: np.ndarray, centre: np.ndarray | None) -> tuple[int, float]:
        """The page of the given points, and its covering radius around its routing object."""
        if centre is None:
            centre = self.points[own].mean(0)
        far = np.linalg.norm(self.points[own] - centre, axis=1)
        radius = float(far.max())
        if len(own) <= self.page:
            order = np.argsort(far, kind="stable")
            self.pages.append((True, own[order], None, None, far[order]))
            return len(self.pages) - 1, radius
        fan = int(min(self.page, max(2, -(-len(own) // self.page) * 3 // 2)))
        seeds = self.points[own[np.linspace(0, len(own) - 1, fan).astype(int)]]
        away = (self.points[own] ** 2).sum(1)[:, None] - 2 * self.points[own] @ seeds.T + (seeds**2).sum(1)
        nearest = away.argmin(1)
        parts = [own[nearest == s] for s in range(fan)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # all alike: by position
            parts = np.array_split(own, fan)
        kids, centres, radii = [], [], []
        for p in parts:
            c = self.points[p].mean(0)
            page, r = self._load(p, c)
            kids.append(page)
            centres.append(c)
            radii.append(r)
        routing = np.stack(centres)
        self.pages.append((False, np.array(kids), routing, np.array(radii), np.linalg.norm(routing - centre, axis=1)))
        self.routing = centre
        return len(self.pages) - 1, radius

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """(score, id) of the k best but id `own`, by score and then id; those under `floor` needn't be found."""
        _, ids, scores = self.search_many(q[None, :], np.array([own]), k, np.array([floor]))
        return list(zip(scores.astype(np.int64).tolist(), ids.tolist(), strict=True))

    def search_many(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, id, score) of each query's k best but id `own`, by query, score and id; those under `floor` needn't be found.

        Queries go best-first side by side: in each round each takes its next pages by their
        lower bounds (one, then two, four and so on), and a page meets all queries that take it in one matrix product.
        """
        n = len(queries)
        none = np.zeros(0, np.int64)
        if self.root < 0 or not n:
            return none, none, np.zeros(0)
        qq = (queries * queries).sum(1)
        slack = 1e-7 * (1.0 + qq + self.peak)
        worst = floor.astype(np.float64)  # the score that an entry has to reach,
        worst_id = np.full(n, np.iinfo(np.int64).max)  # and at that score the id that it has to be under

        def reach() -> np.ndarray:
            """The distance within which a vector with at least the worst score lies."""
            return np.sqrt(np.maximum(0.0, qq + self.peak - 2 * worst + slack))

        limit = reach()
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, np.zeros(0))]

        def merge() -> None:
            nonlocal limit
            who, ids, scores = (np.concatenate(x) for x in zip(*best, strict=True))
            by = np.lexsort((ids, -scores, who))
            who, ids, scores = who[by], ids[by], scores[by]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            last = rank == k - 1
            worst[who[last]], worst_id[who[last]] = scores[last], ids[last]
            best[:] = [(who[rank < k], ids[rank < k], scores[rank < k])]
            limit = reach()

        # Pages still to be read: query, page, lower bound, distance to the page's routing object.
        rest = (np.arange(n), np.full(n, self.root), np.zeros(n), np.full(n, np.nan))
        take = 1
        while True:
            rest = tuple(x[rest[2] <= limit[rest[0]]] for x in rest)
            if not len(rest[0]):
                break
            by = np.lexsort((rest[2], rest[0]))
            rest = tuple(x[by] for x in rest)
            now = np.arange(len(by)) - np.searchsorted(rest[0], rest[0]) < take
            who, page, low, d_parent = (x[now] for x in rest)
            kept = [tuple(x[~now] for x in rest)]
            by = np.argsort(page, kind="stable")
            size = 0
            for g in np.split(by, np.flatnonzero(np.diff(page[by])) + 1):
                # What other pages of this round have raised rules some out.
                g = g[low[g] <= limit[who[g]]]
                if not len(g):
                    continue
                at, dp = who[g], d_parent[g][:, None]
                leaf, members, routing, radii, away = self.pages[page[g[0]]]
                # The distance to the parent rules entries out before their own is computed.
                may = ~(np.abs(dp - away) - (0.0 if leaf else radii) > limit[at][:, None])
                pick = np.flatnonzero(may.any(0))
                may = may[:, pick]
                if leaf:
                    scores = np.asarray(self.raw[members[pick]] @ queries[at].T).T
                    ids = self.ids[members[pick]]
                    bar = worst[at][:, None]
                    may &= (scores > bar) | ((scores == bar) & (ids < worst_id[at][:, None]))
                    may &= ids != own[at][:, None]
                    i, e = np.nonzero(may)
                    best.append((at[i], ids[e], scores[i, e]))
                    size += len(i)
                    if size > 1 << 18:
                        merge()
                        size = 0
                    continue
                centres = routing[pick]
                d = np.sqrt(np.maximum(0.0, (centres * centres).sum(1) - 2 * queries[at] @ centres[:, :-1].T + qq[at][:, None]))
                lower = np.maximum(0.0, d - radii[pick])
                i, e = np.nonzero(may & (lower <= limit[at][:, None]))
                kept.append((at[i], members[pick][e], lower[i, e], d[i, e]))
            merge()
            rest = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
            take *= 2
        return best[0]


@dataclass(frozen=True)
class Pivots:
    points: np.ndarray
    peak: float
    dim: int


def choose_pivots(rows: DataFrame, cfg: MTreeConfig) -> tuple[Pivots, int]:
    """rows / tree_rows vectors, those with the smallest hashes."""
    n, peak, dim = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v"))).first()
    count = max(1, -(-n // cfg.tree_rows))
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id", "v").limit(count).select("v").collect()
    points = np.zeros((max(1, len(some)), max(1, dim or 0)))
    for i, r in enumerate(some):
        points[i, : len(r[0])] = r[0]
    return Pivots(np.unique(points, axis=0), float(peak or 0.0), max(1, dim or 0)), n


def top_inner_products(spark: SparkSession, vectors: DataFrame, queries: DataFrame, cfg: MTreeConfig = MTreeConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): both inputs are (vec_id, v) as `clean` gives them."""
    base = scratch(spark, "mtree")
    vectors.write.parquet(f"{base}/vectors")
    vectors = spark.read.parquet(f"{base}/vectors")
    pivots, total = choose_pivots(vectors, cfg)
    shared = spark.sparkContext.broadcast(pivots)
    dim, peak = pivots.dim, pivots.peak

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            x = matrix(batch.column(1), p.dim)
            away = (x * x).sum(1)[:, None] - 2 * x @ p.points.T + (p.points**2).sum(1)
            pick = away.argmin(1)
            norm = (x * x).sum(1)
            # The augmented distance to a pivot's augmented point.
            lift = np.sqrt(np.maximum(p.peak - norm, 0)) - np.sqrt(np.maximum(p.peak - (p.points[pick] ** 2).sum(1), 0))
            d = np.sqrt(np.maximum(away[np.arange(len(x)), pick], 0) + lift * lift)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pick.astype(np.int32)), pa.array(d)], names=["vec_id", "v", "pivot", "d"])

    vectors.mapInArrow(nearest, "vec_id long, v array<double>, pivot int, d double").write.parquet(f"{base}/dealt")
    dealt = spark.read.parquet(f"{base}/dealt")
    stats = {r["pivot"]: (r["n"], r["radius"]) for r in dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()}
    parts = {p: max(1, -(-n // cfg.tree_rows)) for p, (n, _) in stats.items()}
    trees, at = {}, 0
    for p in sorted(parts):
        trees[p] = (at, parts[p])
        at += parts[p]
    layout = spark.createDataFrame([(p, a, n) for p, (a, n) in trees.items()] or [(-1, 0, 1)], "p int, at int, parts int")
    # One row for each pivot: as bounded as the pivots.
    placed = dealt.join(F.broadcast(layout), F.col("pivot") == F.col("p")).select("vec_id", "v", (F.col("at") + F.pmod(F.xxhash64("vec_id", "v", F.lit(11)), F.col("parts"))).cast("int").alias("tree"))
    blocks = max(1, -(-queries.count() // cfg.query_rows))
    asked = queries.distinct().withColumn("q", F.xxhash64("vec_id", "v")).withColumn("block", F.pmod(F.xxhash64("q", F.lit(3)), F.lit(blocks)).cast("int"))
    order = sorted(trees)
    radius = np.array([stats[p][1] for p in order])

    def bounds(x: np.ndarray) -> np.ndarray:
        """The largest score that each query may find at each pivot."""
        points = shared.value.points[order]
        qq = (x * x).sum(1)[:, None]
        d = np.sqrt(np.maximum(qq + peak - 2 * x @ points.T, 0))
        low = np.maximum(0.0, d - radius - 1e-6 * (1 + d))
        return (qq + peak - low * low) / 2 + 1e-7 * (1 + qq + peak)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = bounds(matrix(batch.column(1), dim)).argmax(1)
            tree = np.array([trees[order[b]][0] for b in best], np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree), pa.array(np.full(len(tree), -np.inf))], names=["vec_id", "v", "q", "block", "tree", "floor"])

    route = "vec_id long, v array<double>, q long, block int, tree int, floor double"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            by = np.argsort(ids, kind="stable")  # the same tree, in whatever order rows come
            tree = MTree(ids[by], matrix(left.column("v"), dim)[by], peak, cfg.page)
            who, q, floor, x = *(right.column(c).to_numpy() for c in ("vec_id", "q", "floor")), matrix(right.column("v"), dim)
            for at in range(0, len(who), cfg.together):
                own = slice(at, at + cfg.together)
                i, found, scores = tree.search_many(x[own], who[own], cfg.k, floor[own])
                out.append((who[own][i], q[own][i], found, scores.astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "q", "vec_id", "score"])

    found_schema = "query_id long, q long, vec_id long, score long"

    def searched(routed: DataFrame) -> DataFrame:
        need = routed.select(F.col("tree").alias("t"), F.col("block").alias("b")).distinct()
        pages = placed.join(need, F.col("tree") == F.col("t")).select("vec_id", "v", "tree", F.col("b").alias("block"))
        return pages.groupBy("tree", "block").cogroup(routed.groupBy("tree", "block")).applyInArrow(search, found_schema)

    first = asked.select("vec_id", "v", "q", "block").mapInArrow(home, route)
    first.write.parquet(f"{base}/first")
    first = spark.read.parquet(f"{base}/first")
    searched(first).write.parquet(f"{base}/found")
    found = spark.read.parquet(f"{base}/found")
    floors = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).select(F.col("q").alias("of"), F.when(F.col("n") >= cfg.k, F.col("low").cast("double")).alias("low"))
    ready = first.join(floors, F.col("q") == F.col("of"), "left").select("vec_id", "v", "q", "block", F.col("tree").alias("seen"), F.coalesce("low", F.lit(float("-inf"))).alias("floor"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, floor = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            may = bounds(matrix(batch.column(1), dim)) >= floor[:, None]
            rows, tree = [], []
            for i, j in zip(*np.nonzero(may), strict=True):
                a, n = trees[order[j]]
                for t in range(a, a + n):
                    if t != seen[i]:
                        rows.append(i)
                        tree.append(t)
            if rows:
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(np.array(tree, np.int32)), some.column(5)], names=["vec_id", "v", "q", "block", "tree", "floor"])

    ready.mapInArrow(others, route).write.parquet(f"{base}/second")
    more = searched(spark.read.parquet(f"{base}/second"))
    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.unionByName(more).withColumn("rank", place).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")


def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clean(table(spark, sf_dir, "embeddings"))
    return top_inner_products(spark, vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
    where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select distinct vec_id, v from e where vec_id % 20 = 0),
s as (select q.vec_id as query_id, q.v as v, c.vec_id as vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
    from q, e c where q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id, v order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
