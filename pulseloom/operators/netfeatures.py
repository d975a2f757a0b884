"""Network features of each graph: size, degrees, clustering, communities, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import divide
from .deltas import lag_delta
from .graph import KEYS, node_degrees
from .kernels import _graph, project


def undirected(edges: DataFrame) -> DataFrame:
    """(u < v), one row for each pair."""
    return edges.select(*KEYS, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).where("u <> v").distinct()


def basic_stats(edges: DataFrame, name: str) -> DataFrame:
    """Nodes, edges and density; edges are counted as half of all degrees, in the pass that counts nodes."""
    size = node_degrees(edges).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("long").alias("e"))
    n = F.col("n").cast("double")
    return size.select(*KEYS, F.col("n").alias(f"net_{name}_n_nodes"), F.col("e").alias(f"net_{name}_n_edges"), divide(F.col("e").cast("double"), n * (n - 1) / 2).alias(f"net_{name}_density"))


def gini(values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and the Gini coefficient of a column; 0 where all are zero."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(column))
    ranked = values.select(*keys, F.col(column).cast("double").alias("x"), rank.alias("i"))
    return ranked.groupBy(*keys).agg(_gini().alias("gini"))


def _gini() -> Column:
    """Over values x with ranks i."""
    n, total = F.count(F.lit(1)).cast("double"), F.sum("x")
    return F.when(total > 0, 2.0 * F.sum(F.col("i") * F.col("x")) / (n * total) - (n + 1) / n).otherwise(0.0)


def degree_stats(edges: DataFrame, name: str) -> DataFrame:
    """Mean, largest and deviation of degrees and their Gini coefficient, in one aggregation over ranked degrees."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("degree"))
    ranked = node_degrees(edges).select(*KEYS, "degree", F.col("degree").cast("double").alias("x"), rank.alias("i"))
    return ranked.groupBy(*KEYS).agg(
        F.avg("x").alias(f"net_{name}_avg_degree"), F.max("degree").alias(f"net_{name}_max_degree"), F.stddev_pop("x").alias(f"net_{name}_std_degree"), _gini().alias(f"net_{name}_degree_gini")
    )


def triangles(edges: DataFrame, simple: bool = False, degree: DataFrame | None = None) -> DataFrame:
    """(u < v < w) of each graph. Edges point from the lower to the higher degree, so no node has many outgoing ones and no hub is squared.

    `simple`: edges are one row a pair, source < target, as projections are; `degree`: their known degrees.
    """
    e = edges.select(*KEYS, F.col("source").alias("u"), F.col("target").alias("v")) if simple else undirected(edges)
    if degree is None:
        degree = node_degrees(e.select(*KEYS, F.col("u").alias("source"), F.col("v").alias("target")))
    du, dv = (degree.select(*KEYS, F.col("id").alias(x), F.struct("degree", "id").alias(f"d{x}")) for x in ("u", "v"))
    full = e.join(du, [*KEYS, "u"]).join(dv, [*KEYS, "v"])
    forward = F.col("du") < F.col("dv")
    out = full.select(*KEYS, F.when(forward, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = out.join(out.select(*KEYS, "a", F.col("b").alias("c")), [*KEYS, "a"]).where("b < c")
    closed = wedge.join(e.select(*KEYS, F.col("u").alias("b"), F.col("v").alias("c")), [*KEYS, "b", "c"], "left_semi")
    three = F.array_sort(F.array("a", "b", "c"))
    return closed.select(*KEYS, three[0].alias("u"), three[1].alias("v"), three[2].alias("w"))


def clustering(edges: DataFrame, name: str, simple: bool = False) -> DataFrame:
    """Mean local clustering and transitivity of graphs with at least three nodes; always exact. `simple` as in triangles."""
    degree = node_degrees(edges)
    found = triangles(edges, simple, degree if simple else None)
    each = found.select(*KEYS, F.explode(F.array("u", "v", "w")).alias("id")).groupBy(*KEYS, "id").agg(F.count(F.lit(1)).alias("t"))
    local = degree.join(each, [*KEYS, "id"], "left").select(*KEYS, F.coalesce("t", F.lit(0)).cast("double").alias("t"), (F.col("degree") * (F.col("degree") - 1) / 2.0).alias("w"))
    return local.groupBy(*KEYS).agg(F.avg(divide(F.col("t"), F.col("w"))).alias(f"net_{name}_avg_clustering"), divide(F.sum("t"), F.sum("w")).alias(f"net_{name}_transitivity"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


def entropy(p: Column, eps: float = 1e-10) -> Column:
    return -F.sum(p * F.log(p + eps))


def community_features(edges: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Number, size entropy, largest share and modularity of communities (id, cluster); modularity over weighted edges between labelled nodes."""
    sizes = labels.groupBy(*KEYS, "cluster").agg(F.count(F.lit(1)).cast("double").alias("s"))
    p = F.col("s") / F.sum("s").over(Window.partitionBy(*KEYS))
    shares = sizes.withColumn("p", p).groupBy(*KEYS).agg(F.count(F.lit(1)).alias(f"net_{name}_n_communities"), entropy(F.col("p")).alias(f"net_{name}_community_size_entropy"), F.max("p").alias(f"net_{name}_largest_community_pct"))
    return shares.join(modularity(edges, labels).withColumnRenamed("modularity", f"net_{name}_modularity"), KEYS, "left")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(keys, modularity): the sum over communities of L/m - (d/2m)^2."""
    w = F.col("weight").cast("double")
    lu, lv = (labels.select(*KEYS, F.col("id").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("source", "target"))
    known = edges.join(lu, [*KEYS, "source"]).join(lv, [*KEYS, "target"]).withColumn("w", w)
    ends = known.select(*KEYS, F.explode(F.array("c_source", "c_target")).alias("c"), F.col("w"))
    degree = ends.groupBy(*KEYS, "c").agg(F.sum("w").alias("d"))
    inner = known.where("c_source = c_target").groupBy(*KEYS, F.col("c_source").alias("c")).agg(F.sum("w").alias("l"))
    total = known.groupBy(*KEYS).agg(F.sum("w").alias("m"))
    each = degree.join(inner, [*KEYS, "c"], "left").join(total, KEYS)
    return each.groupBy(*KEYS).agg(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def network_deltas(features: DataFrame, name: str) -> DataFrame:
    """Edge turnover and differences to the previous window of the tag, whatever the gap."""
    n = F.col(f"net_{name}_n_edges").cast("double")
    w = Window.partitionBy("hashtag").orderBy("window_end")
    out = features.withColumn(f"net_{name}_edge_turnover", F.when(F.lag(n).over(w) > 0, F.abs(n - F.lag(n).over(w)) / F.lag(n).over(w)))
    columns = [c for c in ("modularity", "avg_degree", "density") if f"net_{name}_{c}" in features.columns]
    return lag_delta(out, {f"net_{name}_{c}": f"net_{name}_delta_{c}" for c in columns})


def component_summary(components: DataFrame, minimum: int = 10) -> DataFrame:
    """Number of components, sizes of the five largest, size entropy, share outside the largest, and mid-sized ones."""
    sizes = components.groupBy(*KEYS, "component").agg(F.count(F.lit(1)).alias("s"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("s"), "component"))
    total = F.sum("s").over(Window.partitionBy(*KEYS))
    ranked = sizes.withColumn("r", rank).withColumn("p", F.col("s") / total).withColumn("top", F.max("s").over(Window.partitionBy(*KEYS)))
    return ranked.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_components"),
        *(F.coalesce(F.max(F.when(F.col("r") == k, F.col("s"))), F.lit(0)).alias(f"size_{k}") for k in range(1, 6)),
        entropy(F.col("p")).alias("size_entropy"),
        (1.0 - F.max("p")).alias("share_outside_lcc"),
        F.sum(((F.col("s") >= minimum) & (F.col("s") < F.col("top"))).cast("int")).alias("n_mid"),
    )


def network_features(graphs: dict[str, DataFrame], labels: dict[str, DataFrame] | None = None) -> DataFrame:
    """All families of several graphs side by side, with net_has_<graph> flags. Graphs but `bip` are projections: one row a pair."""
    out = None
    for name, edges in graphs.items():
        own = basic_stats(edges, name).join(degree_stats(edges, name), KEYS).join(clustering(edges, name, simple=name != "bip"), KEYS, "left")
        if labels and name in labels:
            own = own.join(community_features(edges, labels[name], name), KEYS, "left")
        own = network_deltas(own, name).withColumn(f"net_has_{name}", F.lit(1))
        out = own if out is None else out.join(own, KEYS, "full")
    return out.withColumns({f"net_has_{name}": F.coalesce(f"net_has_{name}", F.lit(0)) for name in graphs})


def triangle_counts(n: int, u: np.ndarray, v: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """Triangles at each node of a graph of distinct edges u < v; as in `triangles`, edges point to the higher degree. About `block` wedges are listed at a time."""
    degree = np.bincount(np.r_[u, v], minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), degree))] = np.arange(n)
    a, b = np.minimum(rank[u], rank[v]), np.maximum(rank[u], rank[v])
    code = np.sort(a * n + b)
    a, b = code // n, code % n
    later = np.searchsorted(a, a, "right") - np.arange(len(a)) - 1  # edges of the same node
    total = np.r_[0, np.cumsum(later)]
    found = np.zeros(n, np.int64)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, total[at] + block, "right")) - 1)
        first = np.repeat(np.arange(at, end), later[at:end])
        second = first + 1 + np.arange(len(first)) - np.repeat(total[at:end] - total[at], later[at:end])
        third = b[first] * n + b[second]
        near = np.minimum(np.searchsorted(code, third), len(code) - 1)
        hit = code[near] == third
        for x in (a[first[hit]], b[first[hit]], b[second[hit]]):
            found += np.bincount(x, minlength=n)
        at = end
    return found[rank]


def graph_row(n: int, u: np.ndarray, v: np.ndarray, cluster: np.ndarray | None = None, w: np.ndarray | None = None) -> dict[str, float | None]:
    """basic_stats, degree_stats, clustering and, with each node's cluster, community_features of one graph."""
    m = len(u)
    degree = np.bincount(np.r_[u, v], minlength=n)
    x = np.sort(degree).astype(float)
    code = np.unique((np.minimum(u, v) * n + np.maximum(u, v))[u != v])
    out = {
        "n_nodes": n, "n_edges": m, "density": m / (n * (n - 1) / 2) if n > 1 else 0.0, "avg_degree": x.mean(), "max_degree": int(x[-1]), "std_degree": x.std(),
        "degree_gini": 2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n,
    }
    if n >= 3:
        t, wedges = triangle_counts(n, code // n, code % n), degree * (degree - 1) / 2
        out["avg_clustering"] = np.divide(t, wedges, out=np.zeros(n), where=wedges > 0).mean()
        out["transitivity"] = t.sum() / wedges.sum() if wedges.sum() > 0 else 0.0
    if cluster is not None:
        _, c = np.unique(cluster, return_inverse=True)
        p = np.bincount(c) / n
        total = w.sum()
        ends, inner = np.bincount(np.r_[c[u], c[v]], np.r_[w, w]), np.bincount(c[u], w * (c[u] == c[v]), len(p))
        out |= {"n_communities": len(p), "community_size_entropy": -(p * np.log(p + 1e-10)).sum(), "largest_community_pct": p.max(), "modularity": (inner / total - (ends / (2 * total)) ** 2).sum()}
    return out


FEATURES = {
    "n_nodes": "long", "n_edges": "long", "density": "double", "avg_degree": "double", "max_degree": "long", "std_degree": "double", "degree_gini": "double", "avg_clustering": "double", "transitivity": "double",
    "n_communities": "long", "community_size_entropy": "double", "largest_community_pct": "double", "modularity": "double",
}


def window_features(edges: DataFrame, cluster: str | None = None) -> DataFrame:
    """network_features of bipartite edges (`bip`) and their projections (`proj_a`, `proj_b`), made in one task a window: only the edges are shuffled, no pairs and no wedges.

    cluster: a column of `edges` with the community of the source, for the A projection.
    """
    kinds = dict(edges.dtypes)
    names = {g: [c for c in FEATURES if g == "proj_a" and cluster or c not in ("n_communities", "community_size_entropy", "largest_community_pct", "modularity")] for g in ("bip", "proj_a", "proj_b")}
    schema = {f"net_{g}_{c}": FEATURES[c] for g in names for c in names[g]}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, u, v, _ = _graph(pdf)
        n = len(ids)
        rows = {"bip": graph_row(n, u, v)}
        for side in "AB":
            a, b, w = project(n, u, v, side)
            if len(a):
                there = np.unique(np.r_[a, b])
                known = None
                if side == "A" and cluster:
                    of = dict(zip(pdf["source"], pdf["cluster"], strict=True))
                    known = np.array([of[ids[i]] for i in there.tolist()])
                rows[f"proj_{side.lower()}"] = graph_row(len(there), np.searchsorted(there, a), np.searchsorted(there, b), known, w.astype(float))
        flat = {f"net_{g}_{c}": row.get(c) for g, row in rows.items() for c in names[g]}
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in KEYS}, **{c: pd.Series([flat.get(c)], dtype="Int64" if kind == "long" else "Float64") for c, kind in schema.items()}})

    own = edges.select(*KEYS, "source", "target", F.lit(1.0).alias("weight"), *([F.col(cluster).alias("cluster")] if cluster else []))
    found = own.groupBy(*KEYS).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + "".join(f", {c} {kind}" for c, kind in schema.items()))
    # One row a graph, as a graph's differences are those between its own windows.
    cells = {g: [(F.col(f"net_{g}_{c}") if c in names[g] else F.lit(None).cast(FEATURES[c])).alias(c) for c in names["proj_a"]] for g in names}
    rows = found.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(g).alias("g"), *cells[g]) for g in names))).alias("x"))
    rows = rows.select(*KEYS, "x.*").where("n_nodes is not null")
    before = Window.partitionBy("hashtag", "g").orderBy("window_end")
    n = F.col("n_edges").cast("double")
    rows = rows.withColumn("edge_turnover", F.when(F.lag(n).over(before) > 0, F.abs(n - F.lag(n).over(before)) / F.lag(n).over(before)))
    for c in ("modularity", "avg_degree", "density"):
        if c in rows.columns:
            rows = rows.withColumn(f"delta_{c}", F.col(c) - F.lag(c).over(before))
    out = []
    for g in names:
        out += [F.max(F.when(F.col("g") == g, F.col(c))).alias(f"net_{g}_{c}") for c in (*names[g], "edge_turnover", *(f"delta_{c}" for c in ("modularity", "avg_degree", "density") if c in names[g]))]
        out.append(F.max((F.col("g") == g).cast("int")).alias(f"net_has_{g}"))
    return rows.groupBy(*KEYS).agg(*out)


def label_agreement(labels: DataFrame) -> DataFrame:
    """(keys, prev_window_end, nmi): normalised mutual information with the previous existing window, over ids in both."""
    ends = labels.select(*KEYS).distinct().withColumn("prev_window_end", F.lag("window_end").over(Window.partitionBy("hashtag").orderBy("window_end"))).where("prev_window_end is not null")
    now = labels.join(ends, KEYS).select(*KEYS, "prev_window_end", "id", F.col("cluster").alias("a"))
    then = labels.select("hashtag", F.col("window_end").alias("prev_window_end"), "id", F.col("cluster").alias("b"))
    keys = [*KEYS, "prev_window_end"]
    cell = now.join(then, ["hashtag", "prev_window_end", "id"]).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = Window.partitionBy(*keys)
    cell = cell.withColumn("t", F.sum("n").over(over)).withColumn("na", F.sum("n").over(Window.partitionBy(*keys, "a"))).withColumn("nb", F.sum("n").over(Window.partitionBy(*keys, "b")))
    p, pa, pb = F.col("n") / F.col("t"), F.col("na") / F.col("t"), F.col("nb") / F.col("t")
    sums = cell.groupBy(*keys).agg(F.sum(p * F.log(p / (pa * pb))).alias("mi"), (-F.sum(p * F.log(pa))).alias("ha"), (-F.sum(p * F.log(pb))).alias("hb"))
    return sums.select(*keys, F.when(F.col("ha") + F.col("hb") > 1e-12, F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).otherwise(1.0).alias("nmi"))
