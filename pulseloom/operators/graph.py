"""Rolling bipartite graphs, one-mode projections, pruning and edge weights.

All graphs of all tags and windows are one table keyed by (hashtag, window_end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import day_epoch, epoch_day
from .windows import assign_windows

KEYS = ["hashtag", "window_end"]


def bipartite_edges(exposed: DataFrame, width: int = 90, step: int = 30, min_edges: int = 10, more: tuple[str, ...] = ()) -> DataFrame:
    """(hashtag, window_end, source, target, weight, first_exposure_epoch) of windows with at least min_edges edges; no self-loops. more: columns of exposed, of which an edge has the least value."""
    rows = exposed.select("hashtag", F.col("A").alias("source"), F.col("B").alias("target"), "exposure_epoch", epoch_day(F.col("exposure_epoch")).alias("date"), *more)
    least = [F.min(c).alias(c) for c in more]
    # Days first: an explode of daily counts is smaller than one of events.
    daily = rows.groupBy("hashtag", "source", "target", "date").agg(F.count(F.lit(1)).alias("n"), F.min("exposure_epoch").alias("e"), *least)
    placed = assign_windows(daily, width, step)
    edges = placed.groupBy(*KEYS, "source", "target").agg(F.sum("n").alias("weight"), F.min("e").alias("first_exposure_epoch"), *least).where("source <> target")
    size = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    return edges.withColumn("__n", size).where(F.col("__n") >= min_edges).drop("__n")


def first_times(exposed: DataFrame, adoption: DataFrame) -> DataFrame:
    """exposed with source_ts, the first adoption of A, and target_ts, the first exposure of B, as in bipartite_nodes; 0 where unknown. Exposures are fewer than the edges of all windows."""
    known = adoption.select("hashtag", F.col("user").alias("A"), F.col("first_post_epoch").alias("source_ts"))
    seen = exposed.withColumn("target_ts", F.min("exposure_epoch").over(Window.partitionBy("hashtag", "B")))
    return seen.join(known, ["hashtag", "A"], "left").fillna(0, ["source_ts", "target_ts"])


def bipartite_nodes(edges: DataFrame, adoption: DataFrame, exposed: DataFrame) -> DataFrame:
    """Influencer and audience rows with degrees and times: first adoption for influencers, first exposure for the audience; 0 where unknown. An id in both roles has two rows, each with both degrees."""
    end = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    # One pass over the edges gives both degrees of an id; its roles follow from them.
    degrees = edges.select(*KEYS, end.alias("x")).groupBy(*KEYS, "x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    roles = F.filter(F.array(F.when(F.col("out_degree") > 0, "influencer"), F.when(F.col("in_degree") > 0, "audience")), lambda r: r.isNotNull())
    rows = degrees.select(*KEYS, "id", F.explode(roles).alias("partition"), "out_degree", "in_degree")
    infl = adoption.select("hashtag", F.col("user").alias("id"), F.col("first_post_epoch").alias("node_ts_infl"))
    aud = exposed.groupBy("hashtag", F.col("B").alias("id")).agg(F.min("exposure_epoch").alias("node_ts_aud"))
    full = rows.join(infl, ["hashtag", "id"], "left").join(aud, ["hashtag", "id"], "left")
    known = {c: F.coalesce(c, F.lit(0)) for c in ("node_ts_infl", "node_ts_aud")}
    ts = F.when(F.col("partition") == "influencer", F.col("node_ts_infl")).otherwise(F.col("node_ts_aud"))
    return full.withColumns(known).withColumn("ts", ts).select(*KEYS, "id", "partition", "out_degree", "in_degree", "node_ts_infl", "node_ts_aud", "ts")


def _sides(side: str) -> tuple[str, str]:
    """The column that is projected, and the one that is shared."""
    return ("source", "target") if side == "A" else ("target", "source")


def pairs(edges: DataFrame, side: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of u < v that share a neighbour, with both weights and first times, and the columns `more` of both edges (_u, _v).

    A neighbour's pairs are quadratic in its degree, which the projection itself
    asks for. They aggregate map-side right after the join, whose hot neighbours
    adaptive execution splits.
    """
    own, shared = _sides(side)
    left = edges.select(*KEYS, F.col(shared).alias("r"), F.col(own).alias("u"), F.col("weight").alias("wu"), F.col("first_exposure_epoch").alias("tu"), *(F.col(c).alias(f"{c}_u") for c in more))
    right = edges.select(*KEYS, F.col(shared).alias("r"), F.col(own).alias("v"), F.col("weight").alias("wv"), F.col("first_exposure_epoch").alias("tv"), *(F.col(c).alias(f"{c}_v") for c in more))
    return left.join(right, [*KEYS, "r"]).where("u < v")


def count_projection(edges: DataFrame, side: str = "A", weighted: bool = False, min_shared: int = 1) -> DataFrame:
    """(source < target): number of shared neighbours, or the sum of products of weights; ts: the earliest time at which a neighbour was shared."""
    weight = F.sum(F.col("wu") * F.col("wv")) if weighted else F.count(F.lit(1))
    out = pairs(edges, side).groupBy(*KEYS, F.col("u").alias("source"), F.col("v").alias("target")).agg(weight.alias("weight"), F.min(F.greatest("tu", "tv")).alias("ts"))
    return out.where(F.col("weight") >= min_shared)


def cosine_projection(edges: DataFrame, side: str = "A", weighted: bool = True, min_sim: float = 0.0) -> DataFrame:
    """(source < target, sim): cosine of the neighbour vectors. Each edge carries its node's norm into the self-join, so none follows it."""
    own, _ = _sides(side)
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    base = edges.withColumn("weight", w)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*KEYS, own)) + 1e-12)
    both = pairs(base.withColumn("norm", norm), side, ("norm",)).groupBy(*KEYS, "u", "v").agg(F.sum(F.col("wu") * F.col("wv")).alias("dot"), F.first("norm_u").alias("nu"), F.first("norm_v").alias("nv"))
    sim = F.col("dot") / (F.col("nu") * F.col("nv") + 1e-12)
    return both.select(*KEYS, F.col("u").alias("source"), F.col("v").alias("target"), sim.alias("sim")).where(F.col("sim") >= min_sim)


def top_k_edges(edges: DataFrame, weight: str = "weight", k: int = 50) -> DataFrame:
    """Edges (one row a pair) among the k heaviest of their source or of their target; ties by the pair. Each role is ranked alone, so that its limit applies before the shuffle."""

    def best(end: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*KEYS, end).orderBy(F.desc(weight), "source", "target"))
        return edges.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")

    return best("source").unionByName(best("target")).dropDuplicates([*KEYS, "source", "target"])


def node_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of an undirected edge list."""
    ends = edges.select(*KEYS, F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy(*KEYS, "id").agg(F.count(F.lit(1)).alias("degree"))


def recency_weights(events: DataFrame, tau_days: float = 14.0, mode: str = "sum", transform: str | None = None) -> DataFrame:
    """Edge weights from the age of exposures at the window's end: the sum over (hashtag, window_end, source, target, epoch) rows of exp(-age / tau), or that of the first one; optionally log1p or clipped at the 99th percentile; rescaled to a positive median of 1."""
    age = (day_epoch(F.col("window_end")) - F.col("epoch")) / F.lit(86400.0)
    decay = F.exp(-age / F.lit(tau_days))
    first = F.max_by(decay, -F.col("epoch"))
    out = events.groupBy(*KEYS, "source", "target").agg((F.sum(decay) if mode == "sum" else first).alias("w"))
    if transform == "log1p":
        out = out.withColumn("w", F.log1p("w"))
    scale = out.groupBy(*KEYS).agg(F.percentile("w", 0.99).alias("p99"), F.percentile(F.when(F.col("w") > 0, F.col("w")), 0.5).alias("mid"))
    out = out.join(scale, KEYS)
    if transform == "clip":
        out = out.withColumn("w", F.least("w", "p99"))
    return out.select(*KEYS, "source", "target", F.when(F.col("mid") > 0, F.col("w") / F.col("mid")).otherwise(F.col("w")).alias("w"))


def node_time_features(nodes: DataFrame, width: int = 90) -> DataFrame:
    """One-hot type and first appearance within the window, 0 to 1; a flag where it is unknown."""
    start = day_epoch(F.col("window_end")) - F.lit(width * 86400)
    t = (F.col("ts") - start) / F.lit(width * 86400.0)
    missing = F.col("ts") == 0
    return nodes.select(*KEYS, "id", "partition", (F.col("partition") == "influencer").cast("int").alias("is_influencer"), F.when(missing, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).alias("t_norm"), missing.cast("int").alias("t_missing"))


def min_max(df: DataFrame, columns: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Columns scaled to 0..1 within each graph; 0.5 where all are equal."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(F.lit(0.5)) for c in columns})


def attributed_nodes(projection: DataFrame, edges: DataFrame, attrs: DataFrame, width: int = 90) -> DataFrame:
    """Features of influencers in the A projection: followers, followees, posts, audience size, first exposure, profile flag; min-max scaled."""
    audience = edges.groupBy(*KEYS, F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("audience"), F.min("first_exposure_epoch").alias("first"))
    start = day_epoch(F.col("window_end")) - F.lit(width * 86400)
    known = attrs.select(F.lower("username").alias("id"), "followers", "followees", "posts", F.lit(1.0).alias("has_profile"))
    full = node_degrees(projection).join(audience, [*KEYS, "id"], "left").join(known, "id", "left")
    full = full.withColumn("first_exposure", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("first") - start) / F.lit(width * 86400.0))))
    columns = ["followers", "followees", "posts", "audience", "first_exposure"]
    filled = full.select(*KEYS, "id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in [*columns, "has_profile"]))
    return min_max(filled, columns)


def gcn_normalised(edges: DataFrame) -> DataFrame:
    """Entries of D^-1/2 (A + I) D^-1/2 of an undirected weighted edge list (source, target, weight), both directions and the diagonal."""
    both = edges.select(*KEYS, F.explode(F.array(F.struct(F.col("source").alias("i"), F.col("target").alias("j")), F.struct(F.col("target").alias("i"), F.col("source").alias("j")))).alias("p"), F.col("weight").cast("double").alias("w")).select(*KEYS, "p.i", "p.j", "w")
    loops = both.select(*KEYS, "i").distinct().select(*KEYS, "i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    full = both.unionByName(loops)
    degree = full.groupBy(*KEYS, F.col("i").alias("id")).agg(F.sum("w").alias("d"))
    di, dj = degree.select(*KEYS, F.col("id").alias("i"), F.col("d").alias("di")), degree.select(*KEYS, F.col("id").alias("j"), F.col("d").alias("dj"))
    return full.join(di, [*KEYS, "i"]).join(dj, [*KEYS, "j"]).select(*KEYS, "i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("a"))


def laplacian(edges: DataFrame) -> DataFrame:
    """Off-diagonal entries of I - D^-1/2 A D^-1/2 (source < target)."""
    ends = edges.select(*KEYS, F.explode(F.array("source", "target")).alias("id"), F.col("weight").cast("double").alias("w"))
    degree = ends.groupBy(*KEYS, "id").agg(F.greatest(F.sum("w"), F.lit(1e-10)).alias("d"))
    du, dv = degree.select(*KEYS, F.col("id").alias("source"), F.col("d").alias("du")), degree.select(*KEYS, F.col("id").alias("target"), F.col("d").alias("dv"))
    return edges.join(du, [*KEYS, "source"]).join(dv, [*KEYS, "target"]).select(*KEYS, "source", "target", (-F.col("weight").cast("double") / F.sqrt(F.col("du") * F.col("dv"))).alias("l"))


def absent_pairs(edges: DataFrame, per_graph: int, seed: int = 42) -> DataFrame:
    """per_graph unlinked pairs of each graph (all, if it has fewer), by a seeded hash.

    Numbers in the order of all pairs of a graph's nodes are drawn, so pairs aren't
    listed: as many as give over four times per_graph unlinked pairs on average, and
    all numbers where that is more than there are, so dense graphs lose none.
    """
    linked = edges.select(*KEYS, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).where("source <> target").distinct()
    nodes = node_degrees(edges).select(*KEYS, "id")
    placed = nodes.withColumn("p", F.row_number().over(Window.partitionBy(*KEYS).orderBy("id")) - 1)
    size = placed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).join(linked.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("e")), KEYS)
    total = F.expr("n * (n - 1) div 2")
    tries = F.ceil(F.lit(4.0 * per_graph + 16) * F.col("total") / F.greatest(F.col("total") - F.col("e"), F.lit(1)))
    shots = size.withColumn("total", total).withColumn("tries", F.least(F.col("total"), tries).cast("long")).where("total > e")
    shots = shots.withColumn("t", F.explode(F.expr("sequence(1L, tries)")))
    number = F.when(F.col("tries") == F.col("total"), F.col("t") - 1).otherwise(F.pmod(F.xxhash64(F.lit(seed), "hashtag", "window_end", "t"), F.col("total")))
    # Number c = j (j - 1) / 2 + i stands for places i < j.
    shots = shots.select(*KEYS, number.alias("c")).distinct().withColumn("j", F.floor((F.sqrt(8.0 * F.col("c") + 1) + 1) / 2).cast("long"))
    shots = shots.withColumn("j", F.expr("case when j * (j - 1) div 2 > c then j - 1 when (j + 1) * j div 2 <= c then j + 1 else j end")).withColumn("i", F.expr("c - j * (j - 1) div 2"))
    low, high = placed.select(*KEYS, F.col("id").alias("source"), F.col("p").alias("i")), placed.select(*KEYS, F.col("id").alias("target"), F.col("p").alias("j"))
    free = shots.join(low, [*KEYS, "i"]).join(high, [*KEYS, "j"]).select(*KEYS, "source", "target").join(linked, [*KEYS, "source", "target"], "left_anti")
    pick = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.xxhash64(F.lit(seed), "source", "target"), "source", "target"))
    return free.withColumn("__r", pick).where(F.col("__r") <= per_graph).drop("__r")


def sampled_nodes(edges: DataFrame, target: int = 7000, seed: int = 42) -> DataFrame:
    """The graph on at most `target` nodes of each window: the nodes with the smallest seeded hashes, in place of unseeded burning."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    kept = node_degrees(edges).select(*KEYS, "id", rank.alias("r")).where(F.col("r") <= target)
    a, b = kept.select(*KEYS, F.col("id").alias("source")), kept.select(*KEYS, F.col("id").alias("target"))
    return edges.join(a, [*KEYS, "source"], "left_semi").join(b, [*KEYS, "target"], "left_semi")
