"""The engine's inputs as views over the test tables, and the same views as SQL.

SQL[name] is a common table expression; `with_views` puts those that a query
needs, in order, before it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import day_epoch
from ..operators import graph, labels, propagation, series, slices


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their order: ids, author, days, customer."""
        o = self.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_day"))
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.concat(F.lit("u"), "l_suppkey").alias("author"), F.col("l_shipdate").cast("date").alias("ship_day"))
        post = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("post_id", post).withColumn("shortcode", F.concat(F.lit("s"), post))

    @cached_property
    def parts(self) -> DataFrame:
        return self.table("part").select("p_partkey", F.lower("p_brand").alias("hashtag"))

    @cached_property
    def suppliers(self) -> int:
        return self.table("supplier").count()

    @cached_property
    def posts(self) -> DataFrame:
        return self.lines.join(self.parts, F.col("l_partkey") == F.col("p_partkey")).select("post_id", "shortcode", "author", "hashtag", day_epoch(F.col("order_day")).alias("post_epoch"))

    @cached_property
    def comments(self) -> DataFrame:
        who = F.concat(F.lit("u"), (F.col("o_custkey") % self.suppliers).cast("string"))
        return self.lines.select("post_id", "shortcode", "author", who.alias("commenter"), day_epoch(F.col("ship_day")).alias("comment_epoch"))

    @cached_property
    def tags(self) -> DataFrame:
        who = F.concat(F.lit("u"), ((F.col("o_custkey") + 1) % self.suppliers).cast("string"))
        return self.lines.where("l_linenumber = 1").select("post_id", "shortcode", "author", who.alias("tagged_user"), day_epoch(F.col("order_day")).alias("post_epoch"))

    @cached_property
    def adoption(self) -> DataFrame:
        return propagation.first_adoption(self.posts)

    @cached_property
    def exposed(self) -> DataFrame:
        return propagation.comment_exposures(self.posts, self.comments)

    @cached_property
    def tagged_lines(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("date"))
        return li.join(self.parts, F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def daily(self) -> DataFrame:
        return self.tagged_lines.groupBy("hashtag", "date").agg(F.count(F.lit(1)).alias("mentions"))

    @cached_property
    def daily_comments(self) -> DataFrame:
        return self.posts.groupBy("hashtag", F.expr("date_add(date'1970-01-01', int(post_epoch div 86400))").alias("date")).agg(F.count(F.lit(1)).alias("total_comments"))

    @cached_property
    def totals(self) -> DataFrame:
        return self.tagged_lines.groupBy("date").agg(F.count_distinct(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("total_posts_day"))

    @cached_property
    def mentions(self) -> DataFrame:
        return series.normalised_mentions(self.daily, self.totals)

    @cached_property
    def comment_series(self) -> DataFrame:
        totals = self.daily_comments.groupBy("date").agg(F.sum("total_comments").alias("total_comments"))
        return series.normalised_comments(self.daily_comments, totals)

    @cached_property
    def sliced(self) -> DataFrame:
        return slices.slice_rows(self.daily, 30, 30)

    @cached_property
    def bipartite(self) -> DataFrame:
        return graph.bipartite_edges(self.exposed)

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.bipartite_nodes(self.bipartite, self.adoption, self.exposed)

    @cached_property
    def projection(self) -> DataFrame:
        return graph.count_projection(self.bipartite, "A")

    @cached_property
    def clusters(self) -> DataFrame:
        """Deterministic labels of projected nodes, for operators that read labels."""
        return graph.node_degrees(self.projection).select("hashtag", "window_end", "id", self.cluster_of("id").alias("cluster"))

    @staticmethod
    def cluster_of(name: str) -> Column:
        n = F.substring(name, 2, 9).cast("int")
        return F.when(n % 7 == 0, (n + F.month("window_end")) % 3).otherwise(n % 4)

    @cached_property
    def attrs(self) -> DataFrame:
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        username = F.concat(F.lit("u"), "s_suppkey")
        posts = self.posts.groupBy(F.col("author").alias("username")).agg(F.count(F.lit(1)).cast("double").alias("posts"))
        followers = F.when(F.col("s_acctbal") < 0, -1.0).otherwise(F.round(F.abs("s_acctbal") * 100))
        base = s.select(username.alias("username"), F.col("n_name").alias("category"), followers.alias("followers"), (F.col("s_nationkey") * 37 + F.col("s_suppkey")).cast("double").alias("followees"))
        return base.join(posts, "username", "left")

    @cached_property
    def cps(self) -> DataFrame:
        """Change points as a given table."""
        return self.daily.where("datediff(date, date'1970-01-01') % 11 = 0").select("hashtag", F.col("date").alias("cp_date"))

    @cached_property
    def means(self) -> DataFrame:
        return labels.window_means(self.daily, "mentions")

    @cached_property
    def predictions(self) -> DataFrame:
        n = self.sliced.groupBy("hashtag", "window_end").agg(F.sum("mentions").alias("n"))
        rise = (F.col("mean_now") - F.col("mean_before") >= 0.2) & ((F.col("mean_before") == 0) | (F.col("mean_now") >= 1.1 * F.col("mean_before")))
        both = self.means.join(n, ["hashtag", "window_end"])
        score = (F.col("n") * 37) % 101
        return both.select("hashtag", "window_end", rise.cast("int").alias("label"), score.cast("long").alias("score"), (score / 100.0).alias("y_pred_proba"), (score >= 50).cast("int").alias("y_pred"))

    @cached_property
    def samples(self) -> DataFrame:
        """Predictions as samples: label and a few numeric features."""
        return self.predictions.select("hashtag", "window_end", "label", F.col("score").cast("double").alias("ts_a"), (F.col("score") % 7).cast("double").alias("ts_b"), F.when(F.col("score") % 3 != 0, F.col("score") / 10.0).alias("net_c"))


SQL = {
    "lines": "select l_partkey, l_linenumber, l_orderkey, cast(l_orderkey * 10 + l_linenumber as varchar) as post_id, 's' || cast(l_orderkey * 10 + l_linenumber as varchar) as shortcode, 'u' || l_suppkey as author, cast(l_shipdate as date) as ship_day, cast(o_orderdate as date) as order_day, o_custkey from lineitem join orders on l_orderkey = o_orderkey",
    "posts": "select post_id, shortcode, author, lower(p_brand) as hashtag, cast(epoch(order_day) as bigint) as post_epoch from lines join part on l_partkey = p_partkey",
    "comments": "select post_id, shortcode, author, 'u' || (o_custkey % (select count(*) from supplier)) as commenter, cast(epoch(ship_day) as bigint) as comment_epoch from lines",
    "tags": "select post_id, shortcode, author, 'u' || ((o_custkey + 1) % (select count(*) from supplier)) as tagged_user, cast(epoch(order_day) as bigint) as post_epoch from lines where l_linenumber = 1",
    "adoption": "select author as usr, hashtag, min(post_epoch) as first_post_epoch from posts group by all",
    "exposed": "select p.hashtag, p.author as a, c.commenter as b, least(c.comment_epoch, p.post_epoch + 1296000) as exposure_epoch, p.post_epoch, p.post_id, p.shortcode, 'comment' as exposure_type from posts p join comments c using (post_id, shortcode, author) where c.commenter <> p.author",
    "tag_exposed": "select p.hashtag, p.author as a, t.tagged_user as b, p.post_epoch as exposure_epoch, p.post_epoch, p.post_id, p.shortcode, 'tag' as exposure_type from posts p join tags t using (post_id, shortcode, post_epoch, author) where t.tagged_user <> p.author",
    "prop": "select e.hashtag, e.a, e.b, min(e.exposure_epoch) as first_exposure_epoch, x.first_post_epoch as a_adopt, y.first_post_epoch as b_adopt, min(e.exposure_type) as exposure_type from exposed e join adoption x on x.usr = e.a and x.hashtag = e.hashtag join adoption y on y.usr = e.b and y.hashtag = e.hashtag where y.first_post_epoch > e.exposure_epoch group by 1, 2, 3, 5, 6",
    "daily": "select lower(p_brand) as hashtag, cast(l_shipdate as date) as d, count(*) as mentions from lineitem join part on l_partkey = p_partkey group by all",
    "daily_comments": "select hashtag, cast(date '1970-01-01' + cast(post_epoch // 86400 as integer) as date) as d, count(*) as total_comments from posts group by all",
    "totals": "select cast(l_shipdate as date) as d, count(distinct l_orderkey * 10 + l_linenumber) as total_posts_day from lineitem join part on l_partkey = p_partkey group by all",
    "ext": "select hashtag, min(d) as f, max(d) as l from daily group by all",
    "ends": "select hashtag, cast(f + cast(30 + 30 * k as integer) as date) as e from (select hashtag, f, unnest(range(0, (l - f - 30) // 30 + 1)) as k from ext where l - f >= 30)",
    "sl": "select w.hashtag, w.e, s.d, s.mentions, cast(s.mentions as double) as v, row_number() over (partition by w.hashtag, w.e order by s.d) as pos, count(*) over (partition by w.hashtag, w.e) as n, lag(cast(s.mentions as double)) over (partition by w.hashtag, w.e order by s.d) as l1, lag(cast(s.mentions as double), 3) over (partition by w.hashtag, w.e order by s.d) as l3, lag(cast(s.mentions as double), 7) over (partition by w.hashtag, w.e order by s.d) as l7 from ends w join daily s on s.hashtag = w.hashtag and s.d > w.e - 30 and s.d <= w.e",
    "ed": "select *, cast(date '1970-01-01' + cast(exposure_epoch // 86400 as integer) as date) as d from exposed",
    "gext": "select hashtag, min(d) as f, max(d) as l from ed group by all",
    "gends": "select hashtag, cast(f + cast(90 + 30 * k as integer) as date) as e from (select hashtag, f, unnest(range(0, (l - f - 90) // 30 + 1)) as k from gext where l - f >= 90)",
    "bip0": "select x.hashtag, w.e, x.a, x.b, count(*) as w, min(x.exposure_epoch) as t from ed x join gends w on x.hashtag = w.hashtag and x.d > w.e - 90 and x.d <= w.e group by all",
    "bip": "select * from bip0 qualify count(*) over (partition by hashtag, e) >= 10",
    "outd": "select hashtag, e, a as id, count(*) as n from bip group by all",
    "ind": "select hashtag, e, b as id, count(*) as n from bip group by all",
    "node0": "select hashtag, e, id, 'influencer' as part from outd union all select hashtag, e, id, 'audience' from ind",
    "nodes": "select z.hashtag, z.e, z.id, z.part, coalesce(o.n, 0) as outd, coalesce(i.n, 0) as ind, coalesce(ad.first_post_epoch, 0) as ti, coalesce(au.t, 0) as ta from node0 z left join outd o using (hashtag, e, id) left join ind i using (hashtag, e, id) left join adoption ad on ad.hashtag = z.hashtag and ad.usr = z.id left join (select hashtag, b as id, min(exposure_epoch) as t from exposed group by all) au on au.hashtag = z.hashtag and au.id = z.id",
    "pa": "select x.hashtag, x.e, x.a as u, y.a as v, count(*) as w, sum(x.w * y.w) as ww, min(greatest(x.t, y.t)) as t from bip x join bip y on x.hashtag = y.hashtag and x.e = y.e and x.b = y.b and x.a < y.a group by all",
    "pb": "select x.hashtag, x.e, x.b as u, y.b as v, count(*) as w, sum(x.w * y.w) as ww, min(greatest(x.t, y.t)) as t from bip x join bip y on x.hashtag = y.hashtag and x.e = y.e and x.a = y.a and x.b < y.b group by all",
    "deg": "select hashtag, e, id, count(*) as degree from (select hashtag, e, u as id from pa union all select hashtag, e, v from pa) group by all",
    "clus": "select hashtag, e, id, case when cast(substr(id, 2) as integer) % 7 = 0 then (cast(substr(id, 2) as integer) + month(e)) % 3 else cast(substr(id, 2) as integer) % 4 end as c from deg",
    "attrs": "select 'u' || s_suppkey as id, n_name as category, case when s_acctbal < 0 then -1e0 else round(abs(s_acctbal) * 100) end as followers, cast(s_nationkey * 37 + s_suppkey as double) as followees, cast(p.posts as double) as posts from supplier join nation on s_nationkey = n_nationkey left join (select author, count(*) as posts from posts group by all) p on p.author = 'u' || s_suppkey",
    "matched": "select n.hashtag, n.e, n.id, a.category, a.followers, a.followees, a.posts from nodes n join attrs a on a.id = n.id where n.part = 'influencer' and a.followers >= 0 and a.followees >= 0 and a.posts >= 0",
    "cps": "select hashtag, d as cp from daily where (d - date '1970-01-01') % 11 = 0",
    "means": "select w.hashtag, w.e, cast(w.e - 30 as date) as s, count(*) as n, avg(x.v) as now, sum(x.mentions) as total, coalesce((select avg(cast(y.mentions as double)) from daily y where y.hashtag = w.hashtag and y.d > w.e - 60 and y.d <= w.e - 30), 0e0) as bef from ends w join sl x on x.hashtag = w.hashtag and x.e = w.e group by all having count(*) >= 9",
    "pred": "select hashtag, e, case when now - bef >= 0.2e0 and (bef = 0 or now >= 1.1e0 * bef) then 1 else 0 end as label, (total * 37) % 101 as score, ((total * 37) % 101) / 1e2 as proba, case when (total * 37) % 101 >= 50 then 1 else 0 end as y_pred from means",
    "samples": "select hashtag, e, label, cast(score as double) as ts_a, cast(score % 7 as double) as ts_b, case when score % 3 <> 0 then score / 1e1 end as net_c from pred",
    "tagrate": "select hashtag, count(*) as n, sum(label) as bursts, avg(cast(label as double)) as rate from pred group by all",
}


def with_views(sql: str) -> str:
    """A query with the views it names, directly or through others."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL:
            if name not in need and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                need.add(name)
                visit(SQL[name])

    visit(sql)
    own = [f"{name} as ({SQL[name]})" for name in SQL if name in need]
    more = re.match(r"\s*with\s+(recursive\s+)?", sql)
    if more:
        sql = ", " + sql[more.end() :] if own else sql
    head = "with recursive " if more and more.group(1) else "with "
    return (head + ", ".join(own) + " " + sql) if own else sql


def day(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d') as {name}"


def num(expr: str, name: str) -> str:
    return f"round(cast({expr} as double) + 1e-10, 6) + 0e0 as {name}"


def whole(expr: str, name: str) -> str:
    return f"cast({expr} as bigint) as {name}"


def shown(df: DataFrame) -> DataFrame:
    """Days as text, whole numbers as long, doubles rounded to six places without a negative zero (a little above, so that engines agree on halves)."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.round(c.cast("double") + F.lit(1e-10), 6) + F.lit(0.0)
        cells.append(c.alias(f.name))
    return df.select(*cells)
