import datetime as dt
import gzip
import time

from pyspark.sql import functions as F

from pulseloom.sources import readers, sinks
from pulseloom.streaming import windows as streams


def test_csv_plain_and_gzip(spark, tmp_path):
    text = "timestamp_utc,epoch_seconds,username,post_id,shortcode,hashtag\n2024-01-01,1704067200,ann,p1,s1,Cats\n2024-01-01,,bob,p2,s2,Ünïcode\n"
    (tmp_path / "a.csv").write_text(text)
    with gzip.open(tmp_path / "b.csv.gz", "wt", encoding="utf-8") as f:
        f.write(text)
    for name in ("a.csv", "b.csv.gz"):
        rows = readers.read_posts(spark, f"{tmp_path}/{name}").collect()
        assert [(r.author, r.hashtag, r.post_epoch) for r in rows] == [("ann", "cats", 1704067200), ("bob", "ünïcode", None)]
    assert dict(readers.read_csv(spark, f"{tmp_path}/a.csv").dtypes)["epoch_seconds"] in ("int", "bigint")


def test_keyed_files_partitions_and_optional_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1), ("b", dt.date(2024, 2, 1), 2)], "hashtag string, window_end date, n int")
    sinks.write(df, f"{tmp_path}/w", partitions=("hashtag", "window_end"))
    sinks.write(df.where("hashtag = 'b'").withColumn("n", F.lit(5)), f"{tmp_path}/w", partitions=("hashtag", "window_end"))
    assert {(r.hashtag, r.n) for r in readers.read_windows(spark, f"{tmp_path}/w").collect()} == {("a", 1), ("b", 5)}
    df.coalesce(1).select("n").write.parquet(f"{tmp_path}/k")
    assert all(r.hashtag.startswith("part-") for r in readers.read_keyed_files(spark, f"{tmp_path}/k").collect())
    assert sinks.saved(spark, f"{tmp_path}/none") is None and sinks.saved(spark, f"{tmp_path}/w").count() == 2
    given = spark.createDataFrame([("2024-01-01", 7)], "Day string, N_Posts int")
    fallback = spark.createDataFrame([(dt.date(2024, 1, 1), 3)], "date date, total_posts_day long")
    assert readers.platform_totals(given, fallback).first().total_posts_day == 7.0
    assert readers.platform_totals(given.drop("Day"), fallback).first().total_posts_day == 3.0
    assert [r.hashtag for r in readers.master_list(spark.createDataFrame([("#B",), ("a ",), (None,), ("b",)], "hashtag string")).collect()] == ["a", "b"]


def test_registries(spark):
    log = spark.createDataFrame([("exp_007", 1), ("exp_010", 2)], "id string, x int")
    assert sinks.next_id(log, "id", "exp") == "exp_011" and sinks.next_id(log, "id", "ncv") == "ncv_001"
    out = sinks.upsert(log, spark.createDataFrame([("exp_010", 9)], "id string, x int"), ["id"])
    assert {tuple(r) for r in out.collect()} == {("exp_007", 1), ("exp_010", 9)}
    assert sinks.pending(log, out.where("x = 9"), ["id"]).count() == 1 and sinks.pending(log, None, ["id"]).count() == 2
    fixed = sinks.conform(log, {"x": ("string", None), "y": ("int", 4), "id": ("int", None)})
    assert fixed.columns == ["x", "y", "id"] and [tuple(r) for r in fixed.collect()] == [("1", 4, None), ("2", 4, None)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "b")], "source string, target string")
    assert {(r.u, r.v, r.w) for r in readers.graph_edges(edges).collect()} == {("a", "b", 1.0), ("b", "c", 1.0)}
    assert {r.id: r.degree for r in sinks.migrate_projection(edges.limit(2)).collect()} == {"a": 1, "b": 2, "c": 1}


def test_streaming_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 12), "a") for d in (1, 1, 2, 9)]
    spark.createDataFrame(rows, "ts timestamp, tag string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, tag string").parquet(f"{tmp_path}/in")
    for name, df in (("daily", streams.daily_counts(stream, "tag")), ("rolling", streams.rolling_counts(stream, "tag", 4, 2))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c-{name}").start()
        q.processAllAvailable()
        q.stop()
        time.sleep(0.1)
    assert {(r.tag, r.date, r.n) for r in spark.table("daily").collect()} == {("a", dt.date(2024, 1, 1), 2), ("a", dt.date(2024, 1, 2), 1)}
    assert spark.table("rolling").where("n = 3").count() >= 1
