"""Files, streams and synthetic data."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions.scalar import draw, lenient_int, suffix_int
from graphloom.operators import storage
from graphloom.sources import edges, files
from graphloom.streaming import ingest as streaming
from tests.conftest import rows


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_follows_keep_repetitions(spark, tmp_path):
    path = put(tmp_path, "f.csv", "from_profile_id,to_profile_id,inserted_at\n1,2,x\n1,2,y\n,3,z\n")
    assert rows(files.follows(spark, path), "src", "dst", "etype", "weight") == [("profile:1", "profile:2", "follow", 1.0)] * 2


def test_likes_are_distinct_both_ways(spark, tmp_path):
    path = put(tmp_path, "l.csv", "profile_id,post_id\n1,7\n1,7\n2,7\n")
    assert rows(files.likes(spark, path), "src", "dst") == [("post:7", "profile:1"), ("post:7", "profile:2"), ("profile:1", "post:7"), ("profile:2", "post:7")]
    assert files.duplicate_likes(spark, path).first()[0] == 1


def test_posts_read_leniently(spark, tmp_path):
    path = put(tmp_path, "p.csv", "post_id,profile_id,likes_count,reposts_count,category,type,inserted_at\n1,2,12x,,c,t,d\n2,2,x,3,c,t,d\n")
    assert rows(files.posts(spark, path), "post_id", "likes_count", "reposts_count") == [("1", 12, 0), ("2", 0, 3)]


def test_professor_graph(spark, tmp_path):
    a = put(tmp_path, "a.csv", "profile_id,professor_id,nota,inserted_at\n1,9,5,x\n1,9,4,y\n")
    b = put(tmp_path, "b.csv", "profile_id,professor_id,post_id,likes_count,type,inserted_at\n1,9,3,0,t,x\n")
    assert rows(files.professor_graph(spark, a, b), "src", "dst", "etype") == [
        ("professor:9", "profile:1", "avaliou"), ("professor:9", "profile:1", "postou"), ("profile:1", "professor:9", "avaliou"), ("profile:1", "professor:9", "postou"),
    ]
    c = put(tmp_path, "c.csv", "id,nome_professor,instituto,nota,qts_avaliacao,instituto_id\n1,x,i,3,2,1\n2,y,i,5,z,1\n")
    assert [(r["id"], r["nota"], r["qts_avaliacao"]) for r in files.professors(spark, c).collect()] == [("2", 5, 0), ("1", 3, 2)]


def test_interaction_files(spark, tmp_path):
    put(tmp_path, "users.tsv", "user_idx\tprofile_id\n0\t10\n\n")
    put(tmp_path, "items.tsv", "item_idx\ttipo\tdb_id\n5\tpost\t77\n")
    put(tmp_path, "interactions.tsv", "user_idx\titem_idx\tweight\tinserted_at\n0\t5\t1.5\t2024-01-01 \n")
    assert rows(files.interactions(spark, str(tmp_path)), "src", "dst", "weight") == [("profile:10", "post:77", 1.5)]
    put(tmp_path, "interactions.tsv", "user_idx\titem_idx\tweight\tinserted_at\n1\t5\t1.5\tx\n")
    with pytest.raises(Exception, match="unknown user or item"):
        files.interactions(spark, str(tmp_path)).collect()


def test_adjacency_lists(spark, tmp_path):
    path = put(tmp_path, "train.txt", "1 7 8\n2\n3 7\n")
    assert rows(files.adjacency_lists(spark, path), "src", "dst") == [("user:1", "item:7"), ("user:1", "item:8"), ("user:3", "item:7")]


def test_synthetic_is_reproducible(spark):
    a = rows(edges.synthetic(spark, 10, 10, 200))
    assert a == rows(edges.synthetic(spark, 10, 10, 200)) and {r[3] for r in a} == {0.5, 1.0, 1.5, 2.0}


def test_scalars(spark):
    df = spark.createDataFrame([("42|7|3", "item:12", "+5x"), (None, "item:x", None), ("", "user:1", "99999999999999999999")], "k string, v string, n string")
    assert rows(df.select(suffix_int(F.col("v"), "item"))) == [(None,), (None,), (12,)]
    assert rows(df.select(lenient_int(F.col("n")))) == [(0,), (0,), (5,)]
    assert spark.range(1).select(draw(42, 7, 3)).first()[0] == 843983919


def test_stream_equals_batch_and_replays(spark, tmp_path):
    schema = "src string, dst string, etype string, weight double, ts timestamp, n bigint"
    data = [(f"u{k % 3}", f"i{k}", "x", 1.0, None, k) for k in range(10)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(data[:6], schema).coalesce(1).write.parquet(source)
    run = lambda: streaming.ingest(spark.readStream.schema(schema).parquet(source), out, f"{out}/c", ["n"], 4, availableNow=True).awaitTermination()
    run()
    assert streaming.read_log(spark, out).count() == 6
    spark.createDataFrame(data[6:], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = rows(streaming.read_log(spark, out), "seq", "dst", "segment_id")
    assert got == [(k + 1, f"i{k}", k // 4) for k in range(10)]


def test_stream_survives_batches_without_rows_and_is_pruned(spark, tmp_path):
    schema = "src string, dst string, etype string, weight double, ts timestamp, n bigint"
    source, out = tmp_path / "in", str(tmp_path / "out")
    log = lambda df: storage.edge_log(df, F.col("src"), F.col("dst"), F.col("etype"), F.col("weight"), F.col("ts"), F.col("n"))
    run = lambda: streaming.ingest(log(spark.readStream.schema(schema).parquet(str(source))), out, f"{out}/c", ["n"], 2, availableNow=True).awaitTermination()
    counts = []
    for start, end in ((0, None), (0, "x"), (5, None), (5, "y")):
        spark.createDataFrame([("a", end, "x", 1.0, datetime(2024, 1, 1 + k), k) for k in range(start, start + 5)], schema).coalesce(1).write.mode("append").parquet(str(source))
        run()
        counts.append(streaming.read_log(spark, out).count())
    assert counts == [0, 5, 5, 10]
    assert rows(streaming.read_log(spark, out), "seq", "segment_id") == [(k + 1, k // 2) for k in range(10)]
    assert streaming.prune_log(spark, out, F.lit("2024-01-04").cast("timestamp")) == 2
    assert rows(streaming.read_log(spark, out).select("segment_id").distinct()) == [(2,), (3,), (4,)]
    assert not list((tmp_path / "out").glob("log/batch=*/segment_id=0"))


@pytest.mark.parametrize("name, line", [("users", "0\t10\t5"), ("users", "x\t10"), ("items", "5\tpost"), ("items", "5\tpost\t7.5"), ("interactions", "0\t5\t1.5"), ("interactions", "0\t5\tx\tt")])
def test_interaction_files_are_strict(spark, tmp_path, name, line):
    good = {"users": "0\t10", "items": "5\tpost\t77", "interactions": "0\t5\t1.5kg\t2024"}
    for other, text in good.items():
        put(tmp_path, f"{other}.tsv", f"any\theader\n{text}\n" + (f"{line}\n" if other == name else ""))
    with pytest.raises(Exception, match="no whole number|columns|a weight is no number"):
        files.interactions(spark, str(tmp_path)).collect()
    put(tmp_path, f"{name}.tsv", f"any\theader\n\n{good[name]}  \n")
    assert rows(files.interactions(spark, str(tmp_path)), "src", "weight") == [("profile:10", 1.5)]


def test_windowed_popularity(spark, tmp_path):
    schema = "src string, dst string, ts timestamp"
    spark.sql("select 'u' src, 'i' dst, timestamp '2024-01-01 10:00:00' ts union all select 'u', 'i', timestamp '2024-01-03 10:00:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streaming.windowed_popularity(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts").writeStream.outputMode("complete").format("memory").queryName("pop").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pop").count() == 2


def test_edges_need_both_ends(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("a", "b")], "s string, d string")
    log = storage.edge_log(df, F.col("s"), F.col("d"), F.lit("x"), F.lit(None))
    assert rows(log) == [("a", "b", "x", 1.0)]
