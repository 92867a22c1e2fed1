"""Ingestion of an edge stream into a segmented log.

Each micro-batch writes a folder of its own, named after the batch, and a row that says where its sequence numbers end.
A batch that is replayed after a failure overwrites its own folder and starts from the same number, so the log is the
same however often the query was restarted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.sequence import number_rows
from graphloom.operators.storage import assign_segments, expired_segments, segment_meta
from graphloom.runtime import remove

_ENDS = T.StructType([T.StructField("last_seq", T.LongType()), T.StructField("schema", T.StringType())])


def _last_before(spark: SparkSession, path: str, batch: int) -> int:
    if batch == 0:
        return 0
    return spark.read.schema(_ENDS).parquet(f"{path}/ends/batch={batch - 1}").first()["last_seq"]


def ingest(stream: DataFrame, path: str, checkpoint: str, order: list[str], max_edges: int = 1_000_000, **trigger: object) -> StreamingQuery:
    """Start writing ``stream`` (``src``, ``dst``, ``etype``, ``weight``, ``ts`` and the columns of ``order``) to ``path``.

    Rows of a batch are numbered in ``order``, after those of the batches before. ``trigger`` goes to the query's
    trigger; ``availableNow=True`` takes what is there and ends, as a drain before a shutdown does.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        first = _last_before(spark, path, batch) + 1
        numbered = assign_segments(number_rows(rows, order, "seq", first), max_edges)
        out = numbered.select("seq", "ts", "src", "dst", "etype", "weight", "segment_id")
        out.write.mode("overwrite").partitionBy("segment_id").parquet(f"{path}/log/batch={batch}")
        # a batch without rows leaves no file to tell a schema by
        last = spark.read.schema(out.schema).parquet(f"{path}/log/batch={batch}").agg(F.max("seq")).first()[0] or first - 1
        spark.createDataFrame([(last, out.schema.json())], _ENDS).coalesce(1).write.mode("overwrite").parquet(f"{path}/ends/batch={batch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log written so far, which may have no rows; a filter on ``segment_id`` prunes folders."""
    told = spark.read.schema(_ENDS).parquet(f"{path}/ends").select("schema").first()
    return spark.read.schema(T.StructType.fromJson(json.loads(told["schema"]))).parquet(f"{path}/log")


def prune_log(spark: SparkSession, path: str, cutoff: Column) -> int:
    """Delete the files of closed segments created before ``cutoff``; how many segments that were.

    A batch that is replayed afterwards brings back its own part of them.
    """
    gone = expired_segments(segment_meta(read_log(spark, path)), cutoff).select("segment_id").collect()
    for row in gone:
        remove(spark, f"{path}/log/batch=*/segment_id={row['segment_id']}")
    return len(gone)


def windowed_popularity(stream: DataFrame, at: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Edges per target and event-time window; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
