"""``python -m graphloom demo``: tables to graph to embeddings to recommendations, end to end."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.functions.scalar import vertex_kind
from graphloom.graph import Graph
from graphloom.runtime import scratch
from graphloom.sources import edges, files


def demo(args: argparse.Namespace) -> None:
    spark = SparkSession.builder.appName("graphloom-demo").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tsv = os.path.exists(os.path.join(args.data, "interactions.tsv"))
    log = files.interactions(spark, args.data) if tsv else edges.interactions(spark, args.data)
    with Graph(spark, Config("demo", "bipartite", mode="batch")) as graph:
        graph.insert_edges(log.select("src", "dst", "etype", "weight"), ["src", "dst", "etype", "weight"])
        print(f"edges {graph.edge_count()}, vertices {graph.vertex_count()}")
        graph.vertices.groupBy(vertex_kind(F.col("id")).alias("kind")).count().orderBy("kind").show()
        path, began = scratch(spark, "demo-model"), time.perf_counter()
        info = graph.train_embeddings(path, "profile:", embedding_dim=args.dim, layers=args.layers, epochs=args.epochs)
        print(f"trained in {time.perf_counter() - began:.1f} s: {info}")
        graph.load_embeddings(path)
        who = args.profile or graph.edges.where(F.col("src").startswith("profile:")).groupBy("src").count().orderBy(F.col("count").desc(), "src").first()["src"]
        best = graph.recommend(who, algorithm="lightgcn", top_k=args.top_k, exclude_seen=not args.include_seen)
        seen = graph.neighbors(who).select(F.col("neighbour").alias("id"), F.lit("*").alias("seen"))
        table = best.join(seen, "id", "left").select("rank", "id", F.round("score", 4).alias("score"), F.coalesce("seen", F.lit("")).alias("seen"))
        print(f"for {who} (* had before):")
        table.orderBy("rank").show(args.top_k, truncate=False)
        best.groupBy(vertex_kind(F.col("id")).alias("kind")).count().orderBy("kind").show()


def main() -> None:
    parser = argparse.ArgumentParser(prog="python -m graphloom", description=__doc__)
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("demo", help="recommendations for a profile")
    p.add_argument("--data", required=True, help="folder with users, items and interactions as .tsv or .parquet")
    p.add_argument("--profile", help="id of the vertex asked for, profile:N; the most active one by default")
    p.add_argument("--top-k", type=int, default=20)
    p.add_argument("--dim", type=int, default=64)
    p.add_argument("--layers", type=int, default=3)
    p.add_argument("--epochs", type=int, default=100)
    p.add_argument("--include-seen", action="store_true")
    p.set_defaults(run=demo)
    args = parser.parse_args()
    args.run(args)


if __name__ == "__main__":
    main()
