"""Connected components of links between records."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """Sees to it that there is a checkpoint folder: the one that spark.checkpoint.dir names; one of ours only where that is unset in a local session, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievework-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes df once, in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df, computed once into a table in the checkpoint folder and read from there.

    For loops: a checkpoint keeps the estimates of its plan, and those of a loop's joins multiply each other until the
    optimizer is busy with nothing else; a table is as large as it is. It stays until the folder is emptied.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_bounded(left: DataFrame, right: DataFrame, on: str | list[str], how: str, most: int = 100_000) -> DataFrame:
    """Joins with right broadcast if it is counted to have `most` rows at most, else by an exchange of both sides."""
    few = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if few else right, on, how)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of links; root is the smallest node of its component. Nulls link nothing.

    Large-star and small-star in turn: each node hangs its larger neighbours, then its smaller ones, on the smallest
    node around it. Rounds grow with the logarithm of the nodes, whatever the shape; links never become more. The
    smallest neighbour is an aggregate that starts before the exchange, and a node with very many links is an ordinary
    skewed join. Each round is cut by a checkpoint, and the rounds end when the links stay the same.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a).isNotNull()) & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    pairs = checkpoint(pairs)
    last = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = checkpoint(small.distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
