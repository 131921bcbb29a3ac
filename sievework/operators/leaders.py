"""Leader clustering in order, by rounds over all records at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.components import written


def first_leaders(ties: DataFrame, keys: list[str], pos: str = "pos", max_rounds: int = 10_000) -> DataFrame:
    """(pos, group_pos) for each record of ties, a table of (pos, *keys): the keys under which a record can be matched.

    In order of pos, a record joins the least leader that shares a key with it, or else leads a group itself. In each
    round, the records that come first among the open ones under all of their keys lead; they and what shares a key
    with them are settled. So a key has one leader at most, nothing is compared in pairs, and a round is a few
    aggregates and joins that shrink with what is open. Rounds grow with the longest chain of records each of which
    waits for the one before it, not with the size of a key: a key with any number of records is settled with its first.

    Rows with a null in pos or a key tie nothing; repeated rows count once; an empty table gives an empty one. Records
    need different positions.
    """
    kind = dict(ties.dtypes)[pos]
    ties = written(ties.select(F.col(pos).alias("_pos"), *keys).dropna().distinct())
    open_, led, rounds = ties, [], 0
    while not open_.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"leaders did not settle in {max_rounds} rounds")
        rounds += 1
        least = open_.groupBy(*keys).agg(F.min("_pos").alias("_least"))
        own = open_.join(least, keys).groupBy("_pos").agg(F.bool_and(F.col("_least") == F.col("_pos")).alias("_leads")).where("_leads").select("_pos")
        taken = written(open_.join(own, "_pos").withColumnRenamed("_pos", "_leader"))
        gone = open_.join(taken.select(*keys), keys, "left_semi").select("_pos").distinct()
        open_ = written(open_.join(gone, "_pos", "left_anti"))
        led.append(taken)
    if not led:
        return ties.sparkSession.createDataFrame([], f"{pos} {kind}, group_pos {kind}")
    # a leader may come behind a record of its key that an earlier one had settled
    met = ties.join(reduce(DataFrame.unionByName, led), keys).where("_leader <= _pos")
    return met.groupBy(F.col("_pos").alias(pos)).agg(F.min("_leader").alias("group_pos"))
