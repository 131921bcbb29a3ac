"""Mixing sources to target weights: budgets over a domain - language - source tree.

The budget is divided from the root down by the nodes' weights. A node that cannot use its share, since its documents
do not hold that many tokens (times the epochs allowed), takes what it can; its siblings divide the rest by their
weights, and only what a whole subtree cannot use goes to that subtree's siblings. A leaf that is given more than one
epoch's tokens repeats its documents in epochs, each in its own seeded order; the last one is cut to a prefix.

All of it is DataFrame functions in whole numbers. Sums along a leaf's order are taken over ranges of the order first,
so that no task orders a whole leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import cut, join_bounded

LEVELS = ("domain", "lang", "source")
RANGES = 4096  # of a leaf's order
BROADCAST_LEAVES = 200_000
_BIG = "decimal(38,0)"


def n_tokens(text: Column) -> Column:
    """Runs of other characters than space, tab and line ends."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+")).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in an epoch: 60 bits."""
    said = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def weight_of(level: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(level == name, w).otherwise(out)
    return out.cast("long")


def divide(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (with w, cap, target: the parent's) with given: each one's part of target.

    The water level: sorted by cap / w, children are filled up as long as an even share by weight of what is left would
    be enough. Parts are rounded down to whole tokens.
    """
    big = lambda c: F.col(c).cast(_BIG)
    group = Window.partitionBy(*parent) if parent else Window.partitionBy()
    ordered = group.orderBy((big("cap") / big("w")).asc(), name)
    x = children.withColumn("used", F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    x = x.withColumn("left", F.sum("w").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    x = x.withColumn("full", big("cap") * big("left") <= big("w") * (big("target") - big("used")))
    x = x.withColumn("full", F.min("full").over(ordered))
    x = x.withColumn("rest", F.col("target") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0)))
    x = x.withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(group))
    return x.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.expr(f"cast(w as {_BIG}) * cast(rest as {_BIG}) div cast(open as {_BIG})").cast("long"))).drop("used", "left", "full", "rest", "open")


def leaf_plan(rows: DataFrame, weights: dict[str, dict[str, int]], budget: float, max_epochs: int, seed: int, default: int = 1) -> DataFrame:
    """A row for each leaf: tokens, given, epochs (whole ones), and the prefix of the next one.

    rows (doc_id, domain, lang, source, n_tokens) is read several times. budget: the share of all tokens to select.
    The prefix is given by its last document's (order, doc_id, n_tokens) and the tokens that are taken of that and of the
    rows that are equal to it in all three.
    """
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs).where("tokens > 0")
    goal = caps.select(F.floor(F.sum("tokens") * budget).cast("long").alias("all"), F.sum("cap").alias("most")).select(F.least("all", "most").alias("target"))
    targets = None
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(F.col(level), weights.get(level, {}), default)).where("w > 0")
        if targets is None:
            nodes = nodes.withColumn("one", F.lit(1)).join(goal.withColumn("one", F.lit(1)), "one").drop("one")
        else:
            nodes = nodes.join(targets, parent)
        targets = cut(divide(nodes, parent, level).select(*path, F.col("given").alias("target")))
    plan = leaves.join(targets.withColumnRenamed("target", "given"), list(LEVELS)).where("given > 0")
    plan = plan.withColumn("epochs", F.expr("given div tokens")).withColumn("part", F.expr("given % tokens"))
    plan = cut(plan)
    # the prefix: first the range of the order that it ends in, then the document
    placed = join_bounded(rows, plan.select(*LEVELS, "epochs", "part"), list(LEVELS), "inner", BROADCAST_LEAVES).where("part > 0")
    placed = placed.withColumn("order", order_key(seed, F.col("epochs"), F.col("doc_id"))).withColumn("range", F.expr(f"order div {(1 << 60) // RANGES}"))
    sums = placed.groupBy(*LEVELS, "range", "part").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).where("before < part and part <= before + n").select(*LEVELS, "range", "before")
    near = placed.join(ends, [*LEVELS, "range"])
    # equal rows as one, so that the prefix ends in a known number of their tokens
    near = near.groupBy(*LEVELS, "part", "before", "order", "doc_id", "n_tokens").agg(F.sum("n_tokens").alias("n"))
    one = Window.partitionBy(*LEVELS).orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(one), F.lit(0))).where("before < part and part <= before + n")
    last = near.select(*LEVELS, F.struct("order", "doc_id", "n_tokens").alias("last"), (F.col("part") - F.col("before")).alias("last_taken"))
    return cut(plan.join(last, list(LEVELS), "left"))


def leaf_rows(docs: DataFrame, domain: Column, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), name(domain).alias("domain"), name(F.col(lang)).alias("lang"), name(F.col(source)).alias("source"), n_tokens(F.col(text)).alias("n_tokens"))


def _copies_taken(tied: DataFrame, by: list[str], n: str) -> DataFrame:
    """tied, rows that are equal to the last of a prefix, with taken: whole ones first, one in part, null for the others."""
    before = (F.row_number().over(Window.partitionBy(*by).orderBy(n)) - 1) * F.col(n)
    return tied.withColumn("taken", F.when(before < F.col("last_taken"), F.least(F.col(n), F.col("last_taken") - before)))


def chosen(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows with a row for each epoch that takes part of them: epoch, order and taken (tokens)."""
    x = join_bounded(rows, plan.select(*LEVELS, "epochs", "part", "last", "last_taken"), list(LEVELS), "inner", BROADCAST_LEAVES)
    x = x.withColumn("epoch", F.explode(F.expr("sequence(cast(0 as bigint), epochs)"))).withColumn("order", order_key(seed, F.col("epoch"), F.col("doc_id")))
    own = F.struct("order", "doc_id", "n_tokens")
    at_end = (F.col("epoch") == F.col("epochs")) & F.coalesce(own == F.col("last"), F.lit(False))
    whole = x.where(~at_end).withColumn("taken", F.when((F.col("epoch") < F.col("epochs")) | (own < F.col("last")), F.col("n_tokens")))
    tied = _copies_taken(x.where(at_end), list(LEVELS), "n_tokens")
    return whole.unionByName(tied).where("taken is not null").drop("epochs", "part", "last", "last_taken")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: float, max_epochs: int = 4, seed: int = 7, **columns) -> DataFrame:
    """doc_id, domain, lang, source, epoch, order, n_tokens, taken: what each epoch of each leaf takes of its documents.

    weights: for each level a whole number for each name (1 where absent, 0 to leave out). A null name is an empty
    one. Leaves without tokens are left out. Documents without tokens are taken where they stand in the order before
    the end. Rows with the same doc_id and tokens are alike: if a prefix ends in them, as many as it needs are taken
    whole and one is cut. An empty table gives an empty table; other columns of docs are ignored.
    """
    rows = cut(leaf_rows(docs, domain, **columns))
    plan = leaf_plan(rows, weights, budget, max_epochs, seed)
    return chosen(rows, plan, seed).select("doc_id", *LEVELS, "epoch", "order", "n_tokens", "taken")


def select_documents(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: float, seed: int = 7, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The documents that one epoch at most takes, whole, with the columns of docs; the leaf's last one is kept if any of it is taken.

    Null names are empty ones, null texts have no tokens; a null doc_id is ordered as an empty one. Leaves without tokens are left out.
    Of rows that are alike at a prefix's end, as many stay as the prefix needs. An empty table stays empty; other columns, of whatever name, come along as they are.
    """
    rows = cut(leaf_rows(docs, domain, text, lang, source, doc_id))
    plan = leaf_plan(rows, weights, budget, 1, seed)
    own = docs.columns
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    x = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(own)), name(domain).alias("domain"), name(F.col(lang)).alias("lang"), name(F.col(source)).alias("source"), F.col(doc_id).cast("long").alias("_doc"), n_tokens(F.col(text)).alias("_n"))
    x = join_bounded(x, plan.select(*LEVELS, "epochs", "last", "last_taken"), list(LEVELS), "inner", BROADCAST_LEAVES)
    key = F.struct(order_key(seed, F.col("epochs"), F.col("_doc")).alias("order"), F.col("_doc").alias("doc_id"), F.col("_n").alias("n_tokens"))
    at_end = (F.col("epochs") == 0) & F.coalesce(key == F.col("last"), F.lit(False))
    whole = x.where(~at_end & ((F.col("epochs") > 0) | (key < F.col("last"))))
    tied = _copies_taken(x.where(at_end), list(LEVELS), "_n").where("taken is not null")
    return whole.unionByName(tied.drop("taken")).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(own)))
