"""Connected components by contraction, in joins whose hot keys Spark can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.llm.staging import table


def components(links: DataFrame) -> DataFrame:
    """links(a, b), a written table -> (node, label), a written table: one label for all nodes that reach each other.

    In a round every node moves to the first among itself and its neighbours, by a hash that is
    another in each round, and links become links between where their ends went; nodes that keep
    links go on.  The order being random, rounds grow as the logarithm of the nodes.  At the end
    the moves are followed from the last round, which has the fewest, to the first.  A hub is a
    hot key only of joins between two shuffles, whose partitions can be split, and of partial
    minima.  No links give no rows.
    """
    open_, moves = table(_apart(links), "links"), []
    while not moves or not open_.isEmpty():
        placed = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("place"), F.col(c).alias("to"))
        both = open_.union(open_.select("b", "a"))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min(placed("b")).alias("low"))
        moves.append(table(low.select("node", F.least("low", placed("node"))["to"].alias("to")), "moves"))
        one, two = (moves[-1].select(F.col("node").alias(f"{x}_node"), F.col("to").alias(f"{x}_to")) for x in "ab")
        moved = open_.join(one, F.col("a") == F.col("a_node")).join(two, F.col("b") == F.col("b_node"))
        open_ = table(_apart(moved.select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))), "links")
    labels = moves.pop().select("node", F.col("to").alias("label"))
    while moves:
        last = labels.select(F.col("node").alias("to"), "label")
        labels = moves.pop().join(last, "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    return table(labels, "labels")


def _apart(links: DataFrame) -> DataFrame:
    """Each link of two nodes once."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
