"""Connected components and chains of links between 64-bit keys, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshmill.llm.common import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(key, label) of every key in links(a, b); label is the smallest key that can be reached.

    Each round takes the smallest label among a key's neighbours, then follows
    labels once (pointer jumping), so long chains end in few rounds. Sums and
    minima are combined before each shuffle; the lineage is cut each round.
    Empty links give no rows.
    """
    both = cut(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    labels = cut(labels)
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "key").select("key", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        jump = step.select(F.col("key").alias("label"), F.col("label").alias("next"))
        moved = cut(step.join(jump, "label", "left").select("key", F.least("label", "next").alias("label"), "old"))
        discard(labels, step)
        labels = moved
        if labels.where("label <> old").isEmpty():
            discard(both)
            return labels.select("key", "label")


def chains(links: DataFrame) -> DataFrame:
    """(id, head) of every id in links(id, before), where an id has at most one before it and one after it; head is the first of its chain, of a ring the smallest.

    Doubling: each round an id looks at what stands twice as far before it, so a
    chain of n ids takes about log n rounds. What has found its head no longer
    joins. If a round settles nothing, only rings are left. Empty links give no
    rows.
    """
    heads = links.select(F.col("before").alias("id")).join(links.select("id"), "id", "left_anti").distinct().select("id", F.col("id").alias("head"), F.lit(True).alias("done"))
    state = cut(heads.unionByName(links.select("id", F.col("before").alias("head"), F.lit(False).alias("done"))))
    open_ids = state.where("NOT done").count()
    while open_ids:
        there = state.select(F.col("id").alias("head"), F.col("head").alias("further"), F.col("done").alias("settled"))
        moved = state.where("NOT done").select("id", "head").join(there, "head").select("id", F.col("further").alias("head"), F.col("settled").alias("done"))
        after = cut(state.where("done").unionByName(moved))
        discard(state)
        state, before, open_ids = after, open_ids, after.where("NOT done").count()
        if open_ids == before:
            rings = links.join(state.where("NOT done").select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("before").alias("b"))
            state = cut(state.where("done").select("id", "head", "done").unionByName(components(rings).select(F.col("key").alias("id"), F.col("label").alias("head"), F.lit(True).alias("done"))))
            break
    return state.select("id", "head")
