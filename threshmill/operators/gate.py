"""Ordered acceptance per key. Operators G1, G4, G5, G6, G7, G8, J11, F34, P5."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups for which a source is canonical, and those in which it is capped.
CDC_CANONICAL, CDC_CAPPED = frozenset({"21", "29", "31"}), frozenset({"17", "19", "33", "37", "39", "45", "47", "49", "51"})
OSHA_CANONICAL, OSHA_CAPPED = frozenset({"47", "49", "51", "53"}), frozenset({"17", "29", "31", "33", "37", "45"})
#: Shares and the items before they hold.
DOMAIN_SHARE, CAPPED_SHARE, BLS_SHARE, GRACE = 0.30, 0.15, 0.10, 4


@dataclass
class ShareGate:
    """G1: the state of one key: accepted items in all and of each domain."""

    group: str
    total: int = 0
    of_domain: dict[str, int] | None = None

    def limit(self, domain: str) -> float | None:
        """The largest share that the domain may have; below 0 it is blocked."""
        for root, canonical, capped in (("cdc.gov", CDC_CANONICAL, CDC_CAPPED), ("osha.gov", OSHA_CANONICAL, OSHA_CAPPED)):
            if (domain == root or domain.endswith("." + root)) and self.group not in canonical:
                return CAPPED_SHARE if self.group in capped else -1.0
        return BLS_SHARE if domain == "bls.gov" or domain.endswith(".bls.gov") else DOMAIN_SHARE

    def accept(self, domain: str | None) -> bool:
        domain = (domain or "").lower()
        self.of_domain = self.of_domain if self.of_domain is not None else {}
        share, limit = (self.of_domain.get(domain, 0) + 1) / (self.total + 1), self.limit(domain)
        if limit < 0 or (self.total >= GRACE and share > limit):
            return False
        self.total += 1
        self.of_domain[domain] = self.of_domain.get(domain, 0) + 1
        return True


def folded(df: DataFrame, key: str, order: Sequence[str], start: Callable[[Any], Any], step: Callable[[Any, tuple], tuple | None], schema: str) -> DataFrame:
    """Rows of each key in order, read one after the other with a state of the key: what step returns of each row, where it returns anything.

    A key is one task's, as each decision depends on the ones before it, but its
    rows are sorted by Spark and pass in batches: only the state is held.
    """
    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                own = None if row[0] is None or row[0] != row[0] else row[0]
                if own != now:
                    now, state = own, start(own)
                got = step(state, row)
                if got is not None:
                    out.append(got)
            yield pd.DataFrame({n: pd.Series([x[i] for x in out], dtype=object) for i, n in enumerate(names)})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def share_gate(df: DataFrame, key: str, domain: str, seq: str) -> DataFrame:
    """G1: each row with accepted, in order of seq within its key. Only key, domain and seq travel; a key's state is a count for each domain."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    start = lambda k: ShareGate(str(k)[:2])
    step = lambda gate, row: (row[0], row[2], gate.accept(row[1]))
    return folded(df.select(key, domain, seq), key, [seq], start, step, f"`{key}` {kinds[key]}, `{seq}` {kinds[seq]}, accepted boolean")


def budgeted(df: DataFrame, key: str, seq: str, accepted: Column, failed: Column, target: int, failures: int, unfetched: Column | None = None, fetches: int | None = None, topical: Column | None = None) -> DataFrame:
    """Rows up to and including the one that reaches the target, the failure budget or the budget of failed fetches. Within topical rounds failed fetches don't end a key's run; the next round does see them."""
    run = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    before = df.withColumn("__a", F.coalesce(F.sum(accepted.cast("int")).over(run), F.lit(0))).withColumn("__f", F.coalesce(F.sum(failed.cast("int")).over(run), F.lit(0)))
    open_ = (F.col("__a") < target) & (F.col("__f") < failures)
    if unfetched is None:
        return before.where(open_).drop("__a", "__f")
    round_ = topical if topical is not None else F.lit(None)
    before = before.withColumn("__r", round_).withColumn("__u", F.coalesce(F.sum(unfetched.cast("int")).over(run), F.lit(0)))
    # a topical round (a number) is judged as it stands when the round begins
    at_start = F.min("__u").over(Window.partitionBy(key, "__r"))
    before = before.withColumn("__seen", F.when(F.col("__r").isNull(), F.col("__u")).otherwise(at_start))
    return before.where(open_ & (F.col("__seen") < fetches)).drop("__a", "__f", "__r", "__u", "__seen")


def until_failures_in_row(df: DataFrame, key: str, seq: str, failed: Column, most: int = 10) -> DataFrame:
    """Rows up to and including the `most`-th failure in a row; a success starts anew."""
    w = Window.partitionBy(key).orderBy(seq)
    rows = df.withColumn("__f", failed).withColumn("__island", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__run", F.sum(F.when(F.col("__f"), 1).otherwise(0)).over(Window.partitionBy(key, "__island").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))
    stops = F.sum(F.when(F.col("__run") >= most, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__stop", F.coalesce(stops, F.lit(0))).where("__stop = 0").drop("__f", "__island", "__run", "__stop")


def concentration(df: DataFrame, key: str, publisher: str, document: str) -> DataFrame:
    """Items, share of the largest publisher, publishers and documents of each key, in two levels of sums."""
    per = df.groupBy(key, publisher).agg(F.count("*").alias("c"))
    top = per.groupBy(key).agg(F.sum("c").alias("n"), F.max("c").alias("m"), F.count("*").alias("n_publishers"))
    docs = df.groupBy(key).agg(F.countDistinct(document).alias("n_documents"))
    return top.join(docs, key).select(key, "n", (F.col("m") / F.col("n")).alias("top_share"), "n_publishers", "n_documents")


def replacement_reasons(n: Column, share: Column, publishers: Column, documents: Column, least: int = 15) -> Column:
    """The triggers joined, empty if none holds."""
    some = n > 0
    return F.array_join(F.array_compact(F.array(F.when(n < least, F.lit("under_yield")), F.when(some & (share > 0.7), F.lit("dominant_source")), F.when(some & (publishers < 2), F.lit("one_publisher")), F.when(some & (documents < 3), F.lit("few_documents")))), "; ")


def assign_reserves(primaries: DataFrame, reserves: DataFrame, group: str, order: str, rank: str) -> DataFrame:
    """The k-th under-yielding primary of a group takes its k-th reserve."""
    a = primaries.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    b = reserves.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(rank)))
    return a.join(b.withColumnsRenamed({c: f"reserve_{c}" for c in reserves.columns if c != group}), [group, "__k"], "left").drop("__k")


def assign_until_success(primaries: DataFrame, reserves: DataFrame, group: str, order: str, rank: str, success: str) -> DataFrame:
    """Primaries in order take reserves in rank until one succeeds; a failed reserve is used up. The k-th primary takes the k-th successful reserve, so it is G7 over the successful ones."""
    return assign_reserves(primaries, reserves.where(F.col(success)), group, order, rank)


def replaced(items: DataFrame, key: str, gone: DataFrame, replacement_for: str) -> DataFrame:
    """Items without those of replaced keys, unless they replace one themselves."""
    left = items.join(gone.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    return left.where(F.col("__k").isNull() | F.col(replacement_for).isNotNull()).drop("__k")


def resume_state(kept: Column, fetched: Column, extract_failed: Column) -> Column:
    """done, retry_extract, skip or retry."""
    return F.when(kept >= 1, "done").when((fetched > 5) & (extract_failed / fetched > 0.95), "retry_extract").when(fetched > 0, "skip").otherwise("retry")
