"""Mixing sources to target weights over a time-varying curriculum.

Targets: sources share the budget by weight; none gets more than `cap` times
its size, and what is cut off is shared again by weight among the others.

Schedules: each source has a weight over the run's time from 0 to 1, piecewise
linear between knots. Its integral, scaled to the source's target, is the tokens
that the source has been asked for by each time.

Positions: a source's documents stand in a hashed order, read up to `cap` times
over. Each read begins after the tokens of all reads before it; the integral is
inverted at the read's middle token, which gives its training position. A read
whose middle is asked for at no time isn't taken: so the schedule's demand, which
ends at the target, says how often each document is taken. Reads are then
range-sorted by position.

Running totals are taken in two levels (sums of hashed bins, then rows of one
bin), and equal rows are counted before they meet, so no task gets a whole source
or all copies of a document.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threshmill.llm.common import cut

BINS = 4096
CAP = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, share: Fraction = Fraction(1)) -> dict[str | None, Fraction]:
    """Target of each source, exactly. Sources stand by code point, null last, and weigh `weights`, repeating."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    budget = share * sum(size.values())
    out: dict[str | None, Fraction] = {}
    free = dict(weight)
    while free:
        unit = budget / sum(free.values())
        over = [s for s in free if unit * free[s] > cap * size[s]]
        if not over:
            return out | {s: unit * w for s, w in free.items()}
        for s in over:
            out[s] = Fraction(cap * size[s])
            budget -= out[s]
            del free[s]
    return out


#: Sources at most; their summaries come to the driver, and up to FEW_SOURCES go back as a broadcast.
MOST_SOURCES, FEW_SOURCES = 1_000_000, 10_000
#: Schedules of the sources in turn: (time, weight) of each knot. Falling, even, and rising late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
SEGMENT = "struct<t0:double,t1:double,w0:double,w1:double,c0:double,c1:double>"


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, ...]]:
    """The pieces of a schedule (begin, end, weight at either, integral at either), scaled to an integral of one."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)) or any(w < 0 for _, w in knots):
        raise ValueError("a schedule goes from time 0 to 1 with weights of 0 or more")
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total = sum(area)
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    out, done = [], 0.0
    for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
        after = 1.0 if i == len(area) - 1 else done + area[i] / total
        out.append((a[0], b[0], a[1] / total, b[1] / total, done, after))
        done = after
    return out


def demand_inverse(share: Column, pieces: Column) -> Column:
    """The time by which a schedule has asked for that share (0 to 1) of its target."""
    piece = F.try_element_at(F.filter(pieces, lambda s: (share <= s["c1"]) & (s["c1"] > s["c0"])), F.lit(1))
    rest = F.greatest(share - piece["c0"], F.lit(0.0))
    half_slope = (piece["w1"] - piece["w0"]) / (2 * (piece["t1"] - piece["t0"]))
    root = piece["w0"] + F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 4 * half_slope * rest, F.lit(0.0)))
    return F.least(piece["t0"] + F.when(root > 0, 2 * rest / root).otherwise(0.0), piece["t1"])


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with what the mix takes of it and where.

    Returns doc_id, the columns named in carry (narrow ones: they are written
    once more), size, source_size, target (its source's), positions (of its
    reads, in [0, 1]), copies, taken (size * copies) and position (of the first
    read; null if none), range-sorted by position. The i-th source has the i-th
    schedule, repeating.

    Null texts have size 0; a null source is a source. Documents of size 0 are
    read where a document would begin, those of sources without words not at
    all. Equal rows are ranked by a running number and are alike, so reruns
    agree, however the rows are dealt to tasks. An empty table gives no rows.
    More than MOST_SOURCES sources raise an error.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    more = [c for c in carry if c != "doc_id"]
    # narrow rows, written once: the texts are read and their words counted a single time, and a row keeps the number of its part
    rows = cut(docs.select("doc_id", *more, F.col("source").alias("__source"), word_count(text).alias("size"), F.xxhash64("doc_id", text, F.lit(5)).alias("__h"), F.spark_partition_id().alias("__part")))
    sizes = rows.groupBy("__source").agg(F.sum("size").alias("s")).limit(MOST_SOURCES + 1).collect()  # one row for each source
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = targets([(r["__source"], r.s) for r in sizes], weights, cap)
    order = sorted(((r["__source"], r.s) for r in sizes), key=lambda x: (x[0] is None, x[0] or ""))
    pieces = [segments(x) for x in schedules]
    plan = spark.createDataFrame([(source, i, size, float(goal[source]), pieces[i % len(pieces)]) for i, (source, size) in enumerate(order)], f"__plan string, __sid int, source_size long, target double, __pieces array<{SEGMENT}>")
    plan = F.broadcast(plan) if len(order) <= FEW_SOURCES else plan
    rows = rows.join(plan, F.col("__source").eqNullSafe(F.col("__plan")))
    # equal rows of a part are one unit
    unit = ["__sid", "__h", "size", "__part"]
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*unit).orderBy("doc_id")) - 1)
    units = rows.groupBy(*unit).agg((F.count("*") * F.col("size")).alias("__words")).withColumn("__bin", F.shiftrightunsigned("__h", 52).cast("int"))
    # sums of bins: at most BINS rows for a source, however large it is
    bins = units.groupBy("__sid", "__bin").agg(F.sum("__words").alias("__bin_words"))
    running = Window.partitionBy("__sid").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select("__sid", "__bin", F.coalesce(F.sum("__bin_words").over(running), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__sid", "__bin").orderBy("__h", "size", "__part").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("__inner", F.coalesce(F.sum("__words").over(within), F.lit(0))).join(starts, ["__sid", "__bin"]).select(*unit, (F.col("__start") + F.col("__inner")).alias("__unit_start"))
    out = rows.join(placed, unit).withColumn("__before", F.col("__unit_start") + F.col("__i") * F.col("size"))
    middle = lambda p: F.col("__before") + F.col("size") / 2 + p * F.col("source_size")
    reads = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda p: F.when(middle(p) < F.col("target"), demand_inverse(middle(p) / F.col("target"), F.col("__pieces"))))
    out = out.withColumn("positions", F.filter(reads, lambda x: x.isNotNull()))
    copies = F.size("positions")
    return out.select("doc_id", *more, "size", "source_size", "target", "positions", copies.alias("copies"), (F.col("size") * copies).alias("taken"), F.try_element_at("positions", F.lit(1)).alias("position")).orderBy("position", "doc_id")


def passes(mixed: DataFrame) -> DataFrame:
    """One row for each read that the mix takes, with its number and its own position, range-sorted: the training order."""
    return mixed.drop("position").select("*", F.posexplode("positions").alias("pass", "position")).orderBy("position", "doc_id", "pass")
