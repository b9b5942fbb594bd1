"""Which sources, reserves and threads fill the places of a group. Operators G9-G12, S16, S23, S24, J20, J21, U1, U2, F26."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threshmill.operators.select import first_per_key, gap, top_per_group, with_floor

#: Groups that health sources serve, and kinds of associations that set standards.
HEALTH_GROUPS = ("29", "31")
STANDARD_KINDS = ("certification_board", "licensing_body", "standards_body")
#: The names of the three baseline publishers.
BASELINE_PUBLISHERS = {
    "bls.gov": "U.S. Bureau of Labor Statistics",
    "osha.gov": "U.S. Occupational Safety and Health Administration",
    "cdc.gov": "U.S. Centers for Disease Control and Prevention",
}


def topped_up(dropped: DataFrame, reserves: DataFrame, group: str, slot: str, reserve: str, rank: str, kept: str, populated: int, target: int, least: int = 15) -> DataFrame:
    """What fills dropped places: slot (null in the second phase), reserve, group and phase.

    First each group's slots, in order, take its reserves by rank until one
    yields `least`; a reserve that was tried isn't tried again. Then, while
    fewer than target places are filled, reserves that weren't tried follow from
    all groups, by group and rank.
    """
    slots = dropped.select(group, slot).withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(slot)))
    w = Window.partitionBy(group).orderBy(rank, reserve)
    good = F.col(kept) >= least
    order = reserves.select(group, reserve, rank, kept).withColumn("__before", F.coalesce(F.sum(good.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = slots.groupBy(group).agg(F.count("*").alias("__wanted"))
    tried = order.join(wanted, group, "left").withColumn("__tried", F.col("__before") < F.coalesce("__wanted", F.lit(0)))
    first = tried.where(F.col("__tried") & good).withColumn("__k", F.col("__before") + 1).join(slots, [group, "__k"]).select(group, F.col(slot).alias("slot"), reserve, F.lit(1).alias("phase"))
    left = max(target - populated - first.count(), 0)
    rest = tried.where(~F.col("__tried") & good).orderBy(group, rank, reserve).limit(left)
    return first.unionByName(rest.select(group, F.lit(None).cast(dropped.schema[slot].dataType).alias("slot"), reserve, F.lit(2).alias("phase")))


def filtered_floor(items: DataFrame, key: str, gives_away: Column, least: int = 15) -> DataFrame:
    """The end of a top-up: items that give nothing away, of keys that keep enough."""
    return with_floor(items.where(~F.coalesce(gives_away, F.lit(False))), [key], least)


def quota_buckets(threads: DataFrame, group: str, order: Column, buckets: dict[str, Column], per: int = 2) -> DataFrame:
    """Of each group and bucket the first `per` threads, in order, that the bucket admits; a thread may fill several buckets. Each bucket is ranked by itself, and the limit goes below the shuffle."""
    admitted = F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in buckets.items()]))
    rows = threads.withColumn("__o", order).withColumn("bucket", F.explode(admitted))
    return top_per_group(rows, [group, "bucket"], [F.col("__o")], per, "place").drop("__o")


def both_kinds(pages: DataFrame, task: str, kind: str, rank: str, url: str, chars: Column, kinds: tuple[str, str] = ("community", "authoritative"), tries: int = 4, least: int = 500) -> DataFrame:
    """Of each task the first page of either kind, among the kind's first `tries`, with more than `least` characters; tasks without both are dropped."""
    ranked = top_per_group(pages.where(F.col(kind).isin(*kinds)), [task, kind], [F.col(rank), F.col(url)], tries, "__r").where(chars > least)
    best = ranked.groupBy(task).agg(*[F.min(F.when(F.col(kind) == k, F.struct("__r", url))).alias(k) for k in kinds])
    return best.where(F.col(kinds[0]).isNotNull() & F.col(kinds[1]).isNotNull()).select(task, *[F.col(k)[url].alias(f"{k}_url") for k in kinds])


def backfill(have: DataFrame, wanted: DataFrame, key: str, target: int, candidates: DataFrame, url: str, rank: str) -> DataFrame:
    """For each key that lacks rows, as many of its candidates by rank as it lacks; URLs that any key has are skipped, and a URL counts once."""
    fresh = first_per_key(candidates.join(have.select(url).distinct(), url, "left_anti"), [url], F.struct(rank, key))
    lacking = gap(have, wanted, key, target).where("gap > 0").select(key, "gap")
    ranked = fresh.join(lacking, key).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, url)))
    return ranked.where(F.col("place") <= F.col("gap")).select(key, "gap", "place", url)


def academic_gate(found: DataFrame, source: str, soc: str, mapped: DataFrame) -> DataFrame:
    """Preprints only of codes that are mapped to categories, health articles only of health groups, others always; of repeated URLs of a code the first source's."""
    known = mapped.select(F.col(soc).alias("__m")).distinct()
    rows = found.join(known, F.col(soc) == F.col("__m"), "left")
    fits = (F.col(source) != "arxiv") & (F.col(source) != "pmc") | (F.col(source) == "arxiv") & F.col("__m").isNotNull() | (F.col(source) == "pmc") & F.substring(soc, 1, 2).isin(*HEALTH_GROUPS)
    place = F.when(F.col(source) == "arxiv", 0).when(F.col(source) == "pmc", 1).otherwise(2)
    return first_per_key(rows.where(fits).drop("__m"), [soc, "url"], F.struct(place, F.col(source)))


def venue_texts(found: DataFrame, venue: str, text: str, least: dict[str, int], other: int = 100, most: int = 4000) -> DataFrame:
    """Sources whose text is as long as their venue asks for, cut to `most` characters; the cut is the operator's."""
    needed = F.coalesce(*[F.when(F.col(venue) == v, F.lit(n)) for v, n in least.items()], F.lit(other))
    return found.where(F.length(F.coalesce(F.col(text), F.lit(""))) >= needed).withColumn(text, F.substring(text, 1, most))


def with_fallback(found: DataFrame, group: str, level: str, steps: dict[int, tuple[int, int]], chars: Column) -> DataFrame:
    """Level 0 always, a later level only for groups in which the levels before have fewer than so many sources. steps: level to (sources that make it needless, least characters of its texts)."""
    long = found.where(F.coalesce(*[F.when(F.col(level) == n, chars >= c) for n, (_, c) in steps.items()], F.lit(False)))
    per = long.groupBy(group, level).agg(F.count("*").alias("__n"))
    before = per.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(level, "__n"))).alias("__m"))  # one entry for each level
    open_ = F.lit(False)
    used: list[tuple[int, Column]] = []
    for n, (enough, _) in sorted(steps.items()):
        count = sum((F.when(o, F.coalesce(F.try_element_at("__m", F.lit(i)), F.lit(0))).otherwise(0) for i, o in used), F.lit(0))
        here = F.lit(True) if not used else count < enough
        open_ = open_ | ((F.col(level) == n) & here)
        used.append((n, here))
    return long.join(before, group).where(open_).drop("__m")


def source_tier(rows: DataFrame, domain: str, soc: str, boards: DataFrame, associations: DataFrame, vendor: Column) -> DataFrame:
    """Tier and publisher of a domain for a code: baseline A, state boards A, associations A or B by kind, vendors C, else B; the publisher's name from the same places, else the domain.

    boards and associations have soc, domain, place and name, associations also
    kind; of several rows the first place counts.
    """
    one = lambda df, *c: first_per_key(df.select(F.col("soc").alias("__s"), F.col("domain").alias("__d"), "place", *c), ["__s", "__d"], F.col("place")).drop("place")
    b = one(boards, F.col("name").alias("__board"), F.lit(True).alias("__is_board"))
    a = one(associations, F.col("name").alias("__assoc"), F.lower(F.coalesce("kind", F.lit(""))).alias("__kind"))
    names = F.create_map(*[F.lit(x) for kv in BASELINE_PUBLISHERS.items() for x in kv])
    rows = rows.join(b, (F.col(soc) == F.col("__s")) & (F.col(domain) == F.col("__d")), "left").drop("__s", "__d").join(a, (F.col(soc) == F.col("__s")) & (F.col(domain) == F.col("__d")), "left").drop("__s", "__d")
    known = F.try_element_at(names, F.col(domain))
    tier = F.when(known.isNotNull() | F.col("__is_board"), "A").when(F.col("__kind").isin(*STANDARD_KINDS), "A").when(F.col("__kind").isNotNull(), "B").when(vendor, "C").otherwise("B")
    publisher = F.coalesce(known, "__board", "__assoc", F.col(domain))
    return rows.withColumn("tier", tier).withColumn("publisher", publisher).drop("__board", "__is_board", "__assoc", "__kind")


def not_denied(rows: DataFrame, board: Column, denied: DataFrame, name: str) -> DataFrame:
    """rows whose board isn't denied; those without a board stay."""
    return rows.withColumn("__b", board).join(denied.select(F.col(name).alias("__b")).distinct(), "__b", "left_anti").drop("__b")
