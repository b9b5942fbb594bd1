"""Scores of models and threads. Operators A1, A4-A7, A10-A20, A22-A27, J7, J8, J17, W4, F28, L9-L11, L13."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def question_accuracy(responses: DataFrame, keys: Sequence[str], answer: str, correct: str) -> DataFrame:
    """Of each question and model, the share of its seeds that is right."""
    return responses.groupBy(*keys).agg(F.avg(F.coalesce(F.col(answer) == F.col(correct), F.lit(False)).cast("int")).alias("acc"))


def accuracy(per_question: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and standard error over questions."""
    return per_question.groupBy(*by).agg(F.count("*").alias("n"), F.avg("acc").alias("mean"), (F.stddev_samp("acc") / F.sqrt(F.count("*"))).alias("se"))


def weighted_accuracy(per_question: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """Mean by weight; the standard error has the effective number of questions. One pass of sums."""
    w, x = F.col(weight).cast("double"), F.col("acc")
    s = per_question.groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"))
    mean = F.col("swx") / F.col("sw")
    spread = F.greatest(F.col("swxx") / F.col("sw") - mean * mean, F.lit(0.0))
    return s.select(*by, mean.alias("mean"), F.sqrt(spread * F.col("sww") / (F.col("sw") * F.col("sw"))).alias("se"))


def open_ended(votes: DataFrame, by: Sequence[str], vote: str) -> DataFrame:
    """Share of YES votes, whatever their case; a null is wrong, and so is a vote with spaces."""
    return question_rate(votes, by, F.upper(F.col(vote)) == "YES")


def question_rate(df: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    x = F.coalesce(hit, F.lit(False)).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("rate"), (F.stddev_samp(x) / F.sqrt(F.count("*"))).alias("se"))


def matrix(per_question: DataFrame, row: str, column: str, values: Sequence[str], least: int = 3) -> DataFrame:
    """Mean accuracy by row and column for rows with enough questions, with the row's mean."""
    wide = per_question.groupBy(row).pivot(column, list(values)).agg(F.avg("acc"))
    counts = per_question.groupBy(row).agg(F.count("*").alias("n"))
    mean = sum((F.col(f"`{v}`") for v in values), F.lit(0.0)) / len(values)
    return wide.join(counts.where(F.col("n") >= least), row).withColumn("row_mean", mean)


def frequency_map(df: DataFrame, group: str, key: Column) -> DataFrame:
    """A map of counts for each group; a blank key is empty."""
    per = df.groupBy(group, F.coalesce(F.nullif(key, F.lit("")), F.lit("")).alias("k")).agg(F.count("*").alias("c"))
    return per.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "c")))).alias("counts"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Count and percent of all of each key; the total is one row that every task gets."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(df.agg(F.count("*").alias("__total")))).withColumn("percent", 100 * F.col("n") / F.col("__total")).drop("__total")


def leaderboard(df: DataFrame, by: str, right: Column, error: Column, numbers: Sequence[str]) -> DataFrame:
    """Rows without errors, accuracy in percent and means of numbers that can be read."""
    means = [F.avg(F.col(c).try_cast("double")).alias(f"avg_{c}") for c in numbers]
    return df.where(~F.coalesce(error, F.lit(False))).groupBy(by).agg(F.count("*").alias("n"), F.bround(100 * F.avg(right.cast("int")), 2).alias("accuracy"), *means)


def top_and_next(df: DataFrame, key: str, score: Column) -> DataFrame:
    """The two best scores of each thread and their ratio. Equal scores are counted before they meet, so a thread gives as many values as it has different scores, of which two stay."""
    values = df.select(key, score.alias("s")).groupBy(key, "s").agg(F.count("*").alias("c"))
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("s"))))
    total = values.groupBy(key).agg(F.sum("c").alias("n_answers"))
    best = ranked.where("r <= 2").groupBy(key).agg(F.max(F.when(F.col("r") == 1, F.col("s"))).alias("top"), F.max(F.when((F.col("r") == 1) & (F.col("c") > 1), F.col("s"))).alias("again"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("second"))
    after = F.coalesce("again", "second", F.lit(0))
    return best.join(total, key).select(key, "top", after.alias("next"), (F.col("top") / F.greatest(F.lit(1), after)).alias("ratio"), "n_answers")


def consensus(top: Column, ratio: Column, least: int = 5, times: int = 3) -> Column:
    """F28, L11."""
    return F.when(top.isNull(), "unknown").when((top < least) | (ratio < times), "no_consensus").otherwise("consensus")


def agreement(correct: Column, direct: Column, labels: Column) -> tuple[Column, Column]:
    """(decision, relabelled answer) from the agreement of the other options, a map of letter to AGREES, CONTRADICTS, OFF_TOPIC or UNCLEAR; an empty map keeps the item."""
    values = F.map_values(labels)
    agree, n = F.size(F.filter(values, lambda v: v == "AGREES")), F.size(values)
    unclear = F.array_contains(values, "UNCLEAR")
    decision = F.when(~correct.isin("A", "B", "C", "D"), "drop").when(~direct, "drop").when(unclear, "drop").when(agree == 0, "keep").when(agree == n, "relabel").otherwise("drop")
    return decision, F.when(decision == "relabel", "E").otherwise(correct)


def unique_answer(correct: Column, direct: Column, plausible: Column) -> Column:
    """Whether the plausible letters leave the correct answer as the only one."""
    four = F.array(*map(F.lit, "ABCD"))
    return F.when(correct.isin("A", "B", "C", "D"), direct & (plausible == F.array(correct))).when(correct == "E", plausible == four).when(correct == "F", F.size(plausible) == 0).otherwise(False)


def thread_scores(responses: Column) -> Column:
    """Scores of a thread's responses; if all are zero, their places from the end."""
    zero = F.forall(responses, lambda r: F.coalesce(r["score"], F.lit(0)) == 0)
    return F.when(zero, F.transform(responses, lambda r, i: F.greatest(F.lit(1), F.size(responses) - i))).otherwise(F.transform(responses, lambda r: F.coalesce(r["score"], F.lit(0))))


def melted_matrix(wide: DataFrame, keys: Sequence[str], correct: str, runs: Sequence[str]) -> DataFrame:
    """Accuracy of each question and model out of one column of answers for each run `<model>_seed<n>`; answers are compared trimmed and in capitals."""
    long = wide.unpivot([*keys, correct], list(runs), "run", "answer")
    right = F.coalesce(F.upper(F.trim("answer")) == F.upper(F.trim(correct)), F.lit(False))
    return long.groupBy(*keys, F.regexp_replace("run", r"_seed\d+$", "").alias("model")).agg(F.avg(right.cast("int")).alias("acc"))


def appended_columns(rows: DataFrame, answers: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Rows with one more column for each name, by key; the names are given, so no pass looks for them. Keys that the rows lack are dropped."""
    return rows.join(answers.groupBy(key).pivot(name, list(names)).agg(F.first(value)), key, "left")


def rolled_up(maps: DataFrame, counts: str) -> DataFrame:
    """A10: one total for each key over the maps of all groups."""
    return maps.select(F.explode(counts).alias("k", "c")).groupBy("k").agg(F.sum("c").alias("n"))


def ordered_text(df: DataFrame, group: str, text: str, order: Sequence[str], most: int = 4000) -> DataFrame:
    """A5: a group's texts in order, joined by spaces and cut, with counts of all and of different texts.

    Only texts that begin at the cut or before it are joined, so a group never
    holds more than `most` characters and two texts; one that begins right at
    the cut still brings the space before it. Rows without a place in the order
    come last, rows without a group are one group.
    """
    w = Window.partitionBy(group).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    before = df.select(group, text, *order).withColumn("__before", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.when((F.col("__before") <= most) & F.col(text).isNotNull(), F.struct("__before", text))))
    joined = F.when(F.size(parts) > 0, F.substring(F.array_join(F.transform(parts, lambda x: x[text]), " "), 1, most))
    return before.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(text).alias("n_texts"), joined.alias("texts"))


def kept_share(df: DataFrame, group: str, kept: Column) -> DataFrame:
    """Kept and all rows of each group with their ratio."""
    return df.groupBy(group).agg(F.count_if(kept).alias("kept"), F.count("*").alias("n")).withColumn("ratio", F.col("kept") / F.col("n"))


def status_mix(df: DataFrame, platform: Column, status: Column) -> DataFrame:
    """Rows of each status, in all (platform null) and on each platform; one pass of sums for both."""
    return df.select(platform.alias("platform"), status.alias("status")).groupingSets([["status"], ["platform", "status"]], "platform", "status").agg(F.count("*").alias("n"))
