"""Readers and writers. Operators S1-S7, S9, S10, S18-S23, K1-K8, K10.

Paths are Spark paths; nothing is opened on the driver. Readers take explicit
schemas and keep bad rows apart where the format allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threshmill.operators.select import first_per_key, last_per_key


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, bad ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str, key: str = "evidence_id") -> DataFrame:
    """Bad lines are dropped, and of repeated keys the first stays; all rows without a key stay."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("__seq", F.struct("_metadata.file_path", F.monotonically_increasing_id()))
    known = first_per_key(rows.where(F.col(key).isNotNull()), [key], F.col("__seq"))
    return known.select(*[c for c in rows.columns if c != "__seq"]).unionByName(rows.where(F.col(key).isNull()).drop("__seq"))


def read_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All files of a pattern, each row with its file."""
    return spark.read.schema(schema).json(pattern).withColumn("source_file", F.col("_metadata.file_path"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_keyed_arrays(spark: SparkSession, path: str, item_schema: str, key: str = "occupation") -> DataFrame:
    """A file that is one object of arrays; a row for each element, with its key and place."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", f"map<string,array<struct<{item_schema}>>>").alias("m"))
    return parsed.select(F.explode("m").alias(key, "items")).select(key, F.posexplode("items").alias("seq", "item")).select(key, "seq", "item.*")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """A table with a header, all strings."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def repair_checkpoint(rows: DataFrame, key: str = "row_id", seq: str = "seq") -> DataFrame:
    """Without repeated headers and rows whose key is no number; of each key the last row."""
    typed = rows.withColumn(key, F.col(key).try_cast("long")).where(F.col(key).isNotNull())
    return last_per_key(typed, [key], F.col(seq))


def forum_threads(posts: DataFrame, body: str, least_chars: int = 40, least_posts: int = 4) -> DataFrame:
    """Threads with their long enough answers, accepted first, then by score; threads with too few are dropped."""
    long = posts.where(F.length(F.trim(body)) >= least_chars)
    order = F.struct(F.coalesce(F.col("accepted"), F.lit(False)).cast("int").alias("a"), F.col("score").alias("s"), F.col(body).alias("t"))
    grouped = long.groupBy("url").agg(F.sort_array(F.collect_list(order), asc=False).alias("answers"))
    return grouped.where(F.size("answers") >= least_posts)


def gather_sources(found: DataFrame, priority: str, rank: str, per_venue: Column, most: int = 5) -> DataFrame:
    """Sources by venue priority, none twice, each venue up to its quota, `most` in all for each occupation."""
    from pyspark.sql import Window

    once = first_per_key(found, ["occupation", "url"], F.struct(priority, rank))
    venue = Window.partitionBy("occupation", priority).orderBy(rank, "url")
    capped = once.withColumn("__r", F.row_number().over(venue)).where(F.col("__r") <= per_venue)
    every = Window.partitionBy("occupation").orderBy(priority, rank, "url")
    return capped.withColumn("place", F.row_number().over(every)).where(F.col("place") <= most).drop("__r")


def directory_entries(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """Names and links that a two-group pattern finds, one for each trimmed link."""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(pattern), 1).alias("url"), F.regexp_extract_all(F.col(html), F.lit(pattern), 2).alias("name"))
    rows = pages.select(F.explode(pairs).alias("e")).select(F.regexp_replace(F.trim("e.url"), "/+$", "").alias("url"), F.trim("e.name").alias("name"))
    return first_per_key(rows, ["url"], F.col("name"))


def append_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """K1, K7: append, with a folder for each value of `by`."""
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).json(path)


def split_write(df: DataFrame, keep: Column, kept_path: str, removed_path: str) -> None:
    """K2: kept and removed rows apart, both new; the input is never overwritten."""
    flagged = df.withColumn("__keep", F.coalesce(keep, F.lit(False)))
    flagged.where("__keep").drop("__keep").write.json(kept_path)
    flagged.where("NOT __keep").drop("__keep").write.json(removed_path)


BANK_COLUMNS = ("source_url", "occupation", "question", "option_A", "option_B", "option_C", "option_D", "option_E", "option_F", "correct_answer")
#: Texts of the two options that every item gets.
ALL_OF_THEM, NONE_OF_THEM = "All of the above", "None of the above"


def bank(items: DataFrame, narrow: bool = True) -> DataFrame:
    """K3, K4: items with a column for each option, trimmed; E and F have texts of their own."""
    own = {"E": ALL_OF_THEM, "F": NONE_OF_THEM}
    options = [F.coalesce(F.nullif(F.trim(F.try_element_at("options", F.lit(x))), F.lit("")), F.lit(own.get(x, ""))).alias(f"option_{x}") for x in "ABCDEF"]
    out = items.select(F.trim("source_url").alias("source_url"), F.trim("occupation").alias("occupation"), F.trim("question").alias("question"), *options, F.trim("correct_answer").alias("correct_answer"), *[c for c in ("onet_soc_code", "publisher") if c in items.columns and not narrow])
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """K3, K8: a new table with a header; an existing one is an error, so nothing is lost."""
    df.write.option("header", True).option("escape", '"').csv(path)


def write_checkpoint(df: DataFrame, path: str, number: int) -> None:
    """K6: checkpoint `number` as a folder of its own. It counts once its writer has committed it; the one before stays whole until then."""
    write_csv(df, f"{path}/checkpoint={number:08d}")


def read_checkpoint(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame | None:
    """K6: the newest checkpoint that is complete; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = sorted((x.getPath().toString() for x in fs.listStatus(at)), reverse=True) if fs.exists(at) else []
    for folder in folders:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder + "/_SUCCESS")):
            return read_csv(spark, folder, columns)
    return None


def python_tuples(sources: DataFrame, text: str) -> DataFrame:
    """(code, title, number) tuples that stand in program texts."""
    pattern = r'\(\s*"([0-9-]+)"\s*,\s*"([^"]+)"\s*,\s*(\d+)\s*\)'
    parts = F.arrays_zip(*[F.regexp_extract_all(F.col(text), F.lit(pattern), i).alias(n) for i, n in ((1, "soc"), (2, "title"), (3, "employment"))])
    return sources.select(F.explode(parts).alias("t")).select("t.soc", "t.title", F.col("t.employment").cast("long").alias("employment"))


def not_done(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no row in the append-only log."""
    return rows.join(log.select(key).distinct(), key, "left_anti")


def summary(items: DataFrame, host: str, category: str, top: int = 10) -> DataFrame:
    """K5: one row: totals, the most frequent hosts (ties by name) and the categories."""
    hosts = items.groupBy(host).agg(F.count("*").alias("n")).orderBy(F.desc("n"), host).limit(top).agg(F.sort_array(F.collect_list(F.struct(F.col("n").alias("n"), F.col(host).alias("host"))), asc=False).alias("top_hosts"))
    kinds = items.groupBy(category).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(category, "n"))).alias("categories"))
    return items.agg(F.count("*").alias("n_items"), F.countDistinct(host).alias("n_hosts")).crossJoin(F.broadcast(hosts)).crossJoin(F.broadcast(kinds))


def coverage(items: DataFrame, occupation: str, url: str, seq: str, most: int = 3) -> DataFrame:
    """Items and the first URLs of each occupation; only those URLs of an occupation meet."""
    from threshmill.operators.select import top_per_group

    seen = items.groupBy(occupation, url).agg(F.min(seq).alias("s"), F.count("*").alias("c"))
    counts = seen.groupBy(occupation).agg(F.sum("c").alias("n_items"))
    first = top_per_group(seen, [occupation], [F.col("s"), F.col(url)], most, "r").groupBy(occupation).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", url))), lambda x: x[url]), "; ").alias("urls"))
    return counts.join(first, occupation).orderBy(occupation)
