"""Ports for what isn't deterministic: search, fetch and language models. Operators S11-S17, S20, R5.

A provider answers keyed requests. `Recorded` joins a table of recorded
answers; `Called` runs a function on the executors, batch by batch. Everything
before and after a provider is plain Spark, so queries run without a network.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


@dataclass
class Recorded:
    """Answers by request key, from a table (key, answer)."""

    answers: DataFrame

    def ask(self, requests: DataFrame, key: str = "key") -> DataFrame:
        """Each request with its answer, null if none is recorded. Equal requests are looked up once."""
        known = self.answers.groupBy("key").agg(F.min("answer").alias("answer"))
        return requests.join(known.withColumnRenamed("key", key), key, "left")


#: Statuses that say that a key is used up or refused.
SPENT = (400, 401, 402, 403, 429)


class Refused(Exception):
    """A provider's answer with a status of its own."""

    def __init__(self, status: int) -> None:
        super().__init__(status)
        self.status = status


_exhausted: dict[str, set[int]] = {}


def exhausted(name: str) -> set[int]:
    """The places of a provider list that are used up, for as long as this process lives."""
    return _exhausted.setdefault(name, set())


@dataclass
class Called:
    """Functions from request texts to answers, one for each key. A refusing or failing one gives way to the next; what is used up stays so in its process."""

    functions: tuple[Callable[[list[str]], list[str | None]], ...]
    tries: int = 3
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def ask(self, requests: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
        """Each request with its answer, null if no provider gives one. Equal requests are asked once."""
        functions, tries, name = self.functions, self.tries, self.name

        def answers(texts: list[str]) -> list[str | None]:
            spent = exhausted(name)
            for i, f in enumerate(functions):
                if i in spent:
                    continue
                for _ in range(tries):
                    try:
                        return f(texts)
                    except Refused as e:
                        if e.status in SPENT:
                            break
                    except (OSError, TimeoutError):
                        pass
                spent.add(i)
            return [None] * len(texts)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({key: batch[key], "answer": answers(batch[text].tolist())}, dtype=object)

        once = requests.select(key, text).distinct()
        return requests.join(once.mapInPandas(run, f"`{key}` string, answer string"), key, "left")


def fetch_route(url: Column, anti_bot: Column) -> Column:
    """How a page is fetched."""
    return F.when(url.rlike(r"/(?:articles/)?PMC[0-9]+"), "efetch").when(anti_bot, "premium,basic,direct").otherwise("direct,proxy")


def open_access(works: DataFrame, locations: DataFrame, k: int) -> DataFrame:
    """Of works in rank order the first k that have an open-access URL, the PDF's first."""
    found = works.join(locations, "doi").withColumn("url", F.coalesce(F.nullif("url_for_pdf", F.lit("")), F.nullif("url", F.lit("")))).where("url IS NOT NULL")
    return found.orderBy("rank", "doi").limit(k).select("doi", "rank", "url")


def arxiv_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Title, snippet and PDF address of the entries of Atom feeds."""
    entry = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("e")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = feeds.select(entry)
    link = F.regexp_extract("e", r'<link[^>]+title="pdf"[^>]+href="([^"]+)"', 1)
    page = F.trim(F.regexp_extract("e", r"(?s)<id>(.*?)</id>", 1))
    return rows.select(F.coalesce(F.nullif(link, F.lit("")), F.concat(F.replace(page, F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf"))).alias("url"), F.substring(tidy(F.regexp_extract("e", r"(?s)<title>(.*?)</title>", 1)), 1, 200).alias("title"), F.substring(tidy(F.regexp_extract("e", r"(?s)<summary>(.*?)</summary>", 1)), 1, 300).alias("snippet"), F.lit("arxiv.org").alias("domain"))


def summary_doi(summaries: DataFrame, raw: str = "json") -> DataFrame:
    """Title and DOI out of summaries with article ids."""
    parsed = summaries.select(F.from_json(raw, "struct<title:string,articleids:array<struct<idtype:string,value:string>>>").alias("s"))
    return parsed.select("s.title", F.try_element_at(F.filter("s.articleids", lambda x: x["idtype"] == "doi"), F.lit(1))["value"].alias("doi"))


def xml_text(xml: Column) -> Column:
    """Text of an article's XML."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"(?s)<\?xml.*?\?>", ""), r"(?s)<!DOCTYPE[^>]*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))
