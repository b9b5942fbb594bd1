"""Labels out of model replies. Operators X1-X12, L1, P26."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = "[A-F]"


def letter_first(reply: Column) -> Column:
    """The first character if it is A-F, else the first letter A-F that stands alone."""
    s = F.upper(F.trim(F.coalesce(reply, F.lit(""))))
    return F.when(F.substring(s, 1, 1).rlike(LETTER), F.substring(s, 1, 1)).otherwise(F.regexp_extract(s, r"(?:^|[^A-Z0-9_])([A-F])(?:[^A-Z0-9_]|$)", 1))


def letter_cued(reply: Column) -> Column:
    """The letter after ANSWER, else the first not next to another letter."""
    s = F.upper(F.coalesce(reply, F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(s, r"ANSWER[^A-F]*([A-F])", 1), F.lit("")), F.regexp_extract(s, r"(?:^|[^A-Z])([A-F])(?:[^A-Z]|$)", 1))


def letter_strict(reply: Column) -> Column:
    """Case counts; a leading letter after brackets, else one that stands alone."""
    s = F.trim(F.coalesce(reply, F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^[\s(\[]*([A-F])", 1), F.lit("")), F.regexp_extract(s, r"(?:^|[^A-Za-z0-9_])([A-F])(?:[^A-Za-z0-9_]|$)", 1))


def letter_set(reply: Column) -> Column:
    """The letters of a list at the end, else all that stand alone; sorted."""
    s = F.upper(F.coalesce(reply, F.lit("")))
    end = F.regexp_extract(s, r"([A-F](?:\s*,\s*[A-F])*)\s*\.?\s*$", 1)
    source = F.when(end != "", F.regexp_extract_all(end, F.lit(LETTER), 0)).otherwise(F.regexp_extract_all(s, F.lit(r"(?<![A-Z])([A-F])(?![A-Z])"), 1))
    return F.array_sort(F.array_distinct(source))


def normal_set(letters: Column) -> Column:
    """E means all of A-D, F means none."""
    return F.when(letters == F.array(F.lit("E")), F.array(*map(F.lit, "ABCD"))).when(letters == F.array(F.lit("F")), F.array().cast("array<string>")).otherwise(letters)


def category_token(reply: Column, names: tuple[str, ...]) -> Column:
    """The name itself, else the first name that the reply holds, else other."""
    s = F.regexp_replace(F.lower(F.coalesce(reply, F.lit(""))), "[^a-z_]", "")
    return F.when(s.isin(*names), s).otherwise(F.coalesce(*[F.when(F.contains(s, F.lit(n)), F.lit(n)) for n in names], F.lit("other")))


def yes_no(reply: Column) -> Column:
    """True if YES, else false if NO, else null."""
    s = F.upper(F.coalesce(reply, F.lit("")))
    return F.when(F.contains(s, F.lit("YES")), True).when(F.contains(s, F.lit("NO")), False)


def numbered_verdicts(reply: Column) -> Column:
    """Number to YES or NO, of lines `i. YES`; the last of a number wins."""
    pairs = F.arrays_zip(F.regexp_extract_all(reply, F.lit(r"(?m)^\s*([0-9]+)\.\s*(YES|NO)"), 1).alias("k"), F.regexp_extract_all(reply, F.lit(r"(?m)^\s*([0-9]+)\.\s*(YES|NO)"), 2).alias("v"))
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")), lambda m, p: F.map_zip_with(m, F.create_map(p["k"].cast("int"), p["v"]), lambda k, a, b: F.coalesce(b, a)))


def directness(reply: Column) -> Column:
    """DIRECT, TANGENTIAL, ERROR or UNCLEAR by prefix."""
    s = F.upper(F.ltrim(F.coalesce(reply, F.lit(""))))
    return F.when(s.startswith("DIRECT"), "DIRECT").when(s.startswith("TANGENTIAL"), "TANGENTIAL").when(s.startswith("ERROR"), "ERROR").otherwise("UNCLEAR")


def plausible_letters(reply: Column) -> Column:
    """The letters A-D of the first line; none if it says NONE."""
    line = F.upper(F.substring_index(F.trim(F.coalesce(reply, F.lit(""))), "\n", 1))
    return F.when(F.contains(line, F.lit("NONE")), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.regexp_extract_all(line, F.lit(r"(?<![A-Z])([A-D])(?![A-Z])"), 1))))


def tolerant_json(reply: Column, schema: str) -> Column:
    """L1: the reply without a code fence as JSON, else its outermost braces, else null."""
    s = F.trim(F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"^```(?:json)?|```$", ""))
    whole = F.try_parse_json(s)
    inner = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(whole.isNotNull() & s.startswith("{"), s).when(F.try_parse_json(inner).isNotNull(), inner), schema)


def number(text: Column) -> Column:
    """A number with thousands separators; suppression codes are null."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def transient(error: Column) -> Column:
    """F33."""
    #: Marks of errors that pass.
    marks = ("503", "UNAVAILABLE", "529", "overloaded", "rate_limit", "RateLimitError", "Timeout", "timed out", "ServerError", "InternalServerError", "502", "504", "ServiceUnavailable")
    return error.rlike("|".join(marks))
