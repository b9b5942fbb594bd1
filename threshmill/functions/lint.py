"""Checks of multiple-choice items, each with a reason. Operators F12-F17, F19-F22, P32, P33, P35."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threshmill.functions.text import collapse, word_count

LETTERS = ("A", "B", "C", "D")
#: What gives a distractor away.
GIVEAWAYS = (
    r"\bignore (?:the |this |all )?\w+\b",
    r"\bouts?dated (?:practice|method|procedure|guideline|approach|standard|technique|protocol)\b",
    r"\b(?:rely (?:solely )?on|use (?:only )?)?\s*outdated\b",
    r"\bfocus(?:ing)? (?:solely|only|exclusively|primarily) on\b",
    r"\bfocus(?:ing)? on\b[^.,]{0,40}\b(?:solely|only|exclusively|primarily)\b",
    r"\bonly\s+(?:consider|focus|focus on|address|account for)\b",
    r"\b(?:disregard|dismiss|overlook|ignore) (?:the |any )?\w+",
    r"\bwithout (?:checking|consulting|reviewing|reading|considering|notifying|verifying|documenting|following|adhering to)\b",
    r"\bskip(?:ping)? (?:the |any )?\w+",
    r"\b(?:do|take) (?:nothing|no action|no further action)\b",
    r"\bavoid(?:ing)? (?:the |any |all )?\w+",
    r"\b(?:always|never)\s+(?:do|use|take|require|allow|perform|skip|consult|check)\b",
    r"\b(?:solely|exclusively|only) (?:based on|considering|relying on|on the basis of|on years of)\b",
    r"\bwithout (?:additional|further|prior|proper|written|formal)?\s*(?:consultation|consideration|approval|review|notification)\b",
    r"\bimmediately (?:discard|deposit|delete|remove|terminate)\b",
    r"\bblindly\b",
    r"\b(?:pretend|fake|falsify|fabricate)\b",
)
#: How a correct option names its source; the first ignores case, the others don't.
SOURCE_NAMES = (
    r"(?i)\b(?:follow|per|according to|in accordance with|as per|comply with|adhere to)\s+(?:the\s+)?(?:[A-Z]{2,}\s+)?(?:guideline|standard|code|manual|handbook|publication|publication\s+\d+|policy\s+\d+|protocol\s+\d+|chapter\s+\d+|section\s+\d+|article\s+\d+|rule\s+\d+|§\s*\d+)\b",
    r"\b(?:AICPA|AORN|AANP|AACN|APNA|NFPA|ASHRAE|ANSI|IEEE|ACM|BCS|OSHA|CDC|BLS|FDA|EPA|FAA|NRC|NIH|HRSA|VA|DOL|DOT|HHS|IRS|SEC|FINRA|SHRM|ABA|NCBE)\s+(?:Guideline|Standard|Code|Manual|Handbook|Bulletin|Practice|Publication)\b",
    r"\bPer (?:the )?[A-Z][A-Za-z]+ (?:Guideline|Standard|Code|Manual|Handbook|Statement|Policy)\b",
)
#: Words that an option may not hold.
PRONOUNS = ("i", "i'm", "i've", "we", "we're", "our", "ours", "us", "my", "your")
#: Phrases that a rewritten option may not hold, in either pass.
SOURCE_PHRASES = (
    "per the ", "per aicpa", "per asme", "per nfpa", "per nist", "per osha", "per ieee", "per ncees", "per aota", "per apta", "per asha", "per avma",
    "per usp", "per nabp", "per irs", "per faa", "according to ", "following the ", "as required by ", "in accordance with ", "pursuant to ", "under the ",
)
GENERIC_PHRASES = ("adhere to basic", "follow appropriate", "ensure compliance with", "use best practices", "consult an expert", "appropriate procedures", "applicable standards", "relevant guidelines")
SOURCE_PHRASES_AGAIN = ("per the ", "per aicpa", "per asme", "per nfpa", "per nist", "according to ", "following the ", "in accordance with ", "pursuant to ")
#: Publishers that are no authority.
WEAK_PUBLISHERS = ("reddit", "wikipedia", "blog", "medium.com", "quora", "answers.com", "wikihow", "wikia", "tumblr")
#: Words that carry a jurisdiction or setting.
STATES = "california|texas|florida|new york|washington|massachusetts|oregon|illinois|pennsylvania|virginia|colorado|nevada|arizona|michigan|minnesota|wisconsin|north carolina|south carolina|georgia|maryland|tennessee|ohio|alabama|missouri|indiana|kentucky|louisiana|hawaii|alaska"
SETTINGS = "residential|commercial|industrial|clinical|hospital|outpatient|inpatient"


def _get(options: Column, letter: str) -> Column:
    return F.coalesce(F.try_element_at(options, F.lit(letter)), F.lit(""))


def giveaway(text: Column) -> Column:
    """One pass over all patterns."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in GIVEAWAYS))


def giveaway_pattern(text: Column) -> Column:
    """F16: the first pattern that matches, cut to 40 characters, or null."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + p), F.lit(p[:40])) for p in GIVEAWAYS])


def giveaway_reason(options: Column, correct: Column) -> Column:
    """option_X_giveaway_phrase of the first distractor that gives itself away, or null."""
    return F.coalesce(*[F.when((correct != x) & giveaway(_get(options, x)), F.lit(f"option_{x}_giveaway_phrase")) for x in LETTERS])


def names_source(text: Column) -> Column:
    """F15."""
    out = F.lit(False)
    for p in SOURCE_NAMES:
        out = out | text.rlike(p)
    return out


def structure_reason(question: Column, options: Column, correct: Column) -> Column:
    """the first fault of an item, or null. A correct letter outside A-D is a fault."""
    letter = F.upper(F.trim(F.coalesce(correct, F.lit(""))))
    missing = F.lit(False)
    for x in LETTERS:
        missing = missing | F.try_element_at(options, F.lit(x)).isNull()
    checks = [F.when((F.trim(F.coalesce(question, F.lit(""))) == "") | missing | ~letter.isin(*LETTERS), F.lit("missing_or_invalid_fields"))]
    seen: list[Column] = []
    for x in LETTERS:
        option = F.trim(_get(options, x))
        norm = F.lower(collapse(option))
        words = F.transform(F.split(norm, " "), lambda w: F.btrim(w, F.lit(".,;:")))
        checks += [
            F.when(option == "", F.lit(f"option_{x}_empty")),
            F.when(option.endswith("?"), F.lit(f"option_{x}_trailing_question_mark")),
            F.when(F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS))), F.lit(f"option_{x}_forbidden_pronoun")),
        ]
        if seen:
            checks.append(F.when(norm.isin(*seen), F.lit(f"option_{x}_duplicate")))
        seen.append(norm)
    return F.coalesce(*checks)


def rewritten_option_reason(option: Column, again: bool = False) -> Column:
    """too_short, generic, source or null."""
    low = F.lower(F.coalesce(option, F.lit("")))
    has = lambda phrases: low.rlike("|".join(phrases))
    out = F.when(F.length(F.trim(F.coalesce(option, F.lit("")))) < 8, "too_short")
    return out.when(has(GENERIC_PHRASES), "generic").when(has(SOURCE_PHRASES_AGAIN), "source") if again else out.when(has(SOURCE_PHRASES), "source")


def merge_reason(question: Column, options: Column, correct: Column, least_words: int = 80) -> Column:
    """missing_option, question_mark, pronoun, short_stem, bad_answer or null."""
    every = [F.trim(_get(options, x)) for x in LETTERS]
    any_ = lambda f: F.array_contains(F.array(*[f(o) for o in every]), True)
    pronoun = r"(?i)(^|[^a-z0-9_])(i|i'm|i've|we|we're|our|ours|us|my)([^a-z0-9_]|$)"
    return (
        F.when(any_(lambda o: o == ""), "missing_option").when(any_(lambda o: o.endswith("?")), "question_mark").when(any_(lambda o: o.rlike(pronoun)), "pronoun")
        .when(word_count(question) < least_words, "short_stem").when(~F.coalesce(correct, F.lit("")).isin(*LETTERS), "bad_answer")
    )


def length_imbalance(options: Column, correct: Column) -> Column:
    """the correct option has under 0.6 or over 1.75 times the distractors' mean word count."""
    counts = {x: word_count(_get(options, x)) for x in LETTERS}
    own = F.coalesce(*[F.when(correct == x, counts[x]) for x in LETTERS], F.lit(0))
    mean = sum((F.when(correct == x, 0).otherwise(counts[x]) for x in LETTERS), F.lit(0)) / F.when(correct.isin(*LETTERS), 3.0).otherwise(4.0)
    return F.coalesce((own > 0) & (mean > 0) & ((own < 0.6 * mean) | (own > 1.75 * mean)), F.lit(False))


def authority_reason(tier: Column, url: Column, publisher: Column, domain: Column) -> Column:
    """why a source is no authority, or null."""
    named = F.lower(F.concat_ws(" ", publisher, domain))
    weak = F.coalesce(*[F.when(F.contains(named, F.lit(w)), F.lit(f"publisher/domain contains forbidden substring '{w}'")) for w in WEAK_PUBLISHERS])
    return F.when(~F.coalesce(tier, F.lit("")).isin("A", "B", "C"), "tier").when(F.coalesce(url, F.lit("")) == "", "missing source_url").when(F.coalesce(publisher, F.lit("")) == "", "missing publisher").otherwise(weak)


def unfixable_jurisdiction(limitation: Column, question: Column, ambiguous: Column) -> Column:
    """an ambiguous item whose stem repeats none of the limits of its source."""
    lim, stem = F.lower(F.trim(F.coalesce(limitation, F.lit("")))), F.lower(F.coalesce(question, F.lit("")))
    found = [F.regexp_extract(lim, rf"\b({p})\b", 1) for p in (STATES, r"20[0-9]{2}", SETTINGS)]
    held = F.lit(False)
    for x in found:
        held = held | ((x != "") & F.contains(stem, x))
    return (lim != "") & F.coalesce(ambiguous, F.lit(False)) & ~held


def difficulty(n_correct: Column) -> Column:
    """P32."""
    return F.when(n_correct >= 3, "easy").when(n_correct == 2, "medium").when(n_correct.isNotNull(), "hard")


def shuffled_letters(seed: Column) -> Column:
    """The letters in an order fixed by the seed (by hash; another order than a Mersenne Twister's)."""
    return F.transform(F.array_sort(F.array(*[F.struct(F.sha1(F.concat_ws("|", seed, F.lit(x)).cast("binary")).alias("h"), F.lit(x).alias("x")) for x in LETTERS])), lambda s: s["x"])


@F.pandas_udf(StringType())
def twister_letters(seed: pd.Series) -> pd.Series:
    """The old letters in the order of the new ones, by the standard library's shuffle seeded with eight hex digits of the seed's SHA-1; in Arrow batches, as no expression has that generator."""
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        order = list(LETTERS)
        random.Random(int(hashlib.sha1(text.encode()).hexdigest()[:8], 16)).shuffle(order)
        return "".join(order)

    return seed.map(one)


def reordered(options: Column, order: Column, correct: Column) -> Column:
    """Options and correct letter after a shuffle: struct of options and correct."""
    old = lambda i: F.substring(order, i + 1, 1)
    moved = F.map_from_arrays(F.array(*map(F.lit, LETTERS)), F.array(*[F.try_element_at(options, old(i)) for i in range(4)]))
    return F.struct(moved.alias("options"), F.coalesce(*[F.when(old(i) == correct, F.lit(x)) for i, x in enumerate(LETTERS)], correct).alias("correct"))


def rendered(options: Column, between: str = "\n") -> Column:
    """The options as `k) v` in order of their keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), between)
