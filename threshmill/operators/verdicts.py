"""Verdicts of judges and what follows from them. Operators L2-L7, L12, L14, L16-L18, F29, A9, X11, X12.

A verdict is the text of one JSON object. An absent key and a null value differ,
so objects are read as maps of texts and each value is typed where it is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshmill.functions.text import first_sentences
from threshmill.functions.urls import host
from threshmill.operators.select import specificity

LETTERS = ("A", "B", "C", "D")
#: Most tries of each regenerating pass, in the order in which they run.
MOST_TRIES = {"6b": 2, "2a": 2, "4": 2, "5": 2, "9": 2, "8": 3}
#: Boosts of a source's specificity by kind, and for an own domain.
OWN_DOMAIN_BOOST, UNKNOWN_RELATED = 0.10, 99


def parsed(verdict: Column) -> Column:
    """A JSON object as a map of texts; null if it can't be read."""
    return F.from_json(F.when(F.try_parse_json(verdict).isNotNull() & F.ltrim(verdict).startswith("{"), verdict), "map<string,string>")


def truth(value: Column) -> Column:
    """A JSON value as a flag: null, false, 0 and empty texts are false."""
    return F.coalesce(~F.lower(value).isin("false", "0", "", "null", "[]", "{}"), F.lit(False))


def letters_true(value: Column, wanted: Sequence[str] = LETTERS, but: Column | None = None) -> Column:
    """Whether a map of letters to flags has true for a wanted letter other than `but`."""
    flags = F.from_json(value, "map<string,boolean>")
    out = F.lit(False)
    for x in wanted:
        hit = F.coalesce(F.try_element_at(flags, F.lit(x)), F.lit(False))
        out = out | (hit if but is None else hit & ~F.coalesce(but == x, F.lit(False)))
    return out


def normal_verdict(verdict: Column, correct: Column, imbalanced: Column) -> Column:
    """L2: a verdict's gates with defaults, as one struct.

    Alignment is read from the exact field, else the older one, else true;
    competence is true if missing. The correct answer is entailed if the judge
    says so or its letter is; a distractor if the flag or any letter says so.
    A leak is the judge's or an imbalance of lengths.
    """
    m = parsed(verdict)
    at = lambda k: F.try_element_at(m, F.lit(k))
    has = lambda k: F.coalesce(F.map_contains_key(m, k), F.lit(False))
    aligned = F.when(has("occupation_aligned_exact"), truth(at("occupation_aligned_exact"))).when(has("occupation_aligned"), truth(at("occupation_aligned"))).otherwise(True)
    practical = F.when(has("tests_practical_competence"), truth(at("tests_practical_competence"))).otherwise(True)
    own = F.coalesce(F.try_element_at(F.from_json(at("entailment"), "map<string,boolean>"), correct), F.lit(False))
    leak = truth(at("answer_leaked"))
    return F.struct(
        aligned.alias("aligned"), practical.alias("practical"), (truth(at("labeled_correct_entailed")) | own).alias("entailed"),
        (letters_true(at("entailment"), but=correct) | (at("any_distractor_entailed") == "true").eqNullSafe(F.lit(True))).alias("distractor_entailed"),
        (letters_true(at("partial_entailment"), but=correct) | (at("any_distractor_partially_entailed") == "true").eqNullSafe(F.lit(True))).alias("distractor_partial"),
        truth(at("ambiguous")).alias("ambiguous"), (leak | imbalanced).alias("leaked"), F.when(leak, "llm").when(imbalanced, "length_imbalance").alias("leak_signal"),
        truth(at("correct_names_source")).alias("names_source"), F.substring(F.coalesce(at("notes"), F.lit("")), 1, 300).alias("notes"),
    )


def core_faults(source_ok: Column, v: Column, unfixable: Column) -> list[tuple[str, Column]]:
    """L4: the gates before the costly passes, each with its name and whether it fails, in order."""
    return [
        ("weak_source", ~source_ok), ("not_entailed", ~v["entailed"]), ("not_aligned", ~v["aligned"]), ("not_practical", ~v["practical"]),
        ("distractor_entailed", v["distractor_entailed"]), ("ambiguous", v["ambiguous"]), ("unfixable_jurisdiction", unfixable), ("names_source", v["names_source"]),
    ]


def tier_ladder(source_ok: Column, v: Column, unfixable: Column, specific_ok: Column, eliminable_ok: Column, source_tier: Column) -> Column:
    """L3, L4: struct of tier, the first fault (null if none) and whether the last two passes are skipped. Skipped passes count as passed."""
    core = core_faults(source_ok, v, unfixable)
    skipped = F.lit(False)
    for _, bad in core:
        skipped = skipped | bad
    late = [("generic_answer", ~skipped & ~specific_ok), ("eliminable_distractor", ~skipped & ~eliminable_ok)]
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in [*core, *late]])
    tier = F.when(reason.isNotNull(), None).when(v["leaked"] | v["distractor_partial"], "C").when(source_tier.isin("A", "C"), source_tier).otherwise("B")
    return F.struct(tier.alias("tier"), reason.alias("reason"), skipped.alias("skipped"))


def last_attempts(attempts: DataFrame, item: str, name: str, attempt: str, ok: str, most: dict[str, int] = MOST_TRIES) -> DataFrame:
    """Of each item and pass the attempt that counts: the first that succeeds, else the last allowed one. Attempt 0 is the first judgement; passes stand in their order of running."""
    limits = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(most) for x in (k, i)])
    within = attempts.where(F.col(attempt) <= limits[F.col(name)])
    best = within.groupBy(item, name).agg(F.min(F.when(F.col(ok), F.col(attempt))).alias("won"), F.max(attempt).alias("last"))
    return best.select(item, name, place[F.col(name)].alias("step"), F.coalesce("won", "last").alias("tries"), F.col("won").isNotNull().alias("ok"))


def eliminability(verdict: Column, correct: Column) -> Column:
    """No flag and no distractor's letter is set; an unreadable verdict passes."""
    m = parsed(verdict)
    at = lambda k: F.try_element_at(m, F.lit(k))
    return m.isNull() | ~(truth(at("any_eliminable")) | letters_true(at("eliminable"), but=correct))


def specific(verdict: Column) -> Column:
    """Specific enough and not too generic; without the first field the second decides; an unreadable verdict passes."""
    m = parsed(verdict)
    generic = truth(F.try_element_at(m, F.lit("correct_option_too_generic")))
    enough = F.try_element_at(m, F.lit("correct_option_specific_enough"))
    return m.isNull() | (F.when(enough.isNull(), ~generic).otherwise(truth(enough)) & ~generic)


def all_valid_override(correct: Column, reply: Column) -> Column:
    """E, if the judge says that all four options are valid."""
    return F.when(F.contains(F.upper(F.coalesce(reply, F.lit(""))), F.lit("YES")), "E").otherwise(correct)


def distractor_mix(synthesized: Column) -> Column:
    """Where three distractors come from."""
    return F.when(synthesized == 0, "same_thread_judged_wrong").otherwise(F.concat(F.lit("hybrid_same_source+synth("), (3 - synthesized).cast("string"), F.lit("/3)")))


def assembled(responses: Column, consensus: Column, seed: Column, first_wrong: int = 6, needed: int = 3) -> Column:
    """An item out of a thread's responses (text, wrong), best first: struct of status, letters to options and the correct letter.

    Needs four responses, a consensus, and three wrong ones among the first six
    that are judged wrong and not blank. Which three, and which letter each
    option gets, follows from hashes of the seed: fixed, not random.
    """
    rest = F.filter(responses, lambda r, i: (i > 0) & (F.trim(F.coalesce(r["text"], F.lit(""))) != "") & F.coalesce(r["wrong"], F.lit(False)))
    wrong = F.slice(rest, 1, first_wrong)
    hashed = lambda salt: lambda x, i: F.struct(F.md5(F.concat_ws("|", seed, F.lit(salt), i.cast("string")).cast("binary")).alias("h"), x.alias("x"))
    chosen = F.transform(F.slice(F.array_sort(F.transform(F.transform(wrong, lambda r: r["text"]), hashed("wrong"))), 1, needed), lambda s: s["x"])
    texts = F.concat(F.array(responses[0]["text"]), chosen)
    letters = F.transform(F.array_sort(F.transform(F.array(*map(F.lit, LETTERS)), hashed("letter"))), lambda s: s["x"])
    status = (
        F.when(F.size(responses) < 4, "too_few_responses").when(~F.coalesce(consensus, F.lit(False)), "consensus_reject")
        .when(F.size(wrong) < needed, F.concat(F.lit("not_enough_wrong("), F.size(wrong).cast("string"), F.lit(")"))).otherwise("item")
    )
    made = status == "item"
    return F.struct(status.alias("status"), F.when(made, F.map_from_arrays(letters, texts)).alias("options"), F.when(made, letters[0]).alias("correct"))


def clear_worst(scores: Column, answers: int = 4) -> Column:
    """four answers or more, and the last has a third of the best one's score at most; scores stand best first."""
    return (F.size(scores) >= answers) & (3 * F.element_at(scores, -1) <= scores[0])


def best_and_worst(answers: Column) -> Column:
    """The best and the worst of four answers or more, and those a third and half of the way down; else null."""
    n = F.size(answers)
    pick = lambda i: F.get(answers, i.cast("int"))
    return F.when(n >= 4, F.struct(pick(F.lit(0)).alias("best"), pick(n - 1).alias("worst"), pick(F.floor(n / 3)).alias("first_third"), pick(F.floor(n / 2)).alias("middle")))


def several_correct(answer: Column) -> Column:
    """The trimmed letters of an answer that names several, else null."""
    return F.when(F.contains(answer, F.lit(",")), F.transform(F.split(answer, ","), lambda x: F.trim(x)))


def numbered_blocks(reply: Column, most: int = 260) -> Column:
    """X11: number 1-4 to its block, which ends before the next number, shortened to whole sentences; missing numbers are absent."""
    block = lambda n: F.regexp_extract(reply, rf"(?ms)^\s*{n}\)\s*(.+?)(?=\n\s*\d\)|\z)", 1)
    entries = F.array(*[F.struct(F.lit(str(n)).alias("key"), first_sentences(F.regexp_replace(block(n), r"^\s+|\s+$", ""), most).alias("value")) for n in range(1, 5)])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))


def letter_lines(reply: Column) -> Column:
    """Letter A-D to the rest of its line `A) ...`; missing letters are absent."""
    entries = F.array(*[F.struct(F.lit(x).alias("key"), F.trim(F.regexp_extract(reply, rf"(?m)^\s*{x}\)\s*(.+)$", 1)).alias("value")) for x in LETTERS])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))


def enriched_picks(picks: DataFrame, per_occupation: DataFrame, whole: DataFrame, boost: Column | None = None) -> DataFrame:
    """Picks (occupation, soc, place, name, url, related, kind) with org_id, source_system, category and org_specificity.

    A pick without a related count takes it from the occupation's pool (name,
    domain, related), else 99. The pool it was found in names its system. A
    domain is its occupation's own if a title word of five letters or more
    stands in it.
    """
    d = host(F.col("url"))
    a = per_occupation.select(F.col("name").alias("__n"), F.col("domain").alias("__d"), F.col("related").alias("__related")).dropDuplicates(["__n", "__d"])
    b = whole.select(F.col("name").alias("__bn"), F.col("domain").alias("__bd"), F.lit(True).alias("__b")).distinct()
    rows = picks.withColumn("domain", d).join(a, (F.col("name") == F.col("__n")) & (F.col("domain") == F.col("__d")), "left").join(b, (F.col("name") == F.col("__bn")) & (F.col("domain") == F.col("__bd")), "left")
    related = F.when(F.coalesce("related", F.lit(0)) != 0, F.col("related")).otherwise(F.coalesce("__related", F.lit(UNKNOWN_RELATED)))
    own = F.exists(F.split(F.lower("occupation"), " "), lambda w: (F.length(w) > 4) & F.contains(F.col("domain"), w))
    kind_boost = boost if boost is not None else F.lit(0.0)
    system = F.when(F.col("__n").isNotNull(), "onet_per_soc_associations").when(F.col("__b"), "onet_full_xlsx").otherwise("unknown")
    org = F.concat(F.lit("org_"), F.lpad(F.col("place").cast("string"), 6, "0"), F.lit("_"), F.replace("soc", F.lit("-"), F.lit("")))
    return rows.select(*picks.columns, "domain", org.alias("org_id"), system.alias("source_system"), F.when(related > 5, "national").otherwise("specialist").alias("category"), F.round(specificity(related, kind_boost + F.when(own, OWN_DOMAIN_BOOST).otherwise(0.0)), 4).alias("org_specificity"))


def diagnostics(items: DataFrame, key: str, publisher: Column, document: Column, tier: Column, letter: Column) -> DataFrame:
    """Items of each key and its flags, in order. Counts of publishers, documents and letters are summed before they meet in a key."""
    base = items.select(F.col(key), publisher.alias("p"), F.coalesce(document, F.lit("")).alias("d"), (tier == "A").alias("a"), letter.alias("l"))
    by = lambda c: base.groupBy(key, c).agg(F.count("*").alias("c")).groupBy(key).agg(F.count("*").alias(f"n_{c}"), F.max("c").alias(f"top_{c}"))
    total = base.groupBy(key).agg(F.count("*").alias("n"), F.count_if("a").alias("tier_a"))
    j = total.join(by("p"), key).join(by("d"), key).join(by("l"), key)
    n = F.col("n")
    flags = [
        (n < 5, "under_5_items"), ((F.col("top_p") / n > 0.5) & (n >= 4), "single_publisher_dominant"), ((F.col("n_p") < 2) & (n >= 3), "only_one_publisher"),
        ((F.col("n_d") < 2) & (n >= 3), "only_one_source_document"), ((F.col("n_d") < 3) & (n >= 5), "under_three_source_documents"),
        (F.col("tier_a") == 0, "only_tier_B_C"), ((F.col("top_l") / n > 0.4) & (n >= 5), "answer_letter_imbalanced"),
    ]
    return j.select(key, "n", F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags])).alias("flags"))


