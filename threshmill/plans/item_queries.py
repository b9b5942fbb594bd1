"""More registered queries: verdicts, sourcing and files. Names in brackets are the survey's operators that a query calls."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from threshmill.functions import lint, text, urls
from threshmill.operators import gate, metrics, select, sourcing, verdicts
from threshmill.plans.queries import hosts, items, query, read, responses
from threshmill.shared import shared_dir
from threshmill.sources import io, pdf, providers, sheets
from threshmill.streaming import streams

LETTER = "substring('ABCD', CAST(doc_id % 4 + 1 AS INT), 1)"


def flag(condition: str) -> Column:
    return F.when(F.expr(condition), "true").otherwise("false")


def folder(spark) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


def verdict_json() -> Column:
    """A judge's verdict fixed by arithmetic; some fields are missing, some null."""
    aligned = F.expr("""CASE doc_id % 5 WHEN 0 THEN '"occupation_aligned_exact": true, ' WHEN 1 THEN '"occupation_aligned_exact": false, "occupation_aligned": true, '
      WHEN 2 THEN '"occupation_aligned": false, ' WHEN 3 THEN '"occupation_aligned_exact": null, ' ELSE '' END""")
    practical = F.expr("""CASE doc_id % 3 WHEN 0 THEN '"tests_practical_competence": true, ' WHEN 1 THEN '"tests_practical_competence": false, ' ELSE '' END""")
    letters = F.concat(F.lit('"entailment": {"A": '), flag("doc_id % 4 = 0"), F.lit(', "B": '), flag("doc_id % 6 = 0"), F.lit(', "C": '), flag("doc_id % 10 = 0"), F.lit(', "D": '), flag("doc_id % 14 = 0"), F.lit("}, "))
    partial = F.concat(F.lit('"partial_entailment": {"A": '), flag("doc_id % 9 = 0"), F.lit("}, "))
    flags = [("labeled_correct_entailed", "doc_id % 7 <> 0"), ("any_distractor_entailed", "doc_id % 11 = 0"), ("any_distractor_partially_entailed", "doc_id % 13 = 0"), ("ambiguous", "doc_id % 17 = 0"), ("answer_leaked", "doc_id % 19 = 0"), ("correct_names_source", "doc_id % 29 = 0")]
    said = [x for name, c in flags for x in (F.lit(f'"{name}": '), flag(c), F.lit(", "))]
    return F.concat(F.lit("{"), aligned, practical, letters, partial, *said, F.lit('"notes": "n'), F.col("doc_id").cast("string"), F.lit('"}'))


def normal(labels: DataFrame) -> DataFrame:
    return labels.withColumn("correct", F.expr(LETTER)).withColumn("v", verdicts.normal_verdict(verdict_json(), F.col("correct"), F.expr("doc_id % 23 = 0")))


def specificity_json() -> Column:
    return F.expr("""CASE doc_id % 9 WHEN 0 THEN '{"correct_option_too_generic": true}' WHEN 1 THEN '{"correct_option_specific_enough": false}' WHEN 2 THEN 'no object' WHEN 3 THEN '{}'
      ELSE '{"correct_option_specific_enough": true, "correct_option_too_generic": false}' END""")


def eliminability_json() -> Column:
    return F.concat(F.lit('{"any_eliminable": '), flag("doc_id % 15 = 0"), F.lit(', "eliminable": {"B": '), flag("doc_id % 12 = 0"), F.when(F.expr("doc_id % 25 = 0"), "").otherwise("}}"))


# verdicts


@query
def verdict_normalisation(spark, d):
    """[L2] Gates of verdicts with their defaults."""
    return normal(read(spark, d, "labels")).select("doc_id", "v.*")


@query
def verdict_gates(spark, d):
    """[L6, L7] Whether options can be eliminated, and whether the answer is specific."""
    return read(spark, d, "labels").select("doc_id", verdicts.eliminability(eliminability_json(), F.expr(LETTER)).alias("eliminable_ok"), verdicts.specific(specificity_json()).alias("specific_ok"))


@query
def quality_ladder(spark, d):
    """[L3, L4, L8] Tier, first fault and skipped passes of each labelled document's item."""
    ladder = verdicts.tier_ladder(F.col("quality") == 1, F.col("v"), F.expr("doc_id % 31 = 0"), verdicts.specific(specificity_json()), verdicts.eliminability(eliminability_json(), F.col("correct")), F.expr("CASE WHEN doc_id % 2 = 1 THEN 'A' WHEN doc_id % 3 = 0 THEN 'C' ELSE 'B' END"))
    return normal(read(spark, d, "labels")).select("doc_id", ladder.alias("l")).select("doc_id", "l.*")


@query
def last_attempts(spark, d):
    """[L5] Of each regenerating pass the try that counts."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("pass")) for i, p in enumerate(verdicts.MOST_TRIES)])).alias("g")
    rows = read(spark, d, "labels").select("doc_id", grid).select("doc_id", "g.*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("attempt"))
    rows = rows.withColumn("ok", F.expr("(doc_id * 7 + i * 3 + attempt * 5) % 4 = 0"))
    return verdicts.last_attempts(rows, "doc_id", "pass", "attempt", "ok")


@query
def all_valid_override(spark, d):
    """[L12] E where the judge calls all options valid, and where distractors come from."""
    return read(spark, d, "labels").select("doc_id", verdicts.all_valid_override(F.expr(LETTER), F.expr("CASE WHEN doc_id % 6 = 0 THEN 'yes, all' WHEN doc_id % 6 = 1 THEN 'NO' END")).alias("correct"), verdicts.distractor_mix(F.expr("CAST(doc_id % 4 AS INT)")).alias("mix"))


def thread(c: DataFrame) -> DataFrame:
    """Conversations as threads: their turns as responses, some of them judged wrong."""
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("r"))
    return rows.withColumn("r", F.transform("r", lambda x: F.struct(x["text"].alias("text"), ((x["turn"] + F.col("conv_id")) % 4 != 0).alias("wrong"))))


@query
def assembled_items(spark, d):
    """[L14] Items out of threads: status, correct letter and options."""
    t = thread(read(spark, d, "conversations")).select("conv_id", verdicts.assembled(F.col("r"), F.col("conv_id") % 5 != 0, F.col("conv_id").cast("string")).alias("a"))
    return t.select("conv_id", "a.status", "a.correct", F.md5(F.concat_ws("|", *[F.try_element_at("a.options", F.lit(x)) for x in "ABCD"]).cast("binary")).alias("options"))


def scored(c: DataFrame) -> DataFrame:
    """Answers of conversations, longest first."""
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("n"), F.col("turn").cast("long").alias("turn")))).alias("a"))


@query
def best_worst_picks(spark, d):
    """[L16, F29] Best, worst and two answers between, and whether the worst is clear."""
    t = scored(read(spark, d, "conversations"))
    p = verdicts.best_and_worst(F.col("a"))
    return t.select("conv_id", *[p[x]["turn"].alias(x) for x in ("best", "worst", "first_third", "middle")], verdicts.clear_worst(F.transform("a", lambda x: -x["n"])).alias("clear_worst"))


@query
def several_correct(spark, d):
    """[L17] Answers that name several letters."""
    a = verdicts.several_correct(F.expr("CASE doc_id % 3 WHEN 0 THEN ' A, C' WHEN 1 THEN 'B' ELSE 'A,B ,D' END"))
    return read(spark, d, "labels").select("doc_id", F.array_join(a, "").alias("letters")).where("letters IS NOT NULL")


@query
def reply_blocks(spark, d):
    """[X11, X12] Numbered blocks and letter lines of replies."""
    i = F.col("item_id").cast("string")
    b = read(spark, d, "benchmark").select("item_id", verdicts.numbered_blocks(F.concat(F.lit("so:\n 1) first "), i, F.lit("\n2)  second\n goes on "), i, F.lit("\n7) none\n4) last"))).alias("m"), verdicts.letter_lines(F.concat(F.lit("A) one "), i, F.lit("\n b) no\n  D)  four \nE) five"))).alias("l"))
    return b.select("item_id", *[F.try_element_at("m", F.lit(k)).alias(f"m{k}") for k in "1234"], *[F.try_element_at("l", F.lit(k)).alias(f"l{k}") for k in "ABD"])


@query
def pick_enrichment(spark, d):
    """[L18, J18, J19] Picks with their source system, category, id and specificity."""
    p = hosts(spark, d).withColumn("name", F.concat(F.lit("n"), (F.col("page_id") % 50).cast("string")))
    a = p.where("page_id % 3 = 0").groupBy("name", F.col("host").alias("domain")).agg((F.min("page_id") % 12).cast("int").alias("related"))
    b = p.where("page_id % 3 = 1").select("name", F.col("host").alias("domain"))
    picks = p.select("page_id", F.concat(F.lit("Senior "), F.substring_index("host", ".", 1)).alias("occupation"), F.lit("11-1021").alias("soc"), (F.col("page_id") % 9 + 1).alias("place"), "name", "url", (F.col("page_id") % 9).cast("int").alias("related"))
    return verdicts.enriched_picks(picks, a, b).select("page_id", "org_id", "source_system", "category", "org_specificity")


@query
def diagnostic_flags(spark, d):
    """[A9] Flags of groups of documents taken as items."""
    x = read(spark, d, "documents").select((F.col("doc_id") % 150).alias("k"), "doc_id", F.coalesce("source", F.lit("")).alias("p"))
    got = verdicts.diagnostics(x.withColumn("t", F.when(F.col("doc_id") % 11 == 0, "A").otherwise("B")).withColumn("l", F.expr(LETTER)).withColumn("u", (F.col("doc_id") % 4).cast("string")), "k", F.col("p"), F.col("u"), F.col("t"), F.col("l"))
    return got.select("k", "n", F.array_join("flags", ",").alias("flags"))


# sourcing


@query
def top_up(spark, d):
    """[G9] Reserves for dropped places, first of the group, then of any."""
    poor = read(spark, d, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("slot_key"))
    pool = read(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", (-F.col("s_acctbal")).alias("r"), (F.col("s_suppkey") % 30).cast("int").alias("kept"))
    return sourcing.topped_up(poor, pool, "g", "slot_key", "s_suppkey", "r", "kept", 2, 40)


@query
def top_up_floor(spark, d):
    """[G9, F14, A2] Items that give nothing away, of keys that keep enough."""
    x = items(spark, d).withColumn("k", F.col("conv_id") % 40)
    return sourcing.filtered_floor(x, "k", F.expr("conv_id % 7 = 0"), 4).select("conv_id", "k")


@query
def quota_buckets(spark, d):
    """[G10, F28, F29] The first two threads of each group for each bucket."""
    t = scored(read(spark, d, "conversations")).withColumn("g", F.col("conv_id") % 7)
    buckets = {"single": F.expr("conv_id % 3 <> 0"), "multi": F.expr("conv_id % 4 = 1"), "sjt": verdicts.clear_worst(F.transform("a", lambda x: -x["n"]))}
    return sourcing.quota_buckets(t, "g", F.md5(F.col("conv_id").cast("string").cast("binary")), buckets).select("g", "bucket", "place", "conv_id")


@query
def both_source_kinds(spark, d):
    """[G11] Tasks that have a long enough page of either kind among the first four."""
    p = read(spark, d, "pages").select((F.col("page_id") % 41).alias("task"), F.expr("CASE page_id % 3 WHEN 0 THEN 'community' WHEN 1 THEN 'authoritative' ELSE 'other' END").alias("kind"), "page_id", "url", "html")
    return sourcing.both_kinds(p, "task", "kind", "page_id", "url", F.length(F.coalesce("html", F.lit(""))))


@query
def gap_backfill(spark, d):
    """[G12, A26] Fresh candidates for keys that lack rows."""
    p = read(spark, d, "pages").select("page_id", (F.col("page_id") % 23).alias("k"), urls.canonical(F.col("url"), "utm_source").alias("u"))
    return sourcing.backfill(p.where("page_id % 5 = 0"), p.select("k"), "k", 6, p.where("page_id % 5 <> 0"), "u", "page_id").select("k", "gap", "place", "u")


@query
def academic_sources(spark, d):
    """[S16] Academic sources that a code may use, none twice."""
    p = read(spark, d, "pages").select(F.expr("CASE page_id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'pmc' ELSE 'crossref' END").alias("source"), F.concat((F.col("page_id") % 4 * 6 + 11).cast("string"), F.lit("-0000")).alias("soc"), urls.canonical(F.col("url"), "query").alias("url"))
    mapped = spark.createDataFrame([("17-0000",), ("29-0000",)], "soc string")
    return sourcing.academic_gate(p, "source", "soc", mapped).select("soc", "url", "source")


@query
def venue_texts(spark, d):
    """[S23] Sources long enough for their venue, cut."""
    x = read(spark, d, "documents").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN 'web' ELSE 'wiki' END").alias("venue"), "text")
    return sourcing.venue_texts(x, "venue", "text", {"reddit": 300, "web": 300}).select("doc_id", F.length("text").alias("n"))


@query
def fallback_sources(spark, d):
    """[S24] Later levels only where earlier ones have too few sources."""
    x = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 90).alias("g"), (F.col("doc_id") % 7 % 3).cast("int").alias("level"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return sourcing.with_fallback(x, "g", "level", {0: (0, 800), 1: (3, 500), 2: (4, 200)}, F.col("n")).select("doc_id", "g", "level")


@query
def source_tiers(spark, d):
    """[J20, J21] Tier and publisher of each page's host for its code."""
    h = hosts(spark, d).select("page_id", F.when(F.col("page_id") % 20 == 0, "cdc.gov").otherwise(F.col("host")).alias("domain"), (F.col("page_id") % 2).alias("soc"))
    boards = h.where("page_id % 7 = 0").select("soc", "domain", F.col("page_id").alias("place"), F.concat(F.lit("board "), F.col("page_id").cast("string")).alias("name"))
    assoc = h.where("page_id % 5 = 0").select("soc", "domain", F.col("page_id").alias("place"), F.concat(F.lit("assoc "), F.col("page_id").cast("string")).alias("name"), F.expr("CASE WHEN page_id % 2 = 0 THEN 'Licensing_body' WHEN page_id % 3 = 0 THEN 'society' END").alias("kind"))
    return sourcing.source_tier(h, "domain", "soc", boards, assoc, F.col("domain").endswith(".com")).select("page_id", "tier", "publisher")


@query
def prefix_join(spark, d):
    """[J12] Detailed codes by the code that they begin with."""
    code = lambda e: F.concat(F.lit("11-"), F.lpad((e % 500).cast("string"), 4, "0"))
    left = read(spark, d, "supplier").select("s_suppkey", code(F.col("s_suppkey") * 3).alias("soc"))
    right = read(spark, d, "part").select("p_partkey", F.concat(code(F.col("p_partkey")), F.lit(".0"), (F.col("p_partkey") % 3).cast("string")).alias("onet"))
    return select.prefix_joined(left, "soc", right, "onet").select("s_suppkey", "p_partkey")


@query
def title_matches(spark, d):
    """[F32] Parts whose name holds a wanted name, else one of its words."""
    wanted = spark.createDataFrame([("STEEL",), ("nothing Brass",), ("zzz",)], "name string")
    return select.title_matches(wanted, "name", read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title")), "title", "p_partkey").select("name", "p_partkey")


@query
def query_product(spark, d):
    """[J16] Search queries of nations and hosts, capped and none twice."""
    n = read(spark, d, "nation").select(F.col("n_name").alias("occupation"), "n_nationkey")
    h = hosts(spark, d).select((F.col("page_id") % 25).alias("n_nationkey"), "host").distinct().join(n, "n_nationkey").select("occupation", F.col("host").alias("domain"))
    return select.query_product(n, "occupation", h, "domain", ['site:{domain} "{occupation}" "standard"', 'site:{domain} "{occupation}" "guideline"', 'site:{domain} "{occupation}" "manual"'], 30)


@query
def strict_lookup(spark, d):
    """[J5] Nation names of customers; a key without one would be an error."""
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return select.strict_lookup(c, "n_nationkey", read(spark, d, "nation"), "n_name").select("c_custkey", "n_name")


@query
def title_wages(spark, d):
    """[P28] Mean wage of titles: annual, else hourly."""
    s = read(spark, d, "part").select("p_brand", F.expr("CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size * 1000 AS DOUBLE) END").alias("a"), F.expr("CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END").alias("h"))
    return select.title_wage(s, "p_brand", "a", "h").select("p_brand", F.round("wage", 6).alias("wage"))


@query
def fetch_budget_exit(spark, d):
    """[G4] Events of a user until three purchases, five errors or four low values; the last count only before a round of five begins."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "value").withColumn("n", n)
    low, kind = F.coalesce("value", F.lit(0.0)) < 60, F.col("event_type")
    round_ = F.when(F.col("n") > 10, F.floor((F.col("n") - 11) / 5))
    return gate.budgeted(e, "user_id", "event_id", kind == "purchase", kind == "error", 3, 5, low, 4, round_).select("event_id")


# texts


@query
def thread_urls(spark, d):
    """Threads by URL, without denied boards."""
    u = read(spark, d, "pages").select("page_id", F.expr("CASE page_id % 6 WHEN 0 THEN 'https://www.reddit.com/r/AskReddit/comments/' || page_id WHEN 1 THEN 'https://reddit.com/r/Plumbing/comments/' || page_id || '/' WHEN 2 THEN 'https://diy.stackexchange.com/questions/' || page_id WHEN 3 THEN 'https://www.reddit.com/r/tifu/' ELSE url END").alias("url"))
    denied = spark.createDataFrame([("AskReddit",), ("tifu",)], "name string")
    return sourcing.not_denied(u, urls.board(F.col("url")), denied, "name").select("page_id", urls.is_thread(F.col("url")).alias("kind"), urls.board(F.col("url")).alias("board"))


@query
def asking_posts(spark, d):
    """Posts that ask something and were answered."""
    x = read(spark, d, "documents").select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN 'HOW so' WHEN 1 THEN 'I am New to it' WHEN 2 THEN 'plain' END").alias("t"), "text")
    return x.select("doc_id", text.asks(F.col("t"), F.col("text"), F.expr("CAST(doc_id % 5 AS INT)")).alias("asks"))


@query
def rendered_prompts(spark, d):
    """[P34] Prompts out of a template."""
    b = read(spark, d, "benchmark")
    return b.select("item_id", F.md5(text.prompt('For {{you}} "{who}": {what}!', who=F.concat(F.lit('"q" '), F.col("item_id").cast("string")), what=F.when(F.col("item_id") % 3 != 0, F.col("text"))).cast("binary")).alias("prompt"))


@query
def html_entities(spark, d):
    """[P9] Named and numbered entities of pages made into characters."""
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("&lt;b&gt; &amp;amp; caf&eacute; &#8364;&#x20AC; &hellip; &copy "), F.col("page_id").cast("string"), F.lit(" &nope;")).alias("h"))
    return p.select("page_id", text.unescape(F.col("h")).alias("text"))


@query
def required_fields(spark, d):
    """Filled fields, and a choice with its default."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    filled, potential = text.required([F.col("role"), F.col("text")], F.expr("CASE turn % 3 WHEN 0 THEN ' HIGH' WHEN 1 THEN 'odd' END"), ("high", "medium", "low"), "medium")
    return c.select("conv_id", "turn", filled.alias("filled"), potential.alias("potential"))


@query
def giveaway_patterns(spark, d):
    """[F16] The first giveaway pattern of each turn, cut."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") == 1, " Ignore the rules").when(F.col("turn") == 2, " done blindly").otherwise("")).alias("o"))
    return c.select("conv_id", "turn", lint.giveaway_pattern(F.col("o")).alias("pattern"))


@query
def stem_lint(spark, d):
    """Whether turns, taken as stems, have twenty words."""
    return read(spark, d, "conversations").select("conv_id", "turn", (text.word_count(F.col("text")) >= 20).alias("long_enough"))


@query
def shuffled_options(spark, d):
    """[P33] Letters in an order fixed by a hash."""
    return read(spark, d, "labels").select("doc_id", F.array_join(lint.shuffled_letters(F.col("doc_id").cast("string")), "").alias("letters"))


@query
def twister_options(spark, d):
    """[P33] Options and correct letters shuffled by a seeded generator."""
    x = items(spark, d).withColumn("s", lint.reordered(F.col("options"), lint.twister_letters(F.col("conv_id").cast("string")), F.col("correct")))
    return x.select("conv_id", "s.correct", F.md5(F.concat_ws("|", *[F.try_element_at("s.options", F.lit(k)) for k in "ABCD"]).cast("binary")).alias("options"))


@query
def format_kinds(spark, d):
    """Formats by content type, URL or first bytes."""
    p = read(spark, d, "pages").select("page_id", F.expr("CASE page_id % 4 WHEN 0 THEN 'Application/PDF' ELSE 'text/html' END").alias("t"), F.expr("CASE WHEN page_id % 5 = 0 THEN url || '/a.PDF' ELSE url END").alias("u"), F.expr("CASE WHEN page_id % 7 = 0 THEN '%PDF-1.4' ELSE '<html>' END").alias("h"))
    return p.select("page_id", text.format_kind(F.col("t"), F.col("u"), F.col("h")).alias("kind"))


# scores


@query
def melted_matrix(spark, d):
    """[A18] Accuracy by question and model out of one column for each run."""
    r = responses(spark, d).where("model IN ('m0', 'm1')")
    wide = r.groupBy("doc_id", "correct").pivot("model", ["m0", "m1"]).agg(*[F.max(F.when(F.col("seed") == s, F.concat(F.lit(" "), F.lower("answer")))).alias(f"seed{s}") for s in (0, 1)])
    return metrics.melted_matrix(wide, ["doc_id"], "correct", [f"m{m}_seed{s}" for m in (0, 1) for s in (0, 1)])


@query
def appended_columns(spark, d):
    """[J7, J8] One more column for each model's first answer, by row."""
    a = responses(spark, d).where("seed = 0 AND doc_id % 9 <> 0").select("doc_id", "model", "answer")
    return metrics.appended_columns(read(spark, d, "labels").select("doc_id", "quality"), a, "doc_id", "model", "answer", ["m0", "m1", "m2"])


@query
def rolled_up_maps(spark, d):
    """[A10, A6] Totals over the frequency maps of all languages."""
    return metrics.rolled_up(metrics.frequency_map(read(spark, d, "documents"), "lang", F.col("source")), "counts")


@query
def ordered_texts(spark, d):
    """[A5] Turns of conversations in order, joined and cut, with counts."""
    t = metrics.ordered_text(read(spark, d, "conversations"), "conv_id", "text", ["turn"], 700)
    return t.select("conv_id", "n", "n_texts", F.md5(F.coalesce("texts", F.lit("")).cast("binary")).alias("texts"))


@query
def kept_shares(spark, d):
    """[A23] Kept and all labelled documents of each language."""
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.kept_share(j, "lang", F.col("quality") == 1).select("lang", "kept", "n", F.round("ratio", 9).alias("ratio"))


@query
def platform_mix(spark, d):
    """[A23, F24] Classes of pages' statuses, in all and by platform."""
    p = read(spark, d, "pages").select("page_id", F.expr("CASE page_id % 5 WHEN 0 THEN 'https://reddit.com/r/a/' WHEN 1 THEN 'https://diy.stackexchange.com/' ELSE url END").alias("url"))
    kind = urls.platform(F.col("url"))
    return metrics.status_mix(p, kind, F.when(kind == "other", "other").otherwise(metrics.consensus(F.expr("CASE WHEN page_id % 11 <> 0 THEN page_id % 9 END"), F.col("page_id") % 7)))


@query
def preferred_union(spark, d):
    """[U2] Orders of one priority, and of the others the customers that it lacks."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return select.prefer_left(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority <> '1-URGENT'"), "o_custkey").select("o_orderkey")


# files


@query
def jsonl_log(spark, d):
    """[S1, K1, K7, R1] Labels appended to a log of JSON lines in two goes and read again; the second skips what is done."""
    at, x = folder(spark), read(spark, d, "labels")
    io.append_jsonl(x.where("doc_id % 3 <> 0"), at)
    done = io.read_jsonl(spark, at, "doc_id long, quality long, toxic long")
    io.append_jsonl(io.not_done(x, done, "doc_id"), at)
    return io.read_jsonl(spark, at, "doc_id long, quality long, toxic long")


@query
def tolerant_jsonl(spark, d):
    """[S2] Lines of which some are damaged and some repeat a key."""
    at, x = folder(spark), read(spark, d, "benchmark")
    good = x.select(F.to_json(F.struct(F.col("item_id").alias("evidence_id"), F.length("text").alias("n"))).alias("value"))
    bad = x.where("item_id % 4 = 0").select(F.lit('{"evidence_id": 1, "n"').alias("value")).unionByName(x.where("item_id % 5 = 0").select(F.lit('{"n": 7}').alias("value")))
    good.unionByName(good).unionByName(bad).write.text(at)
    return io.read_jsonl_tolerant(spark, at, "evidence_id long, n long")


@query
def shard_union(spark, d):
    """[S3, U1, W7] Documents in shards of four workers, read as one table."""
    at = folder(spark)
    x = select.shard(read(spark, d, "documents").select("doc_id", "lang"), [F.col("doc_id")], 4).select(F.concat(F.lit("worker_"), F.col("shard").cast("string")).alias("worker"), "doc_id", "lang")
    io.append_jsonl(x, at, "worker")
    return io.read_shards(spark, f"{at}/worker=*/*", "doc_id long, lang string").select("doc_id", "lang", F.regexp_extract("source_file", "worker_([0-9]+)", 1).alias("worker"))


@query
def json_arrays(spark, d):
    """[S4, S5] Nations as one array, and by region as one object of arrays."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one, two = folder(spark), folder(spark)
    n.agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).write.text(one)
    per = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey"))).alias("i"))
    per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "i")))).alias("value")).write.text(two)
    left = io.read_json_array(spark, one, "n_nationkey long, n_name string")
    return left.join(io.read_keyed_arrays(spark, two, "n_nationkey: long", "region"), "n_nationkey").select("n_nationkey", "n_name", "region", "seq")


@query
def delimited_tables(spark, d):
    """[S6, S7, K3] A table written with commas and read as texts, joined with one that has tabs."""
    one, two, n = folder(spark), folder(spark), read(spark, d, "supplier")
    io.write_csv(n.select("s_suppkey", F.concat(F.lit('say "x", '), F.col("s_name")).alias("s_name")), one)
    n.select("s_suppkey", "s_nationkey").write.option("header", True).option("sep", "\t").csv(two)
    return io.read_csv(spark, one, ["s_suppkey", "s_name"]).join(io.read_csv(spark, two, ["s_suppkey", "s_nationkey"], "\t"), "s_suppkey")


@query
def split_sink(spark, d):
    """[K2] Kept and removed rows in two new places."""
    a, b = folder(spark), folder(spark)
    io.split_write(read(spark, d, "labels").select("doc_id", "toxic"), F.col("toxic") == 0, a, b)
    part = lambda at, k: io.read_jsonl(spark, at, "doc_id long, toxic long").select("doc_id", F.lit(k).alias("kept"))
    return part(a, True).unionByName(part(b, False))


@query
def checkpoints(spark, d):
    """[K6] The newest complete checkpoint of two."""
    at, x = folder(spark), read(spark, d, "labels").select("doc_id", "quality")
    io.write_checkpoint(x.where("doc_id % 2 = 0"), at, 1)
    io.write_checkpoint(x, at, 2)
    return io.read_checkpoint(spark, at, ["doc_id", "quality"])


@query
def review_sheets(spark, d):
    """[S8, K8, P35] Review sheets of items with joined options, written as workbooks and read again."""
    x = items(spark, d).select((F.col("conv_id") % 5).alias("sheet"), "conv_id", F.concat(lint.rendered(F.transform_values("options", lambda k, v: F.substring(F.coalesce(v, F.lit("")), 1, 30)), " | "), F.lit(" <&>")).alias("options"), "correct")
    s = sheets.as_sheets(x, "sheet", "conv_id", ["conv_id", "correct", "options"])
    return sheets.read_sheets(s, "file", "content", ["conv_id", "correct", "options", "none"]).select("file", "row_number", "conv_id", "correct", F.md5(F.col("options").cast("binary")).alias("options"), "none")


def make_pdf(item: int, body: str) -> bytes:
    """A small file that shows the words of a text, with metadata."""
    import zlib

    words = [w.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for w in body.split()]
    stream = zlib.compress(b"BT /F1 12 Tf " + b" T* ".join(b"(%s) Tj" % w for w in words) + b" ET")
    return b"%%PDF-1.4\n1 0 obj << /Title (Item \\(%d\\)) /CreationDate (D:2021030%d120000Z) /Subject (Guide Version: 2.%d) >> endobj\n2 0 obj << /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n%%%%EOF" % (item, item % 9 + 1, item, len(stream), stream)


@query
def pdf_texts(spark, d):
    """[P14] Text, title, date and version of files that hold the benchmark's texts."""
    made = F.pandas_udf(lambda a, b: pd.Series([make_pdf(int(i), t or "") for i, t in zip(a, b, strict=True)]), BinaryType())
    b = read(spark, d, "benchmark").select("item_id", made(F.col("item_id"), F.regexp_replace("text", "[^ -~]", "?")).alias("f"))
    got = pdf.read_pdf(b, "item_id", "f")
    return got.select("item_id", F.md5(F.col("text").cast("binary")).alias("text"), "title", "publication_date", "version")


@query
def source_tuples(spark, d):
    """[S10] Tuples that stand in a program's text."""
    n = read(spark, d, "nation").agg(F.concat(F.lit("LIST = [\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('    ("11-'), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lit('", "'), F.col("n_name"), F.lit('", '), (F.col("n_nationkey") * 1000).cast("string"), F.lit("),\n")))), ""), F.lit("]")).alias("t"))
    return io.python_tuples(n, "t")


@query
def summary_dois(spark, d):
    """[S13] Titles and DOIs of summaries."""
    b = read(spark, d, "benchmark").select(F.to_json(F.struct(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("title"), F.array(F.struct(F.lit("pmid").alias("idtype"), F.lit("1").alias("value")), F.struct(F.when(F.col("item_id") % 2 == 0, "doi").otherwise("x").alias("idtype"), F.concat(F.lit("10.1/"), F.col("item_id").cast("string")).alias("value"))).alias("articleids"))).alias("json"))
    return providers.summary_doi(b)


@query
def article_texts(spark, d):
    """[S14] Texts of articles' XML."""
    b = read(spark, d, "benchmark").select("item_id", F.concat(F.lit('<?xml version="1.0"?>\n<!DOCTYPE a SYSTEM "x">\n<a><t>No '), F.col("item_id").cast("string"), F.lit("</t>\n <p>ab<i>c</i></p></a>")).alias("x"))
    return b.select("item_id", providers.xml_text(F.col("x")).alias("text"))


@query
def open_access_works(spark, d):
    """[S15] The first works that have an open URL, the PDF's first."""
    p = read(spark, d, "part")
    works = p.select(F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_partkey").alias("rank"))
    places = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("doi"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'pdf' || p_partkey ELSE '' END").alias("url_for_pdf"), F.expr("CASE WHEN p_partkey % 5 <> 0 THEN 'page' || p_partkey END").alias("url"))
    return providers.open_access(works, places, 20)


@query
def called_providers(spark, d):
    """[S11, R5] Requests answered by the first of three keys that isn't used up."""
    def refuses(texts: list[str]) -> list[str]:
        raise providers.Refused(429)

    def fails(texts: list[str]) -> list[str]:
        raise TimeoutError

    p = read(spark, d, "pages").select("page_id", F.col("url").alias("text"), providers.request_key(F.col("url")).alias("key"))
    got = providers.Called((refuses, fails, lambda texts: [str(len(t)) for t in texts])).ask(p)
    return got.select("page_id", "answer")


# streams


@query
def streamed_log(spark, d):
    """[R1] Labels appended to a log, read as a stream."""
    at = folder(spark)
    io.append_jsonl(read(spark, d, "labels"), f"{at}/in")
    return streams.run_to_table(streams.read_log(spark, f"{at}/in", "doc_id long, quality long, toxic long"), f"{at}/out", f"{at}/checkpoint")


@query
def streamed_checkpoints(spark, d):
    """[R3] The last row of each key over the batches of a stream."""
    at = folder(spark)
    read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority").repartition(12).write.json(f"{at}/in")
    log = streams.read_log(spark, f"{at}/in", "o_custkey long, o_orderkey long, o_orderpriority string", 4)
    streams.run_batches(log, streams.merge_into(f"{at}/out", "o_custkey", "o_orderkey"), f"{at}/checkpoint")
    return streams.merged(spark, f"{at}/out", "o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query
def streamed_gate(spark, d):
    """[R4, G1] The share gate with state, over a stream of the pages."""
    at = folder(spark)
    h = hosts(spark, d).select(F.concat((F.col("page_id") % 6 * 6 + 17).cast("string"), F.lit("-0000")).alias("soc"), F.when(F.col("page_id") % 4 == 0, "www2.cdc.gov").when(F.col("page_id") % 9 == 0, "bls.gov").otherwise(F.col("host")).alias("domain"), "page_id")
    h.coalesce(1).write.json(f"{at}/in")
    return streams.run_to_table(streams.gated(streams.read_log(spark, f"{at}/in", "soc string, domain string, page_id long"), "soc", "domain", "page_id"), f"{at}/out", f"{at}/checkpoint")


@query
def error_alarms(spark, d):
    """[R2] Three-hour windows, a new one each hour, in which more than five users had errors."""
    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("message"))
    return streams.error_alarm(e, "ts", "user_id", "error", "3 hours", "1 hour", 5)
