"""The registered queries of the engine's own operators, each over whole tables; names in brackets are the survey's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threshmill.functions import lint, parsers, text, urls
from threshmill.operators import gate, metrics, select, similar

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Multiple-choice items out of conversations: the first four turns as options, the first as question."""
    c = read(spark, d, "conversations").where("turn < 4")
    wide = c.groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == i, F.col("text"))).alias(x) for i, x in enumerate("abcd")])
    options = F.map_from_arrays(F.array(*map(F.lit, "ABCD")), F.array("a", "b", "c", "d"))
    return wide.select("conv_id", F.coalesce("a", F.lit("")).alias("question"), options.alias("options"), F.substring(F.lit("ABCD"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1)).alias("correct"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers of three models with three seeds to each labelled document, fixed by arithmetic."""
    grid = spark.range(9).select((F.col("id") / 3).cast("int").alias("m"), (F.col("id") % 3).cast("int").alias("seed"))
    base = read(spark, d, "labels").select("doc_id", "quality", "toxic").crossJoin(F.broadcast(grid))
    letter = lambda e: F.substring(F.lit("ABCD"), (e % 4 + 1).cast("int"), F.lit(1))
    return base.select("doc_id", "quality", F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "seed", letter(F.col("doc_id")).alias("correct"), letter((F.col("doc_id") * (F.col("m") + 2) + F.col("seed") * F.col("doc_id") % 7) % 5).alias("answer"))


# sources and URLs


@query
def source_category_share(spark, d):
    """[P1, P4, A20, A21] Pages by source category, with their percent of all."""
    h = hosts(spark, d).select(urls.category(urls.organisation(F.col("host"))).alias("category"))
    return metrics.shares(h, "category").select("category", "n", F.round("percent", 6).alias("percent"))


@query
def source_category_v2(spark, d):
    """[A21] The second version of the categories."""
    return hosts(spark, d).select("page_id", urls.category(F.col("host"), 2).alias("category"))


@query
def url_host(spark, d):
    """[P1, P2] Host, and the host without every leading w and dot."""
    return hosts(spark, d).select("page_id", "host", urls.strip_www_run(F.col("host")).alias("stripped"))


@query
def url_canonical(spark, d):
    """[P3] The three ways to cut a URL."""
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", urls.canonical(u).alias("no_utm"), urls.canonical(u, "query").alias("no_query"), urls.canonical(u, "utm_fragment").alias("no_fragment"))


@query
def url_org_rollup(spark, d):
    """[P4, W8] Pages of each organisation."""
    return hosts(spark, d).groupBy(urls.organisation(F.col("host")).alias("org")).agg(F.count("*").alias("n"))


@query
def url_classes(spark, d):
    """[F4, F5, F23, F24, P16] Vendor, community, platform and paywall classes."""
    h = F.col("host")
    return hosts(spark, d).select("page_id", urls.is_vendor(h).alias("vendor"), urls.community_class(h).alias("class"), urls.platform(F.col("url")).alias("platform"), urls.paywalled(F.col("url")).alias("paywalled"), urls.pmc_id(F.col("url")).alias("pmc"))


@query
def domain_allowlist(spark, d):
    """[F1, F2, F3, J13] Pages whose host stands at or below a listed one."""
    roots = hosts(spark, d).where(F.col("url").contains(".org/")).select(F.array_join(F.slice(F.split("host", "[.]"), -2, 2), ".").alias("root")).distinct()
    return similar.allowed(hosts(spark, d), "host", roots, "root").select("page_id", "host")


@query
def soc_codes(spark, d):
    """[P5, P6, J12] Major group and lifted code of a code made of the customer key."""
    code = F.concat((F.col("c_custkey") % 43 + 11).cast("string"), F.lit("-"), (F.col("c_custkey") % 9000 + 1000).cast("string"))
    return read(spark, d, "customer").select("c_custkey", urls.major_group(code).alias("grp"), urls.major_group(code, True).alias("merged"), urls.lift_soc(code).alias("lifted"))


# text


@query
def html_clean_v1(spark, d):
    """[P7, P18, P21] Page text without scripts, styles and tags."""
    t = text.clean_html(F.col("html"))
    return read(spark, d, "pages").select("page_id", t.alias("body"), text.word_count(t).alias("n_words"))


@query
def html_clean_v2(spark, d):
    """[P8] Pages without frames and advertising."""
    return read(spark, d, "pages").select("page_id", F.length(text.strip_chrome(F.col("html"))).alias("n"), F.md5(text.strip_chrome(F.col("html")).cast("binary")).alias("digest"))


@query
def html_unescaped(spark, d):
    """[P9] Clean text with the five basic entities undone."""
    return read(spark, d, "pages").select("page_id", text.unescape_basic(text.clean_html(F.col("html"))).alias("body"))


@query
def html_article_focus(spark, d):
    """[P10] The first articles, or the page."""
    return read(spark, d, "pages").select("page_id", text.article_focus(F.col("html"), least=1).alias("body"))


@query
def html_title(spark, d):
    """[P11, P12, P13] Title, date and version."""
    h = F.col("html")
    return read(spark, d, "pages").select("page_id", text.title(h).alias("title"), text.publication_date(h).alias("published"), text.version(h).alias("version"))


@query
def content_hash_exact_dedup(spark, d):
    """[P15, D1] The first document of each content hash."""
    rows = read(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    return select.first_per_key(rows, ["hash"], F.col("doc_id")).select("doc_id", "hash")


@query
def last_wins_dedup(spark, d):
    """[D2, U4, S9] The last order of each customer."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return select.last_per_key(o, ["o_custkey"], F.struct("o_orderkey"))


@query
def token_sets(spark, d):
    """[P19, P20] Distinct tokens of each document, by either pattern."""
    return read(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"), F.size(text.tokens(F.col("text"), "[a-z]{4,}")).alias("n_long"))


@query
def normal_forms(spark, d):
    """[P17, P18] Normal form of each benchmark text, and its first 120 characters."""
    n = text.normal_form(F.col("text"))
    return read(spark, d, "benchmark").select("item_id", n.alias("normal"), F.substring(n, 1, 120).alias("head"))


@query
def doc_min_length_reason(spark, d):
    """[F7, P31] Why a document is too short, and its quota."""
    return read(spark, d, "documents").select("doc_id", text.too_short(F.col("text")).alias("reason"), text.length_quota(F.length("text")).alias("quota"))


@query
def thin_content(spark, d):
    """[F8, F9, F10] Error pages and thin content."""
    return read(spark, d, "documents").select("doc_id", text.error_page(F.col("text")).alias("error"), text.thin_reason(F.col("text")).alias("reason"))


@query
def voice_strip(spark, d):
    """[P22] Turns without community voice."""
    c = read(spark, d, "conversations").withColumn("text", F.concat(F.when(F.col("turn") == 0, "Hello everyone, hi all! Has anybody ever seen this? ").otherwise(""), F.coalesce("text", F.lit(""))))
    return c.select("conv_id", "turn", text.strip_voice(F.col("text")).alias("clean"))


@query
def first_sentences(spark, d):
    """[P23] The first sentences of each turn."""
    return read(spark, d, "conversations").select("conv_id", "turn", text.first_sentences(F.col("text")).alias("head"))


@query
def title_terms(spark, d):
    """[P24, P25] Titles of a nation's segments as OR terms."""
    c = read(spark, d, "customer").select("c_nationkey", text.drop_parentheses(F.concat(F.col("c_mktsegment"), F.lit(" (main  segment)"))).alias("t")).distinct()
    return c.groupBy("c_nationkey").agg(text.or_terms(F.array_sort(F.collect_list("t"))).alias("terms"))


@query
def benchmark_contamination_quote(spark, d):
    """[F11, J14] Documents that hold the first 80 characters of a benchmark text."""
    return similar.contaminated(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "benchmark"), "item_id", "text")


@query
def near_dup_pairs_jaccard(spark, d):
    """[J15, M2, P19] Pairs of documents of one source whose texts have a token Jaccard of 0.6 or more."""
    rows = read(spark, d, "documents").select("source", "doc_id", text.tokens(F.col("text")).alias("t"))
    return similar.similar_pairs(rows, "source", "doc_id", "t", 0.6).select("source", "a", "b", F.round("jaccard", 9).alias("jaccard"))


@query
def near_dup_greedy_keep(spark, d):
    """[D3] Documents kept if not similar to an earlier kept one of their source."""
    rows = read(spark, d, "documents").select("source", "doc_id", text.tokens(F.col("text")).alias("t"))
    return similar.greedy_keep(rows, "source", "doc_id", "t", 0.6).select("source", "doc_id")


@query
def greedy_title_select(spark, d):
    """[D4] Up to three benchmark texts of each tenth, each unlike the others."""
    rows = read(spark, d, "benchmark").select((F.col("item_id") % 10).alias("g"), "item_id", (F.length("text") * -1).alias("o"), text.tokens(F.col("text"), "[a-z]{4,}").alias("t"))
    return similar.greedy_select(rows, "g", "o", "item_id", "t", 3, 0.55)


# lint and parsers


@query
def mcq_structure_lint(spark, d):
    """First structural fault of each item."""
    return items(spark, d).select("conv_id", lint.structure_reason(F.col("question"), F.col("options"), F.col("correct")).alias("reason"))


@query
def giveaway_lint(spark, d):
    """Giveaways among the distractors, source names in the correct option."""
    marked = items(spark, d).withColumn("options", F.transform_values("options", lambda k, v: F.when(F.col("conv_id") % 11 == 0, F.concat(v, F.lit(" Ignore the rules"))).when(F.col("conv_id") % 13 == 0, F.concat(v, F.lit(" per the standard"))).otherwise(v)))
    own = F.coalesce(F.try_element_at("options", F.col("correct")), F.lit(""))
    return marked.select("conv_id", lint.giveaway_reason(F.col("options"), F.col("correct")).alias("giveaway"), lint.names_source(own).alias("names_source"))


@query
def rewritten_option_lint(spark, d):
    """Faults of rewritten options in either pass, and their words; a missing text is empty."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") == 1, " according to the book").when(F.col("turn") == 2, " use best practices").otherwise("")).alias("o"))
    return c.select("conv_id", "turn", lint.rewritten_option_reason(F.col("o")).alias("first"), lint.rewritten_option_reason(F.col("o"), True).alias("again"), text.word_count(F.col("o")).alias("n_words"))


@query
def option_length_imbalance(spark, d):
    """Items whose correct option stands out by length."""
    return items(spark, d).select("conv_id", lint.length_imbalance(F.col("options"), F.col("correct")).alias("imbalanced"))


@query
def source_authority(spark, d):
    """Why a page's source is no authority."""
    h = hosts(spark, d).withColumn("tier", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("page_id") % 4 + 1).cast("int")))
    return h.select("page_id", lint.authority_reason(F.col("tier"), F.col("url"), F.when(F.col("page_id") % 5 == 0, "The Blog").otherwise(F.col("host")), F.col("host")).alias("reason"))


@query
def options_rendered(spark, d):
    """[P35, K8] Options in one string."""
    return items(spark, d).where("options['D'] IS NOT NULL").select("conv_id", F.md5(lint.rendered(F.col("options"), " | ").cast("binary")).alias("digest"))


@query
def answer_letters(spark, d):
    """[X1, X2, X3] The letter that each parser reads from a reply."""
    c = read(spark, d, "conversations").withColumn("r", F.concat(F.when(F.col("turn") % 3 == 0, "Answer: ").when(F.col("turn") % 3 == 1, "(b) ").otherwise(""), F.coalesce("text", F.lit(""))))
    return c.select("conv_id", "turn", parsers.letter_first(F.col("r")).alias("x1"), parsers.letter_cued(F.col("r")).alias("x2"), parsers.letter_strict(F.col("r")).alias("x3"))


@query
def verdict_tokens(spark, d):
    """[X6, X7, X9, F33] Categories and verdicts of replies."""
    r = F.coalesce("text", F.lit(""))
    return read(spark, d, "conversations").select("conv_id", "turn", parsers.category_token(r, ("other_half", "the", "und", "que")).alias("category"), parsers.yes_no(r).alias("yes"), parsers.directness(F.concat(F.when(F.col("turn") == 0, " direct ").otherwise("error "), r)).alias("direct"), parsers.transient(r).alias("transient"))


@query
def tolerant_json(spark, d):
    """[L1, S1] A field of properties in fences or prose."""
    raw = F.concat(F.when(F.col("event_id") % 2 == 0, "```json\n").otherwise("Reply: "), F.coalesce("props", F.lit("none")), F.when(F.col("event_id") % 2 == 0, "\n```").otherwise(" end"))
    return read(spark, d, "events").select("event_id", parsers.tolerant_json(raw, "k string, page string, ref string, n string").isNotNull().alias("parsed"))


@query
def numeric_coercion(spark, d):
    """[P26, P27, P28, P29, P30] Numbers with separators and codes, wages and scores."""
    o = read(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, "*").when(F.col("o_orderkey") % 5 == 1, "#").otherwise(F.concat((F.col("o_orderkey") % 900 + 100).cast("string"), F.lit(",000")))
    n = parsers.number(raw)
    return o.select("o_orderkey", n.alias("number"), F.round(select.wage(n, F.lit(None).cast("double"), F.col("o_totalprice")), 4).alias("wage"), F.round(select.specificity(F.col("o_orderkey") % 9, F.lit(0.5)), 9).alias("specificity"), select.rank_score(F.col("o_orderkey"), F.col("o_custkey"), F.lit(3)).alias("score"))


# joins


@query
def label_join_semi_anti(spark, d):
    """[J9, J10, U3] Labelled and unlabelled documents by source."""
    docs, labels = read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels").select("doc_id")
    semi = docs.join(labels, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("labelled"))
    anti = docs.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("unlabelled"))
    return semi.join(anti, "source", "full").select("source", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("unlabelled", F.lit(0)).alias("unlabelled"))


@query
def label_default_fill(spark, d):
    """[J1, J3] Documents with labels, 0 where there are none."""
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query
def two_key_pivot_join(spark, d):
    """[J2] Quantities of two flags side by side, joined on two keys."""
    li = read(spark, d, "lineitem")
    keys = ["l_orderkey", "l_suppkey"]
    wide = li.where(F.col("l_returnflag").isin("A", "R")).groupBy(*keys).pivot("l_returnflag", ["A", "R"]).agg(F.sum("l_quantity"))
    base = li.where("l_linestatus = 'F'").select(*keys).distinct()
    return base.join(wide, keys, "left").select(*keys, F.round("A", 4).alias("a_qty"), F.round("R", 4).alias("r_qty"))


@query
def dictionary_lookup(spark, d):
    """[J4, J5, J6] Nation and region of each customer, some through another name."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 24, 23).otherwise(F.col("c_nationkey")).alias("n_nationkey"))
    dims = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return c.join(F.broadcast(dims), "n_nationkey").select("c_custkey", "n_name", "r_name")


@query
def wide_votes(spark, d):
    """[J7, J8, K6] Answers of all models side by side."""
    r = responses(spark, d).where("seed = 0")
    return r.groupBy("doc_id").pivot("model", ["m0", "m1", "m2"]).agg(F.first("answer"))


@query
def items_by_seeds(spark, d):
    """[J16, J17, W7] Each benchmark item with each seed, dealt to shards in turn."""
    rows = read(spark, d, "benchmark").select("item_id").crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("seed"))))
    return select.shard(rows, [F.col("item_id"), F.col("seed")], 4)


@query
def pick_validation(spark, d):
    """[J18] Every supplier that a line item picks: whether it is in the pool of those with a balance, with what the pool says of it."""
    pool = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), "s_name", "s_nationkey")
    picks = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("k")).distinct()
    j = picks.join(pool, "k", "left")
    return j.select("p_partkey", "k", F.col("s_name").isNotNull().alias("valid"), F.when(F.col("s_name").isNull(), None).when(F.col("s_nationkey") < 8, "A").when(F.col("s_nationkey") < 16, "C").otherwise("B").alias("tier"), F.coalesce("s_name", F.concat(F.lit("#"), F.col("k").cast("string"))).alias("publisher"))


@query
def url_metadata_join(spark, d):
    """[J22] One lookup for each different URL path, joined back."""
    p = read(spark, d, "pages").select("page_id", urls.canonical(F.col("url"), "query").alias("u"))
    once = p.select("u").distinct().select("u", F.length("u").alias("n"))
    return p.join(once, "u", "left").select("page_id", "n")


# aggregates


@query
def group_counts(spark, d):
    """[A1, A4, A5] Counts, distinct counts and a joined list by source."""
    docs = read(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_langs"), F.count_if(F.col("n_chars") > 1500).alias("n_long"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query
def floor_having(spark, d):
    """[A2, F30, F31] Documents of sources and languages with twelve or more."""
    return select.with_floor(read(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], 12)


@query
def above_below_floor(spark, d):
    """[A3] Hosts above and below a floor of three pages, with their first page's URL."""
    return select.floor_split(hosts(spark, d), "host", "url", "page_id", 3)


@query
def frequency_maps(spark, d):
    """[A6, A7, A10] Languages of each source as a map, shown as sorted text."""
    m = metrics.frequency_map(read(spark, d, "documents"), "source", F.col("lang"))
    return m.select("source", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query
def publisher_concentration(spark, d):
    """[A8, G6] Concentration of each language's sources, and what it triggers."""
    c = gate.concentration(read(spark, d, "documents"), "lang", "source", "n_chars")
    reasons = gate.replacement_reasons(F.col("n"), F.col("top_share"), F.col("n_publishers"), F.col("n_documents"), least=130)
    return c.select("lang", "n", F.round("top_share", 9).alias("top_share"), "n_publishers", "n_documents", reasons.alias("reasons"))


@query
def rollup_totals(spark, d):
    """[A11] Quantities by flag and status with subtotals."""
    li = read(spark, d, "lineitem")
    r = li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().cast("int").alias("gid"))
    return r.select(F.coalesce("l_returnflag", F.lit("<TOTAL>")).alias("flag"), F.coalesce("l_linestatus", F.lit("<TOTAL>")).alias("status"), "n", "qty", "gid")


@query
def wage_share(spark, d):
    """[A12] Share of each segment in all balances."""
    c = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s"))
    return c.select("c_mktsegment", F.bround(F.col("s") / F.sum("s").over(Window.partitionBy()), 4).alias("share"))


@query
def accuracy_mean_se(spark, d):
    """[A13, A14] Accuracy and standard error of each model."""
    q = metrics.question_accuracy(responses(spark, d), ["doc_id", "model"], "answer", "correct")
    return metrics.accuracy(q, ["model"]).select("model", "n", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


@query
def weighted_accuracy(spark, d):
    """[A16, J4] Accuracy weighted by text length."""
    q = metrics.question_accuracy(responses(spark, d), ["doc_id", "model"], "answer", "correct").join(read(spark, d, "documents").select("doc_id", F.length("text").alias("w")), "doc_id")
    return metrics.weighted_accuracy(q, ["model"], "w").select("model", F.round("mean", 9).alias("mean"), F.round("se", 7).alias("se"))


@query
def open_ended_rate(spark, d):
    """[A15, A27] Share of YES votes; one with a space before it is none."""
    votes = read(spark, d, "labels").select((F.col("doc_id") % 4).alias("g"), F.when(F.col("doc_id") % 9 == 0, None).when((F.col("quality") == 1) & (F.col("doc_id") % 5 == 0), " yes").when(F.col("quality") == 1, "yes").otherwise("No").alias("v"))
    return metrics.open_ended(votes, ["g"], "v").select("g", "n", F.round("rate", 9).alias("rate"), F.round("se", 9).alias("se"))


@query
def accuracy_matrix_pivot(spark, d):
    """[A17, A18, A19] Accuracy by source and model."""
    q = metrics.question_accuracy(responses(spark, d), ["doc_id", "model"], "answer", "correct").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    m = metrics.matrix(q, "source", "model", ["m0", "m1", "m2"])
    return m.select("source", "n", *[F.round(c, 9).alias(c) for c in ("m0", "m1", "m2", "row_mean")])


@query
def leaderboard(spark, d):
    """[A22] Accuracy and means of readable numbers."""
    e = read(spark, d, "events")
    return metrics.leaderboard(e, "event_type", F.col("value") > 50, F.col("event_type") == "error", ["value"]).select("event_type", "n", "accuracy", F.round("avg_value", 6).alias("avg_value"))


@query
def label_distribution(spark, d):
    """[A24] Values of two label columns, in long form."""
    return read(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "label", "value").groupBy("label", "value").agg(F.count("*").alias("n"))


@query
def count_histogram(spark, d):
    """[A25] How many customers have how many orders."""
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders")).groupBy("n_orders").agg(F.count("*").alias("n"))


@query
def supply_gap(spark, d):
    """[A26, G12] How many documents each source lacks of 51."""
    docs = read(spark, d, "documents")
    return select.gap(docs.where("lang = 'en'"), docs, "source", 51)


# ranking, quotas, gates


@query
def top_n_per_group(spark, d):
    """[W1, W3, W10, W11] The five largest orders of each customer segment, then the first twelve."""
    j = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    best = select.top_per_group(j, ["c_mktsegment"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return best.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12).select("c_mktsegment", "o_orderkey", "rank")


@query
def primary_reserve_split(spark, d):
    """[W2] Three primaries and two reserves of each nation."""
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return select.primary_and_reserve(c, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3, 2).select("c_nationkey", "c_custkey", "rank", "role")


@query
def round_robin_cap(spark, d):
    """[W5] Up to 40 documents of each language, from its sources in turn."""
    return select.round_robin_cap(read(spark, d, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id", 40)


@query
def k_groups_m_items(spark, d):
    """[W6] Four items of each of the three largest sources of a language."""
    return select.k_groups_m_items(read(spark, d, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id", 3, 4)


@query
def top_mid_bottom(spark, d):
    """[W9] First, middle and last five sources by mean length."""
    s = read(spark, d, "documents").groupBy("source").agg(F.round(F.avg(F.length("text")), 6).alias("m"))
    return select.top_mid_bottom(s, [F.desc("m"), F.col("source")], 5).select("source", "rank", "part")


@query
def hashed_sample(spark, d):
    """[W13, W14] Twenty documents in a hashed order."""
    return select.hashed_sample(read(spark, d, "documents").select("doc_id"), "doc_id", 20, 7)


@query
def proportional_allocation(spark, d):
    """[G3] Places of each market segment in proportion to its balance."""
    c = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("w"), F.count("*").alias("n")).collect()  # one row for each segment
    got = select.proportional([(r[0], float(r[1]), r[2]) for r in c], 100)
    return spark.createDataFrame(sorted(got.items()), "segment string, places int")


@query
def domain_cap_iterative(spark, d):
    """[G2] Pages after the largest host is cut back to a tenth."""
    h = hosts(spark, d).withColumn("g", (F.col("page_id") % 5).cast("string"))
    return select.capped_domains(h, "host", "g", "page_id", 0.1).select("page_id", "host")


@query
def share_gate(spark, d):
    """[G1, R4] Pages accepted by the share gate, in order within each group."""
    h = hosts(spark, d).select(F.concat((F.col("page_id") % 6 * 6 + 17).cast("string"), F.lit("-0000")).alias("soc"), F.when(F.col("page_id") % 4 == 0, "www2.cdc.gov").when(F.col("page_id") % 9 == 0, "bls.gov").otherwise(F.col("host")).alias("domain"), "page_id")
    return gate.share_gate(h, "soc", "domain", "page_id")


@query
def budgeted_exit(spark, d):
    """[G4] Events of a user until ten purchases or four errors."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    types = F.col("event_type")
    return gate.budgeted(e, "user_id", "event_id", types == "purchase", types == "error", 10, 4).select("event_id")


@query
def consecutive_failure_cutoff(spark, d):
    """[G5] Events of a user until three in a row are not above 50."""
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    return gate.until_failures_in_row(e, "user_id", "event_id", ~(F.coalesce("value", F.lit(0.0)) > 50), 3).select("event_id")


@query
def reserve_assignment(spark, d):
    """[G7, G8] The k-th poor customer of a nation takes its k-th supplier."""
    poor = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("g"), "c_custkey")
    pool = read(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", (F.col("s_acctbal") > 0).alias("ok"))
    return gate.assign_until_success(poor, pool, "g", "c_custkey", "s_suppkey", "ok").select("c_custkey", "reserve_s_suppkey")


@query
def replaced_filter(spark, d):
    """[J11] Orders without those of removed customers, unless urgent."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", "x").alias("why"))
    gone = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return gate.replaced(o, "k", gone, "why").select("o_orderkey")


@query
def resume_state(spark, d):
    """Whether a user's run is done, to skip or to retry."""
    e = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("kept"), F.count("*").alias("fetched"), F.count_if(F.col("value") < 90).alias("bad"))
    return e.select("user_id", gate.resume_state(F.when(F.col("user_id") % 2 == 0, 0).otherwise(F.col("kept")), F.col("fetched"), F.col("bad")).alias("state"))


# threads and verdicts


@query
def thread_top_next_ratio(spark, d):
    """[W4, F28, L11] Best and next scores of each conversation, and its consensus."""
    t = metrics.top_and_next(read(spark, d, "conversations"), "conv_id", F.length(F.coalesce("text", F.lit(""))))
    return t.select("conv_id", "top", "next", F.round("ratio", 9).alias("ratio"), "n_answers", metrics.consensus(F.col("top"), F.col("ratio")).alias("consensus"))


@query
def consensus_mix(spark, d):
    """[A23, L11] How many conversations have a consensus."""
    t = metrics.top_and_next(read(spark, d, "conversations"), "conv_id", F.length(F.coalesce("text", F.lit(""))))
    return t.groupBy(metrics.consensus(F.col("top"), F.col("ratio"), times=2).alias("consensus")).agg(F.count("*").alias("n"))


@query
def agreement_filter(spark, d):
    """[L9, L10] Decisions from option labels fixed by arithmetic."""
    labels = read(spark, d, "labels").select("doc_id")
    word = lambda i: F.element_at(F.array(*map(F.lit, ("AGREES", "CONTRADICTS", "OFF_TOPIC", "UNCLEAR"))), (F.pmod(F.col("doc_id") * i + F.floor(F.col("doc_id") / 4), F.lit(4)) + 1).cast("int"))
    m = F.map_from_arrays(F.array(*map(F.lit, "BCD")), F.array(word(1), word(3), word(5)))
    decision, relabel = metrics.agreement(F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.col("doc_id") % 6 + 1).cast("int")), F.col("doc_id") % 5 != 0, m)
    return labels.select("doc_id", decision.alias("decision"), relabel.alias("answer"))


# vectors and streams


@query
def cosine_to_centroid(spark, d):
    """[M1, A27] Cosine of each vector to the mean of its label."""
    e = read(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return e.join(centre, "label").select("vec_id", F.round(similar.cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"))


@query
def event_windows_tumbling(spark, d):
    """[R2, extension] Events by hour and type."""
    w = read(spark, d, "events").groupBy(F.window(F.col("ts"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query
def event_sessions(spark, d):
    """[extension] Sessions of users with gaps of at most 30 minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").select("user_id", "ts", "event_id").withColumn("new", F.coalesce((F.col("ts") - F.lag("ts").over(w)) > F.expr("interval 30 minutes"), F.lit(True)).cast("int"))
    s = e.withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "s").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select("user_id", F.col("s").alias("session"), "n", "first", "last")


# sources and sinks


@query
def bank_rows(spark, d):
    """[K3, K4] Items flattened to a bank row, with texts for E and F."""
    from threshmill.sources.io import bank

    rows = items(spark, d).select(F.concat(F.lit(" u"), F.col("conv_id").cast("string")).alias("source_url"), F.lit("o ").alias("occupation"), "question", "options", F.col("correct").alias("correct_answer"))
    b = bank(rows)
    return b.select("source_url", "occupation", F.length("option_A").alias("a"), F.length("option_D").alias("d"), "option_E", "option_F", "correct_answer")


@query
def coverage_map(spark, d):
    """[K10] Pages and first three URLs of each host."""
    from threshmill.sources.io import coverage

    return coverage(hosts(spark, d), "host", "url", "page_id")


@query
def bank_summary(spark, d):
    """[K5, W8] Totals and the most frequent hosts, in one row."""
    from threshmill.sources.io import summary

    h = hosts(spark, d).withColumn("category", urls.category(F.col("host")))
    s = summary(h, "host", "category", 5)
    return s.select("n_items", "n_hosts", F.array_join(F.transform("top_hosts", lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["host"])), ",").alias("top"))


@query
def forum_threads(spark, d):
    """[S18, S19] Conversations with four answers or more of 40 characters, accepted first."""
    from threshmill.sources.io import forum_threads as threads

    posts = read(spark, d, "conversations").select(F.col("conv_id").alias("url"), "text", F.col("turn").alias("score"), (F.col("turn") == 1).alias("accepted"))
    t = threads(posts, "text")
    return t.select(F.col("url").alias("conv_id"), F.size("answers").alias("n"), F.element_at("answers", 1)["s"].alias("first_score"))


@query
def gathered_sources(spark, d):
    """[S22] Five URLs of each group by venue priority, two of the first venue at most."""
    from threshmill.sources.io import gather_sources

    p = read(spark, d, "pages").select((F.col("page_id") % 9).alias("occupation"), urls.canonical(F.col("url"), "query").alias("url"), (F.col("page_id") % 3).alias("venue"), F.col("page_id").alias("seq"))
    return gather_sources(p, "venue", "seq", F.when(F.col("venue") == 0, 2).otherwise(9)).select("occupation", "url", "place")


@query
def checkpoint_repair(spark, d):
    """[S9, D2] Checkpoint rows with repeated headers and keys."""
    from threshmill.sources.io import repair_checkpoint

    o = read(spark, d, "orders")
    rows = o.select(F.when(F.col("o_orderkey") % 7 == 0, "row_id").otherwise((F.col("o_orderkey") % 200).cast("string")).alias("row_id"), F.col("o_orderkey").alias("seq"), "o_custkey")
    return repair_checkpoint(rows)


@query
def page_links(spark, d):
    """[S21, D1] Links of pages with their names, one for each trimmed link."""
    from threshmill.sources.io import directory_entries

    return directory_entries(read(spark, d, "pages"), "html", '<a href="([^"]*)">([^<]*)</a>')


@query
def feed_parsing(spark, d):
    """[S12] Feed entries, made of benchmark texts."""
    from threshmill.sources import providers

    b = read(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[<>&\"\\\\]", " ").alias("t"))
    feed = b.select("item_id", F.concat(F.lit("<feed><entry><id>http://arxiv.org/abs/"), F.col("item_id").cast("string"), F.lit("</id><title>"), F.col("t"), F.lit("</title><summary>"), F.col("t"), F.lit("</summary></entry></feed>")).alias("xml"))
    e = providers.arxiv_entries(feed)
    return e.select("url", F.md5(F.col("title").cast("binary")).alias("title"), F.length("snippet").alias("n"), "domain")


@query
def recorded_provider(spark, d):
    """[S11, S17, S20, R5, J22] Requests answered from a recorded table by key."""
    from threshmill.sources.providers import Recorded, fetch_route, request_key

    p = read(spark, d, "pages").select("page_id", "url", request_key(F.col("url")).alias("key"))
    seen = p.where(F.col("url").contains("?")).select("key", F.length("url").cast("string").alias("answer"))
    return Recorded(seen).ask(p).select("page_id", "answer", fetch_route(F.col("url"), F.col("page_id") % 2 == 0).alias("route"))


# more verdicts


@query
def answer_sets(spark, d):
    """[X4, X5, X10, L15] Letter sets of replies, and whether they are what was expected."""
    r = F.concat(F.when(F.col("turn") % 3 == 0, "So A, C").when(F.col("turn") % 3 == 1, "It is (B) or D here").otherwise("E"), F.when(F.col("conv_id") % 2 == 0, ".").otherwise(""))
    s = read(spark, d, "conversations").select("conv_id", "turn", parsers.normal_set(parsers.letter_set(r)).alias("s"), parsers.plausible_letters(r).alias("p"))
    return s.select("conv_id", "turn", F.array_join("s", "").alias("letters"), F.array_join("p", "").alias("plausible"), (F.col("s") == F.array(F.lit("A"), F.lit("C"))).alias("as_expected"))


@query
def numbered_verdict_map(spark, d):
    """[X8] Verdicts of numbered lines."""
    line = lambda n, yes: F.concat(F.lit(f"{n}. "), F.when(yes, "YES").otherwise("NO"), F.lit(" because\n"))
    r = F.concat(line(1, F.col("doc_id") % 2 == 0), line(2, F.col("doc_id") % 3 == 0), F.lit("3 nothing\n"), line(1, F.col("doc_id") % 5 == 0))
    m = read(spark, d, "labels").select("doc_id", parsers.numbered_verdicts(r).alias("m"))
    return m.select("doc_id", F.size("m").alias("n"), F.try_element_at("m", F.lit(1)).alias("one"), F.try_element_at("m", F.lit(2)).alias("two"))


@query
def thread_scores(spark, d):
    """[L13] Scores of threads, by place where all are zero."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("conv_id") % 2 == 0, 0).otherwise(F.col("turn").cast("int")).alias("score")))).alias("r"))
    return c.select("conv_id", F.array_join(F.transform(metrics.thread_scores(F.col("r")), lambda x: x.cast("string")), ",").alias("scores"))


@query
def difficulty_labels(spark, d):
    """[P32, L8] Difficulty of labelled documents by how many of three seeds were right."""
    n = responses(spark, d).where("model = 'm1'").groupBy("doc_id").agg(F.count_if(F.col("answer") == F.col("correct")).alias("n"))
    return n.select("doc_id", lint.difficulty(F.col("n")).alias("difficulty"), F.when(F.col("n") == 3, "too_easy").when((F.col("n") == 0) & (F.col("doc_id") % 2 == 0), "too_hard").otherwise("keep").alias("verdict"))


@query
def jurisdiction_limits(spark, d):
    """Ambiguous items whose stem doesn't repeat a limit of the source."""
    b = read(spark, d, "benchmark").select("item_id", F.col("text").alias("q"), F.when(F.col("item_id") % 3 == 0, "Only in Texas 2019").when(F.col("item_id") % 3 == 1, "").otherwise("some limit").alias("lim"))
    stem = F.concat(F.col("q"), F.when(F.col("item_id") % 2 == 0, F.lit(" texas")).otherwise(F.lit("")))
    return b.select("item_id", lint.unfixable_jurisdiction(F.col("lim"), stem, F.col("item_id") % 5 != 0).alias("unfixable"))


@query
def merge_lint(spark, d):
    """First fault of items before a merge."""
    return items(spark, d).select("conv_id", lint.merge_reason(F.col("question"), F.col("options"), F.when(F.col("conv_id") % 9 == 0, "F").otherwise(F.col("correct")), 20).alias("reason"))


@query
def merge_with_locked(spark, d):
    """[D5] Pages with secure URLs by priority, up to twelve of a group with the locked plain ones, none with a known URL."""
    p = read(spark, d, "pages").select((F.col("page_id") % 11).alias("g"), urls.canonical(F.col("url"), "query").alias("u"), (F.col("page_id") % 2).alias("pr"), F.col("page_id").alias("seq"), F.array(F.col("page_id").cast("string")).alias("t"))
    return similar.merge_with_locked(p.where("u LIKE 'http:%'"), p.where("u NOT LIKE 'http:%'"), "g", "u", "pr", "seq", "t", 12).select("g", "seq")


@query
def event_windows_sliding(spark, d):
    """[R2, extension] Errors in sliding windows of three hours."""
    e = read(spark, d, "events").where("event_type = 'error'")
    return e.groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
