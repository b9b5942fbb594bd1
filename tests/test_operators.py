"""Closed forms against plain folds on random rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from threshmill.functions import lint, parsers, text
from threshmill.operators import gate, metrics, select, similar


def test_greedy_keep_is_the_fold(spark):
    r = random.Random(1)
    rows = [("g" + str(i % 3), i, r.sample("abcdefghij", r.randint(0, 5))) for i in range(240)]
    kept = []
    for g, i, t in rows:
        s = set(t)
        if all(h != g or not s or not u or len(s & u) / len(s | u) < 0.6 for h, _, u in kept):
            kept.append((g, i, s))
    got = similar.greedy_keep(spark.createDataFrame(rows, "g string, i long, t array<string>"), "g", "i", "t", 0.6).collect()
    assert sorted(x.i for x in got) == [i for _, i, _ in kept]


def test_greedy_keep_settles_long_chains(spark):
    # windows of ten drifting words: neighbours have 8 of 12 tokens in common, those after them 6 of 14
    rows = [("g", i, [f"w{j}" for j in range(2 * i, 2 * i + 10)]) for i in range(75)]
    got = similar.greedy_keep(spark.createDataFrame(rows, "g string, i long, t array<string>"), "g", "i", "t", 0.6).collect()
    assert sorted(x.i for x in got) == list(range(0, 75, 2))


@pytest.mark.parametrize("least", [0.5, 0.6, 0.75, 1.0])
def test_similar_pairs_are_complete(spark, least):
    r = random.Random(7)
    rows = [("g", i, r.sample("abcdefghijkl", r.randint(1, 7))) for i in range(70)]
    want = sorted((a, b) for a, (_, _, x) in enumerate(rows) for b, (_, _, y) in enumerate(rows) if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= least)
    got = similar.similar_pairs(spark.createDataFrame(rows, "g string, i long, t array<string>"), "g", "i", "t", least).collect()
    assert sorted((x.a, x.b) for x in got) == want


@pytest.mark.parametrize("least", [0.2, 0.6, 0.9])
def test_similar_pairs_of_sets_of_all_sizes(spark, least):
    # bitmaps of several widths, groups of near copies, equal sets, a null group, words in an order of their own
    r = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    bases = [r.sample(words, n) for n in (12, 40, 90, 300, 700)]
    rows = []
    for i in range(150):
        t = list(bases[i % 5])
        for _ in range(r.randint(0, len(t) // 3)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append(((None, "g", "h")[i % 3], i, r.sample(t, r.randint(len(t) // 4, len(t))) if i % 4 == 0 else t))
    rows += [("g", 200 + i, rows[1][2][::-1]) for i in range(4)] + [("g", 300, []), ("g", 301, None)]
    sets = [(g, i, set(t or ())) for g, i, t in rows]
    want = sorted((a, b, round(len(x & y) / len(x | y), 9)) for g, a, x in sets for h, b, y in sets if g and g == h and a < b and x and y and len(x & y) / len(x | y) >= least)
    df = spark.createDataFrame(rows, "g string, i long, t array<string>").repartition(3)
    assert sorted((x.a, x.b, round(x.jaccard, 9)) for x in similar.similar_pairs(df, "g", "i", "t", least).collect()) == want
    kept: list[tuple] = []
    for g, i, s in sets:
        if all(not g or h != g or not s or not u or len(s & u) / len(s | u) < least for h, _, u in kept):
            kept.append((g, i, s))
    assert sorted(x.i for x in similar.greedy_keep(df, "g", "i", "t", least).collect()) == [i for _, i, _ in kept]


def test_a_set_is_no_candidate_of_itself():
    import struct

    import numpy as np
    import pyarrow as pa

    # two tokens of the first set and one of the second have the same 32 bits
    parts = [np.array(x, t) for x, t in (([5, 9], np.uint64), ([4, 4], np.uint32), ([2, 1], np.uint32), ([7, 7, 7], np.uint32), ([0, 1, 0], np.uint16), ([0] * 16, np.uint8))]
    blob = struct.pack("<II", 2, 3) + b"".join(x.tobytes() for x in parts)
    assert similar._candidates(pa.table({"bucket": [0], "blob": [blob]}), 0.6).to_pylist() == [{"x": 5, "y": 9}]


def test_round_robin_is_the_loop(spark):
    r = random.Random(2)
    rows = [(f"g{r.randint(0, 2)}", f"m{r.randint(0, 4)}", i) for i in range(120)]
    want = []
    for g in {x[0] for x in rows}:
        lists = {}
        for h, m, i in rows:
            if h == g:
                lists.setdefault(m, []).append(i)
        order = sorted(lists, key=lambda m: (len(lists[m]), m))
        taken = []
        for turn in range(200):
            for m in order:
                if turn < len(lists[m]) and len(taken) < 20:
                    taken.append(lists[m][turn])
        want += taken
    got = select.round_robin_cap(spark.createDataFrame(rows, "g string, m string, i long"), "g", "m", "i", 20).collect()
    assert sorted(x.i for x in got) == sorted(want)


def capped_by_the_loop(rows: list[tuple], share: float) -> list[tuple]:
    """(domain, group, place) rows after the loop that drops the largest domain's last rows, row by row."""
    rows = list(rows)
    while rows:
        size = {}
        for d, _, _ in rows:
            size[d] = size.get(d, 0) + 1
        top = max(size, key=size.get)
        excess = size[top] - int(share * len(rows))
        if excess <= 0:
            break
        piles = {}
        for row in rows:
            if row[0] == top:
                piles.setdefault(row[1], []).append(row)
        order = sorted(piles, key=lambda g: -len(piles[g]))
        gone = set()
        while excess and any(piles.values()):
            for g in order:
                if excess and piles[g]:
                    gone.add(piles[g].pop())
                    excess -= 1
        rows = [row for row in rows if row not in gone]
    return rows


def test_domain_cap_is_the_loop(spark):
    r = random.Random(3)
    for trial in range(200):
        rows = [(r.choice("wwwxyz"), r.choice("ppq"), i) for i in range(r.randint(1, 40))]
        share = r.choice([0.2, 0.3, 0.5])
        counts = {}
        for d, g, i in rows:
            n, first = counts.get((d, g), (0, i))
            counts[d, g] = (n + 1, first)
        keep, left = select.domain_cap([(d, g, n, f) for (d, g), (n, f) in counts.items()], share)
        want = capped_by_the_loop(rows, share)
        place = {k: 0 for k in keep}
        got = []
        for row in rows:
            place[row[:2]] += 1
            if place[row[:2]] <= keep[row[:2]]:
                got.append(row)
        assert got == want and left == len(want)
        if trial < 3:
            df = spark.createDataFrame(rows, "d string, g string, i long")
            for looked_at in (1, 100):
                assert sorted(tuple(x) for x in select.capped_domains(df, "d", "g", "i", share, looked_at).collect()) == sorted(want)


def test_taking_in_turn():
    for counts in ([3, 1, 2], [0, 5], [1], []):
        for excess in range(9):
            left, gone = list(counts), 0
            while gone < excess and any(left):
                for i, c in enumerate(left):
                    if c and gone < excess:
                        left[i] -= 1
                        gone += 1
            assert select.in_turn(counts, excess) == [a - b for a, b in zip(counts, left, strict=True)]


def test_proportional_cases():
    assert select.proportional([("a", 70, 100), ("b", 20, 100), ("c", 10, 100)], 10, cap=9) == {"a": 7, "b": 2, "c": 1}
    # no cap given: a quarter of the target at most; the missing places go to the heaviest that has room
    assert select.proportional([("a", 70, 100), ("b", 20, 100), ("c", 10, 100)], 100) == {"a": 25, "b": 25, "c": 25}
    assert select.proportional([("a", 50, 100), ("b", 30, 100), ("c", 15, 100), ("d", 3, 100), ("e", 2, 100)], 20, floor=3) == {"a": 5, "b": 5, "c": 4, "d": 3, "e": 3}
    # supply runs out, then the floor holds against the trim
    assert select.proportional([("a", 90, 3), ("b", 9, 50), ("c", 1, 50)], 20, floor=2, cap=15) == {"a": 3, "b": 15, "c": 2}
    assert select.proportional([("a", 1, 9), ("b", 1, 9)], 2, floor=3) == {"a": 3, "b": 3}


def test_quotes_in_documents(spark):
    docs = [(1, "Some words before The quick brown fox jumps over the lazy dog near the old river bank and after"), (2, "nothing here"), (3, None), (4, "x" * 20 + "incomprehensibilities-of-" + "y" * 30), (5, "")]
    items = [(1, "the quick brown fox jumps over the lazy dog near the old river bank"), (2, ""), (3, "quick brown fox"), (4, None), (5, "x" * 15 + "incomprehensibilities"), (6, "fox jumps over the lazy dog near"), (7, "brown fox jumps over the lazy cat near the old river")]
    got = similar.contaminated(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, q string"), "i", "q").collect()
    norm = lambda t: " ".join((t or "").lower().split())
    want = sorted((d, i) for d, t in docs for i, q in items if len(norm(q)) >= 30 and norm(q)[:80] in norm(t))
    assert sorted((r.d, r.i) for r in got) == want == [(1, 1), (1, 6), (4, 5)]


def test_strict_lookup_raises(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    assert select.strict_lookup(rows.where("k = 1"), "k", table, "v").first().v == "a"
    with pytest.raises(Exception, match="no value for 2"):
        select.strict_lookup(rows, "k", table, "v").collect()


def test_fetch_budget_skips_topical_rounds(spark):
    rows = [("s", i, i in (0, 1, 5, 6), 1 if i < 4 else 2 if i < 8 else 3) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, i long, u boolean, round int")
    no = F.lit(False)
    plain = gate.budgeted(df, "k", "i", no, no, 9, 9, F.col("u"), 2)
    assert [r.i for r in plain.orderBy("i").collect()] == [0, 1]
    topical = gate.budgeted(df, "k", "i", no, no, 9, 9, F.col("u"), 3, F.when(F.col("round") > 1, F.col("round")))
    # the second round goes on although the budget is spent in it; the third doesn't begin
    assert [r.i for r in topical.orderBy("i").collect()] == list(range(8))


def test_ladder_and_attempts(spark):
    from threshmill.operators import verdicts as v

    said = [('{"occupation_aligned": true, "labeled_correct_entailed": true}', "A"), ('```json {"x": 1}', "A"), ('{"occupation_aligned_exact": null, "entailment": {"A": true, "B": true}}', "B"), (None, "C")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(said)], "i int, j string, c string").withColumn("v", v.normal_verdict(F.col("j"), F.col("c"), F.lit(False)))
    got = [tuple(r) for r in df.orderBy("i").select("v.aligned", "v.practical", "v.entailed", "v.distractor_entailed").collect()]
    assert got == [(True, True, True, False), (True, True, False, False), (False, True, True, True), (True, True, False, False)]
    tries = spark.createDataFrame([(1, "8", 0, False), (1, "8", 1, False), (1, "8", 2, False), (1, "8", 3, False), (1, "8", 4, True), (1, "4", 0, False), (1, "4", 1, True), (1, "4", 2, False)], "i int, p string, a int, ok boolean")
    assert sorted(tuple(r) for r in v.last_attempts(tries, "i", "p", "a", "ok").collect()) == [(1, "4", 2, 1, True), (1, "8", 5, 3, False)]


def test_share_gate_cases():
    cdc = gate.ShareGate("15")
    assert not cdc.accept("cdc.gov") and not cdc.accept("x.cdc.gov")
    health = gate.ShareGate("29")
    assert [health.accept("cdc.gov") for _ in range(6)] == [True] * 4 + [False] * 2
    assert [gate.ShareGate("11").accept(None)] == [True]


def test_share_gate_order(spark):
    rows = [("15-1", d, i) for i, d in enumerate(["a.org", "a.org", "b.org", "c.org", "a.org", "b.org", "d.org", None])]
    got = gate.share_gate(spark.createDataFrame(rows, "soc string, domain string, seq long").repartition(3), "soc", "domain", "seq").orderBy("seq").collect()
    own = gate.ShareGate("15")
    assert [r.accepted for r in got] == [own.accept(d) for _, d, _ in rows]


def test_numbering_in_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = select.numbered(df, [F.col("x")], "n").collect()
    assert sorted((r.x, r.n) for r in got) == [(i, i + 1) for i in range(1000)]


def test_structure_faults(spark):
    good = {"A": "one", "B": "two", "C": "three", "D": "four"}
    cases = [(good, "A", None), (good, "", "missing_or_invalid_fields"), (good, "AB", "missing_or_invalid_fields"), (good | {"B": " "}, "A", "option_B_empty"), (good | {"C": "so?"}, "A", "option_C_trailing_question_mark"), (good | {"A": "Call us."}, "A", "option_A_forbidden_pronoun"), (good | {"D": " ONE "}, "A", "option_D_duplicate")]
    df = spark.createDataFrame([(i, "q", o, c) for i, (o, c, _) in enumerate(cases)], "i int, q string, o map<string,string>, c string")
    assert [r.x for r in df.orderBy("i").select(lint.structure_reason(F.col("q"), F.col("o"), F.col("c")).alias("x")).collect()] == [w for *_, w in cases]


def test_letters(spark):
    cases = ["B", " (C) because", "The answer is D.", "ANSWER: e", "", None, "none of it", "A) x", "f"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").orderBy("i")
    got = df.select(parsers.letter_first(F.col("t")), parsers.letter_cued(F.col("t")), parsers.letter_strict(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("B", "B", "B"), ("C", "C", "C"), ("D", "D", "D"), ("A", "E", "A"), ("", "", ""), ("", "", ""), ("", "", ""), ("A", "A", "A"), ("F", "F", "")]


def test_text_cases(spark):
    df = spark.createDataFrame([("Hi everyone, hello all! Has anyone ever seen it? the pump leaks .",)], "t string")
    assert df.select(text.strip_voice(F.col("t"))).first()[0] == "The pump leaks."
    long = "word " * 20 + "end. " + "more " * 60
    assert spark.createDataFrame([(long,)], "t string").select(text.first_sentences(F.col("t"))).first()[0] == ("word " * 20 + "end.")
    df = spark.createDataFrame([('<meta name="date" content="2021-05-06T10">',), ('<time datetime="May 2020">',), ("none",)], "h string")
    assert [r[0] for r in df.select(text.publication_date(F.col("h"))).collect()] == ["2021-05-06", "2020", ""]


def test_quality_and_agreement(spark):
    df = spark.createDataFrame([("A", True, {}), ("A", True, {"B": "AGREES", "C": "AGREES"}), ("A", True, {"B": "AGREES", "C": "CONTRADICTS"}), ("A", True, {"B": "UNCLEAR"}), ("E", True, {"B": "CONTRADICTS"}), ("B", False, {})], "c string, d boolean, m map<string,string>")
    decision, answer = metrics.agreement(F.col("c"), F.col("d"), F.col("m"))
    assert [tuple(r) for r in df.select(decision, answer).collect()] == [("keep", "A"), ("relabel", "E"), ("drop", "A"), ("drop", "A"), ("drop", "E"), ("drop", "B")]


def test_twister_shuffle(spark):
    import hashlib

    seeds = ["", "a", "evidence-17|q", "\u00e9"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(seeds)], "i int, s string")
    options = F.create_map(*[F.lit(x) for k in "ABCD" for x in (k, k.lower())])
    got = df.orderBy("i").select(lint.reordered(options, lint.twister_letters(F.col("s")), F.lit("B")).alias("r")).collect()
    for seed, row in zip(seeds, got, strict=True):
        order = list("ABCD")
        random.Random(int(hashlib.sha1(seed.encode()).hexdigest()[:8], 16)).shuffle(order)
        assert row.r.options == {new: old.lower() for new, old in zip("ABCD", order, strict=True)}
        assert row.r.correct == "ABCD"[order.index("B")]


def test_locked_merge_is_the_fold(spark):
    r = random.Random(9)
    word = lambda: r.sample("abcdefgh", r.randint(0, 4))
    locked = [(r.choice("pq"), f"u{r.randrange(30)}", i, word()) for i in range(8)]
    new = [(r.choice("pqr"), f"u{r.randrange(40)}", r.randrange(3), 100 + i, word()) for i in range(90)]
    want = []
    for g in "pqr":
        urls = {u for h, u, *_ in locked if h == g}
        sets = [set(t) for h, _, _, t in locked if h == g]
        for h, u, p, q, t in sorted(new, key=lambda x: (x[2], x[3])):
            t = set(t)
            if h == g and u not in urls and len(sets) < 9 and all(not t or not s or len(t & s) / len(t | s) < 0.6 for s in sets):
                urls.add(u)
                sets.append(t)
                want.append((g, u, q))
    got = similar.merge_with_locked(spark.createDataFrame(locked, "g string, u string, q long, t array<string>"), spark.createDataFrame(new, "g string, u string, p int, q long, t array<string>"), "g", "u", "p", "q", "t", 9)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
