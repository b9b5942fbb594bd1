from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm import brute
from threshmill.llm.common import cut

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = cut(p.drop_toxic(spark, docs, SMALL))
    assert first.columns == docs.columns and first.join(docs, docs.columns, "left_anti").count() == 0
    second = cut(p.keep_one_of_near_copies(spark, first, SMALL))
    want = brute.near_components([tuple(r) for r in first.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in second.collect()) == sorted(d for d, (_, least) in want.items() if d == least)
    third = cut(p.drop_repeated_passages(spark, second, SMALL))
    kept = {d: h for d, _, _, h in brute.without_repeats([tuple(r) for r in second.select("doc_id", "text").collect()])}
    for r in third.collect():
        assert hashlib.sha256(" ".join(brute.WORD.findall(r.text or "")).encode()).hexdigest() == kept[r.doc_id]
    fourth = cut(p.mix_by_weight(spark, third, SMALL))
    assert fourth.columns == docs.columns and fourth.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    last = {(r.doc_id, r.n_tokens) for r in p.encode(spark, fourth, SMALL).collect()}
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert last == {(r.doc_id, len(own.encode(r.text or "", add_special_tokens=False).ids)) for r in fourth.collect()}
    assert p.run(spark, SMALL).count() == fourth.count()


def test_repeated_null_and_empty_rows(spark):
    rows = [(1, "same words " * 5, "en", "s", 1), (1, "same words " * 5, "en", "s", 1), (2, None, None, None, None), (None, "x y", "en", "s", 3), (None, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = p.keep_one_of_near_copies(spark, docs, SMALL).collect()
    assert sorted(str(r.doc_id) for r in one) == ["1", "2", "3", "None", "None"]
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        stage(spark, docs, SMALL).count()


def test_columns_of_clashing_names(spark):
    rows = [(i, f"{'a b c d e f g ' * 6} {i // 2}", "en", "st"[i % 2], 9) for i in range(40)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs
    for c in ("row_key", "pass", "position", "positions", "key", "n", "size", "path", "spans", "row", "own_id", "component_id", "h", "score", "held_out"):
        clashing = clashing.withColumn(c, F.lit("clash"))
    for _, stage in p.STAGES:
        one, two = stage(spark, docs, SMALL), stage(spark, clashing, SMALL)
        assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_equal_rows_are_all_mixed(spark):
    rows = [(None, "one two three", "en", "s", 13)] * 50 + [(1, "four five", "en", "t", 9), (2, "six", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    # all 153 words: s takes 25.5 and 25.5 more that the others leave, t 6 and the null source 3 at most
    plan = p.mix_sources(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    got = p.mix_by_weight(spark, docs, SMALL).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {r.doc_id: r.n for r in plan if r.n}


def test_repeated_ids_of_unlike_texts(spark):
    a, b, c = ("".join(f" {x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, c), (2, a + " more"), (3, b), (4, c), (4, c), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.keep_one_of_near_copies(spark, docs, SMALL).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", a), ("1", b), ("2", c), ("None", a)])
