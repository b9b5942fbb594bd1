"""Every registered query of the engine against its SQL, at the smallest scale."""

from __future__ import annotations

import pathlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from threshmill.plans import item_oracles, item_queries, oracles, queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and np.isnan(v)):
        return None
    if isinstance(v, bool | np.bool_ | int | np.integer) or (isinstance(v, float | np.floating) and float(v).is_integer()):
        return int(v)
    return round(float(v), 9) if isinstance(v, float | np.floating) else str(v)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))


SQL = oracles.ORACLE_SQL | item_oracles.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_option_lint_sees_whole_turns(spark, tmp_path):
    far = "plain words " * 5
    rows = [(1, 0, far + "according to the book"), (1, 3, far + "use best practices"), (2, 0, far), (2, 3, None), (2, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["rewritten_option_lint"](spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): (r.first, r.again, r.n_words) for r in got} == {(1, 0): ("source", "source", 14), (1, 3): (None, "generic", 13), (2, 0): (None, None, 10), (2, 3): ("too_short", "too_short", 0), (2, 1): ("source", "source", 4)}


def test_picks_of_every_key(spark, tmp_path):
    spark.createDataFrame([(3, "three", 1, 5.0), (200, "late", 9, 1.0), (4, "four", 2, -1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 3), (1, 3), (2, 200), (3, 4), (4, 999)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.QUERIES["pick_validation"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, True, "A", "three"), (2, 200, True, "C", "late"), (3, 4, False, None, "#4"), (4, 999, False, None, "#999")]


def test_missing_operators_are_not_claimed():
    root = pathlib.Path(__file__).parents[1]
    missing = re.search(r"No code: ([^.]*)\.", (root / "README.md").read_text())[1].split(", ")
    for f in (root / "threshmill").rglob("*.py"):
        for line in re.findall(r'""".*', f.read_text()):
            spans = [(a, int(b), int(c)) for a, b, _, c in re.findall(r"\b([A-Z])(\d+)-([A-Z])(\d+)\b", line)] + [(a, int(b), int(b)) for a, b in re.findall(r"\b([A-Z])(\d+)\b", line)]
            assert not [m for m in missing for a, b, c in spans if a == m[0] and b <= int(m[1:]) <= c], (f, line)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ordered_texts_cut_at_a_space(spark, tmp_path):
    # the cut falls behind, at and before the space between two turns; a conversation without an id; turns without a place or a text
    turns = [(c, t, x * n) for c, n in ((1, 699), (2, 700), (3, 698), (None, 699)) for t, x in ((0, "a"), (1, "b"))]
    turns += [(4, 0, ""), (4, 1, "c" * 698), (4, 2, None), (4, 3, "d"), (5, None, "last"), (5, 3, "first"), (6, 0, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    mine, theirs = queries.QUERIES["ordered_texts"](spark, str(tmp_path)).toPandas(), c.execute(SQL["ordered_texts"]).df()
    assert rows(mine) == rows(theirs)
