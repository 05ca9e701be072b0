"""Every registered query beside its SQL on the smallest tables (where the driver's tables are there)."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from arkline.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert Counter(tuple(norm(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(norm(r[i]) for i in places) for r in want.fetchall())


def test_signature_join_is_no_nested_loop(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    for name in ("signature_theta_join", "semantic_relation_semi"):
        assert "NestedLoop" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_entry_without_the_llm_subpackage():
    """The entry imports and answers where arkline/llm and corpus_pipeline.py are not there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['arkline.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'entry_page' in e.queries() and not any(k.startswith('op') for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
