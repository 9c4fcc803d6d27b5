"""Every catalogued query on empty tables: no errors, empty results (or the documented constant rows)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tavola.sources.domain import RAW_TABLES

# queries that still return rows on empty input, and how many
CONSTANT_ROWS = {"constraint_report": 70, "dashboard": 5, "kpis": 1, "category_list": 1, "pos_categories": 1,
                 "insights_dashboard": 1, "table_update": 0}


@pytest.fixture(scope="module")
def empty_dir(spark, small_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for t in RAW_TABLES:
        spark.read.parquet(f"{small_dir}/{t}.parquet").limit(0).coalesce(1).write.parquet(str(out / f"{t}.parquet"))
    return str(out)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_on_empty_tables(spark, empty_dir, name):
    df = E.queries()[name](spark, empty_dir)
    n = df.count()
    assert n == CONSTANT_ROWS.get(name, 0), (name, n)
