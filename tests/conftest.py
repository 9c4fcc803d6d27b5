from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tavola.session import local_session

    s = local_session("4", shuffle_partitions=4, app="tavola-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SMALL


def make_domain(spark, **frames):
    """A Domain whose tables are the given small DataFrames (edge-case fixtures)."""
    from tavola.sources.domain import Domain

    d = Domain(spark, "/nonexistent")
    d.__dict__.update(frames)
    return d


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
