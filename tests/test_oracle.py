"""Every registered meter query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.oracle import differ, tables
from wattloom.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert differ(spark, con, FOLDER, QUERIES[name], SQL[name]) == ""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
