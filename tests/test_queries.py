import importlib.util
import os

import pytest

from sitefold.plans.catalog import CHECKS, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"


def load(path, name):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, path))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


check = load("tools/check.py", "check_tool")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, rows, note = check.compare(spark, con, FOLDER, name)
    assert status == ("ok" if name in CHECKS else "rows only"), note


def test_entry(spark):
    entry = load("__spark_entry__.py", "entry_mod")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
