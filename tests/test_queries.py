"""Every named query against its SQL counterpart on the smallest tables."""

import pytest

from maskwright.plans.oracles import ORACLES
from maskwright.plans.queries import QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    found = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        assert_same(found, duck.execute(ORACLES[name]).df())
    else:
        assert list(found.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 80
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "maskwright"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", path.read_text(), re.M), path
