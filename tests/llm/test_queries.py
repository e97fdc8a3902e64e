"""Every query of the subpackage that has SQL agrees with DuckDB at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check  # noqa: E402
from strainwise.llm import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    assert check.compare(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name]) == ""


def test_resharding_follows_its_law(spark):
    rows = catalog.op6_reshard(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    total, longest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(16):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 16) <= 3 * longest


def test_the_rest_imports_without_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "strainwise")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "llm" not in f.read(), n
