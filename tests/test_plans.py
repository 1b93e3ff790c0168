"""Plans of the registered queries: no Cartesian products, few scans."""

import re

import pytest

from tempora.plans.queries import QUERIES
from conftest import SF

FEW_SCANS = {"q_split": 2, "q_folds": 2, "q_slices": 2, "q_latest": 2, "q_metrics": 2, "q_cv": 2, "q_last_n": 2}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    if name in FEW_SCANS:
        assert len(re.findall(r"FileScan parquet", text)) <= FEW_SCANS[name]


def test_profile_has_no_expand(spark):
    assert "Expand" not in plan(QUERIES["q_profile"](spark, SF))
