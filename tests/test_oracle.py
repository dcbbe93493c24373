"""Every query of the catalogue against its SQL on DuckDB."""

import pytest

from subgrade.plans.everything import ORACLE_SQL, QUERIES
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(ORACLE_SQL[name]).df())


def test_density_instances_are_numbered_by_size(spark):
    rows = QUERIES["density_instances"](spark, str(DATA)).toPandas()
    assert not rows["pid"].duplicated().any()
    for _, site in rows[rows["label"] >= 0].groupby("site_id"):
        sizes = site.groupby("label").size()
        assert list(sizes.index) == list(range(len(sizes)))
        assert sizes.is_monotonic_decreasing and sizes.min() >= 25
