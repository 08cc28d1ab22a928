import oracle
import pytest

from skerry.plans import design, inference, lookups, metrics, models, reports, resampled, spatial  # noqa: F401
from skerry.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], SF) == ""
