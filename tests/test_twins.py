"""Every query of the library against its DuckDB twin."""

import pytest

from skein.plans import catalogue
from tests.compare import duck, rows


@pytest.fixture(scope="module")
def twin(sf_dir):
    with duck(sf_dir) as con:
        yield con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_twin(spark, sf_dir, twin, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    want = twin.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_a_twin():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
