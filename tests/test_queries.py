"""Every query of the library against its SQL."""

import pytest

from quire.plans import library
from tests.conftest import SF
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    same(library.queries()[name](spark, SF), duck, library.oracle_sql()[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
