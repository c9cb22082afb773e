import pytest
from compare import SF, same

from vantage import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    same(catalog.queries()[name](spark, SF), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 35
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
