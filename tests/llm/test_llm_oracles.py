import pytest
from compare import SF, same

from vantage.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])
