"""Rolling features by block are those of windows over whole histories, for blocks far smaller than what they look at."""

import pytest
from compare import rows as counted

from strandline.plans import all_queries
from strandline.sources.tables import Tables

all_queries()
from strandline.plans.rolling import FEATURES, HISTORY  # noqa: E402


@pytest.fixture(scope="module")
def bars(spark):
    """Some 700 bars a symbol, more than BACK and a block."""
    return spark.createDataFrame(Tables(spark, "/root/testdata/sf0.01").bars.toPandas())


@pytest.mark.parametrize("name", sorted(set(FEATURES) - set(HISTORY)))
def test_blocks(bars, name):
    whole, parts = (counted(FEATURES[name](bars, block).toPandas()) for block in (None, 48))
    assert whole == parts and sum(whole.values()) == bars.count()


def test_tasks_hold_blocks(bars):
    plan = FEATURES["w1_bollinger"](bars)._jdf.queryExecution().analyzed().toString()
    assert "Window" in plan and all("_block" in x or "_symbol" in x or "symbol#" in x for x in plan.splitlines() if "Window [" in x)
