import random

import pytest

from accesslake.operators import ranking


@pytest.fixture(scope="module")
def listing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 5.0, 5.0, float(rng.randrange(40)), rng.random() * 100])) for i in range(700)]
    return rows, spark.createDataFrame(rows, "id int, v double")


@pytest.mark.parametrize("order", ["v", "-v"])
def test_deep_pages_as_a_full_sort(listing, order):
    rows, df = listing
    down = order == "-v"
    if down:
        ordered = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0])) + [r for r in rows if r[1] is None]
    else:
        ordered = [r for r in rows if r[1] is None] + sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))
    for number, size, parts in ((1, 15, 20), (12, 30, 20), (47, 15, 50), (3, 200, 4), (4, 200, 20), (60, 15, 20)):
        got = [tuple(r) for r in ranking.page_at(df, number, size, order, "id", parts).collect()]
        assert got == ordered[(number - 1) * size : number * size]


def test_only_the_pages_range_is_sorted(listing, spark):
    _, df = listing
    plan = ranking.page_at(df, 20, 15, "v", "id", 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "<=" in plan
    assert ranking.page_at(df.limit(0), 1, 15, "v", "id").collect() == []
