import random

import pytest
from pyspark.sql import functions as F

from accesslake.operators import tree


def climbed(parents, node):
    """Ancestors of a node, nearest first, until none is left or one comes again."""
    found, at = [], parents[node]
    while at in parents and at != node and at not in found:
        found.append(at)
        at = parents[at]
    return found


@pytest.mark.parametrize("kind", ["forest", "cycles", "chain"])
def test_ancestors_as_climbing(spark, monkeypatch, kind):
    rng = random.Random(5)
    if kind == "forest":
        parents = {i: rng.choice([None, 999, rng.randrange(i + 1), max(0, i - 1)]) for i in range(120)}
    elif kind == "cycles":
        parents = {i: rng.randrange(60) for i in range(60)} | {60: 60, 61: 62, 62: 61, 63: 61}
    else:
        parents = {i: i - 1 if i else None for i in range(300)}
    rounds = []
    real = tree.cut_lineage
    monkeypatch.setattr(tree, "cut_lineage", lambda df: rounds.append(1) or real(df))
    df = spark.createDataFrame(list(parents.items()), "id int, parent_id int").withColumn("name", F.concat(F.lit("n"), "id"))
    got = {r.id: [(a.id, a.name) for a in r.ancestors] for r in tree.with_ancestors(df, ("name",)).collect()}
    assert got == {n: [(a, f"n{a}") for a in climbed(parents, n) if a != n] for n in parents}
    assert len(rounds) <= 11
