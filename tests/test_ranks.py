"""Distributed places against a sort on the driver."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkfactors.operators.ranks import quantiles, ranked


def test_places_of_groups_with_nulls_and_a_hot_group(spark):
    r = random.Random(2)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", None if i % 13 == 0 else r.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(7)
    key = lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0, x[2])
    got = {x["id"]: x["rank"] for x in ranked(df, ("v", "id"), ("g",)).collect()}
    want, last, n = {}, object(), 0
    for x in sorted(rows, key=key):
        n = n + 1 if x[0] == last else 0
        last, want[x[2]] = x[0], n
    assert got == want
    groups = sorted({x[0] for x in rows}, key=lambda g: (g is not None, g or ""))
    numbered = ranked(df, ("v", "id"), ("g",), size="n", group="i", overall="all").select("id", "rank", "n", "i", "all").collect()
    n = Counter(x[0] for x in rows)
    assert {x["id"]: tuple(x)[1:] for x in numbered} == {x[2]: (want[x[2]], n[x[0]], groups.index(x[0]), i) for i, x in enumerate(sorted(rows, key=key))}
    everywhere = {x["id"]: x["rank"] for x in ranked(df, ("v", "id")).collect()}
    assert everywhere == {x[2]: i for i, x in enumerate(sorted(rows, key=lambda x: key(x)[2:]))}


def test_ties_and_empty_tables(spark):
    same = spark.range(100).select(F.lit(1).alias("v"))
    assert sorted(x["rank"] for x in ranked(same, ("v",)).collect()) == list(range(100))
    assert ranked(same.limit(0), ("v",)).count() == 0
    assert ranked(same, ("v",), name="place").columns == ["v", "place"]


def test_quantiles_are_exact(spark):
    r = random.Random(4)
    rows = [(i % 3, None if i % 17 == 0 else r.choice([r.random(), 0.5])) for i in range(2000)] + [(3, 1.5)]
    at = [0.0, 0.1, 0.25, 1 / 3, 0.9, 1.0]
    got = {x["k"]: x["e"] for x in quantiles(spark.createDataFrame(rows, "k int, v double").repartition(5), "v", at, ("k",)).collect()}
    for k in range(4):
        want = np.quantile([v for g, v in rows if g == k and v is not None], at)
        assert np.allclose(got[k], want, rtol=0, atol=1e-15)
    (every,) = quantiles(spark.createDataFrame(rows, "k int, v double"), "v", [0.5]).collect()
    assert every["e"] == [np.median([v for _, v in rows if v is not None])]
