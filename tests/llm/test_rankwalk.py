import random

import numpy as np
import pytest

from tomeforge.llm import rankwalk as R


def brute(rows):
    """rows: item -> scores (None missing).  The chain as a dense matrix."""
    items = sorted(rows)
    n, s = len(items), len(next(iter(rows.values())))
    v = np.array([[-np.inf if x is None else x for x in rows[i]] for i in items])
    p = np.zeros((n, n))
    for k in range(s):
        for i in range(n):
            better = v[:, k] >= v[i, k]
            p[i] += better / better.sum() / s
    m = np.full(n, 1 / n)
    for _ in range(200):
        m = R.DAMPING * m @ p + (1 - R.DAMPING) / n
    return dict(zip(items, m))


def make(seed, n):
    r = random.Random(seed)
    return {i: [None if r.random() < 0.2 else r.choice([1.0, 2.0, r.random() * 1000]), r.random(), None if r.random() < 0.1 else round(r.random(), 1)] for i in range(n)}


@pytest.mark.parametrize("small", [R.SMALL, 20])
def test_against_matrix(spark, small):
    groups = {1: make(1, 7), 2: make(2, 1), 3: make(3, 60)} if small == 20 else {g: make(g, 1 + g % 50) for g in range(60)}
    rows = [(g, i, *v, 5) for g, x in groups.items() for i, v in x.items()]
    rows += rows[:3] + [(None, 1, 1.0, 1.0, 1.0, 1), (1, None, 1.0, 1.0, 1.0, 1)] + [(rows[0][0], rows[0][1], 9e9, 9.0, 9.0, 1)]
    df = spark.createDataFrame(rows, "query long, item long, a double, b double, c double, at int").withColumn("rank", R.F.lit(7))
    got = R.rank_walk(df, "query", "item", {"a": True, "b": True, "c": True}, at="at", small=small).toPandas()
    assert len(got) == sum(map(len, groups.values()))
    for g, x in groups.items():
        want = brute(x)
        own = got[got["query"] == g]
        assert np.allclose(own.stationarity, [want[i] for i in own.item], atol=1e-8)
        assert sorted(own["rank"]) == list(range(1, len(x) + 1))
        assert list(own.sort_values("rank").item) == sorted(want, key=lambda i: (-round(want[i], 12), i))
    assert R.rank_walk(df.limit(0), "query", "item", {"a": True}).count() == 0
