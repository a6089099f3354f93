"""Budgets and chunks of one group over many partitions, against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import collect, sequences


def looped(tokens, limit, budget, total=0, number=0):
    out = []
    for n in tokens:
        if budget:
            out.append(total + n <= limit)
            total += n if out[-1] else 0
        else:
            if total and total + n > limit:
                number, total = number + 1, 0
            total += n
            out.append(number)
    return out, total


def samples():
    r = random.Random(4)
    for k in range(300):
        top = r.choice([1, 3, 12, 40])
        yield [r.choice([0, r.randint(0, top)]) for _ in range(r.randint(1, 30))], r.choice([1, 5, 17, 60]), k


def test_steps_equal_a_loop():
    for tokens, limit, k in samples():
        x = np.array(tokens, np.int64)
        assert sequences.taken(x, limit).tolist() == looped(tokens, limit, True)[0]
        total, number = k % (limit + 3), k % 2
        got, end = sequences.numbered(x, limit, total, number)
        assert (got.tolist(), end) == looped(tokens, limit, False, total, number)
        state = sequences.after(sequences.summary(x, limit, False), limit, total, number)
        assert state == (end, got[-1])


@pytest.mark.parametrize("budget", [True, False])
def test_large_groups_are_spread(spark, monkeypatch, budget):
    monkeypatch.setattr(collect, "LARGE", 100)
    r = random.Random(6)
    rows = [(g, i, r.choice([0, 1, 7, 30, 200])) for g, n in (("a", 1_500), (None, 700), ("b", 40), ("c", 300)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "src string, ord long, tokens long").repartition(3)
    for limit in (90, 5_000):
        got = (collect.within_budget if budget else collect.chunked)(df, "src", "ord", limit).collect()
        want = []
        for g in ("a", None, "b", "c"):
            own = sorted((i, t) for x, i, t in rows if x == g)
            want += [(g, i, t, m) for (i, t), m in zip(own, looped([t for _, t in own], limit, budget)[0], strict=True)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_group_of_millions_uses_all_tasks(spark, monkeypatch):
    """Both passes over one group; no task has more than its share."""
    n = 2_000_000
    rows = spark.range(n).select(F.lit("all").alias("g"), F.col("id").alias("o"), (F.col("id") * 7919 % 900 + 1).alias("tokens"))
    tokens = [k * 7919 % 900 + 1 for k in range(n)]
    chunk = sequences.spread(rows, 12_000, False)
    want, _ = looped(tokens, 12_000, False)
    assert chunk.agg(F.max("chunk"), F.sum(F.col("chunk") * (F.col("o") % 1000))).first() == (want[-1], sum(c * (k % 1000) for k, c in enumerate(want)))
    sizes = [r["count"] for r in chunk.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * n
    took, _ = looped(tokens, 500_000_000, True)
    assert sequences.spread(rows, 500_000_000, True).where("taken").agg(F.count("*"), F.sum("o")).first() == (sum(took), sum(k for k, t in enumerate(took) if t))
