import hashlib
import math
import random

import numpy as np
import pytest

from tabulon.errors import InvalidRequest
from tabulon.llm import clustering
from tabulon.llm.clustering import Cells, assign, bounds, cluster_vectors, packed, unpacked


def brute(records, clusters, rounds, dimensions, scale=256, seed=2):
    kept = [
        (i, [math.floor(scale * x) for x in v]) for i, v in records
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    ordered = sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))
    centres = [v for _, v in ordered[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    each = {}
    for _, d, c in found:
        each[c] = each.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(map(str, ((i, c, d, each[c], total, digest[c]) for i, d, c in found)))


def table(spark, records):
    return spark.createDataFrame([(i, v, 1) for i, v in records], "vec_id long, embedding array<float>, key int")


@pytest.mark.parametrize("bits, spread", [(1, 1.5), (5, 0.05)])
def test_equal_to_brute_force(spark, bits, spread):
    random.seed(bits)
    centres = [[random.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    records = [(i, [float(np.float32(random.gauss(x, spread))) for x in random.choice(centres)]) for i in range(300)]
    got = cluster_vectors(table(spark, records), clusters=7, rounds=3, dimensions=4, bits=bits)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(records, 7, 3, 4)


def test_odd_rows(spark):
    """Nulls, broken vectors, repeated rows and ids, ties, and a third of all rows alike."""
    nan, inf = float("nan"), float("inf")
    records = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [2.0, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (5, None), (6, [1.0]), (7, [1.0, None])]
    records += [(8, [nan, 1.0]), (9, [inf, 1.0]), (10, [-inf, 0.0]), (11, []), (12, [0.5, 0.5, 0.5])] + [(100 + i, [0.5, -0.5]) for i in range(20)]
    records += [(200 + i, [float(i), -0.001 * i]) for i in range(20)]
    got = cluster_vectors(table(spark, records), clusters=3, rounds=5, dimensions=2)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(records, 3, 5, 2)
    few = records[:3]
    assert sorted(str(tuple(r)) for r in cluster_vectors(table(spark, few), dimensions=2).collect()) == brute(few, 40, 5, 2)
    none = cluster_vectors(table(spark, records).limit(0), dimensions=2)
    assert none.columns == got.columns and none.count() == 0
    with pytest.raises(InvalidRequest):
        cluster_vectors(table(spark, [(1, [1e30, 0.0])]), dimensions=2)


def test_intervals_hold_every_distance_and_spare_most_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (6, 16))
    x = centres[rng.integers(0, 6, 2000)] + rng.integers(-20, 21, (2000, 16))
    cells = Cells({"low": x.min(0), "high": x.max(0), "mean": x.mean(0), "deviation": x.std(0)}, 5)
    numbers = cells.of(x)
    assert (unpacked(packed(numbers, 5), 16, 5) == numbers).all()
    least, largest = bounds(numbers, cells.tables(centres))
    distance = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    shift = distance - least
    assert (shift.max(1) - shift.min(1) <= (largest - least).max(1)).all()
    possible = least <= largest.min(1)[:, None]
    assert possible[np.arange(len(x)), assign(centres, x)[0]].all()
    heard = []
    records = [(i, [float(v) / 256 for v in row]) for i, row in enumerate(x.tolist())]
    cluster_vectors(table(spark, records), clusters=6, rounds=2, dimensions=16, report=lambda turn, n: heard.append(n)).count()
    assert heard[0] == 2000 and min(heard) < 1000


def test_vectors_are_not_shuffled_again(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return computed_once(df)

    computed_once = clustering.computed_once
    monkeypatch.setattr(clustering, "computed_once", kept)
    monkeypatch.setattr(clustering, "BITS", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = [(i, [math.sin(i), math.cos(i)]) for i in range(100)]
        cluster_vectors(table(spark, records), clusters=4, rounds=2, dimensions=2).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    turns = [p for p in plans if "LeftOuter" in p]
    assert turns and all(p.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in p for p in turns)
