"""Two-level windows, components and chains against plain restatements on random input."""

import random

from pyspark.sql import functions as F

from quireflow.functions import graph, scan


def _rows(seed, n=400):
    rng = random.Random(seed)
    keys = ["hot"] * (n // 3) + [rng.choice("abcd") for _ in range(n - n // 3)]
    return [(k, i // 16, i, rng.choice([None, rng.randint(-5, 5)])) for i, k in enumerate(keys)]


def test_running_and_neighbours(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "k string, chunk int, ord int, v int")
    got = scan.running(df, ["k"], ["chunk"], ["ord"], sums={"s": F.coalesce("v", F.lit(0))}, maxes={"m": F.col("v")}, lasts={"l": F.col("v")})
    got = scan.neighbours(got, ["k"], ["chunk"], ["ord"], lag={"p": F.col("ord")}, lead={"n": F.col("ord")})
    result = {(r.k, r.ord): (r.s, r.m, r.l, r.p, r.n) for r in got.collect()}
    assert len(result) == len(rows)
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        for i, (_, _, o, _) in enumerate(mine):
            seen = [r[3] for r in mine[: i + 1] if r[3] is not None]
            expected = (sum(seen), max(seen) if seen else None, seen[-1] if seen else None, mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None)
            assert result[key, o] == expected


def test_components_long_chain_and_star(spark):
    edges = [(1, i, i + 1) for i in range(60)] + [(1, 100, i) for i in range(101, 150)] + [(2, 7, 9)]
    nodes = [(s, n) for s, a, b in edges for n in (a, b)] + [(2, 8)]
    e = spark.createDataFrame(edges, "scope int, a int, b int")
    n = spark.createDataFrame(nodes, "scope int, node int")
    got = {(r.scope, r.node): r.component for r in graph.components(n, e, ["scope"]).collect()}
    assert {got[1, i] for i in range(61)} == {0}
    assert {got[1, i] for i in range(100, 150)} == {100}
    assert (got[2, 9], got[2, 8]) == (7, 8)


def test_follow_chain(spark):
    pointers = spark.createDataFrame([(1, i, i + 2 if i < 40 else None) for i in range(50)], "doc int, node int, nxt int")
    starts = spark.createDataFrame([(1, 3)], "doc int, node int")
    got = sorted(r.node for r in graph.follow_chain(pointers, starts, ["doc"]).collect())
    assert got == list(range(3, 42, 2))
