"""Chains, cycles and orders against plain walks."""

import random

from pyspark.sql import functions as F

from lumenledger.operators import chains


def walked(links):
    """node to end, hops, cycle, on_cycle, by walking."""
    out = {}
    for v in set(links) | set(links.values()):
        seen, at = [], v
        while at in links and at not in seen:
            seen.append(at)
            at = links[at]
        out[v] = (at, len(seen), None, False) if at not in links else (None, None, min(seen[seen.index(at) :]), seen.index(at) == 0)
    return out


def test_chains_and_cycles(spark):
    rng = random.Random(1)
    links = {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 7, 10: 10, 11: 10}
    links |= {1000 + i: 1000 + rng.randrange(200) for i in range(0, 200, 2)} | {2000 + i: 2000 + rng.randrange(i + 1, 300) for i in range(250)}
    df = spark.createDataFrame([*links.items(), (None, 5), (7, None)], "node long, next long").repartition(3)
    assert {r.node: tuple(r)[1:] for r in chains.chains(df).collect()} == walked(links)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    kept = chains.written
    monkeypatch.setattr(chains, "written", lambda df: rounds.append(1) or kept(df))
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(10).select((F.col("id") * 1000).alias("a"), (-1 - F.col("id")).alias("b")))
    got = chains.layers(edges)
    assert got.where("node >= 0 AND layer <> node").isEmpty() and got.count() == n + 11
    assert got.where("node < 0 AND layer <> (-1 - node) * 1000 + 1").isEmpty()
    assert len(rounds) < 40


def test_rounds_do_not_grow_with_the_number_of_chains(spark, monkeypatch):
    """Nodes that turn stop when their own cycles are known, and don't carry along those that have ended."""
    rounds = []
    kept = chains.written
    monkeypatch.setattr(chains, "written", lambda df: rounds.append(1) or kept(df))
    links = {10 * i + k: 10 * i + k + 1 for i in range(2000) for k in range(3)} | {10 * i + 4: 10 * i + 5 for i in range(2000)} | {10 * i + 5: 10 * i + 4 for i in range(0, 2000, 2)}
    links |= {7: 4, 8: 7, 9: 8}
    df = spark.createDataFrame([*links.items()], "node long, next long")
    assert {r.node: tuple(r)[1:] for r in chains.chains(df).collect()} == walked(links)
    assert len(rounds) < 8


def longest(edges):
    nodes = {v for e in edges for v in e}
    layer, left = {}, set(edges)
    at = 0
    while free := {v for v in nodes - layer.keys() if all(b != v for _, b in left)}:
        layer |= {v: at for v in free}
        left = {e for e in left if e[0] not in free}
        at += 1
    return {v: layer.get(v) for v in nodes}


def test_layers_are_those_of_peeling(spark):
    rng = random.Random(4)
    edges = {(900, 900), (900, 901)}
    for k, (n, m, cyclic) in enumerate(((30, 25, False), (40, 60, False), (20, 20, True), (8, 4, True))):
        pairs = {tuple(rng.sample(range(n), 2)) for _ in range(m)}
        edges |= {(100 * k + a, 100 * k + b) for a, b in (pairs if cyclic else map(sorted, pairs))}
    got = {r.node: r.layer for r in chains.layers(spark.createDataFrame([*edges], "a long, b long")).collect()}
    assert got == longest(edges) and None in got.values() and max(v or 0 for v in got.values()) > 4


def test_import_order_takes_targets_first(spark):
    events = [("e1", "s2", 1), ("e2", "s1", 1), ("e3", "s1", 2), ("e4", "s1", 3), ("e5", "s3", 1), ("e6", "s3", 2), ("e7", "s3", 3), ("e8", "s0", 1)]
    relations = [("e3", "e1"), ("e3", "e2"), ("e4", "e3"), ("e5", "e6"), ("e6", "e5"), ("e7", "gone"), ("e8", None), ("e3", "e1")]
    got = chains.import_order(spark.createDataFrame(events, "event_id string, session_id string, sequence int"), spark.createDataFrame(relations, "event_id string, target string"))
    assert {r.event_id: (r.layer, r.place) for r in got.collect()} == {
        "e8": (0, 0), "e2": (0, 1), "e1": (0, 2), "e3": (1, 0), "e4": (2, 0), "e5": (None, None), "e6": (None, None), "e7": (None, None),
    }


def test_import_order_joins_its_rows_once(spark, capsys):
    """Places and the rows without one are read from a table, and don't make layers anew."""
    events, relations = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "event_id long, session_id long, sequence int"), spark.createDataFrame([(2, 1)], "event_id long, target long")
    chains.import_order(events, relations).explain()
    assert 0 < capsys.readouterr().out.count("Join") < 3
