import random
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import packing as pk
from tidemill.llm.tokens import token_counts


def test_plan_uses_every_item_once():
    rng = random.Random(4)
    for cap in (7, 64, 512):
        counts = Counter(min(cap, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(4000))
        plan = pk.plan(dict(counts), cap)
        used = Counter()
        for p, times in plan:
            assert times > 0 and sum(n * m for n, m in p) <= cap
            for n, m in p:
                used[n] += m * times
        assert used == counts
        containers, least = sum(t for _, t in plan), -(-sum(n * k for n, k in counts.items()) // cap)
        assert containers <= least * 1.02 + 1
    assert pk.plan({}, 10) == []


def test_nnls_finds_a_known_solution():
    patterns = [((2, 1), (3, 1)), ((2, 2),), ((3, 3),)]
    x = pk.nnls(patterns, {2: 5 + 2 * 4, 3: 5 + 3 * 2})
    a = np.array([[1, 2, 0], [1, 0, 3]])
    assert (x >= 0).all() and np.allclose(a @ x, [13, 11], atol=1e-2)


def test_packing_round_trip(spark):
    rng = random.Random(8)
    lengths = [rng.choice([0, 1, 10, 10, 10, 33, 50, 99, 100, 101, 250, rng.randrange(1, 400)]) for _ in range(900)]
    rows = [(i, n, 1, 2) for i, n in enumerate(lengths)] + [(5, lengths[5], 1, 2), (None, 7, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container_id int, piece int")
    sizes = {1: 100, 2: 256}
    packed = pk.pack(df.repartition(5), sizes)
    got = packed.collect()
    for p, cap in sizes.items():
        mine = [r for r in got if r["pack_id"] == p]
        load = Counter()
        pieces = {}
        for r in mine:
            load[r["container_id"]] += r["n_tokens"]
            pieces.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert max(load.values()) <= cap and set(load) == set(range(len(load)))
        assert len(load) <= -(-sum(n for _, n, *_ in rows) // cap) * 1.03 + 1
        for doc, ps in pieces.items():
            total = sum(n for d, n, *_ in rows if d == doc)
            assert sum(n for _, n in ps) == total
            if doc is not None and doc != 5 and total <= cap:
                assert ps == [(0, total)]
            elif doc is not None and doc != 5:
                assert sorted(ps) == [(s, min(cap, total - s)) for s in range(0, total, cap)]
    report = {r["pack_id"]: r for r in pk.fill(packed, sizes).collect()}
    assert report[1]["tokens"] == sum(n for _, n, *_ in rows) and report[1]["fullest"] <= 100
    assert pk.pack(df.limit(0), sizes).count() == 0 and pk.pack(df, {}).count() == 0
    with pytest.raises(ValueError):
        pk.pack(df, {1: 0})


def test_full_cuts_are_containers_of_their_own(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, 64 * rng.randrange(1, 40) if i % 50 else rng.randrange(1, 64)) for i in range(1500)]  # nearly all pieces are full
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(6)
    got = [tuple(r) for r in pk.pack(df, {7: 64}).collect()]
    load = Counter()
    for r in got:
        load[r[1]] += r[5]
    least = -(-sum(n for _, n in rows) // 64)
    assert max(load.values()) <= 64 and set(load) == set(range(len(load))) and len(load) <= least * 1.02 + 1
    assert sum(r[5] == 64 for r in got) > 0.98 * len(got) and sum(r[5] for r in got) == sum(n for _, n in rows)
    # the plan never sees them
    assert pk.Places({7: {64: 10**9, 10: 6}}, {7: 64}, 0.01).planned == {7: 1}
    monkeypatch.setattr(pk, "OFFSET_ROWS", 0)
    assert Counter(r["container_id"] for r in pk.pack(df, {7: 64}).collect()).keys() == load.keys()


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, None, "b"), (3, "", "b"), (4, "word " * 50_000, None)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and 50_000 <= got[4] <= 50_002
