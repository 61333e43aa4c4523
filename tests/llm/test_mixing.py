import random

from tidemill.llm import mixing as mx

TOKENS = "doc_id long, source string, n_tokens long, repeats int"
TARGETS = "source string, target_share double, max_repeats int, tokens int"


def test_shares_and_repeats(spark):
    rng = random.Random(6)
    size = {"big": 3000, "mid": 800, "small": 60, "other": 500}
    rows, i = [], 0
    for s, n in size.items():
        for _ in range(n):
            i += 1
            rows.append((i, s, rng.randrange(1, 400), 9))
    rows += [(i + 1, None, 50, 9), (i + 2, "big", 0, 9), (None, "mid", 5, 9), (7, "big", 30, 9)]
    df = spark.createDataFrame(rows, TOKENS)
    targets = {"big": mx.Target(0.5, 1), "mid": mx.Target(0.4, 2), "small": mx.Target(0.1, 4)}
    mixed, plan = mx.mixture(df, targets)
    used = mixed.collect()
    assert {r["source"] for r in used} <= set(targets)
    total = sum(r["n_tokens"] * r["repeats"] for r in used)
    tokens = {s: sum(n for _, x, n, _ in rows if x == s) for s in targets}
    assert total > 0.99 * min(t.repeats * tokens[s] / t.share for s, t in targets.items())
    for s, t in targets.items():
        mine = [r for r in used if r["source"] == s]
        assert max(r["repeats"] for r in mine) <= t.repeats
        assert max(r["repeats"] for r in mine) - min([r["repeats"] for r in mine] + ([0] if len(mine) < sum(x == s for _, x, *_ in rows) else [])) <= 1
        assert abs(sum(r["n_tokens"] * r["repeats"] for r in mine) - total * t.share) < 0.005 * total
    table = spark.createDataFrame([(s, t.share, t.repeats, 1) for s, t in targets.items()] + [("none", 0.0, 1, 1)], TARGETS)
    report = {r["source"]: r for r in mx.shares(mixed, table).collect()}
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9 and report["none"]["tokens"] == 0
    again, _ = mx.mixture(df.repartition(7), targets)
    assert sorted(map(str, again.collect())) == sorted(map(str, used))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", 10, 0), (2, "a", 10, 0)], TOKENS)
    assert mx.mixture(df, {})[0].count() == 0
    assert mx.mixture(df, {"a": mx.Target(0.5, 1), "gone": mx.Target(0.5, 1)})[0].count() == 0
    whole = mx.mixture(df, {"a": mx.Target(1.0, 3)})[0].collect()
    assert [r["repeats"] for r in whole] == [3, 3]
    assert mx.mixture(df.limit(0), {"a": mx.Target(1.0, 3)})[0].count() == 0
