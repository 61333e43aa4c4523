import random

from tidemill.llm import survivors as sv

LADDER = sv.Ladder(fields=["a", "b", "c", "updated_at"], compare=["a", "b", "c"], core=["a"], backfill=["a", "b"])
ROWS = "row_id long, feed_id long, line long, sku string, a string, b string, c string, updated_at string, survivor string, n_rows int, tied string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], ROWS)
    return {(r["feed_id"], r["sku_key"]): r for r in sv.survivors(sv.sku_groups(df), ["feed_id", "sku_key"], LADDER).collect()}


def test_ladder(spark):
    got = run(
        spark,
        [
            (1, 1, 2, "A-1", "x", " ", "p", "2026-01-01"), (2, 1, 3, "a 1", None, "y", "p", "2026-01-02T05:00"), (3, 1, 4, "A.1", "z", "n/a", "p", "bad"),
            (4, 1, 5, "B", "x", None, " ", "2026-01-01"), (5, 1, 6, "b", "x", "", None, "2026-01-09"),
            (6, 1, 7, "C", "x", "1", "-", None), (7, 1, 8, "C", "-", "1", "2", None),
            (8, 1, 9, "D", "x", "1", "", "1.2.26"), (9, 1, 10, "D", "y", "", "1", "01/02/2026"),
            (10, 1, 11, "E", "only", "one", "", ""), (11, None, 12, "F", "x", "", "", ""), (12, None, 13, "F", "y", "", "", ""),
            (13, 1, 14, "é", "x", "", "", ""), (14, 1, 15, "é", "y", "", "", ""), (15, 1, 16, None, "x", "", "", ""),
            (16, 2, 1, "A", "x", "q", "", None), (17, 2, None, "A", "x", "q", "", None), (18, 1, 30, "L", "w" * 100_000, "", "", None), (19, 1, 31, "L", "", "", "", None),
        ],
    )
    pick = {k: (r["survivor"], r["backfills"], r["tied"], r["identical"]) for k, r in got.items()}
    assert pick == {
        (1, "a 1"): (2, 1, False, False), (1, "b"): (4, 0, False, True), (1, "c"): (6, 0, False, False), (1, "d"): (None, None, True, False),
        (2, "a"): (16, 0, False, True), (1, "l"): (18, 0, False, False),
    }
    a = got[1, "a 1"]
    assert (a["a"], a["b"], a["c"], a["updated_at"], a["n_rows"]) == ("x", "y", "p", "2026-01-02T05:00", 3)
    b = got[1, "b"]
    assert (b["a"], b["updated_at"]) == ("x", "2026-01-01")  # identical: the lowest line's own time
    d = got[1, "d"]
    assert d["tied"] and (d["a"], d["c"], d["updated_at"]) == ("x", "1", "1.2.26")
    assert run(spark, []) == {}


def test_survivors_come_from_the_attributes_maxima(spark):
    rows = [(1, 1, 1, "S", "x", "", "1", "2026-01-02", "x", 0, "y"), (2, 1, 2, "S", "", "b", "", "2026-01-01", "x", 0, "y")]
    plan = sv.survivors(sv.sku_groups(spark.createDataFrame(rows, ROWS)), ["feed_id"], LADDER).select("survivor", "backfills")
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"__a_{f}" in optimized for f in LADDER.backfill)
    assert [tuple(r) for r in plan.collect()] == [(1, 1)]


def test_many_keys_meet_their_rows_in_salted_parts(spark, monkeypatch):
    rows = [(i, 1, i, f"s{i % 90}" if i % 3 else "hot", "x", None, str(i % 2), None) for i in range(600)]
    want = run(spark, rows)
    monkeypatch.setattr(sv, "KEYS_LIMIT_BYTES", 0)
    assert run(spark, rows) == want and want[1, "hot"]["n_rows"] == 200


def test_hot_group_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        sku = "hot" if rng.random() < 0.34 else f"s{rng.randrange(300)}"
        cell = lambda: rng.choice(["", None, "n/a", "v", f"w{rng.randrange(4)}"])
        rows.append((i, 1, i, sku, cell(), cell(), cell(), rng.choice([None, "2026-01-01", f"2026-01-{rng.randrange(1, 9):02d}", "x"])))
    got = run(spark, rows)
    full = lambda v: v is not None and v.strip() not in ("", "-", "--", "n/a", "N/A")
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    for sku, g in groups.items():
        if len(g) < 2:
            assert (1, sku) not in got
            continue
        same = len({tuple(v or "" for v in r[4:7]) for r in g}) == 1
        rank = lambda r: (r[7] if r[7] and r[7][0] == "2" else "", full(r[4]), sum(map(full, r[4:])))
        best = max(map(rank, g))
        top = [g[0]] if same else [r for r in g if rank(r) == best]
        r = got[1, sku]
        assert r["tied"] == (len(top) > 1)
        if len(top) == 1:
            w = top[0]
            assert r["survivor"] == w[0]
            assert r["backfills"] == sum(not full(w[k]) and any(full(x[k]) for x in g) for k in (4, 5))
