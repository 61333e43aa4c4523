import math
import random
from collections import Counter

from tidemill.operators import column_profile as cp

ROWS = "load long, c string, value string, n string"


def rows():
    rng = random.Random(3)
    out = []
    for load in (1, 2, 3):
        for _ in range(400):
            # one value holds a third of the rows
            v = "hot" if rng.random() < 0.34 else f"v{rng.randrange(30 * load):03d}"
            out.append((load, None if rng.random() < 0.05 * load else v, rng.choice(["", " ", "a"]), "x"))
    return out + [(4, None, None, None), (None, "z", "z", None), (None, "z", "z", None)]


def test_profile_is_exact(spark):
    data = rows()
    got = {(r["field_name"], r["load"]): r for r in cp.profile(spark.createDataFrame(data, ROWS), ["c", "value"], "load", {"c": "hot|v0.*"}).collect()}
    for load in (1, 2, 3, None):
        filled = sorted(r[1] for r in data if r[0] == load and r[1])
        p = got["c", load]
        assert p["rows"] == sum(r[0] == load for r in data) and p["blanks"] == p["rows"] - len(filled)
        assert (p["distinct_values"], p["min_value"], p["max_value"]) == (len(set(filled)), filled[0], filled[-1])
        assert p["bad_form"] == sum(not (v == "hot" or v.startswith("v0")) for v in filled)
        assert p["quantiles"] == [filled[max(1, math.ceil(len(filled) * q)) - 1] for q in (0.25, 0.5, 0.75)]
    assert got["c", 4]["blanks"] == 1 and got["c", 4]["quantiles"] == [None] * 3 and got["c", 4]["min_value"] is None


def test_distances_are_exact(spark):
    data = rows()
    pairs = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "load long, before long")
    counts = cp.value_counts(spark.createDataFrame(data, ROWS), ["c"], "load")
    got = {r["load"]: r for r in cp.distances(cp.curves(counts, pairs, partitions=3)).collect()}
    assert set(got) == {2, 3}
    for load, before in ((2, 1), (3, 2)):
        a, b = (Counter(r[1] for r in data if r[0] == x and r[1]) for x in (load, before))
        na, nb = sum(a.values()), sum(b.values())
        run = ks = shift = 0.0
        for v in sorted({*a, *b}):
            step = a[v] / na - b[v] / nb
            run += step
            ks, shift = max(ks, abs(run)), shift + abs(step) / 2
        assert abs(got[load]["ks"] - ks) < 1e-9 and abs(got[load]["shift"] - shift) < 1e-9


def test_findings(spark):
    data = [(1, "a.b", None, None)] * 10 + [(2, "a.b", None, None)] * 9 + [(2, None, None, None)] + [(3, "a.c", None, None)] * 10 + [(4, " a.b", None, None)] * 2
    pairs = spark.createDataFrame([(2, 1), (3, 2), (4, 9)], "load long, before long")
    counts = cp.value_counts(spark.createDataFrame(data, ROWS), ["c"], "load")
    got = sorted((r["load"], r["finding"]) for r in cp.findings(cp.curves(counts, pairs), {"c": r"[a-z_]+\.[a-z_]+"}).collect())
    assert got == [(2, "blank_rise"), (3, "value_shift"), (4, "bad_form")]
    empty = cp.value_counts(spark.createDataFrame([], ROWS), ["c"], "load")
    assert cp.findings(cp.curves(empty, pairs), {}).count() == 0
    assert cp.profile(spark.createDataFrame([], ROWS), ["c"], "load").count() == 0


def test_findings_come_off_the_sorted_curves(spark, monkeypatch):
    data = [(1, f"v{i:02d}", None, None) for i in range(40)] + [(2, f"v{i:02d}" if i < 20 else f"w{i:02d}", None, None) for i in range(40)]
    pairs = spark.createDataFrame([(2, 1)], "load long, before long")
    counts = cp.value_counts(spark.createDataFrame(data, ROWS), ["c"], "load")
    found = lambda: sorted((r["load"], r["finding"]) for r in cp.findings(cp.curves(counts, pairs, partitions=5), {"c": "v.*"}).collect())
    assert found() == [(2, "bad_form"), (2, "value_shift")]
    curve = cp.curves(counts, pairs, partitions=5)
    rows = sorted((r for r in curve.collect() if r["load"] == 2), key=lambda r: r["value"])
    seen = before = 0
    for r in rows:  # exact prefix counts across the ranges
        seen, before = seen + r["n"], before + r["n_before"]
        assert (r["rows_upto"], r["before_upto"], r["rows"], r["before"]) == (seen, before, 40, 40)
    # without running sums there is no curve, and no shift
    monkeypatch.setattr(cp, "_running", lambda keys: lambda batches: (b.assign(n_in=0, n_before_in=0, part=0) for b in batches))
    assert found() == []
