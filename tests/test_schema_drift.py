from tidemill.operators import schema_drift as sd

ROWS = "row_id long, feed_id long, line long, original map<string,string>, extra map<string,string>, place int, sku string"
FILES = "feed_id long, series_id long, received_at long, key string"
ALIASES = [("sku", "SKU"), ("sku", "Item No"), ("cost", "Cost"), ("cost", "Net"), ("title", "Title")]


def feed(spark, cells):
    """(feed_id, rows of {header: cell}) of one series, in order."""
    known = {sd_fold(h) for _, h in ALIASES}
    out, n = [], 0
    for feed_id, rows in cells:
        for i, r in enumerate(rows):
            n += 1
            out.append((n, feed_id, i + 2, r, None if r is None else {h: v for h, v in r.items() if sd_fold(h) not in known}, 0, "clash"))
    files = spark.createDataFrame([(f, 1, i, "k") for i, (f, _) in enumerate(cells)], FILES)
    return spark.createDataFrame(out, ROWS), files, spark.createDataFrame(ALIASES, "field string, header string")


def sd_fold(s):
    from tidemill.functions.text import fold_py

    return fold_py(s)


def drifts(df):
    return sorted((r["feed_id"], r["header"], r["drift"]) for r in df.where("drift is not null").collect())


def test_all_kinds_of_drift(spark):
    one = [{"SKU": f"s{i}", "Cost": f"{i}.50", "Bin": f"b{i}", "Flag": "true", "Due": "12", "Gone": "x"} for i in range(12)]
    two = [{"Item No": f"S{i}", "Net": f"{i}.50", "Shelf": f"b{i}" if i else "odd", "FLAG ": "true", "Due": "12 days", "Fresh": "y"} for i in range(12)]
    three = [{"SKU": f"s{i}", "Buy": f"{i}.50", "Shelf": f"b{i}", "flag": "maybe", "Due": "3 days", "Fresh": ""} for i in range(12)]
    rows, files, aliases = feed(spark, [(1, one), (2, two), (3, three), (4, [])])
    matched = sd.drift(rows, files, aliases)
    assert drifts(matched) == [
        (2, "Due", "retyped"), (2, "Fresh", "added"), (2, "Gone", "removed"), (2, "Item No", "renamed"), (2, "Net", "renamed"), (2, "Shelf", "renamed"),
        (3, "Buy", "renamed"), (3, "SKU", "renamed"), (3, "flag", "retyped"),
    ]
    got = {(r["feed_id"], r["line"]): r for r in sd.unified(rows, matched, ["sku", "cost"]).collect()}
    assert got[1, 3]["sku"] == "s1" and got[3, 3]["cost"] == "1.50" and got[2, 3]["extra"]["bin"] == "b1" and got[3, 3]["extra"]["bin"] == "b1"
    assert len(got) == 36


def test_no_false_rename_and_nulls(spark):
    one = [{"SKU": f"s{i}", "A": f"{i}", "B": ""} for i in range(5)] + [None, {}, {"SKU": None, "A": None}]
    two = [{"SKU": f"s{i}", "C": f"{i + 1}", "D": ""} for i in range(5)] + [{"SKU": "s1", "C": "9", "long": "z" * 100_000}]
    rows, files, aliases = feed(spark, [(1, one), (2, two)])
    assert drifts(sd.drift(rows, files, aliases)) == [(2, "A", "removed"), (2, "B", "removed"), (2, "C", "added"), (2, "D", "added"), (2, "long", "added")]
    empty = rows.limit(0)
    assert sd.drift(empty, files, aliases).count() == 0


def test_flooding_prefers_the_likelier_pair():
    h = lambda k, t="text": {"key": k, "type": t, "in_extra": True, "field": None, "header": k}
    gone, new = [h("bin location"), h("season", "whole")], [h("bin place"), h("saison", "whole")]
    scores = sd.flood(gone, new, {})
    assert scores["bin location", "bin place"] > scores["bin location", "saison"]
    assert scores["season", "saison"] > scores["season", "bin place"]
    both = {(a["key"], b["key"]): 1.0 for a in gone for b in new}
    assert sorted(sd.correspondences(gone, new, both)) == [("bin location", "bin place"), ("season", "saison")]
    assert sd.correspondences(gone, new, {}) == [] and sd.correspondences(gone, gone, both) == []


def test_settled_scores_choose_between_rivals(spark, monkeypatch):
    # both old columns hold what the new one holds; words, type and what stays tell which it continues
    one = [{"SKU": f"s{i}", "Area": "n", "Bay code": f"b{i}", "A shelf": f"b{i}", "Bay depth": "3"} for i in range(8)]
    two = [{"SKU": f"s{i}", "Area": "n", "Bay no": f"b{i}", "Bay depth": "3"} for i in range(8)]
    three = [{"SKU": f"s{i}", "Area": "n", "Box label": f"b{i}", "Zone bay": f"b{i}", "Bay depth": "3"} for i in range(8)]
    rows, files, aliases = feed(spark, [(1, one), (2, two), (3, three)])
    want = [(2, "A shelf", "removed"), (2, "Bay no", "renamed"), (3, "Box label", "added"), (3, "Zone bay", "renamed")]
    matched = sd.drift(rows, files, aliases)
    assert drifts(matched) == want
    assert {r["key"]: r["before_key"] for r in matched.where("drift = 'renamed'").collect()} == {"bay no": "bay code", "zone bay": "bay no"}
    # without flooding the rows are others; two consecutive files each, so that the functions below reach the workers
    schema = lambda ks: [{"key": k, "type": "text", "in_extra": k != "sku", "field": "sku" if k == "sku" else None, "header": k} for k in ks]
    before, now = schema(["sku", "bay code", "a shelf", "bay depth"]), schema(["sku", "bay no", "bay depth"])
    agreed = {("bay code", "bay no"): 1.0, ("a shelf", "bay no"): 1.0}
    assert sd.correspondences(before, now, agreed) == [("bay code", "bay no")]
    flat = lambda b, n, e: {p: 0.0 for p in agreed}
    monkeypatch.setattr(sd, "flood", flat)
    assert sd.correspondences(before, now, agreed) == [("a shelf", "bay no")]


def test_cast_to_one_type(spark):
    one = [{"SKU": f"s{i}", "N": f"0{i}", "T": "Yes", "D": "2026-01-02", "W": "1"} for i in range(11)] + [{"SKU": "x", "N": "tbc", "T": "", "D": None, "W": "2"}]
    two = [{"SKU": f"s{i}", "N": f"{i},50", "T": "false", "D": "2026-02-03T10:00:00Z", "W": "x y"} for i in range(11)]
    rows, files, aliases = feed(spark, [(1, one), (2, two)])
    matched = sd.drift(rows, files, aliases)
    got = {(r["feed_id"], r["line"]): r for r in sd.unified(rows, matched, ["sku"]).collect()}
    assert got[1, 3]["extra"] == {"n": "1", "t": "true", "d": "2026-01-02", "w": "1"} and got[1, 3]["odd"] == {}
    assert got[2, 3]["extra"] == {"n": "1.5", "t": "false", "d": "2026-02-03", "w": "x y"}
    assert got[1, 13]["extra"] == {"w": "2"} and got[1, 13]["odd"] == {"n": "tbc"}
    assert sd.common_type({"whole", "decimal", "empty"}) == "decimal" and sd.common_type({"empty"}) == "text" and sd.common_type({"truth", "mixed"}) == "text"
