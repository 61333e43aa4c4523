import csv
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemill import cli
from tidemill.operators.dedupe import deduplicate
from tidemill.operators.normalize import normalize
from tidemill.operators.summary import render, render_brief
from tidemill.plans.pipeline import judge, run
from tidemill.profile import ProfileError, build_profile, load_profile
from tidemill.sources import grid
from tidemill.sources.feed import UnreadableInput, from_table, read_feed
from tidemill.testfeed import PROFILE, synthetic

PROF = build_profile(PROFILE)


def deduped(spark, rows):
    base = dict.fromkeys(("title", "vendor", "price", "barcode", "image_url", "stock_status", "tags", "updated_at", "sku"), "")
    table = spark.createDataFrame([{"line": i + 2, **base, **r} for i, r in enumerate(rows)])
    out = deduplicate(normalize(from_table(table, PROF).rows, PROF))
    return {r["line"]: r for r in out.collect()}


def test_ladder_rungs(spark):
    got = deduped(
        spark,
        [
            {"sku": "A-1", "title": "One Thing", "updated_at": "2026-01-01"}, {"sku": "a 1", "title": "Other Thing", "updated_at": "2026-01-02", "tags": "t"},
            {"sku": "B", "title": "Same"}, {"sku": "b", "title": " Same ", "updated_at": "2026-01-02"},
            {"sku": "C", "title": "X y", "updated_at": "03/04/2026"}, {"sku": "C", "title": "X y", "price": "$5", "updated_at": "04/05/2026"},
            {"sku": "D", "title": "P q"}, {"sku": "D", "title": "P r"},
            {"sku": "E", "title": "M n", "tags": "a"}, {"sku": "E", "title": "M o"},
            {"sku": "", "title": "No sku"}, {"sku": "é", "title": "No key"}, {"sku": "F", "title": "Alone"},
            {"sku": "G", "title": "", "updated_at": "2026-02-01"}, {"sku": "G", "title": "Kept words", "vendor": "quillmark", "updated_at": "2026-01-01"},
            {"sku": "G", "title": "Later words", "image_url": "//i.example/x", "updated_at": "2026-01-01"},
        ],
    )
    roles = {k: (r["role"], r["reason"]) for k, r in got.items()}
    assert roles == {
        2: ("dropped", "newest updated_at"), 3: ("kept", "newest updated_at"), 4: ("kept", "identical"), 5: ("dropped", "identical"),
        6: ("dropped", "more complete"), 7: ("kept", "more complete"), 8: ("tied", "unresolved tie"), 9: ("tied", "unresolved tie"),
        10: ("kept", "more columns populated"), 11: ("dropped", "more columns populated"), 12: ("nosku", None), 13: ("nosku", None), 14: ("single", None),
        15: ("kept", "newest updated_at"), 16: ("dropped", "newest updated_at"), 17: ("dropped", "newest updated_at"),
    }
    g = got[15]
    assert (g["v"]["title"], g["v"]["vendor"], g["v"]["image_url"], g["backfills"]) == ("Kept words", "Quillmark Tools", "https://i.example/x", 3)
    fills = [(c["field"], c["before"], c["after"], c["note"]) for c in g["changes"] if c["rule"] == "dedupe.backfill"]
    assert ("image_url", "", "https://i.example/x", "was empty, from line 17") in fills
    assert got[8]["issues"][0]["rule"] == "duplicate_unresolved" and got[8]["issues"][0]["message"] == "title P q vs P r: none of 2 rows is newer or fuller (lines 8, 9)"
    assert [c["note"] for c in got[8]["changes"] if c["rule"] == "dedupe.unresolved"] == ["tied with lines 9"]
    assert [c["note"] for c in got[15]["changes"] if c["rule"] == "dedupe.keep"] == ["best of 3 rows (newest updated_at), without lines 16, 17"]


def test_large_ties_are_told_in_bounds_and_joined_in_parts(spark, monkeypatch):
    rows = [{"sku": "T", "title": f"Thing {i:02d}", "tags": "ab"[i % 2], "vendor": f"V{i}", "price": str(i + 1)} for i in range(40)] + [{"sku": "", "title": "x"}, {"sku": "S", "title": "y"}]
    want = deduped(spark, rows)
    tied = want[2]["issues"][0]["message"]
    assert tied.startswith("title Thing 00 vs Thing 01 vs Thing 02 vs Thing 03 vs Thing 04 vs 35 more; vendor V0 vs V1 vs ") and "; 1 more fields: none of 40 rows" in tied
    assert tied.endswith("(lines 2, 3, 4, 5, 6, 7, 8, 9, 10, 11 and 30 more)")
    note = [c["note"] for c in want[2]["changes"] if c["rule"] == "dedupe.unresolved"][0]
    assert note == "tied with lines 3, 4, 5, 6, 7, 8, 9, 10, 11 and 30 more"
    from tidemill.operators import dedupe

    monkeypatch.setattr(dedupe, "BROADCAST_LIMIT_BYTES", 0)
    assert deduped(spark, rows) == want


def test_run_conserves_rows_and_logs_everything(spark):
    done = run(from_table(synthetic(spark, 140), PROF), PROF)
    s = done.summary("made up")
    assert s.totals["clean"] + s.totals["rejected"] + s.totals["dropped"] == s.totals["rows_in"] == 140
    assert done.clean.count() == s.totals["clean"] and done.rejects.count() == s.totals["rejected"]
    truth = {r["line"]: r for r in synthetic(spark, 140).collect()}
    for r in done.judged.where("role != 'dropped'").collect():
        assert r["v"]["price"] == f"{truth[r['line']]['truth_cents'] / 100:.2f}" and r["v"]["weight_g"] == str(truth[r["line"]]["truth_grams"])
    for c in done.changes.collect():
        if c["outcome"] == "unresolved":
            assert c["before"] and not c["after"] and c["note"] and c["flagged"]
        if c["rule"] == "dedupe.backfill":
            assert not c["before"] and c["after"]
    assert len(render(s).splitlines()) <= 60 and len(render_brief(s).splitlines()) <= 8
    done.judged.unpersist()


def test_rules(spark):
    p = build_profile({**PROFILE, "required": ["sku", "title", "price", "weight"]})
    rows = spark.createDataFrame(
        [(2, "A", "T" * 61, "TBC", "5", "1234", "a.jpg", "x" * 201), (3, "", "", "", "", "", "", ""), (4, None, None, None, None, None, None, None), (5, "B", "Fine", "EUR 5", "5 g", "", "//a/b", "ok")],
        "line int, sku string, title string, price string, weight string, barcode string, image_url string, description string",
    )
    got = {r["line"]: r for r in judge(from_table(rows, p), p).collect()}
    rules = lambda n, s: {i["rule"] for i in got[n]["issues"] if i["severity"] == s}
    assert rules(2, "reject") == {"price.format", "weight.unit", "barcode_invalid", "image_unusable", "description_too_long"}
    assert rules(2, "review") == {"title_too_long"}
    assert rules(3, "reject") == rules(4, "reject") == {"missing_sku", "missing_title", "missing_price", "missing_weight"}
    assert rules(5, "reject") == set() and rules(5, "review") == {"price.currency_mismatch"} and got[5]["needs_review"] and not got[5]["rejected"]


def test_profile_checks(tmp_path):
    ok = {"columns": {"sku": ["SKU"]}}
    assert build_profile(ok).required == ("sku", "title", "price") and build_profile(ok).field_of(" sku ") == "sku"
    assert PROF.headers_for("price") == ["price"]
    bad = [[], {"columns": {}}, {**ok, "extra": 1}, {**ok, "currency": "US"}, {**ok, "required": ["nope"]}, {**ok, "limits": {"x": 1}}, {**ok, "vendors": {"A": ["x"], "B": ["X "]}}, {**ok, "vendors": {"A": "x"}}, {**ok, "booleans": {"maybe": []}}]
    for b in bad:
        with pytest.raises(ProfileError):
            build_profile(b)
    with pytest.raises(ProfileError):
        load_profile(tmp_path / "none.json")
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(ProfileError):
        load_profile(tmp_path / "broken.json")


CSV = '﻿Item No,Title,Brand,Price,Bay,Text,Bay\r\nA1,led lamp,quillmark,"$1,299.00", b 1 ,"<p>a ""b""\nc</p>",z\r\n\r\nA2,LED LAMP,nobody,n/a\r\nA3,,x,TBC,1,2,3,surplus\r\n'


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.json").write_text(json.dumps(PROFILE))
    (tmp_path / "feed.csv").write_bytes(CSV.encode())
    args = [str(tmp_path / "feed.csv"), "--profile", str(tmp_path / "p.json"), "--quiet", "--out"]
    assert cli.main([*args, str(tmp_path / "one"), "--brief", "--fail-on-reject"], spark) == cli.REJECTS
    assert "3 rows, 1 clean, 2 rejected" in capsys.readouterr().out
    with (tmp_path / "one/clean.csv").open(newline="") as f:
        clean = list(csv.DictReader(f))
    assert [(r["sku"], r["title"], r["vendor"], r["price"], r["Bay"], r["description"]) for r in clean] == [("A1", "LED Lamp", "Quillmark Tools", "1299.00", "z", 'a "b" c')]
    with (tmp_path / "one/rejects.csv").open(newline="") as f:
        rejects = list(csv.DictReader(f))
    assert [(r["line"], r["reject_rules"], r["Bay"]) for r in rejects] == [("3", "missing_price", ""), ("4", "missing_title price.format", "3")]
    assert cli.main([*args, str(tmp_path / "two")], spark) == cli.OK
    book = tmp_path / "one/clean.xlsx"
    assert book.read_bytes() == (tmp_path / "two/clean.xlsx").read_bytes()
    sheet = grid.read_table(spark, book)
    row = sheet.collect()[0]
    assert (row["sku"], row["price"], row["needs_review"]) == ("A1", "1299.00", "no")
    assert {m.date_time for m in zipfile.ZipFile(book).infolist()} == {(1980, 1, 1, 0, 0, 0)}
    assert grid.read_xlsx(spark, book, "Changes").count() == sum(1 for _ in csv.DictReader((tmp_path / "one/changes.csv").open(newline="")))
    assert cli.main([str(tmp_path / "none.csv"), *args[1:], str(tmp_path / "x")], spark) == cli.UNREADABLE
    assert cli.main([args[0], "--profile", "none.json"], spark) == cli.USAGE
    assert cli.main(["--nonsense"], spark) == cli.USAGE
    (tmp_path / "bad.csv").write_bytes(b"Item No\n\xff\xfe\n")
    with pytest.raises(UnreadableInput):
        read_feed(spark, tmp_path / "bad.csv", PROF)
    (tmp_path / "head.csv").write_text("Item No,Title\n")
    (tmp_path / "zero.csv").write_text("")
    for name in ("head.csv", "zero.csv"):
        with pytest.raises(UnreadableInput):
            read_feed(spark, tmp_path / name, PROF)
    listed = [r["name"] for r in grid.list_folder(spark, tmp_path / "one", sort="name").collect()]
    assert listed == ["changes.csv", "clean.csv", "clean.xlsx", "rejects.csv", "summary.txt"]
    assert grid.read_table(spark, tmp_path / "one/clean.csv").count() == 1
    (tmp_path / "ragged.csv").write_bytes(b'a,surplus\r\n1\r\n3,4,"x, ""y""\nz",\r\n5,6\r\n')
    assert [tuple(r)[1:] for r in grid.read_csv(spark, tmp_path / "ragged.csv").collect()] == [("1", "", []), ("3", "4", ['x, "y"\nz', ""]), ("5", "6", [])]
    sizes = grid.list_folder(spark, tmp_path, "*.csv", sort="size").collect()
    assert [(r["name"], r["type"], r["size"]) for r in sizes][-1] == ("zero.csv", "CSV", "0 B") and sizes[0]["modified"].count("-") == 2
    shown = spark.createDataFrame([(1023,), (1536,), (5_000_000_000,)], "n long")
    assert [r[0] for r in shown.orderBy("n").select(grid.shown_size(F.col("n"))).collect()] == ["1,023 B", "1.5 KB", "4768.4 MB"]
    with pytest.raises(ValueError):
        grid.read_table(spark, tmp_path / "p.json")


def test_clashing_headers(spark, tmp_path):
    (tmp_path / "feed.csv").write_text("Item No,Title,Price,currency,line,ISSUES\nA,One,5,c,l,i\nB,,5,c2,l2,i2\n")
    feed = read_feed(spark, tmp_path / "feed.csv", PROF)
    done = run(feed, PROF, persist=False)
    assert done.clean.columns[-6:] == ["currency (2)", "line (2)", "ISSUES (2)", "needs_review", "issues", "flagged"]
    assert done.rejects.columns[:5] == ["line", "sku", "reject_rules", "reason", "Item No"] and "line (2)" in done.rejects.columns
    assert done.rejects.first()["line (2)"] == "l2"


def test_stream_gives_the_same_rows(spark, tmp_path):
    from tidemill.streaming.feed_stream import normalized_stream, run_stream

    rows = synthetic(spark, 30).drop("truth_cents", "truth_grams", "truth_mm")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert normalized_stream(stream, PROF).isStreaming
    run_stream(stream, PROF, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = judge(from_table(rows, PROF), PROF)
    key = lambda df: sorted(map(tuple, df.select("line", "role", "sku", F.to_json("v")).collect()))
    assert key(got) == key(want)


def test_feed_pipeline_never_merges_rows_without_a_sku(spark, tmp_path):
    from tidemill.functions.text import fold_py
    from tidemill.plans.survey import feed_pipeline

    skus = [None, None, "", "", " ", " ", "-", "-", "--", "#", "é", "n/a", "A-1", "a 1", "A-1 ", "B"]
    cells = [(f, s, t) for f in (1, 2) for s in skus for t in ("Same thing", "Same thing", "Other thing")]
    rows = [(i + 1, f, s, t, "5") for i, (f, s, t) in enumerate(cells)]
    spark.createDataFrame(rows, "row_id long, feed_id long, sku string, title string, price string").write.parquet(str(tmp_path / "feed_row.parquet"))
    out = feed_pipeline(spark, str(tmp_path))
    got = {r["line"]: r for r in out.collect()}
    groups = {}
    for i, f, s, *_ in rows:
        if fold_py(s):
            groups.setdefault((f, fold_py(s)), []).append(i)
    role = {i: "single" if len(g) == 1 else "tied" for g in groups.values() for i in g}  # titles differ in all groups and nothing decides
    assert {i: got[i]["role"] for i, *_ in rows} == {i: role.get(i, "nosku") for i, *_ in rows}
    assert {i for i, r in got.items() if r["role"] == "nosku"} == {i for i, _, s, *_ in rows if not fold_py(s)}
    # no sku at all is a rejection; marks are a sku that has no key
    assert {i for i, r in got.items() if r["role"] == "nosku" and r["rejected"]} == {i for i, _, s, *_ in rows if not (s or "").strip()}
    assert all(got[i]["sku"] == (s or "").strip() for i, _, s, *_ in rows if not fold_py(s))


def test_report_counts_all_vendors_without_an_alias(spark):
    rows = spark.range(1203).select((F.col("id") + 2).alias("line"), F.concat(F.lit("S"), F.col("id")).alias("sku"), F.lit("A thing").alias("title"), F.lit("5").alias("price"), F.format_string("Maker %04d", F.col("id") % 1201).alias("vendor"))
    s = run(from_table(rows, PROF), PROF, persist=False).summary("made up")
    assert (s.vendors, s.n_vendors) == (["Maker 0000", "Maker 0001", "Maker 0002"], 1201)
    assert "vendors without an alias  1201: Maker 0000, Maker 0001, Maker 0002 and 1198 more" in render(s)
