import random

from tidemill.llm import vocab_match as vm

ENTRIES = [
    (1, "vendor", "Quorvale Ropeworks"), (2, "vendor", "Quorvale Oil & Wax"), (3, "vendor", "Tamblehurst Garden Goods"), (4, "vendor", "Ostrebury Glass"),
    (5, "stock_status", "in_stock"), (6, "stock_status", "out_of_stock"), (7, "stock_status", "preorder"), (8, "published", "true"), (9, "published", "false"),
]
VOCAB = "entry_id long, field string, canonical string, note string"
ROWS = "row_id long, vendor string, stock_status string, published string, field string, value string, entry_id long"
LOG = "field string, outcome string, before_text string, after_text string, rule string"
TOLD = [
    ("stock_status", "auf Lager", "in_stock"), ("stock_status", "Sold out", "out_of_stock"), ("stock_status", "O.O.S.", "out_of_stock"), ("stock_status", "not available", "out_of_stock"),
    ("stock_status", "pre order only", "preorder"), ("stock_status", "available to pre-order", "preorder"), ("published", "x (yes)", "true"), ("published", "not live", "false"),
    ("vendor", "T.G.G.", "Tamblehurst Garden Goods"),
]


def corrections(spark):
    rows = [(f, "changed", b, a, "r") for f, b, a in TOLD for _ in range(3)]
    rows += [
        ("stock_status", "changed", "maybe", "in_stock", "r"), ("stock_status", "changed", "maybe", "preorder", "r"),  # they do not agree
        ("stock_status", "changed", "ask", "asked", "r"), ("stock_status", "unresolved", "soon", "preorder", "r"), (None, "changed", "q", "true", None),
        ("published", "changed", " ", "true", "r"), ("published", None, "w", "true", "r"), ("published", "changed", None, "true", "r"), ("published", "changed", "true", "true", "r"),
    ]
    return spark.createDataFrame(rows, LOG)


def vocabulary(spark):
    return spark.createDataFrame([(*e, "x") for e in ENTRIES] + [(10, "vendor", None, None), (11, "vendor", " ", None), (12, None, "y", None)], VOCAB)


def found(spark, cells, entries=None, learn=True):
    """(field, value) -> entry of each cell."""
    fields = ("vendor", "stock_status", "published")
    rows = [(i, *[v if f == field else None for field in fields], "clash", "clash", 0) for i, (f, v) in enumerate(cells)]
    vocab = entries or vocabulary(spark)
    words = vm.learned_wordings(corrections(spark), vocab) if learn else None
    out = vm.matched(spark.createDataFrame(rows, ROWS), vocab, fields, wordings=words).collect()
    return {(r["field"], r["value"]): r["entry_id"] for r in out}


def test_wordings_are_learned_from_agreeing_corrections(spark):
    got = sorted((r["field"], r["wording"], r["canonical"]) for r in vm.learned_wordings(corrections(spark), vocabulary(spark)).collect())
    assert got == sorted(TOLD)
    assert vm.learned_wordings(corrections(spark).limit(0), vocabulary(spark)).count() == 0


def test_names(spark):
    want = {
        "QUORVALE ROPEWORKS": 1, "Quorvale Ropewroks": 1, "Ropeworks, Quorvale": 1, "Ropeworks by Quorvale": 1, "The Quorvale Oil and Wax Company": 2,
        "Quorvale Oil &amp; Wax, Ltd": 2, "quorvale oil + wax (NL)": 2, "Tamble Hurst GrdnGds.": 3, "tmblehrst GARDEN GOODS": 3, "Tamblehurst B.V.": 3,
        "Quorvale": -1, "Quorvale Glass": -1, "Ostrebury": 4, "ÖSTREBÜRY GLASS - import": 4, "Ostrebury_Glass​": 4, "own label": -1, "Brandywell Glass": -1,
        "???": -1, "and": -1, "x" * 100_000: -1, "Ostrebury Leather": -1, "vsotrebury GLASS": 4, "tgg": 3, "Ostrebury - Leather": -1, "Ostreburry": 4, "word " * 20_000: -1,
    }
    got = found(spark, [("vendor", v) for v in want])
    assert {v: got["vendor", v] for v in want} == want


def test_phrases(spark):
    want = {
        ("stock_status", "In Stcok"): 5, ("stock_status", "SoldOut"): 6, ("stock_status", "available to pre-order"): 7, ("stock_status", "OOS"): 6,
        ("stock_status", "auf Lager bei uns"): 5, ("stock_status", "ask"): -1, ("stock_status", "not available"): 6, ("stock_status", "now pre order only please"): 7,
        ("stock_status", "auf Lger"): 5, ("stock_status", "not auf lager"): -1, ("stock_status", "maybe"): -1, ("stock_status", "auf lager " * 20_000): 5,
        ("published", "x yes"): 8, ("published", "flase"): 9, ("published", "not live"): 9, ("published", "2"): -1, ("published", "-"): -1, ("published", "TRUE"): 8,
    }
    assert found(spark, list(want)) == want
    # without evidence only the canonical values and their misspellings are known
    bare = found(spark, list(want), learn=False)
    assert bare["stock_status", "In Stcok"] == 5 and bare["stock_status", "SoldOut"] == -1 and bare["published", "flase"] == 9


def test_edits():
    assert vm.edits("brentury", "breunry", 2) == 2 and vm.edits("abc", "acb", 2) == 1 and vm.edits("", "ab", 2) == 2 and vm.edits("abc", "xyz", 2) == 3
    assert vm.weighted_edits("ab", "ba") < vm.weighted_edits("ab", "xb") and vm.weighted_edits("aab", "ab") < 1


def test_a_long_list_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    names = sorted({word(rng.randrange(4, 11)) for _ in range(2000)})
    vocab = spark.createDataFrame([(i, "stock_status", w, "") for i, w in enumerate(names)], VOCAB)
    asked = sorted({word(rng.randrange(3, 12)) for _ in range(400)} - set(names))
    want = {}
    for s in asked:
        near = [(vm.weighted_edits(s, f), i) for i, f in enumerate(names) if vm.edits(s, f, m := vm.allowed_edits(len(f), vm.PHRASE_EDITS)) <= m]
        inner = -1
        want["stock_status", s] = min(near)[1] if near else inner
    assert found(spark, [("stock_status", s) for s in asked], vocab, learn=False) == want
    # a list too large to broadcast meets the values in a joined way, with the same outcome
    monkeypatch.setattr(vm, "BROADCAST_BYTES", 0)
    assert found(spark, [("stock_status", s) for s in asked], vocab, learn=False) == want


def test_rows(spark):
    vocab = vocabulary(spark)
    rows = [
        (1, "Quorvale Ropeworks", "in_stock", "TRUE", "f", "v", 0), (2, None, " ", "", "f", "v", 0), (3, "quorvale ropeworks", None, "n/a", "f", "v", 0),
        (3, "quorvale ropeworks", None, "n/a", "f", "v", 0), (None, "ropeworks quorvale", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = sorted((r["row_id"] or 0, r["field"], r["entry_id"]) for r in vm.matched(df, vocab, ("vendor", "stock_status", "published")).collect())
    assert got == [(0, "vendor", -1), (1, "published", 8), (3, "published", -1), (3, "published", -1), (3, "vendor", 1), (3, "vendor", 1)]
    assert vm.matched(df.limit(0), vocab, ("vendor",)).count() == 0
    assert {r["entry_id"] for r in vm.matched(df, vocab.limit(0), ("vendor",)).collect()} == {-1}
