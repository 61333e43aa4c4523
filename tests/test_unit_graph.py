from fractions import Fraction

import pytest

from tidemill.operators import unit_graph as ug

FEED = "row_id long, weight string, weight_unit string, dimensions string, description string, kind string, unit string"


def found(spark, rows):
    df = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], FEED)  # clashing extra columns
    return {(r["row_id"], r["measure"]): r["tenths"] for r in ug.converted(df).collect() if not r["was_common"]}


def test_graph_compositions_and_cycles():
    g = ug.UnitGraph()
    g.add("c", "f", "1.8", 32)
    g.add("k", "c", 1, "-273.15")
    ways = g.compositions("f")
    assert ways["k"].factor == Fraction(9, 5) and ways["k"].offset == Fraction("-459.67")
    g.add("k", "f", "1.8", "-459.67")
    assert g.compositions("f")["k"] == ways["k"]
    g.add("k", "r", 2)
    g.add("r", "f", 5)
    with pytest.raises(ug.InconsistentUnits):
        g.compositions("f")
    with pytest.raises(ug.InconsistentUnits):
        g.add("c", "f", 2)
    for graph, target, _ in ug.standard_graph().values():
        graph.compositions(target)


def test_weights(spark):
    rows = [
        ("1.5 kg", None, None, None), ("2", "LB.", "", None), ("1 lb 8 oz", None, None, None), ("1 1/2 pounds", "kg", None, None), ("½ lb", None, None, None),
        ("1.248gr", "kg", None, None), ("0", "kg", None, None), ("n/a", "kg", None, None), ("2-3 kg", None, None, None), ("3 x 400 g", None, None, None),
        ("5", "each", None, "Poids indiqué en lbs."), ("5", " ", None, "<p>x</p> Weight column given in pounds."), ("5", None, None, "Holds up to 5 kg of flour."),
        ("5", None, None, "(wt. in oz)"), (None, None, None, None), ("", "kg", None, None), ("1 000", "kg", None, None), ("7 #", None, None, None), ("9", None, None, "Gewichtsangabe in kilos."),
    ]
    got = found(spark, rows)
    want = {0: 15000, 1: 9072, 2: 6804, 3: 6804, 4: 2268, 11: 22680, 13: 1417, 16: 10000000, 17: 31751, 18: 90000}
    assert got == {(k, "weight_g"): v for k, v in want.items()}


def test_dimensions(spark):
    dims = [
        "12 x 8 x 4 in", "300 x 200 x 100 mm", "cm: 1 x 2 x 3", "L1,5 x W2 x H3 cm", "10mm x 2cm x 3 cm", "1 x 2 x 3", "20 x 30 cm", "1m x 2 x 3",
        "1cm x 2 x 3in", "9 ½in x 1in x 1 1/2in", "1 by 2 by 3 ft.", "n/a", None, "1' x 2' x 3'", "0,1x0.2×0.3 M",
    ]
    got = found(spark, [(None, None, d, None) for d in dims])
    by = {}
    for (i, m), v in got.items():
        by.setdefault(i, {})[m] = v
    shape = lambda *v: dict(zip(ug.MEASURES, v))
    assert by == {
        0: shape(3048, 2032, 1016), 2: shape(100, 200, 300), 3: shape(150, 200, 300), 4: shape(100, 200, 300), 7: shape(10000, 20000, 30000),
        9: shape(2413, 254, 381), 10: shape(3048, 6096, 9144), 13: shape(3048, 6096, 9144), 14: shape(1000, 2000, 3000),
    }


def test_report_empty_and_long(spark):
    rows = [(1, "heavy", None, "see carton", None, "", ""), (1, "heavy", None, "see carton", None, "", ""), (None, "5", None, None, "x" * 300_000, "", ""), (2, "9" * 50_000, "kg", "1 x " * 20_000, None, "", "")]
    got = ug.unusable(spark.createDataFrame(rows, FEED)).collect()
    assert sorted((r["row_id"] or 0, r["field"], r["problem"]) for r in got) == [
        (0, "weight", "no unit"), (1, "dimensions", "not three measured edges"), (1, "dimensions", "not three measured edges"), (1, "weight", "no usable number"), (1, "weight", "no usable number"),
        (2, "dimensions", "not three measured edges"), (2, "weight", "no usable number"),
    ]
    empty = spark.createDataFrame([], FEED)
    assert ug.converted(empty).count() == 0 and ug.unusable(empty).count() == 0


def test_phrases_of_any_length_and_with_markup(spark):
    filler = "as printed on the carton by the maker and checked again by us on arrival "
    texts = [
        f"All weights {filler * 3}are in lbs.", "Weight <b>column</b> given in <span class=\"u\">pounds</span>.", f"<p>Poids <i>{filler}</i>en oz</p>",
        "<p>Weight</p><p>Sold in kg bags</p>", f"The weight is {filler * 3}. Sold in kg bags.", f"Our weight {filler}wt. in oz", "weight " * 50_000 + ". wt in kg", "weight " * 50_000,
    ]
    got = found(spark, [("5", None, None, t) for t in texts])
    assert {k: v for (k, _), v in got.items()} == {0: 22680, 1: 22680, 2: 1417, 5: 1417, 6: 50000}


def test_spellings_of_one_unit_are_one(spark):
    dims = ["10 cm x 8 centimeter x 3", "centimetre: 1 x 2 CM x 3", '1 in x 2" x 3', "1 ft x 2 in x 3", "1 x 2 mm x 3 millimetre", "1cm x 2 centimeter x 3in"]
    df = spark.createDataFrame([(i, None, None, d, None, "x", "y") for i, d in enumerate(dims)], FEED)
    got = {}
    for r in sorted(ug.converted(df).collect(), key=lambda r: ug.MEASURES.index(r["measure"])):
        got.setdefault(r["row_id"], []).append(r["tenths"])
    assert got == {0: [1000, 800, 300], 1: [100, 200, 300], 2: [254, 508, 762], 4: [10, 20, 30], 5: [100, 200, 762]}
    assert [(r["row_id"], r["problem"]) for r in ug.unusable(df).collect()] == [(3, "no unit")]
