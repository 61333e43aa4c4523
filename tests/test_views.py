import pytest
from pyspark.sql import functions as F

from tidemill.operators import view
from tidemill.sinks.tables import terminal_table


def test_views(spark):
    df = spark.createDataFrame([(i, f"n{i % 3}", None if i == 4 else float(i)) for i in range(20)], "i int, name string, x double")
    assert [r[0] for r in view.view(df, ["i"], "i", 3).collect()] == [0, 1, 2]
    assert view.rows_where(df, "name", "n1").count() == 7 and view.rows_where(df, "x", lambda c: c > 17).count() == 2
    assert [r["i"] for r in view.head_and(df, "i", 2, F.col("i") > 16, 4).collect()] == [0, 1, 17, 18]
    assert [r["tint"] for r in view.tinted(df, {"a": F.col("i") > 17, "b": F.col("i") > 16}).orderBy("i").collect()][-3:] == ["b", "a", "a"]
    with pytest.raises(ValueError):
        view.view(df, ["nope"], "i")
    wide = spark.createDataFrame([("5", "a b c d e f g", "1"), ("1,200.5", "short", "x"), ("", "", "2")], "n string, words string, m string")
    assert terminal_table(wide, ["n", "words", "m"], width=7, wrap="words").splitlines() == [
        "      n  words    m", "-------  -------  -", "      5  a b c d  1", "         e f g", "1,200.5  short    x", "                  2",
    ]
    text = terminal_table(df.orderBy("i"), ["i", "name"], limit=2)
    assert text.splitlines()[-1] == "... and 18 more" and len(text.splitlines()) == 5


def test_collapse_repeats(spark):
    cells = ["a", "a", None, None, "b", "a a", "a  a", "a"] * 40
    df = spark.createDataFrame(list(enumerate(cells)), "i long, c string").repartition(5)
    want = [i for i, c in enumerate(cells) if i == 0 or c != cells[i - 1]]
    assert [r["i"] for r in view.collapse_repeats(df, "i", ["c"], partitions=7).orderBy("i").collect()] == want
    assert view.collapse_repeats(df, "i", ["c"], width=10).count() < len(want)
    assert view.collapse_repeats(df.limit(0), "i", ["c"]).count() == 0


def test_mean_abs_difference(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([], []), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(view.mean_abs_difference(F.col("a"), F.col("b"))).collect()] == [1.5, None, None, None]
