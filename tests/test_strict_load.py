import csv
import random

from tidemill.operators import strict_load as sl

RECORD = "record_id long, feed_id long, line long, raw_text string, width int, positions string"


def by_hand(s):
    """The cells of a record, None if its quoting is broken."""
    out, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            j = i + 1
            while True:
                k = s.find('"', j)
                if k < 0:
                    return None
                if s[k + 1 : k + 2] != '"':
                    break
                j = k + 2
            out.append(s[i + 1 : k].replace('""', '"'))
            i = k + 1
            if i < len(s) and s[i] != ",":
                return None
        else:
            k = s.find(",", i)
            k = len(s) if k < 0 else k
            if '"' in s[i:k]:
                return None
            out.append(s[i:k])
            i = k
        if i >= len(s):
            return out
        i += 1


def test_csv_record_against_a_scanner(values):
    rng = random.Random(5)
    cells = ["", '""', '"', ",", '"a""b",c', '"a\nb",', 'a"b"c', '"a"b', ' "a"', None, '"' + 'x""' * 60_000 + '"', "a," * 50_000]
    cells += ["a\x01b,\x02", '"\x01,\x02a",\x01b\x02b', '"\x02""\x01",x', "\x01", "\x02"]
    cells += ["".join(rng.choice('",a\x01\x02') for _ in range(rng.randrange(12))) for _ in range(1000)]
    cells += ["".join(rng.choice('",a \n') for _ in range(rng.randrange(12))) for _ in range(3000)]
    got = values(sl.csv_record, cells)
    for c, g in zip(cells, got):
        if c is None:
            assert g is None
        else:
            want = by_hand(c)
            assert (g["cells"] if g["sound"] else None) == want, c
    assert next(csv.reader(['"a""b",c'])) == values(sl.csv_record, ['"a""b",c'])[0]["cells"]


def test_load_and_reject(spark):
    files = spark.createDataFrame([(1, "SKU,Price,EAN,extra"), (2, None), (3, '"a,b",Old Price')], "feed_id long, header string")
    aliases = spark.createDataFrame([("price", "Price"), ("barcode", "EAN"), ("barcode", "ean"), ("sku", "SKU")], "field string, header string")
    raw = [
        "a,1.50,40170725,x", 'a,"1,50",,"x, y"', "a,n/a,40170725,", "a,TBC,123,", "a,-2,0,", "a,1", 'a,"1.50,40170725,x', "a,$5 was $6,-,", None, "a,0,40170725,x",
    ]
    rows = [(i, 1, i, t, 9, "z") for i, t in enumerate(raw)] + [(20, 2, 1, "a", 9, "z"), (21, 9, 1, "a", 9, "z"), (22, 3, 1, "q,r", 9, "z"), (None, 1, 1, "a,1,,", 9, "z"), (0, 1, 0, raw[0], 9, "z")]
    records = spark.createDataFrame(rows, RECORD)
    loaded = sl.load(records, files, aliases).collect()
    assert sorted((r["record_id"] is None, r["record_id"]) for r in loaded if r["record_id"] is not None) == [(False, 0), (False, 0), (False, 1), (False, 22)]
    assert [r["cells"] for r in loaded if r["record_id"] == 1] == [["a", "1,50", "", "x, y"]]
    got = sorted((r["record_id"], r["rule"]) for r in sl.reject(records, files, aliases).collect())
    assert got == [
        (2, "missing_price"), (3, "barcode_invalid"), (3, "price.format"), (4, "price_not_positive"), (5, "column_count"), (6, "broken_quoting"), (7, "price.format"),
        (8, "column_count"), (9, "price_not_positive"), (20, "no_header"), (21, "no_header"),
    ]
    empty = spark.createDataFrame([], RECORD)
    assert sl.reject(empty, files, aliases).count() == 0 and sl.load(records, files.limit(0), aliases).count() == 0
