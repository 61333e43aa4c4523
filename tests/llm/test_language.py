import random

import pytest

from tidemill.llm import language as lg

TEXTS = {
    "en": ["The kettle is made of steel and weighs about 40 grams.", "Please measure the shelf before you order this lamp.", "You can return the brush unused within 30 days.", "Wipe the tray with a damp cloth and keep it dry."],
    "de": ["Der Kessel besteht aus Stahl und wiegt ungefähr 40 Gramm.", "Bitte messen Sie das Regal, bevor Sie diese Lampe bestellen.", "Sie können die Bürste unbenutzt binnen 30 Tagen zurückgeben.", "Wischen Sie das Tablett mit einem feuchten Tuch ab."],
    "sv": ["Vattenkokaren är gjord av stål och väger ungefär 40 gram.", "Mät hyllan innan du beställer den här lampan.", "Du kan lämna tillbaka borsten oanvänd i 30 dagar.", "Torka av brickan med en fuktig trasa och håll den torr."],
    "da": ["Kedlen er lavet af stål og vejer omkring 40 gram.", "Mål hylden op, før du bestiller denne lampe.", "Du kan levere børsten ubrugt tilbage i 30 dage.", "Tør bakken af med en fugtig klud og hold den tør."],
    "es": ["La tetera está hecha de acero y pesa unos 40 gramos.", "Mida bien la estantería antes de pedir esta lámpara.", "Puede devolver el cepillo sin usar durante 30 días.", "Limpie la bandeja con un paño húmedo y manténgala seca."],
    "pt": ["A chaleira é feita de aço e pesa cerca de 40 gramas.", "Meça bem a prateleira antes de encomendar este candeeiro.", "Pode devolver a escova sem uso durante 30 dias.", "Limpe o tabuleiro com um pano húmido e mantenha-o seco."],
    "ru": ["Этот чайник сделан из стали и весит около 40 граммов.", "Перед заказом лампы измерьте, пожалуйста, полку.", "Неиспользованную щётку можно вернуть в течение 30 дней.", "Протирайте поднос влажной тряпкой и держите сухим."],
    "ja": ["このやかんは鋼でできていて、重さは約40グラムです。", "ご注文の前に棚の寸法を測ってください。", "未使用のブラシは30日以内に返品できます。", "トレイは湿った布で拭いてください。"],
}
DOCS = "doc_id long, text string, lang string, code string, segment int, n_sentences int"


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    samples = {c: [rng.choice(t).replace("40", str(rng.randrange(99))) for _ in range(80)] for c, t in TEXTS.items()}
    for c in samples:  # a fifth under a wrong label
        other = rng.choice([x for x in samples if x != c])
        samples[c] += [rng.choice(TEXTS[other]) for _ in range(20)]
    return lg.fit(samples)


def test_held_out_accuracy(model):
    pairs = [(c, s.replace("30", "7").replace("40", "8")) for c, t in TEXTS.items() for s in t]
    pairs += [(c, lg.without_accents(s)) for c, s in pairs if c not in ("ru", "ja")] + [(c, s.upper()) for c, s in pairs]
    got, sure = model.predict([lg.plain(s) for _, s in pairs])
    assert [g for g in got] == [c for c, _ in pairs] and (sure > 0.5).all()
    assert model.predict([]) [0] == []


def test_sentences():
    text = "Wide Mouth Clamp (RU591-1652)\n\nSlate Apron (GI758-1301) Wipe the tray with a damp cloth. <p>Is it made of steel &amp; oak?</p> https://a.b/c.d EAN 123. このやかんは鋼でできています。\nPY1-2 | 3 | 4.50"
    assert [s for _, s in lg.sentences(text)] == ["Wipe the tray with a damp cloth.", "Is it made of steel & oak?", "このやかんは鋼でできています。"]
    assert [len(lg.sentences(t)) for t in ("one two three.", "one two three four.", "a 1-2 b c3d.", "a b c d.", "x" * 50_000 + " y z.", "abcd.", "a_b_c_d.")] == [0, 1, 1, 1, 0, 0, 1]
    assert lg.sentences(None) == lg.sentences("") == lg.sentences("USB-C Cable 5") == []


def test_labels(spark):
    labels = ["en", " EN ", "en-GB", "en_GB", "ENG", "English", "german", "xx", "", None, "unknown", "ger", "??", "jpn"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(lg.label_code(df["x"])).collect()]
    assert got == ["en", "en", "en", "en", "en", "en", "de", None, None, None, None, "de", None, "ja"]


def test_documents(spark, model):
    t = TEXTS
    docs = [
        (1, f"{t['en'][0]} {t['en'][1]}", "en", "zz", 0, 0), (2, f"{t['en'][0]} {t['de'][1]} {t['de'][2]}", "en", None, 0, 0), (3, t["pt"][0], "Spanish", None, 0, 0),
        (4, t["da"][0], None, None, 0, 0), (5, "Clamp (RU1-1)", None, None, 0, 0), (6, None, "en", None, 0, 0), (7, "", "en", None, 0, 0), (8, (t["sv"][0] + " ") * 3000, "sv-SE", None, 0, 0),
        (1, f"{t['en'][0]} {t['en'][1]}", "en", "zz", 0, 0),
    ]
    parts = lg.segments(spark.createDataFrame(docs, DOCS), model=model)
    rows = parts.collect()
    assert [(r["segment"], r["lang"], r["n_sentences"]) for r in rows if r["doc_id"] == 2] == [(0, "en", 1), (1, "de", 2)]
    assert next(r for r in rows if r["doc_id"] == 8)["n_sentences"] == 3000
    assert {r["doc_id"] for r in rows if r["lang"] is None} == {5, 6, 7}
    assert all(0 < r["confidence"] <= 1 for r in rows if r["lang"])
    by = lg.languages(spark.createDataFrame(docs, DOCS), model=model)
    found = sorted((r["doc_id"], r["lang"]) for r in lg.mislabelled(by).collect())
    assert found == [(2, "de"), (2, "en"), (3, "pt"), (4, "da")]
    assert sorted((r["doc_id"], r["n_sentences"], r["n_langs"]) for r in by.collect()) == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 2, 2), (3, 1, 1), (4, 1, 1), (8, 3000, 1)]
    assert lg.segments(spark.createDataFrame([], DOCS), model=model).count() == 0


def test_fitting_from_a_table(spark):
    docs = [(i, " ".join(t), c, None, 0, 0) for i, (c, t) in enumerate(list(TEXTS.items()) * 12)]
    df = spark.createDataFrame(docs, DOCS)
    got = {r["doc_id"]: r["lang"] for r in lg.languages(df).collect()}
    assert got == {d[0]: d[2] for d in docs}
    assert lg.segments(df.limit(0)).count() == 0


def test_copies_do_not_thin_the_sample(spark):
    text = lambda i: TEXTS["da"][0].replace("40", str(1000 + i))
    docs = [(i, text(i), "da", None, 0, 0) for i in range(300)] + [(300 + i, text(300), "da", None, 0, 0) for i in range(3000)]
    found = lg.sample(spark.createDataFrame(docs, DOCS), "text", "lang", per_label=100)["da"]
    assert len(found) == len(set(found)) and 70 <= len(found) <= 130
