"""Missing or wrong language labels, by hierarchical discrimination (problem 9).

A sentence's family is found first (one-versus-rest linear SVMs), then one-versus-one linear SVMs
tell the languages of the family apart. The machines are fitted on the driver, on a bounded sample
of labelled documents; wrong labels in it are found and left out first. Their weights,
a fixed-size matrix over hashed character n-grams, are broadcast, and every sentence of every
document is scored in Arrow batches without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by family, and the codes and English names a label may use.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da"), "romance": ("fr", "es", "pt", "it"), "slavic": ("pl", "ru"), "japonic": ("ja",)}
LABELS = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"), "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch"), "sv": ("swe", "swedish"),
    "da": ("dan", "danish"), "pl": ("pol", "polish"), "ru": ("rus", "russian"), "ja": ("jpn", "japanese"),
}
# Languages that are not written in Latin letters.
SCRIPTS = {"ru": "cyrillic", "ja": "cjk"}
LANGUAGES = tuple(c for f in FAMILIES.values() for c in f)

#: Documents sampled for fitting, per label, in expectation; and sentences kept of them per label.
SAMPLE_DOCUMENTS = 400
SAMPLE_SENTENCES = 600
#: Sentences of a label that the family machines are fitted on.
FAMILY_SENTENCES = 250
#: Texts longer than this are not sampled for fitting (all are classified).
SAMPLE_CHARS = 20_000
#: Size of the hashed feature space.
FEATURES = 1 << 12
ORDERS = (1, 2, 3, 4)
#: Characters scored at a time; bounds a worker's memory.
CHUNK_CHARS = 5_000


def label_code(label: Column) -> Column:
    """The two-letter code a label names, its region, case and spaces ignored; null if it names none."""
    key = F.lower(F.regexp_replace(F.regexp_replace(label, r"[-_].*$", ""), r"[\s\x{a0}\x{200b}]+", ""))
    names = F.create_map(*[F.lit(x) for code, more in LABELS.items() for name in (code, *more) for x in (name, code)])
    return F.try_element_at(names, key)


# ------------------------------------------------------------------- sentences
_NOISE = re.compile(r"<[^>]*>|(?:https?:)?//\S+|www\.\S+|\S+@\S+\.\S+")
# a name and its code in brackets, as headings and lead-ins of product texts have it
_CODED = re.compile(r"(?:(?<=[.!?。！？\n])|^)[^.!?。！？\n]*?\((?=[^()]*\d)[A-Za-z]{1,4}\d[\w-]*\)[\s:,-]*", re.M)
_CODE = re.compile(r"#?\b(?=\w*\d)(?=\w*[A-Za-z])[\w]+-[\w-]*\d[\w-]*\b")
_END = re.compile(r"[.!?](?=[\s\"'”»)]|$)|[。！？]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
_WORD = re.compile(r"[^\W\d_]+")
_FOUR_WORDS = re.compile(r"(?:[\W\d_]*[^\W\d_]+(?=[\W\d_]|$)){4}")


def sentences(text: str | None) -> list[tuple[int, str]]:
    """(place, sentence) of the full sentences of a text: ended by a mark, four words or six CJK characters."""
    if not text:
        return []
    clean = html.unescape(_NOISE.sub("\n", text)) if "<" in text or "&" in text or "//" in text or "@" in text or "www." in text else text
    # the patterns need these marks, and most texts have none
    if "(" in clean:
        clean = _CODED.sub("\n", clean)
    if "-" in clean:
        clean = _CODE.sub(" ", clean)
    out: list[tuple[int, str]] = []
    for line in clean.split("\n"):
        start = 0
        for end in _END.finditer(line):
            s = line[start : end.end()].strip(" \t\r\n-*•\"'“”«»|")
            start = end.end()
            if s and s[-1] in ".!?。！？" and (_FOUR_WORDS.match(s) or len(_CJK.findall(s)) >= 6):
                out.append((len(out), s))
    return out


def plain(s: str) -> str:
    """Lower case, digits as 0, other marks as spaces."""
    return re.sub(r"[\W_]+", " ", re.sub(r"\d+", "0", s.lower())).strip()


def without_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).replace("ł", "l").replace("ø", "o").replace("ß", "ss")


# --------------------------------------------------------------------- features
def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, text of each) of all texts at once."""
    joined = "".join(f" {t} \0" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = codes == 0
    owner = np.cumsum(ends) - ends
    feats, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, 1469598103934665603 + n, dtype=np.uint64)
        inside = np.ones(len(h), dtype=bool)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(1099511628211)
            inside &= ~ends[k : len(codes) - n + 1 + k]
        h ^= h >> np.uint64(29)
        feats.append((h[inside] % np.uint64(FEATURES)).astype(np.int32))
        owners.append(owner[: len(h)][inside])
    return np.concatenate(feats) if feats else np.zeros(0, np.int32), np.concatenate(owners) if owners else np.zeros(0, np.int64)


SCALE = 20.0


def matrix(texts: list[str]) -> np.ndarray:
    """Dense relative n-gram frequencies; for samples only."""
    f, o = ngrams(texts)
    x = np.bincount(o * FEATURES + f, minlength=len(texts) * FEATURES).astype(np.float32).reshape(len(texts), FEATURES)
    return x * (SCALE / np.maximum(1.0, x.sum(axis=1, keepdims=True)))


@dataclass
class Model:
    """Columns of `weights` are machines: first one per family, then one per pair of a family's languages."""

    weights: np.ndarray
    bias: np.ndarray
    families: list[str]
    pairs: list[tuple[str, str]] = field(default_factory=list)
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text; the confidence is the chance implied by the closest decision.

        Equal texts are scored once, and CHUNK_CHARS characters at a time whatever the batch.
        """
        if not texts:
            return [], np.zeros(0)
        number: dict[str, int] = {}
        at = np.array([number.setdefault(t, len(number)) for t in texts])
        langs, sure, start, size = [], [], 0, 0
        different = list(number)
        for i, t in enumerate(different):
            size += len(t)
            if size >= CHUNK_CHARS or i == len(different) - 1:
                found, chance = self._predict(different[start : i + 1])
                langs += found
                sure.append(chance)
                start, size = i + 1, 0
        return [langs[i] for i in at], np.concatenate(sure)[at]

    def _predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        feats, owner = ngrams(texts)
        count = np.bincount(owner, minlength=len(texts))
        order = np.argsort(owner, kind="stable")
        feats, ends = feats[order], np.cumsum(count)
        scale = (SCALE / np.maximum(1, count))[:, None]

        def decide(rows: np.ndarray, machines: slice) -> np.ndarray:
            """Decision values of some machines for some of the texts, from the n-grams hashed once."""
            n = count[rows]
            first = np.cumsum(n) - n
            which = np.repeat(ends[rows] - n - first, n) + np.arange(n.sum())
            sums = np.zeros((len(rows), machines.stop - machines.start), dtype=np.float32)
            some = np.flatnonzero(n)
            if len(some):
                sums[some] = np.add.reduceat(self.weights[feats[which], machines], first[some], axis=0)
            return sums * scale[rows] + self.bias[machines]

        # the families first, then only the pairs of the family that won
        every, k = np.arange(len(texts)), len(self.families)
        s = decide(every, slice(0, k))
        fam = s.argmax(axis=1)
        ranked = np.sort(s, axis=1)
        margin = ranked[:, -1] - ranked[:, -2] if k > 1 else np.full(len(texts), 4.0)
        langs, sure, at = np.empty(len(texts), dtype=object), np.empty(len(texts)), k
        for i, name in enumerate(self.families):
            codes, rows = self.known[name], np.flatnonzero(fam == i)
            machines = slice(at, at + len(codes) * (len(codes) - 1) // 2)
            at = machines.stop
            if not len(rows):
                continue
            d = decide(rows, machines)
            votes, least = np.zeros((len(rows), len(codes))), np.full((len(rows), len(codes)), np.inf)
            for j, (a, b) in enumerate(self.pairs[machines.start - k : machines.stop - k]):
                a, b = codes.index(a), codes.index(b)
                votes[:, a] += d[:, j] >= 0
                votes[:, b] += d[:, j] < 0
                least[:, a] = np.minimum(least[:, a], d[:, j])
                least[:, b] = np.minimum(least[:, b], -d[:, j])
            best = (votes + 1e-3 * np.tanh(np.where(np.isfinite(least), least, 0))).argmax(axis=1)
            langs[rows] = np.array(codes, dtype=object)[best]
            sure[rows] = np.minimum(margin[rows], 2 * least[np.arange(len(rows)), best])
        return list(langs), 1.0 / (1.0 + np.exp(-2.0 * np.clip(sure, -10, 10)))


def fit_svm(gram: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Linear SVM with squared hinge loss, by accelerated gradient descent; y is +1 or -1.

    The gram matrix of the rows (plus one, for the bias) stands in for the rows themselves: the
    result holds their coefficients. Both classes weigh the same.
    """
    n = len(y)
    cost = np.where(y > 0, n / (2.0 * max(1, (y > 0).sum())), n / (2.0 * max(1, (y < 0).sum()))).astype(np.float32)
    # largest eigenvalue of the curvature, by power iteration
    v, top = np.ones(n, dtype=np.float32), 1.0
    for _ in range(12):
        v = gram @ (cost * v)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    lam = 1.0 / (c * n)
    step = np.float32(1.0 / (lam + 2.0 * top / n))
    w = z = np.zeros(n, dtype=np.float32)
    t = 1.0
    for _ in range(rounds):
        gap = np.maximum(np.float32(0), 1 - y * (gram @ z))
        nxt = z - step * (np.float32(lam) * z - np.float32(2.0 / n) * cost * gap * y)
        t2 = (1.0 + math.sqrt(1.0 + 4.0 * t * t)) / 2.0
        z = nxt + np.float32((t - 1.0) / t2) * (nxt - w)
        w, t = nxt, t2
    return w


def script_of(s: str) -> str:
    """cjk, cyrillic or latin: where most letters of a text belong."""
    cjk, cyrillic = len(_CJK.findall(s)), len(_CYRILLIC.findall(s))
    letters = sum(len(w) for w in _WORD.findall(s))
    return "cjk" if 2 * cjk > letters else "cyrillic" if 2 * cyrillic > letters else "latin"


def fit(samples: dict[str, list[str]], seed: int = 7) -> Model:
    """Fit on label -> sentences, some of them under a wrong label.

    Sentences in a script their label's language does not use are left out at once, then those
    that a naive Bayes pass over the n-grams gives to another label. In that pass a language's own
    label always has the largest share of its sentences, so every n-gram speaks for it.
    """
    right = {c: [t for t in v if script_of(t) == SCRIPTS.get(c, "latin")] for c, v in samples.items()}
    right = {c: v for c, v in right.items() if v}
    if not right:
        raise ValueError("no labelled sentences to fit languages on")
    codes = list(right)
    hashed = {c: ngrams([plain(t) for t in v]) for c, v in right.items()}
    counts = np.stack([np.bincount(f, minlength=FEATURES) for f, _ in hashed.values()]).astype(np.float64) + 0.5
    chance = np.log(counts / counts.sum(axis=1, keepdims=True))
    kept = {}
    for c, (f, o) in hashed.items():
        totals = np.stack([np.bincount(o, weights=chance[k][f], minlength=len(right[c])) for k in range(len(codes))])
        own = totals.argmax(axis=0) == codes.index(c)
        kept[c] = [t for t, ok in zip(right[c], own) if ok] or right[c]
    return _fit(kept, seed)


def _fit(samples: dict[str, list[str]], seed: int) -> Model:
    rng = np.random.default_rng(seed)
    rows = {label: matrix([plain(t) for t in texts] + [plain(without_accents(t)) for t in texts[::2]]) for label, texts in samples.items()}
    known = {f: tuple(c for c in codes if c in rows) for f, codes in FAMILIES.items()}
    known = {f: codes for f, codes in known.items() if codes}
    some = {c: x[rng.permutation(len(x))[:FAMILY_SENTENCES]] for c, x in rows.items()}
    allx = np.vstack([some[c] for f in known for c in known[f]])
    of = np.concatenate([np.full(len(some[c]), i) for i, f in enumerate(known) for c in known[f]])
    weights, bias, pairs = [], [], []

    def machine(x: np.ndarray, gram: np.ndarray, positive: np.ndarray) -> None:
        beta = fit_svm(gram, np.where(positive, 1, -1).astype(np.float32))
        weights.append(x.T @ beta)
        bias.append(float(beta.sum()))

    gram = allx @ allx.T + 1
    for i in range(len(known)):
        machine(allx, gram, of == i)
    for codes in known.values():
        x = np.vstack([rows[c] for c in codes])
        of = np.concatenate([np.full(len(rows[c]), i) for i, c in enumerate(codes)])
        gram = x @ x.T + 1 if len(codes) > 1 else None
        for a in range(len(codes)):
            for b in range(a + 1, len(codes)):
                at = np.flatnonzero((of == a) | (of == b))
                machine(x[at], gram[np.ix_(at, at)], of[at] == a)
                pairs.append((codes[a], codes[b]))
    return Model(np.array(weights, dtype=np.float32).T.copy(), np.array(bias, dtype=np.float32), list(known), pairs, known)


def sample(documents: DataFrame, text: str, lang: str, per_label: int = SAMPLE_DOCUMENTS) -> dict[str, list[str]]:
    """label -> sentences of a bounded sample of labelled documents.

    Documents are drawn by a hash of their text, at a rate that yields `per_label` different texts of
    each label in expectation, however many copies there are; of their sentences at most SAMPLE_SENTENCES a label are kept, drawn by hash too.
    """
    coded = documents.select(F.col(text).alias("text"), label_code(F.col(lang)).alias("code")).where(F.col("code").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    # copies share a draw, so rates come from the different texts; their hashes count them
    texts = coded.select("code", F.xxhash64("text").alias("__hash")).distinct()
    sizes = {r["code"]: r["n"] for r in texts.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    rates = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))])
    # copies of a text share the draw, and the hash of each is uniform
    unit = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6
    drawn = coded.where(unit < F.try_element_at(rates, F.col("code"))).dropDuplicates(["text", "code"]).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(drawn, key=lambda r: r["text"]):
        out.setdefault(r["code"], []).extend(s for _, s in sentences(r["text"]))
    # drawn as often as they occur: the wrongly labelled stay the few they are
    rng = np.random.default_rng(11)
    return {code: [found[i] for i in rng.permutation(len(found))[:SAMPLE_SENTENCES]] for code, found in out.items()}


_SEGMENTS = "doc_id long, code string, segment int, n_sentences int, lang string, confidence double, chars long"
_LANGUAGES = "doc_id long, code string, lang string, n_sentences long, confidence double, n_langs int"


def _fitted(documents: DataFrame, text: str, lang: str, model: Model | None) -> Model:
    if model is not None:
        return model
    samples = sample(documents, text, lang)
    return fit(samples) if any(samples.values()) else Model(np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32), [])


def _read(documents: DataFrame, key: str, text: str, lang: str, model: Model | None, shape: str, rows_of) -> DataFrame:
    """Every document's sentences classified in Arrow batches; `rows_of` makes rows of (doc, code, sentences, languages, confidences)."""
    shipped = documents.sparkSession.sparkContext.broadcast(vars(_fitted(documents, text, lang, model)))
    columns = [c.split()[0] for c in shape.split(", ")]

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(**shipped.value)
        for batch in batches:
            found = [sentences(t) if m.families else [] for t in batch["text"]]
            # sentences repeat, within a text and between texts: each is made plain once
            number: dict[str, int] = {}
            flat = np.array([number.setdefault(s, len(number)) for ss in found for _, s in ss], dtype=np.int64)
            names, chances = m.predict([plain(s) for s in number])
            langs, sure = [names[i] for i in flat], chances[flat]
            out, at = [], 0
            for doc, code, ss in zip(batch["doc_id"], batch["code"], found):
                out += rows_of(doc, code, ss, langs[at : at + len(ss)], sure[at : at + len(ss)])
                at += len(ss)
            yield pd.DataFrame(out, columns=columns)

    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), label_code(F.col(lang)).alias("code"))
    return rows.mapInPandas(classify, shape)


def segments(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per document and run of sentences of one language:

    doc_id, code (what its label names, or null), segment, n_sentences, lang, confidence (mean of
    the sentences), chars. A document without a full sentence gives one row with a null
    lang, and so does every document if no label of the table names a language. Whole texts are read, of any length; null and empty texts have no sentences.
    """

    def runs(doc, code, ss, langs, sure):
        if not ss:
            return [(doc, code, 0, 0, None, None, 0)]
        out, start = [], 0
        for i in range(1, len(ss) + 1):
            if i == len(ss) or langs[i] != langs[start]:
                out.append((doc, code, start, i - start, langs[start], float(sure[start:i].mean()), sum(len(s) + 1 for _, s in ss[start:i]) - 1))
                start = i
        return out

    return _read(documents, key, text, lang, model, _SEGMENTS, runs)


def languages(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, code, lang, n_sentences, confidence, n_langs): one row per document and language of its sentences.

    Documents without a full sentence give none. A document is read as one, so nothing is shuffled;
    repeated rows give repeated results.
    """

    def totals(doc, code, ss, langs, sure):
        by: dict[str, list[float]] = {}
        for name, x in zip(langs, sure):
            by.setdefault(name, []).append(float(x))
        return [(doc, code, name, len(xs), sum(xs) / len(xs), len(by)) for name, xs in by.items()]

    return _read(documents, key, text, lang, model, _LANGUAGES, totals)


def mislabelled(by_language: DataFrame) -> DataFrame:
    """The rows of documents without a label, with the wrong one, or of several languages."""
    wrong = F.col("code").isNull() | (F.col("code") != F.col("lang")) | (F.col("n_langs") > 1)
    return by_language.where(wrong)
