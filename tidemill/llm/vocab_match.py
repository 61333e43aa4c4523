"""Free-entered values mapped to a canonical list (problem 2).

The canonical values, and wordings known for them from evidence, are a dictionary of forms, indexed
by symmetric deletes: every string left when up to a bounded number of characters are taken out.
Each distinct value is probed with its own deletes. Index and probes are tables, and they meet in
one equi-join, so a lookup costs the deletes of the value and never a pass over the list, whatever
the list's size. Candidates are ranked by weighted Damerau-Levenshtein distance, then by how often
the canonical value occurs in the data. Answers are joined back to the cells; values that mean none
of the list are reported with -1.

No wording is written down here. `learned_wordings` takes them from logged corrections.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import is_blank
from tidemill.session import checkpointed, measured_side, small_side

#: A side of a join is broadcast up to this size, measured.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Edits a canonical name, and any other form, may be away.
NAME_EDITS, PHRASE_EDITS = 2, 1
#: Share of the corrections of a wording that must agree for it to be learned.
AGREED = 0.9
#: Letters a wording needs to count inside a longer phrase.
INSIDE = 6

# Legal forms at the end of a company's name, and articles before it.
LEGAL_FORMS = (
    "inc", "incorporated", "ltd", "limited", "llc", "llp", "plc", "corp", "corporation", "co", "company", "group",
    "holding", "gmbh", "ag", "kg", "bv", "nv", "sa", "srl", "sarl", "spa", "oy", "ab", "as", "aps", "pty",
)
LEADS = ("the",)
# Words that turn a phrase round.
NEGATIONS = ("not", "no", "never")


def simplify(value: str) -> str:
    """Lower case without accents, entities, zero-width characters; words parted by single spaces."""
    s = unicodedata.normalize("NFKD", html.unescape(value)).translate({0x200B: None, 0xFEFF: None, 0x200C: None, 0x200D: None})
    s = "".join(c for c in s if not unicodedata.combining(c)).lower()
    return s.strip()


def words(s: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_+", s) if w and w != "and"]


def squeeze(s: str) -> str:
    return "".join(words(s))


def skeleton(s: str) -> str:
    """Each word's first letter and its later consonants: how a trade is abbreviated."""
    return "".join(w[:1] + re.sub("[aeiou]", "", w[1:]) for w in words(s))


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance, most + 1 if larger.

    Swapped letters count once even if letters between them were lost or put in (these count too).
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), at
            if x == y:
                at = j
            d[i + 1][j + 1] = min(
                d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)
            )
        seen[x] = i
        if min(d[i + 1][1:]) > most + 1:
            return most + 1
    return min(d[-1][-1], most + 1)


def weighted_edits(a: str, b: str) -> float:
    """Damerau-Levenshtein with costs: swaps 0.7, doubled letters 0.5, vowels for vowels 0.8, others 1; half as much more at the first letter."""
    vowels = set("aeiouy")
    inf = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and not j:
                continue
            first = 1.5 if max(i, j) == 1 else 1.0
            ways = []
            if i:
                ways.append(inf[i - 1][j] + (0.5 if i > 1 and a[i - 1] == a[i - 2] else first))
            if j:
                ways.append(inf[i][j - 1] + (0.5 if j > 1 and b[j - 1] == b[j - 2] else first))
            if i and j:
                x, y = a[i - 1], b[j - 1]
                ways.append(inf[i - 1][j - 1] + (0 if x == y else (0.8 if x in vowels and y in vowels else 1.0) * first))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    ways.append(inf[i - 2][j - 2] + 0.7)
            inf[i][j] = min(ways)
    return inf[-1][-1]


def deletes(s: str, most: int) -> set[str]:
    out = {s}
    for k in range(1, min(most, len(s)) + 1):
        out.update("".join(c for i, c in enumerate(s) if i not in gone) for gone in map(set, combinations(range(len(s)), k)))
    return out


def allowed_edits(length: int, most: int) -> int:
    """Edits a canonical form of this length may have: none below 4 letters, one below 7, else `most`."""
    return 0 if length < 4 else min(1, most) if length < 7 else most


# ------------------------------------------------------------------- the index
_INDEX = "field string, kind string, key string, form string, entry_id long, n long"
#: Kinds of keys: a whole form; a maker alone; a maker and its trade; a known maker; a known trade; a wording inside a phrase.
FORM, ALONE, PAIR, MAKER, TRADE, INNER = "form", "alone", "pair", "maker", "trade", "inner"


def form_keys(field: str, text: str, entry: int, n: int, is_name: bool, learned: bool) -> Iterator[tuple]:
    """The index rows of one canonical value or learned wording."""
    parts = words(simplify(text))
    form = "".join(parts)
    if not form:
        return
    bound = NAME_EDITS if is_name else PHRASE_EDITS
    # a learned spelling of a name may be a misspelling itself, so nothing is sought around it
    for d in deletes(form, 0 if is_name and learned else allowed_edits(len(form), bound)):
        yield field, FORM, d, form, entry, n
    if not is_name:
        if len(form) >= INSIDE:
            yield field, INNER, form, " ".join(parts), entry, n
    elif not learned:
        maker, rest = parts[0], parts[1:]
        for d in deletes(maker, min(1, allowed_edits(len(maker), NAME_EDITS))):
            yield field, ALONE, d, maker, entry, n
        yield field, MAKER, maker, maker, None, 0
        if rest:
            for trade in {"".join(rest), skeleton(" ".join(rest))}:
                yield field, TRADE, trade, trade, None, 0
                for d in deletes(maker, allowed_edits(len(maker), NAME_EDITS)):
                    yield field, PAIR, f"{d}|{trade}", maker, entry, n


def readings(value: str) -> list[list[str]]:
    """Readings of a name as words: decorations off, parts in either order."""
    s = re.sub(r"\([^()]*\)\s*$", "", simplify(value)).strip()
    # a word set off by a dash after two words or more stands beside the name
    s = re.sub(r"^(\S+\s+\S.*?)\s+[-–]\s+\w+$", r"\1", s)
    # letters with stops are one word
    s = re.sub(r"\b(?:[a-z]\.){1,3}(?:[a-z]\b)?(?=\s|$|,)", lambda m: m.group().replace(".", ""), s)
    forms = []

    def trimmed(w: list[str]) -> list[str]:
        while len(w) > 1 and w[0] in LEADS:
            w = w[1:]
        while len(w) > 1 and w[-1] in LEGAL_FORMS:
            w = w[:-1]
        return w

    head, comma, tail = s.rpartition(",")
    if comma and not [x for x in words(tail) if x not in LEGAL_FORMS]:
        s, comma = head, ""
    if comma:
        forms.append(trimmed(words(tail)) + trimmed(words(head)))
    if " by " in s:
        what, _, who = s.partition(" by ")
        forms.append(trimmed(words(who)) + trimmed(words(what)))
    forms.append(trimmed(words(s)))
    return [f for f in forms if f]


_PROBES = "field string, value string, kind string, key string, reading int, split int, text string"


def probe_keys(field: str, value: str, is_name: bool, longest: int, most_words: int) -> Iterator[tuple]:
    """The keys under which a value is sought: (kind, key, reading, split, text compared with the form)."""
    if not is_name:
        clean = words(simplify(value))
        s = "".join(clean)
        if not s:
            return
        if len(s) <= longest + PHRASE_EDITS:
            for d in deletes(s, PHRASE_EDITS if len(s) >= 3 else 0):
                yield FORM, d, 0, 0, s
        if not set(NEGATIONS) & set(clean):
            inner = {"".join(clean[i : i + k]) for k in range(1, most_words + 1) for i in range(len(clean) - k + 1) if k < len(clean)}
            for part in inner:
                if INSIDE <= len(part) <= longest:
                    yield INNER, part, 0, 0, part
        return
    for r, parts in enumerate(readings(value)):
        s = "".join(parts)
        if len(s) > longest + NAME_EDITS:
            continue
        for d in deletes(s, NAME_EDITS if len(s) >= 3 else 0):
            yield FORM, d, r, 0, s
        for d in deletes(s, 1 if len(parts) == 1 and len(s) >= 3 else 0):
            yield ALONE, d, r, 0, s
        for j in range(1, len(parts)):
            maker, trade = "".join(parts[:j]), "".join(parts[j:])
            yield MAKER, maker, r, j, maker
            yield TRADE, trade, r, j, trade
            for d in deletes(maker, NAME_EDITS if len(maker) >= 3 else 0):
                yield PAIR, f"{d}|{trade}", r, j, maker


# ------------------------------------------------------------------- ranking
def best_phrase(hits: list[dict]) -> int:
    """The entry of a phrase: an exact form, else the nearest one, else the longest wording inside it."""
    exact = [h for h in hits if h["kind"] == FORM and h["text"] == h["form"]]
    if exact:
        return exact[0]["entry_id"] if exact[0]["owners"] == 1 else -1
    near = [
        (weighted_edits(h["text"], h["form"]), -h["n"], h["entry_id"])
        for h in hits
        if h["kind"] == FORM and edits(h["text"], h["form"], m := allowed_edits(len(h["form"]), PHRASE_EDITS)) <= m
    ]
    if near:
        return min(near)[2]
    inner = [(-len(h["form"].split(" ")), -len(h["text"]), -h["n"], h["entry_id"]) for h in hits if h["kind"] == INNER]
    return min(inner)[3] if inner else -1


def best_name(hits: list[dict]) -> int:
    """The entry of a name: an exact form or a maker alone, else the nearest candidate of any reading.

    A reading that ends in a known trade is that trade of the maker before it. A listed maker in
    a trade it is not listed with is another name; a maker that is not listed may be a misspelt one
    that has the trade. Other readings go by the whole form, or by a maker alone with one edit.
    """
    by_reading: dict[int, list[dict]] = {}
    for h in hits:
        by_reading.setdefault(h["reading"], []).append(h)
    for _, hs in sorted(by_reading.items()):
        exact = [h for h in hs if h["kind"] == FORM and h["text"] == h["form"]]
        if exact:
            return exact[0]["entry_id"]
        alone = [h for h in hs if h["kind"] == ALONE and h["text"] == h["form"]]
        if alone:
            return alone[0]["entry_id"] if alone[0]["owners"] == 1 else -1
    ranked: list[tuple[float, int, int]] = []
    for hs in by_reading.values():
        trades = [h["split"] for h in hs if h["kind"] == TRADE]
        if trades:
            at = min(trades)  # the longest trade
            pairs = [h for h in hs if h["kind"] == PAIR and h["split"] == at]
            exact = [h for h in pairs if h["text"] == h["form"]]
            if exact:
                ranked.append((0.0, 0, exact[0]["entry_id"]))
            elif not any(h["kind"] == MAKER and h["split"] == at for h in hs):
                near = [h for h in pairs if edits(h["text"], h["form"], m := allowed_edits(len(h["form"]), NAME_EDITS)) <= m]
                ranked += [(weighted_edits(h["text"], h["form"]), -h["n"], h["entry_id"]) for h in near]
            continue
        near = [h for h in hs if h["kind"] == FORM and edits(h["text"], h["form"], m := allowed_edits(len(h["form"]), NAME_EDITS)) <= m]
        if not near:
            near = [h for h in hs if h["kind"] == ALONE and h["owners"] == 1 and edits(h["text"], h["form"], m := min(1, allowed_edits(len(h["form"]), NAME_EDITS))) <= m]
        ranked += [(weighted_edits(h["text"], h["form"]), -h["n"], h["entry_id"]) for h in near]
    return min(ranked)[2] if ranked else -1


# -------------------------------------------------------------------- the joins
def learned_wordings(corrections: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(field, wording, canonical): what logged corrections say a wording means.

    `corrections` has field, outcome, before_text and after_text. Only changes into a canonical value of
    the field count; a wording is learned if AGREED of its corrections agree. Blank wordings and
    canonical values themselves are none. Partial counts cross the shuffle, not rows.
    """
    listed = vocabulary.where(F.col("canonical").isNotNull()).select(F.col("field").alias("__f"), F.col("canonical").alias("__c")).distinct()
    told = corrections.where((F.col("outcome") == "changed") & ~is_blank(F.col("before_text"))).groupBy("field", "before_text", "after_text").agg(F.count(F.lit(1)).alias("n"))
    meant = told.join(small_side(listed), (F.col("field") == F.col("__f")) & (F.col("after_text") == F.col("__c")), "left_semi")
    one = meant.groupBy("field", F.col("before_text").alias("wording")).agg(F.max_by("after_text", F.struct("n", "after_text")).alias("canonical"), F.max("n").alias("top"), F.sum("n").alias("n"))
    agreed = one.where(F.col("top") >= AGREED * F.col("n"))
    return agreed.join(small_side(listed), (F.col("field") == F.col("__f")) & (F.col("wording") == F.col("__c")), "left_anti").select("field", "wording", "canonical")


def build_index(forms: DataFrame, names: Iterable[str]) -> DataFrame:
    """The delete index (field, kind, key, form, entry_id, owners, n) of forms (field, text, entry_id, n, learned).

    Of entries that share a form the most frequent one stands for it; owners says how many there are.
    """
    named = set(names)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _INDEX.split(", ")]
        for batch in batches:
            out = [k for r in batch.itertuples(index=False) for k in form_keys(r.field, r.text, r.entry_id, r.n, r.field in named, r.learned)]
            yield pd.DataFrame(out, columns=columns).astype({"entry_id": "Int64"})

    each = forms.mapInPandas(rows, _INDEX)
    return each.groupBy("field", "kind", "key", "form").agg(
        F.max_by("entry_id", F.struct("n", -F.col("entry_id"))).alias("entry_id"), F.countDistinct("entry_id").alias("owners"), F.max("n").alias("n")
    )


def answers(values: DataFrame, index: DataFrame, names: Iterable[str], longest: int, most_words: int) -> DataFrame:
    """(field, value, entry_id) of distinct (field, value) rows; values that mean nothing listed are left out."""
    named = set(names)

    def sought(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _PROBES.split(", ")]
        for batch in batches:
            out = []
            for f, v in zip(batch["field"], batch["value"]):
                out += [(f, v, *p) for p in probe_keys(f, v, f in named, longest, most_words)]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    probes = values.select("field", "value").mapInPandas(sought, _PROBES)
    entries = measured_side(index, BROADCAST_BYTES)
    met = probes.join(entries, ["field", "kind", "key"])
    hit = F.struct("kind", "reading", "split", "text", "form", "entry_id", "owners", "n")
    hits = met.groupBy("field", "value").agg(F.collect_set(hit).alias("hits"))

    @F.pandas_udf("long")
    def choose(field: pd.Series, found: pd.Series) -> pd.Series:
        picked = []
        for f, hs in zip(field, found):
            ordered = sorted((dict(h) for h in hs), key=lambda h: (h["reading"], h["split"], h["kind"], h["form"]))
            picked.append((best_name if f in named else best_phrase)(ordered))
        return pd.Series(picked, dtype="int64")

    return hits.select("field", "value", choose("field", "hits").alias("entry_id"))


def matched(
    rows: DataFrame, vocabulary: DataFrame, fields: Iterable[str], key: str = "row_id", wordings: DataFrame | None = None, names: Iterable[str] = ("vendor",)
) -> DataFrame:
    """(key, field, value, entry_id) of every filled cell that is no canonical value as it stands.

    `wordings` has (field, wording, canonical), such as `learned_wordings` gives. Fields of `names` hold names made of a
    maker and a trade; the others phrases. entry_id is -1 for values that mean none of the list, among them all values of
    a field without entries. Blank cells give no row; repeated rows give repeated results. Null and blank
    canonical values are passed over; of entries with one canonical value the lowest id counts.
    """
    fields, names = list(fields), list(names)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = rows.select(F.col(key).alias("__key"), F.inline(cells)).where(~is_blank(F.col("value")))
    listed = vocabulary.where(F.col("field").isin(*fields) & ~is_blank(F.col("canonical"))).groupBy(F.col("field").alias("__f"), F.col("canonical").alias("__c")).agg(F.min("entry_id").alias("entry_id"))
    listed = checkpointed(listed)
    exact = (F.col("field") == F.col("__f")) & (F.col("value") == F.col("__c"))
    values = checkpointed(long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))  # the distinct values, counted
    small = measured_side(listed, BROADCAST_BYTES)
    seen = values.join(small, exact).select("entry_id", F.col("n").alias("__n"))
    counted = listed.join(seen.withColumnRenamed("entry_id", "__e"), F.col("entry_id") == F.col("__e"), "left").select(
        F.col("__f").alias("field"), F.col("__c").alias("text"), "entry_id", F.coalesce("__n", F.lit(0)).alias("n"), F.lit(False).alias("learned")
    )
    forms = counted
    if wordings is not None:
        known = wordings.select(F.col("field").alias("__wf"), F.col("wording"), F.col("canonical").alias("__wc"))
        forms = forms.unionByName(
            known.join(counted, (F.col("__wf") == F.col("field")) & (F.col("__wc") == F.col("text"))).select("field", F.col("wording").alias("text"), "entry_id", "n", F.lit(True).alias("learned"))
        )
    index = checkpointed(build_index(forms, names))
    # two numbers: how long a form is, and of how many words a phrase may be
    longest, most_words = index.agg(F.max(F.length("form")), F.max(F.when(F.col("kind") == INNER, F.size(F.split("form", " "))))).first()
    asked = values.join(small, exact, "left_anti")
    found = checkpointed(answers(asked, index, names, longest or 0, most_words or 0))
    rest = long.join(small.select("__f", "__c"), exact, "left_anti")
    told = measured_side(found.select(F.col("field").alias("__af"), F.col("value").alias("__av"), "entry_id"), BROADCAST_BYTES)
    out = rest.join(told, (F.col("field") == F.col("__af")) & (F.col("value") == F.col("__av")), "left")
    return out.select(F.col("__key").alias(key), "field", "value", F.coalesce("entry_id", F.lit(-1).cast("bigint")).alias("entry_id"))
