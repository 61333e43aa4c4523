"""Schemas that drift between the files of a series (problem 5).

Each file's schema is a small graph: the file, its two nests (mapped and extra columns), the
headers in them, the words of their names, their value types. Between consecutive files the pairs
of such nodes form a connectivity graph, over which match scores are propagated until they settle
(similarity flooding). Correspondences are picked by settled score, one to one, and each has to be
confirmed by an exact check: both listed for one field, or cells that agree for the shared skus.
Only schema-sized data reaches Python; the cells themselves are compared by an aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.numbers import plain_decimal
from tidemill.functions.text import fold, is_blank, let, tidy
from tidemill.session import checkpointed, measured_side, small_side

#: Share of the skus with both cells for which they must agree.
AGREEMENT = 0.8
#: Share of a column's filled values that must be of one type for the column to have it.
TYPE_SHARE = 0.9
# Words of a truth column.
TRUTH_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f", "on", "off")
#: Names of value types; a column in which none has its share is `mixed` and never retyped.
TYPES = ("whole", "decimal", "truth", "date", "text")


def _type_of(t: Column) -> Column:
    """The type of a tidied, filled text."""
    return (
        F.when(t.rlike(r"^[+-]?[0-9]+$"), F.lit("whole"))
        .when(t.rlike(r"^[+-]?[0-9]*[.,][0-9]+$"), F.lit("decimal"))
        .when(F.lower(t).isin(*TRUTH_WORDS), F.lit("truth"))
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"), F.lit("date"))
        .otherwise(F.lit("text"))
    )


def value_type(c: Column) -> Column:
    """The type of one filled cell."""
    return let(tidy(c), _type_of)


def _headers(rows: DataFrame) -> DataFrame:
    """(feed_id, header, place): the headers of each file as written, and the last place each has in a record.

    Records of a file mostly have the same headers, so whole lists are made distinct before they are taken apart.
    """
    lists = rows.select("feed_id", F.map_keys("original").alias("hs")).groupBy("feed_id", "hs").agg(F.count(F.lit(1)).alias("n"))
    each = lists.select("feed_id", F.posexplode("hs").alias("place", "header"))
    return each.groupBy("feed_id", "header").agg(F.max("place").alias("place"))


def _key(header: Column) -> Column:
    return F.coalesce(F.nullif(fold(header), F.lit("")), header)


def elements(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(feed_id, key, header, spellings, place, field, in_extra, type): the headers of each file.

    A file has a header if any record has it. Headers that fold alike are one; its spelling is
    the first in order, `spellings` are all, and place is the last place any has in a record. A
    header that folds to nothing is compared as written. Listed headers have the type `listed`: only
    cells of extra are typed, and none but these are read.
    """
    heads = _headers(rows)
    # columns of their own, so that each cell is tidied and typed once
    cells = rows.select("feed_id", F.explode("extra").alias("header", "cell")).withColumn("__t", tidy(F.col("cell")))
    typed = cells.withColumn("__kind", F.when(F.col("__t") != "", _type_of(F.col("__t"))))
    counts = typed.groupBy("feed_id", "header").agg(*[F.count_if(F.col("__kind") == t).alias(f"__{t}") for t in TYPES])
    none = [F.lit(0).cast("bigint").alias(f"__{t}") for t in TYPES]
    every = heads.select("feed_id", "header", "place", F.lit(False).alias("in_extra"), *none).unionByName(
        counts.select("feed_id", "header", F.lit(None).cast("int").alias("place"), F.lit(True).alias("in_extra"), *[f"__{t}" for t in TYPES])
    )
    named = every.withColumn("key", _key(F.col("header")))
    held = F.col("place").isNotNull()
    one = named.groupBy("feed_id", "key").agg(
        F.min(F.when(held, F.col("header"))).alias("header"), F.collect_set(F.when(held, F.col("header"))).alias("spellings"), F.max("place").alias("place"),
        F.max("in_extra").alias("in_extra"), *[F.sum(f"__{t}").alias(f"__{t}") for t in TYPES],
    ).where(F.col("place").isNotNull())
    filled = sum((F.col(f"__{t}") for t in TYPES[1:]), F.col(f"__{TYPES[0]}"))
    kind = F.when(~F.col("in_extra"), F.lit("listed")).when(filled == 0, F.lit("empty"))
    for t in TYPES:
        kind = kind.when(F.col(f"__{t}") >= TYPE_SHARE * filled, F.lit(t))
    known = aliases.select(fold(F.col("header")).alias("__key"), "field").groupBy("__key").agg(F.min("field").alias("field"))
    return one.join(small_side(known), F.col("key") == F.col("__key"), "left").select(
        "feed_id", "key", "header", "spellings", "place", "field", "in_extra", kind.otherwise(F.lit("mixed")).alias("type")
    )


def agreements(rows: DataFrame, lone: DataFrame, skus: DataFrame) -> DataFrame:
    """(feed_id, gone_key, new_key, share): how often the cells of two headers agree.

    `lone` has (feed_id, of, old, key, spellings, field): the headers of file `of` that went (old 1)
    or came (old 0) with file `feed_id`; `skus` (feed_id, headers) where a file holds its skus. Of a file's
    rows with one sku the first line counts; of several sku columns the last filled one. Only cells filled on
    both sides are compared, tidied, by 64-bit hashes, and only if one of the two headers is not
    listed. Both sides of a file meet in one aggregation by sku; a joined row holds the few headers
    that came or went, never the pairs of a whole schema.
    """
    mixed = Window.partitionBy("feed_id")
    free = F.col("field").isNull()
    # a file in which nothing went, nothing came, or all of both is listed has nothing to compare
    asked = lone.withColumns({"__sides": F.min("old").over(mixed) + F.max("old").over(mixed) * 2, "__free": F.max(free).over(mixed)})
    asked = asked.where((F.col("__sides") == 2) & F.col("__free"))
    entry = F.struct(F.col("key").alias("k"), free.alias("free"), F.col("spellings").alias("hs"))
    sides = asked.groupBy(F.col("of").alias("__of"), F.col("feed_id").alias("pair"), "old").agg(F.collect_list(entry).alias("wanted"))
    per_file = sides.groupBy("__of").agg(F.collect_list(F.struct("pair", "old", "wanted")).alias("sides"))  # at most two a file
    wanted = per_file.join(skus.withColumnRenamed("feed_id", "__file"), F.col("__of") == F.col("__file")).select("__of", "sides", F.col("headers").alias("__skus"))
    cell = lambda h: F.try_element_at(F.col("original"), h)
    joined = rows.select("feed_id", "line", "original").join(measured_side(checkpointed(wanted)), F.col("feed_id") == F.col("__of"))
    named = F.filter(F.transform("__skus", cell), lambda v: ~is_blank(v))
    keyed = joined.withColumn("sku", fold(F.element_at(named, F.when(F.size(named) > 0, F.lit(-1))))).where(F.col("sku") != "")
    each = keyed.select("line", "original", "sku", F.inline("sides"))
    held = F.flatten(F.transform("wanted", lambda w: F.transform(w["hs"], lambda h: F.struct(w["k"].alias("k"), w["free"].alias("free"), tidy(cell(h)).alias("t")))))
    hashed = F.transform(F.filter(held, lambda x: x["t"] != ""), lambda x: F.struct(x["k"].alias("k"), x["free"].alias("free"), F.xxhash64(x["t"]).alias("h")))
    first = each.select("pair", "sku", "old", F.struct("line", hashed.alias("cells")).alias("__at"))
    both = first.groupBy("pair", "sku").agg(F.min(F.when(F.col("old") == 1, F.col("__at"))).alias("olds"), F.min(F.when(F.col("old") == 0, F.col("__at"))).alias("news"))
    met = F.flatten(
        F.transform(
            "olds.cells",
            lambda o: F.transform(
                F.filter("news.cells", lambda n: o["free"] | n["free"]), lambda n: F.struct(o["k"].alias("gone_key"), n["k"].alias("new_key"), (o["h"] == n["h"]).alias("same"))
            ),
        )
    )
    long = both.where(F.col("olds").isNotNull() & F.col("news").isNotNull()).select(F.col("pair").alias("feed_id"), F.inline(met))
    return long.groupBy("feed_id", "gone_key", "new_key").agg(F.avg(F.col("same").cast("double")).alias("share"))


# ------------------------------------------------------------ similarity flooding
def _grams(s: str) -> set[str]:
    padded = f"  {s} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


@lru_cache(maxsize=100_000)
def name_likeness(a: str, b: str) -> float:
    """Share of common trigrams of two folded names."""
    x, y = _grams(a), _grams(b)
    return len(x & y) / max(1, len(x | y))


def flood(before: list[dict], now: list[dict], evidence: dict[tuple[str, str], float], rounds: int = 60, tolerance: float = 1e-4) -> dict[tuple[str, str], float]:
    """Settled match scores of every pair of a gone and a new header, over the graphs of both whole schemas.

    Nodes are pairs of headers, words, types, nests and files; an edge joins two pairs if both of
    their members are joined by an edge of the same label. Headers that stay are pairs too, and pass
    on what their words, types and nests stand for. What flows over an edge is divided by the number
    of edges of that label at its start, and scores are scaled to a largest of 1 each round. `evidence`
    says what is known of a pair before: 2 for one listed field, else the share of equal cells.
    """
    old_keys, new_keys = {e["key"] for e in before}, {e["key"] for e in now}
    gone, new = [e for e in before if e["key"] not in new_keys], [e for e in now if e["key"] not in old_keys]
    held = {e["key"]: e for e in before}
    number: dict[tuple, int] = {}
    start: list[float] = []

    def node(kind: str, a, b, first: float) -> int:
        at = number.setdefault((kind, a, b), len(start))
        if at == len(start):
            start.append(first)
        return at

    links: dict[str, list[tuple[int, int]]] = {"word": [], "type": [], "nest": [], "file": []}
    root = node("file", None, None, 1.0)
    pairs = [(a, b, 0.5 * name_likeness(a["key"], b["key"]) + evidence.get((a["key"], b["key"]), 0.0) + 0.05) for a in gone for b in new]
    pairs += [(held[e["key"]], e, 1.0) for e in now if e["key"] in held]
    nests = set()
    for a, b, first in pairs:
        pair = node("header", a["key"], b["key"], first)
        links["word"] += [(pair, node("word", u, v, name_likeness(u, v))) for u in a["key"].split() for v in b["key"].split()]
        links["type"].append((pair, node("type", a["type"], b["type"], float(a["type"] == b["type"]))))
        nest = node("nest", a["in_extra"], b["in_extra"], float(a["in_extra"] == b["in_extra"]))
        links["nest"].append((pair, nest))
        nests.add(nest)
    links["file"] = [(nest, root) for nest in sorted(nests)]
    ends, weights = [], []
    for edges in links.values():
        if edges:
            e = np.array(edges)
            for way in (e, e[:, ::-1]):
                ends.append(way)
                weights.append(1.0 / np.bincount(way[:, 0])[way[:, 0]])
    flow, share = np.vstack(ends), np.concatenate(weights)
    first = np.array(start)
    score = first.copy()
    for _ in range(rounds):
        base = first + score
        nxt = base + np.bincount(flow[:, 1], weights=share * base[flow[:, 0]], minlength=len(first))
        nxt /= nxt.max()
        moved = float(np.linalg.norm(nxt - score))
        score = nxt
        if moved < tolerance:
            break
    return {(p[1], p[2]): float(score[i]) for p, i in number.items() if p[0] == "header" and p[1] not in new_keys}


def correspondences(before: list[dict], now: list[dict], agreed: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """One-to-one pairs (gone key, new key): by settled score, the highest first, each confirmed by an exact check.

    The check refuses a pair unless both headers are listed for one field, or one is not listed and the
    cells agree for at least AGREEMENT of the shared skus. A refused pair takes neither header.
    """
    old_keys, new_keys = {e["key"]: e for e in before}, {e["key"]: e for e in now}
    if not old_keys.keys() - new_keys.keys() or not new_keys.keys() - old_keys.keys():
        return []
    evidence = dict(agreed)
    for a in before:
        for b in now:
            if a["field"] is not None and b["field"] is not None:
                evidence[a["key"], b["key"]] = 2.0 if a["field"] == b["field"] else 0.0

    def confirmed(p: tuple[str, str]) -> bool:
        return evidence.get(p, 0.0) >= AGREEMENT - 1e-9

    scores = flood(before, now, evidence)
    taken_a, taken_b, out = set(), set(), []
    for a, b in sorted(scores, key=lambda p: (-round(scores[p], 9), p)):
        if a not in taken_a and b not in taken_b and confirmed((a, b)):
            out.append((a, b))
            taken_a.add(a)
            taken_b.add(b)
    return out


_OUT = "feed_id long, key string, header string, drift string, lineage string, before_key string, common_type string"


def common_type(types: set[str]) -> str:
    """The narrowest type that holds them all: whole numbers widen to decimals, all else to text; empty columns fit any."""
    kinds = types - {"empty", "listed"}
    if kinds <= {"whole", "decimal"} and kinds:
        return "decimal" if "decimal" in kinds else "whole"
    return kinds.pop() if len(kinds) == 1 and kinds <= set(TYPES) else "text"


def match_series(schema: pd.DataFrame, agreed: pd.DataFrame) -> pd.DataFrame:
    """All files of one series: a row per header of each file, and one per removed header.

    drift is null for headers that just stay. lineage is the canonical field, or for unlisted
    headers the key the column had when it first appeared; common_type is one type for all files.
    """
    shares: dict[object, dict[tuple[str, str], float]] = {}
    for r in agreed.itertuples(index=False):
        shares.setdefault(r.feed_id, {})[(r.gone_key, r.new_key)] = r.share
    files: dict[int, list[dict]] = {}
    for place, feed, key, header, field, kind, in_extra in zip(*(schema[c] for c in ("place", "feed_id", "key", "header", "field", "type", "in_extra"))):
        listed = field if isinstance(field, str) else None
        files.setdefault(place, []).append({"feed": feed, "key": key, "header": header, "field": listed, "type": kind, "in_extra": bool(in_extra)})
    out, lines = [], {}
    kinds: dict[str, set[str]] = {}
    before: dict[str, dict] | None = None
    for _, headers in sorted(files.items()):
        feed = headers[0]["feed"]
        now = {e["key"]: e for e in sorted(headers, key=lambda e: e["key"])}
        lineage: dict[str, str] = {}
        if before is None:
            for k, e in now.items():
                lineage[k] = e["field"] or k
                out.append((feed, k, e["header"], None, lineage[k], None))
        else:
            gone = [e for k, e in before.items() if k not in now]
            pairs = {b: a for a, b in correspondences(list(before.values()), list(now.values()), shares.get(feed, {}))}
            kept = set(pairs.values())
            for k, e in now.items():
                if k in before:
                    old = before[k]
                    usable = {e["type"], old["type"]} <= set(TYPES)
                    drift = "retyped" if e["in_extra"] and usable and e["type"] != old["type"] else None
                    source = k
                else:
                    source = pairs.get(k)
                    drift = "added" if source is None else "renamed"
                lineage[k] = e["field"] or (lines[source] if source in lines else k)
                out.append((feed, k, e["header"], drift, lineage[k], source))
            for e in gone:
                if e["key"] not in kept:
                    out.append((feed, e["key"], e["header"], "removed", lines[e["key"]], e["key"]))
        before, lines = now, lineage
        for k, e in now.items():
            kinds.setdefault(lineage[k], set()).add(e["type"])
    rows = [(*r, common_type(kinds[r[4]])) for r in out]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])


def drift(rows: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(feed_id, key, header, drift, lineage, before_key) for all files of all series.

    `rows` has feed_id, line, original and extra; `files` feed_id, series_id and received_at. A
    file without rows has no headers and is passed over; null maps count as empty. Schemas are as
    wide as a file has columns, so a series is small even if it holds most of the rows.
    """
    schema = checkpointed(elements(rows, aliases))  # schema-sized, read several times below
    # files that hold no rows are no load of the series
    held = schema.select(F.col("feed_id").alias("__held")).distinct()
    order = Window.partitionBy("series_id").orderBy("received_at", "feed_id")
    placed = files.join(held, files["feed_id"] == F.col("__held")).select(
        "series_id",
        F.col("feed_id").alias("__feed"),
        F.row_number().over(order).alias("place_in_series"),
        F.lag("feed_id").over(order).alias("before"),
        F.lead("feed_id").over(order).alias("after"),
    )
    located = schema.drop("spellings", "place").join(placed, F.col("feed_id") == F.col("__feed")).drop("__feed")
    located = checkpointed(located.withColumnRenamed("place_in_series", "place"))
    # a header that came or went is on one side of a consecutive pair only
    ways = F.array(F.struct(F.col("feed_id").alias("pair"), F.lit(0).alias("old")), F.struct(F.col("after").alias("pair"), F.lit(1).alias("old")))
    sides = located.select("feed_id", "key", "field", "before", F.inline(ways)).where(F.col("pair").isNotNull() & ((F.col("old") == 1) | F.col("before").isNotNull()))
    lone = sides.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n"), F.max("old").alias("old"), F.max("feed_id").alias("of"), F.max("field").alias("field")).where(F.col("n") == 1)
    spelt = schema.select(F.col("feed_id").alias("__f"), F.col("key").alias("__k"), "spellings")
    lone = lone.join(spelt, (F.col("of") == F.col("__f")) & (F.col("key") == F.col("__k"))).select(F.col("pair").alias("feed_id"), "of", "old", "key", "spellings", "field")
    at = F.array_sort(F.collect_list(F.struct("place", "spellings")))
    skus = schema.where(F.col("field") == "sku").groupBy("feed_id").agg(F.flatten(F.transform(at, lambda x: x["spellings"])).alias("headers"))
    agreed = agreements(rows, lone, skus)
    series = placed.select(F.col("series_id").alias("__series"), F.col("__feed").alias("__pair"))
    agreed = agreed.join(series, F.col("feed_id") == F.col("__pair")).select(F.col("__series").alias("series_id"), "feed_id", "gone_key", "new_key", "share")
    shown = located.drop("before", "after")
    return shown.groupBy("series_id").cogroup(agreed.groupBy("series_id")).applyInPandas(match_series, _OUT)


def cast_text(cell: Column, kind: Column) -> Column:
    """A cell in the one notation of its column's type; null if it is blank or of another type.

    Whole numbers without sign and zeros in front, decimals with a point, true and false, ISO dates; text is tidied.
    """

    def cast(x: Column) -> Column:
        t, k, own = x["t"], x["k"], x["own"]
        numeric = F.translate(t, ",", ".")
        return (
            F.when((t == "") | t.isNull(), F.lit(None))
            .when(k == "text", t)
            .when((k == "whole") & (own == "whole"), t.try_cast("decimal(38,0)").cast("string"))
            .when((k == "decimal") & own.isin("whole", "decimal"), plain_decimal(numeric.try_cast("decimal(38,12)")))
            .when((k == "truth") & (own == "truth"), F.lower(t).isin("true", "yes", "y", "t", "on").cast("string"))
            .when((k == "date") & (own == "date"), F.left(t, F.lit(10)))
        )

    return let(F.struct(tidy(cell).alias("t"), kind.alias("k"), value_type(cell).alias("own")), cast)


def unified(rows: DataFrame, matched: DataFrame, fields: Iterable[str]) -> DataFrame:
    """All rows as one table: row_id, feed_id, line, the canonical fields as text, `extra` and `odd`.

    extra maps the lineage of each unlisted column to its cell, cast to the one type the column has
    over all files (`cast_text`); odd maps it to the cell as delivered where that is not of the type.
    A column a file lacks is in neither, nor is a blank cell. Columns whose type changed are text.
    Both maps are in the order of their keys.
    """
    fields = list(fields)
    names = matched.where(F.col("drift").isNull() | (F.col("drift") != "removed")).select(F.col("feed_id").alias("__file"), F.col("key").alias("__key"), "lineage", "common_type")
    heads = _headers(rows).withColumn("key", _key(F.col("header")))
    known = heads.join(names, (F.col("feed_id") == F.col("__file")) & (F.col("key") == F.col("__key")))
    # of each file: the headers of each field and of all other columns, in order
    own_field = F.col("lineage").isin(*fields)
    entry = F.struct("lineage", "place", "header", "common_type")
    per_file = known.groupBy("__file").agg(
        F.array_sort(F.collect_list(F.when(own_field, entry))).alias("__listed"), F.array_sort(F.collect_list(F.when(~own_field, entry))).alias("__rest")
    )
    by_field = F.struct(*[F.transform(F.filter("__listed", lambda e: e["lineage"] == f), lambda e: e["header"]).alias(f) for f in fields])  # noqa: B023
    placed = per_file.select("__file", by_field.alias("__fields"), "__rest")
    joined = rows.select("row_id", "feed_id", "line", "original").join(measured_side(checkpointed(placed)), F.col("feed_id") == F.col("__file"), "left")
    in_record = lambda h: F.map_contains_key(F.col("original"), h)

    def first_cell(field: str) -> Column:
        # a record may lack the first of several headers of a field
        return F.try_element_at("original", F.get(F.filter(F.col(f"__fields.{field}"), in_record), F.lit(0))).alias(field)

    own = [F.when(F.col("original").isNotNull(), first_cell(f)).alias(f) for f in fields]
    # headers that fold alike share a lineage; the first cell counts
    rest = F.filter(
        F.transform("__rest", lambda e: F.struct(e["lineage"].alias("k"), F.try_element_at("original", e["header"]).alias("v"), e["common_type"].alias("kind"))),
        lambda e: ~is_blank(e["v"]),
    )
    typed = F.transform(rest, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"), cast_text(e["v"], e["kind"]).alias("c")))
    none = F.array().cast("array<struct<k:string,v:string,c:string>>")
    cells = joined.select("row_id", "feed_id", "line", *own, F.coalesce(typed, none).alias("__t"))

    def as_map(kept, value: str) -> Column:
        return let(
            F.filter("__t", kept),
            lambda xs: let(
                F.array_distinct(F.transform(xs, lambda x: x["k"])),
                lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.get(F.filter(xs, lambda x: x["k"] == k), F.lit(0))[value])),
            ),
        )

    return cells.select(
        "row_id", "feed_id", "line", *fields,
        as_map(lambda x: x["c"].isNotNull(), "c").alias("extra"),
        as_map(lambda x: x["c"].isNull(), "v").alias("odd"),
    )
