"""Quantities in many units brought to common ones (problem 1).

Conversions are edges of a graph, each an affine function y = factor * x + offset. The shortest
composition from every unit to the canonical unit of its kind is worked out once on the driver,
every cycle of the graph is checked for consistency, and the rows meet the result in an equi-join
on (kind, unit). The table has one row per spelling, so it is small and broadcast; a larger one that a
caller brings is left to a join on its keys.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.numbers import join_thousands, number
from tidemill.functions.text import PLACEHOLDERS_WIDE, let, tidy
from tidemill.functions.units import GRAMS_IN, LENGTH_UNITS, MM_IN, OUNCE_SPELLINGS, POUND_SPELLINGS, WEIGHT_UNITS
from tidemill.session import measured_side


class InconsistentUnits(ValueError):
    """Two paths between the same units give different conversions."""


@dataclass(frozen=True)
class Affine:
    factor: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)

    def then(self, other: Affine) -> Affine:
        return Affine(self.factor * other.factor, self.offset * other.factor + other.offset)

    def inverse(self) -> Affine:
        return Affine(1 / self.factor, -self.offset / self.factor)


class UnitGraph:
    """Units as nodes, affine conversions as edges usable in both directions."""

    def __init__(self) -> None:
        self.edges: dict[str, dict[str, Affine]] = {}

    def unit(self, name: str) -> None:
        self.edges.setdefault(name, {})

    def add(self, source: str, target: str, factor, offset=0) -> None:
        """y[target] = factor * x[source] + offset. An edge given twice must agree."""
        if not factor:
            raise InconsistentUnits(f"{source} to {target}: factor 0")
        f = Affine(Fraction(str(factor)), Fraction(str(offset)))
        for a, b, g in ((source, target, f), (target, source, f.inverse())):
            self.unit(a)
            if self.edges[a].setdefault(b, g) != g:
                raise InconsistentUnits(f"{a} to {b} is given twice, differently")

    def compositions(self, target: str) -> dict[str, Affine]:
        """For each unit connected with `target` the shortest composition into it.

        Every edge off the shortest paths closes a cycle; all of them must agree.
        """
        self.unit(target)
        found, queue = {target: Affine()}, deque([target])
        while queue:
            at = queue.popleft()
            for other, f in self.edges[at].items():
                into = f.inverse().then(found[at])
                if other not in found:
                    found[other] = into
                    queue.append(other)
                elif found[other] != into:
                    raise InconsistentUnits(f"the cycle through {at} and {other} does not close")
        return found


def standard_graph() -> dict[str, tuple[UnitGraph, str, dict[str, str]]]:
    """kind -> (graph, canonical unit, spelling -> unit) for weight and length."""
    weight, length = UnitGraph(), UnitGraph()
    for u, grams in GRAMS_IN.items():
        weight.add(u, "g", grams)
    weight.add("lb", "oz", 16)
    for u, mm in MM_IN.items():
        length.add(u, "mm", mm)
    length.add("ft", "in", 12)
    length.add("m", "cm", 100)
    return {"weight": (weight, "g", WEIGHT_UNITS), "length": (length, "mm", LENGTH_UNITS)}


def ounces_a_pound() -> float:
    """By the graph, so that sums of the two follow its edges."""
    return float(standard_graph()["weight"][0].compositions("oz")["lb"].factor)


def conversion_table(spark: SparkSession, graphs=None) -> DataFrame:
    """(kind, unit, factor, shift, is_common): one row per spelling."""
    rows = []
    for kind, (graph, target, spellings) in (graphs or standard_graph()).items():
        ways = graph.compositions(target)
        for spelling, u in spellings.items():
            if u in ways:
                rows.append((kind, spelling, float(ways[u].factor), float(ways[u].offset), u == target))
    return spark.createDataFrame(rows, "kind string, unit string, factor double, shift double, is_common boolean")


def convert(rows: DataFrame, table: DataFrame, kind: str = "kind", unit: str = "unit", amount: str = "amount", out: str = "converted") -> DataFrame:
    """Equi-join `rows` with the conversion table; a unit not in it gives a null `out`.

    The columns of `rows` are kept, whatever their names; `out` and `is_common` are added.
    """
    t = table.select(
        F.col("kind").alias("__kind"), F.col("unit").alias("__unit"), F.col("factor").alias("__factor"),
        F.col("shift").alias("__shift"), F.col("is_common").alias("__common"),
    )
    joined = rows.join(measured_side(t), (rows[kind] == F.col("__kind")) & (rows[unit] == F.col("__unit")), "left")
    return joined.withColumns({out: F.col(amount) * F.col("__factor") + F.col("__shift"), "is_common": F.col("__common")}).drop(
        "__kind", "__unit", "__factor", "__shift", "__common"
    )


# ----------------------------------------------------------------- reading cells

# One-character fractions.
VULGAR = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
# Words that say the weight of the item is meant, and words that lead to its unit.
WEIGHT_WORDS = ("weights?", "wts?", "gewicht[a-z]*", "poids", "pesos?", "vikt[a-z]*", "vægt[a-z]*", "waga", "wag[aię]")
UNIT_LEADS = ("in", "en", "em", "is", "unit", "units", "einheit", "unité", "unidad", "unità")
# Letters that name an edge.
EDGE_LABELS = "lwhdb"

_AMOUNT = rf"(?:[0-9]+\s+)?[0-9]+\s*/\s*[0-9]+|(?:[0-9]+\s*)?[{''.join(VULGAR)}]|[0-9.,]+"
_MARK = "\x01"


def _any_of(spellings: Iterable[str]) -> str:
    return "|".join(sorted(spellings, key=lambda s: (-len(s), s)))


def read_amount(c: Column) -> Column:
    """A double: a number by the project's grammar or a common fraction; null for anything else."""
    frac = r"^\s*(?:([0-9]+)\s+)?([0-9]+)\s*/\s*([0-9]+)\s*$"

    def fraction(x: Column) -> Column:
        for sign, text in VULGAR.items():
            x = F.replace(x, F.lit(sign), F.lit(f" {text}"))
        return let(
            F.split(F.regexp_replace(x, frac, "$1:$2:$3"), ":"),
            lambda p: F.coalesce(F.nullif(F.get(p, F.lit(0)), F.lit("")).try_cast("double"), F.lit(0.0))
            + F.try_divide(F.get(p, F.lit(1)).try_cast("double"), F.get(p, F.lit(2)).try_cast("double")),
        )

    return let(c, lambda x: F.when(x.rlike("^[0-9.,]+$"), number(x, "decimal(20,6)").cast("double")).otherwise(fraction(x)))


def _fields(c: Column, shape: str, groups: int) -> Column:
    """The groups of a match of the whole cell as an array, null if there is none: one pass."""
    marked = F.regexp_replace(c, shape, _MARK.join(f"${i + 1}" for i in range(groups)) + _MARK)
    return let(F.split(marked, _MARK, -1), lambda parts: F.when(F.size(parts) == groups + 1, parts))


_WEIGHT_SHAPE = rf"(?i)^({_AMOUNT})\s*([a-z#]*)\.?$"
_SUM_SHAPE = (
    rf"(?i)^({_AMOUNT})\s*({_any_of(POUND_SPELLINGS)})\.?\s*(?:,|and|&|\+)?\s*"
    rf"({_AMOUNT})\s*(?:{_any_of(OUNCE_SPELLINGS)})\.?$"
)
_WEIGHT_WORD = rf"(?<![\p{{L}}0-9])(?:{'|'.join(WEIGHT_WORDS)})(?![\p{{L}}0-9])"
# the first weight word of a sentence reaches all that later ones do; taking it for good keeps the search linear
_PHRASE = (
    rf"(?i)(?:^|[.<>;!?])(?>[^.<>;!?]*?{_WEIGHT_WORD})[^.<>;!?]*?"
    rf"(?<![\p{{L}}])(?:{'|'.join(UNIT_LEADS)})(?![\p{{L}}]):?\s+({_any_of(WEIGHT_UNITS)})(?![\p{{L}}0-9])"
)
# Tags within a sentence; all others end it.
INLINE_TAGS = (
    "a", "abbr", "b", "big", "cite", "code", "del", "em", "font", "i", "ins", "label", "mark", "q", "s", "small", "span", "strong", "sub",
    "sup", "tt", "u", "var", "wbr",
)
_INLINE = rf"(?i)</?(?:{'|'.join(INLINE_TAGS)})(?:\s[^<>]*)?/?>"


def _phrase_unit(description: Column) -> Column:
    """The spelling of the unit that a sentence names for the weight, of any length; empty if none does."""
    # the point of an abbreviated weight word ends no sentence
    open_ended = F.regexp_replace(F.regexp_replace(description, _INLINE, ""), rf"(?i)({_WEIGHT_WORD})\.", "$1 ")
    return F.lower(F.regexp_extract(open_ended, _PHRASE, 1))


def _unit_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(tidy(c)), r"\.+$", "")


def read_weight(cell: Column, unit_cell: Column, description: Column) -> Column:
    """struct<amount double, unit string, problem string> of a weight.

    Null for blanks, placeholders and 0. The unit is that of the cell, else the unit column, else the one a phrase of the description
    names for the weight. Pounds and ounces are added up in pounds. `problem` is null for blanks,
    placeholders and 0 as well as for weights that were read.
    """

    def outcome(x: Column) -> Column:
        known = x["unit"].isin(*WEIGHT_UNITS)
        problem = (
            F.when(x["amount"].isNull(), F.lit("no usable number")).when(x["unit"].isNull(), F.lit("no unit")).when(~known, F.lit("unknown unit"))
        )
        good = x["amount"].isNotNull() & F.coalesce(known, F.lit(False))
        return F.struct(F.when(good, x["amount"]).alias("amount"), F.when(good, x["unit"]).alias("unit"), problem.alias("problem"))

    def single(one: Column) -> Column:
        unit = F.coalesce(
            F.nullif(F.lower(F.get(one, F.lit(1))), F.lit("")),
            F.nullif(_unit_name(unit_cell), F.lit("")),
            F.nullif(_phrase_unit(description), F.lit("")),
        )
        return F.struct(read_amount(F.get(one, F.lit(0))).alias("amount"), F.when(one.isNotNull(), unit).alias("unit"))

    def summed(two: Column) -> Column:
        pounds = read_amount(F.get(two, F.lit(0))) + read_amount(F.get(two, F.lit(2))) / F.lit(ounces_a_pound())
        return F.struct(pounds.alias("amount"), F.lower(F.get(two, F.lit(1))).alias("unit"))

    def read(t: Column) -> Column:
        pair = F.when(t.rlike(_SUM_SHAPE), let(_fields(t, _SUM_SHAPE, 3), summed)).otherwise(let(_fields(t, _WEIGHT_SHAPE, 2), single))
        return F.when(~t.isin("", *PLACEHOLDERS_WIDE, "0"), let(pair, outcome))

    return let(F.coalesce(join_thousands(tidy(cell)), F.lit("")), read)


_LENGTH = _any_of(LENGTH_UNITS)
_EDGE = rf"(?:[{EDGE_LABELS}]\s*)?({_AMOUNT})\s*({_LENGTH})?\.?"
_BY = r"\s*(?:x|×|\*|by)\s*"
_DIM_SHAPE = rf"(?i)^(?:({_LENGTH})\s*:\s*)?{_EDGE}{_BY}{_EDGE}{_BY}{_EDGE}$"


def read_dimensions(cell: Column) -> Column:
    """struct<amounts array<double>, units array<string>, problem string> of three edges.

    An edge without a unit takes the one unit in the cell; if there is none, or there are
    several, the cell is a problem.
    """

    def judged(x: Column) -> Column:
        no_number = F.exists(x["amounts"], lambda a: a.isNull())
        no_unit = F.exists(x["units"], lambda u: u.isNull())
        problem = F.when(no_number, F.lit("no usable number")).when(no_unit, F.lit("no unit"))
        return let(
            problem,
            lambda p: F.struct(F.when(p.isNull(), x["amounts"]).alias("amounts"), F.when(p.isNull(), x["units"]).alias("units"), p.alias("problem")),
        )

    known = F.create_map(*[F.lit(x) for pair in LENGTH_UNITS.items() for x in pair])

    def edges(got: Column) -> Column:
        given = F.filter(F.array(*[F.lower(F.get(got, F.lit(i))) for i in (0, 2, 4, 6)]), lambda u: u != "")
        # units, not their spellings: cm and centimetre are one; a unit's name is one of its spellings
        named = F.array_distinct(F.transform(given, lambda u: F.try_element_at(known, u)))
        written = F.array(*[F.lower(F.get(got, F.lit(i))) for i in (2, 4, 6)])
        units = let(
            F.when(F.size(named) == 1, F.get(named, F.lit(0))),
            lambda only: F.transform(written, lambda u: F.when(u != "", u).otherwise(only)),
        )
        amounts = F.transform(F.array(*[F.get(got, F.lit(i)) for i in (1, 3, 5)]), read_amount)
        none = F.struct(F.lit(None).cast("array<double>").alias("amounts"), F.lit(None).cast("array<string>").alias("units"), F.lit("not three measured edges").alias("problem"))
        return F.when(got.isNull(), none).otherwise(let(F.struct(amounts.alias("amounts"), units.alias("units")), judged))

    def read(t: Column) -> Column:
        return F.when(~t.isin("", *PLACEHOLDERS_WIDE, "0"), let(_fields(t, _DIM_SHAPE, 7), edges))

    return let(F.coalesce(join_thousands(tidy(cell)), F.lit("")), read)


MEASURES = ("length_mm", "width_mm", "height_mm")


def measured(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, measure, kind, amount, unit, cell_common): every readable quantity of feed rows.

    One row per weight, three per dimensions cell. `weight`, `weight_unit`, `dimensions` and
    `description` are read as delivered; cells without a readable quantity give no row (see
    `unusable`). Null keys are kept; repeated rows give repeated results.
    """
    base = rows.select(
        F.col(key),
        read_weight(F.col("weight"), F.col("weight_unit"), F.col("description")).alias("__w"),
        read_dimensions(F.col("dimensions")).alias("__d"),
    )
    common_length = [s for s, u in LENGTH_UNITS.items() if u == "mm"]
    item = "struct<measure:string,kind:string,amount:double,unit:string,cell_common:boolean>"
    weight = F.when(
        F.col("__w.amount").isNotNull(),
        F.array(F.struct(F.lit("weight_g").alias("measure"), F.lit("weight").alias("kind"), F.col("__w.amount").alias("amount"), F.col("__w.unit").alias("unit"), F.lit(None).cast("boolean").alias("cell_common"))),
    )
    all_mm = F.forall(F.col("__d.units"), lambda u: u.isin(*common_length))
    edges = F.when(
        F.col("__d.amounts").isNotNull(),
        F.array(*[
            F.struct(F.lit(m).alias("measure"), F.lit("length").alias("kind"), F.get(F.col("__d.amounts"), F.lit(i)).alias("amount"), F.get(F.col("__d.units"), F.lit(i)).alias("unit"), all_mm.alias("cell_common"))
            for i, m in enumerate(MEASURES)
        ]),
    )
    none = F.array().cast(f"array<{item}>")
    items = F.concat(F.coalesce(weight.cast(f"array<{item}>"), none), F.coalesce(edges.cast(f"array<{item}>"), none))
    return base.select(key, F.explode(items).alias("__i")).select(key, "__i.*")


def converted(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, measure, value double, tenths bigint, was_common): all quantities in common units.

    was_common tells whether the cell was in grams, or all three edges in millimetres, already.
    """
    out = convert(measured(rows, key), conversion_table(rows.sparkSession), out="value")
    return out.select(
        key,
        "measure",
        "value",
        F.round(F.col("value") * 10).cast("bigint").alias("tenths"),
        F.coalesce("cell_common", "is_common").alias("was_common"),
    )


def unusable(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, field, cell, problem): cells that name no usable unit or number."""
    w = read_weight(F.col("weight"), F.col("weight_unit"), F.col("description"))
    d = read_dimensions(F.col("dimensions"))
    items = F.array(
        F.struct(F.lit("weight").alias("field"), F.col("weight").alias("cell"), w["problem"].alias("problem")),
        F.struct(F.lit("dimensions").alias("field"), F.col("dimensions").alias("cell"), d["problem"].alias("problem")),
    )
    return rows.select(key, F.inline(F.filter(items, lambda x: x["problem"].isNotNull())))
