"""Title casing as bounded nested array transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import let

_EDGE = r"""[.,()\[\]"']"""


def _literal_map(pairs: Mapping[str, str]) -> Column | None:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.create_map(*flat) if flat else None


def title_case(c: Column, acronyms: Mapping[str, str] | None = None, minor_words: Sequence[str] = ()) -> Column:
    """Case each word of `c`; a null gives null.

    A word's core (without brackets, quotes and stops at its ends) is looked up in `acronyms`
    (lower case -> spelling) first. Compounds are cased part by part, at hyphens and then at
    slashes. Measurements such as 12mm become lower case, other words with a digit upper case,
    minor words inside the title lower case. The later parts of a compound are inside a title of
    more than two words, wherever the compound stands.
    """
    known = _literal_map(acronyms or {})
    minors = list(minor_words)

    def leaf(core: Column, inner: Column) -> Column:
        low = F.lower(core)
        out = F.when(core.rlike(r"(?i)^[0-9]+(\.[0-9]+)?[a-z]{1,3}$"), low).when(core.rlike("[0-9]"), F.upper(core))
        if minors:
            out = out.when(low.isin(*minors) & inner, low)
        return out.otherwise(F.concat(F.upper(F.left(core, F.lit(1))), F.lower(F.substring(core, 2, 2**31 - 1))))

    def word(w: Column, inner: Column, roomy: Column, seps: tuple[str, ...]) -> Column:
        edges = F.struct(
            F.regexp_extract(w, f"^({_EDGE}*)", 1).alias("head"),
            F.regexp_replace(w, f"^{_EDGE}+|{_EDGE}+$", "").alias("core"),
        )

        def part(rest: tuple[str, ...]):
            return lambda p, j: word(p, F.when(j == 0, inner).otherwise(roomy), roomy, rest)

        def cased(k: Column) -> Column:
            out = None
            for i, sep in enumerate(seps):
                compound = F.contains(F.regexp_replace(k, f"^{sep}+|{sep}+$", ""), F.lit(sep))
                joined = F.array_join(F.transform(F.split(k, sep), part(seps[i + 1 :])), sep)
                out = F.when(compound, joined) if out is None else out.when(compound, joined)
            plain = leaf(k, inner)
            out = plain if out is None else out.otherwise(plain)
            return F.coalesce(F.try_element_at(known, F.lower(k)), out) if known is not None else out

        def put_back(x: Column) -> Column:
            tail = F.substring(w, F.length(x["head"]) + F.length(x["core"]) + 1, F.length(w))
            return F.when(x["core"] == "", w).otherwise(F.concat(x["head"], cased(x["core"]), tail))

        return let(edges, put_back)

    def whole(words: Column) -> Column:
        return F.array_join(F.transform(words, lambda w, i: word(w, (i > 0) & (i < F.size(words) - 1), F.size(words) > 2, ("-", "/"))), " ")

    return let(F.split(c, " "), whole)
