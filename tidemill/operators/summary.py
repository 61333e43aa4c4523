"""Counts of a run, as DataFrames and as text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.normalize import CHANGED, REJECT, REVIEW, UNRESOLVED
from tidemill.operators.outputs import is_clean

TOP = 4
#: Names a list in the report shows.
NAMED = 3


def totals(rows: DataFrame) -> DataFrame:
    """One row: rows_in, clean, rejected, flagged, dropped, tied, groups, rows_involved, backfills, rows_changed."""
    edited = F.exists("changes", lambda c: (c["outcome"] == CHANGED) & ~F.startswith(c["rule"], F.lit("dedupe.")))
    once = (F.col("role") == "kept") | ((F.col("role") == "tied"))
    return rows.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(is_clean()).alias("clean"),
        F.count_if("rejected").alias("rejected"),
        F.count_if(is_clean() & F.col("needs_review")).alias("flagged"),
        F.count_if(F.col("role") == "dropped").alias("dropped"),
        F.count_if(F.col("role") == "tied").alias("tied"),
        F.countDistinct(F.when(once, F.col("sku_key"))).alias("groups"),
        F.count_if(F.col("role").isin("kept", "dropped", "tied")).alias("rows_involved"),
        F.coalesce(F.sum("backfills"), F.lit(0)).alias("backfills"),
        F.count_if(edited).alias("rows_changed"),
    )


def rule_counts(rows: DataFrame) -> DataFrame:
    """(kind, rule, n, first_line): changes by rule, and rejections and flags once per row and rule."""
    changes = rows.select("line", F.inline("changes")).where(~F.startswith(F.col("rule"), F.lit("dedupe.")) & F.col("outcome").isin(CHANGED, UNRESOLVED))
    by_change = changes.select(F.when(F.col("outcome") == CHANGED, F.lit("normalized")).otherwise(F.lit("unresolved")).alias("kind"), "rule", "line")

    def once(kept, severity: str, kind: str) -> DataFrame:
        rules = F.array_distinct(F.transform(F.filter("issues", lambda x: x["severity"] == severity), lambda x: x["rule"]))
        return rows.where(kept).select(F.lit(kind).alias("kind"), F.explode(rules).alias("rule"), "line")

    every = by_change.union(once(F.col("rejected"), REJECT, "reject")).union(once(is_clean(), REVIEW, "flag"))
    return every.groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def top_rules(counts: DataFrame, kind: str, k: int = TOP) -> DataFrame:
    """The k most frequent rules of a kind; ties go to the one met first."""
    return counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "first_line", "rule").limit(k).select("rule", "n")


def reasons(rows: DataFrame) -> DataFrame:
    """(reason, n): groups decided by each reason."""
    decided = rows.where(F.col("role").isin("kept", "tied"))
    return decided.groupBy("reason").agg(F.countDistinct("sku_key").alias("n"))


def unmapped_vendors(rows: DataFrame) -> DataFrame:
    return rows.where(is_clean() & F.col("v.vendor_unmapped").isNotNull() & (F.col("v.vendor") != "")).select(F.col("v.vendor").alias("vendor")).distinct()


@dataclass
class Summary:
    source: str
    profile: str
    totals: dict[str, int]
    rules: dict[str, list[tuple[str, int]]]
    reasons: dict[str, int]
    mapped: int
    unmapped: list[str]
    #: Vendors without an alias: the first NAMED, and how many there are.
    vendors: list[str]
    n_vendors: int
    files: dict[str, int] = field(default_factory=dict)


def summarise(rows: DataFrame, source: str, profile: str, mapped: int, unmapped: list[str]) -> Summary:
    """Collects counts only: one row of totals, one per rule and reason, and the vendors to show."""
    rules: dict[str, list[tuple[str, int]]] = {}
    for r in rule_counts(rows).orderBy(F.desc("n"), "first_line", "rule").collect():
        rules.setdefault(r["kind"], []).append((r["rule"], r["n"]))
    unlisted = unmapped_vendors(rows)
    vendors = [r["vendor"] for r in unlisted.orderBy("vendor").limit(NAMED).collect()]
    return Summary(source, profile, totals(rows).first().asDict(), rules, {r["reason"]: r["n"] for r in reasons(rows).collect()}, mapped, unmapped, vendors, unlisted.count())


def _breakdown(pairs: list[tuple[str, int]], k: int = TOP) -> list[str]:
    lines = [f"    {rule:<34}{n:>8}" for rule, n in pairs[:k]]
    if len(pairs) > k:
        label = f"{len(pairs) - k} more rules"
        lines.append(f"    {label:<34}{sum(n for _, n in pairs[k:]):>8}")
    return lines


def _named(names: list[str], n: int, k: int = NAMED) -> str:
    return ", ".join(names[:k]) + (f" and {n - k} more" if n > k else "")


def _sum(s: Summary, kind: str) -> int:
    return sum(n for _, n in s.rules.get(kind, []))


def render(s: Summary) -> str:
    """The full report."""
    t = s.totals
    out = [f"source   {s.source}", f"profile  {s.profile}", ""]
    out.append(f"{t['rows_in']} rows read: {t['clean']} clean ({t['flagged']} of them to review), {t['rejected']} rejected, {t['dropped']} dropped as duplicates")
    out += ["", f"duplicates  {t['groups']} skus on {t['rows_involved']} rows"]
    out += [f"    {reason:<34}{n:>8}" for reason, n in sorted(s.reasons.items(), key=lambda x: (-x[1], x[0]))]
    out.append(f"    {'cells filled from dropped rows':<34}{t['backfills']:>8}")
    for title, kind in (("edits", "normalized"), ("unreadable", "unresolved"), ("rejections", "reject"), ("reviews", "flag")):
        out += ["", f"{title}  {_sum(s, kind)}", *(_breakdown(s.rules.get(kind, [])) or ["    none"])]
    out += ["", f"headers  {s.mapped} mapped, {len(s.unmapped)} carried along" + (f": {_named(s.unmapped, len(s.unmapped))}" if s.unmapped else "")]
    if s.vendors:
        out.append(f"vendors without an alias  {s.n_vendors}: {_named(s.vendors, s.n_vendors)}")
    out += ["", *(f"{name:<24}{n:>8} rows" for name, n in s.files.items())]
    return "\n".join(out).rstrip() + "\n"


def render_brief(s: Summary) -> str:
    """At most eight lines."""
    t = s.totals
    top = lambda kind: ", ".join(f"{r} {n}" for r, n in s.rules.get(kind, [])[:3]) or "none"
    out = [f"{s.source}: {t['rows_in']} rows, {t['clean']} clean, {t['rejected']} rejected, {t['flagged']} to review"]
    if t["groups"]:
        out.append(f"duplicates: {t['groups']} skus, {t['dropped']} rows dropped, {t['tied']} tied")
    out.append(f"edits: {_sum(s, 'normalized')}, unreadable: {_sum(s, 'unresolved')}")
    out += [f"rejections: {top('reject')}", f"reviews: {top('flag')}", f"headers: {s.mapped} mapped, {len(s.unmapped)} not"]
    out.append(", ".join(f"{k} {v}" for k, v in s.files.items()))
    return "\n".join(x for x in out if x) + "\n"
