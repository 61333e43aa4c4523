"""Mixing sources to target weights (problem 8).

Which documents of a source are used one time more than the others is decided by a threshold on
a hash of their id, so the selection is a filter and nothing is sorted. The threshold comes from
token sums per source and hash bucket: the bucket in which a source's budget runs out is the only
one looked into again, at ten more bits of the hash, until it holds a single document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import checkpointed

BITS, STEP = 63, 10
#: Most sources that may have a target; sums per source and bucket reach the driver.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Target:
    share: float
    repeats: int


@dataclass(frozen=True)
class Ration:
    """Every document of the source `passes` times, those hashed below `threshold` once more."""

    passes: int
    threshold: int


def hashed(c: Column) -> Column:
    """A uniform whole number below 2**63 for each id."""
    return F.shiftrightunsigned(F.xxhash64(c, F.lit("mixture")), 1)


def budget(sizes: dict[str, int], targets: dict[str, Target]) -> float:
    """The largest total at which no source must be used more than its repeats allow."""
    limits = [targets[s].repeats * sizes.get(s, 0) / targets[s].share for s in targets if targets[s].share > 0]
    return min(limits, default=0.0)


def thresholds(tokens: DataFrame, wanted: dict[str, float]) -> dict[str, int]:
    """source -> hash below which its documents hold `wanted` tokens, within half a document."""
    prefix = {s: 0 for s, w in wanted.items() if w > 0}
    taken = dict.fromkeys(prefix, 0)
    done = {s: 0 for s in wanted if s not in prefix}
    shift = BITS
    while prefix and shift > 0:
        shift = max(0, shift - STEP)
        open_at = F.create_map(*[x for s, p in prefix.items() for x in (F.lit(s), F.lit(p).cast("bigint"))])
        width = min(STEP, BITS - shift)
        here = tokens.where(F.shiftright("__h", min(63, shift + width)) == F.try_element_at(open_at, F.col("source")))
        bucket = F.shiftright("__h", shift)
        sums: dict[str, list[tuple[int, int, int]]] = {}
        for r in here.groupBy("source", bucket.alias("b")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():
            sums.setdefault(r["source"], []).append((r["b"], r["t"], r["n"]))
        for s in list(prefix):
            edge = None
            for b, t, n in sorted(sums.get(s, [])):
                if taken[s] + t > wanted[s]:
                    edge = (b, t, n)
                    break
                taken[s] += t
            if edge is None:  # the whole range is within the budget
                done[s] = (prefix[s] + 1) << (shift + width)
            elif edge[2] == 1 or shift == 0:
                more = taken[s] + edge[1] - wanted[s] < wanted[s] - taken[s]
                done[s] = (edge[0] + (1 if more else 0)) << shift
            else:
                prefix[s] = edge[0]
            if s in done:
                del prefix[s]
    return done


def rations(tokens: DataFrame, targets: dict[str, Target]) -> dict[str, Ration]:
    sizes = {r["source"]: r["t"] for r in tokens.where(F.col("source").isin(*targets)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total = budget(sizes, targets)
    passes, rest = {}, {}
    for s, t in targets.items():
        need = total * t.share
        passes[s] = min(t.repeats, int(need / sizes[s] + 1e-12)) if sizes.get(s) else 0
        rest[s] = need - passes[s] * sizes.get(s, 0) if passes[s] < t.repeats else 0.0
    cut = thresholds(tokens, rest)
    return {s: Ration(passes[s], min(cut.get(s, 0), 2**63 - 1)) for s in targets}


def mixture(tokens: DataFrame, targets: dict[str, Target]) -> tuple[DataFrame, dict[str, Ration]]:
    """(doc_id, source, n_tokens, repeats) of the documents used, and the rations they follow.

    `tokens` has doc_id, source and n_tokens. Documents of other sources, or of none, are not
    used. The total is the largest the repeats allow; a target whose source holds no tokens makes it
    0. Rows that repeat an id are used or left together. Documents without tokens follow the
    same thresholds.
    """
    if len(targets) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not targets:
        return tokens.select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats")).where(F.lit(False)), {}
    kept = tokens.where(F.col("source").isin(*targets)).select("doc_id", "source", "n_tokens", hashed(F.col("doc_id")).alias("__h"))
    kept = checkpointed(kept)  # counted once, filtered several times
    plan = rations(kept, targets)
    of = lambda values: F.try_element_at(F.create_map(*[x for s, v in values for x in (F.lit(s), F.lit(v).cast("bigint"))]), F.col("source"))
    once_more = F.col("__h") < of([(s, r.threshold) for s, r in plan.items()])
    times = (of([(s, r.passes) for s, r in plan.items()]) + once_more.cast("int")).cast("int")
    return kept.select("doc_id", "source", "n_tokens", times.alias("repeats")).where(F.col("repeats") > 0), plan


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_repeats, tokens, actual_share) per target."""
    by = mixed.groupBy(F.col("source").alias("__s")).agg(
        F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens")
    )
    joined = targets.select("source", "target_share", "max_repeats").join(by, F.col("source") == F.col("__s"), "left")
    joined = joined.withColumn("__all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # one row per target
    return joined.select(
        "source", "target_share", "max_repeats",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("documents", "most_repeats", "tokens")],
        F.coalesce(F.try_divide(F.col("tokens"), F.col("__all")), F.lit(0.0)).alias("actual_share"),
    )
