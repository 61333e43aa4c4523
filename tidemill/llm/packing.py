"""Filling fixed-capacity containers with items (problem 7).

The lengths' histogram is all that is planned on, and it has at most `capacity` entries however
many items there are. Shallow combinations of up to three lengths that fill a window below the
capacity are enumerated; non-negative least squares finds how often to use each so that they use
the histogram up; the counts are rounded down, and what is left is packed greedily. Items are
numbered within their length where they lie, partition by partition, and a number's place in the plan is
its container. Full cuts of long texts need no plan: each is a container of its own. Nothing is sorted,
and no length, however frequent, comes together in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemill.session import checkpointed

#: Unused share of a container that a planned combination may leave.
WINDOW = 0.01
#: Largest capacity: the histogram and the plan are as long.
MAX_CAPACITY = 1_000_000
#: Offsets are broadcast up to this many rows, as counted; beyond it they meet the items in a join.
OFFSET_ROWS = 1_000_000
#: Bits for an item's number within its length.
NUMBER_BITS = 40

Pattern = tuple[tuple[int, int], ...]


def combinations(lengths: list[int], capacity: int, window: float = WINDOW) -> list[Pattern]:
    """Patterns ((length, times), ...) of one to three lengths that leave at most the window free."""
    slack = max(1, int(capacity * window))
    out: set[Pattern] = set()

    def fits(total: int) -> bool:
        return capacity - slack <= total <= capacity

    def longest(most: int) -> int:
        i = bisect_right(lengths, most)
        return lengths[i - 1] if i else 0

    for a in lengths:
        most = capacity // a
        # from many of the length to a single one, in halving steps
        for m in sorted({most, most - 1, *(most >> k for k in range(1, most.bit_length()))}):
            if m < 1:
                continue
            free = capacity - m * a
            if fits(m * a):
                out.add(((a, m),))
            for k in (1, 2, 3, 5, 8):
                b = longest(free // k) if free >= k else 0
                if not b or b == a:
                    continue
                rest = free - k * b
                if fits(m * a + k * b):
                    out.add(tuple(sorted(((a, m), (b, k)))))
                c = longest(rest) if rest else 0
                if c and c not in (a, b) and fits(m * a + k * b + c):
                    out.add(tuple(sorted(((a, m), (b, k), (c, 1)))))
    return sorted(out)


def nnls(patterns: list[Pattern], counts: dict[int, int], rounds: int = 400) -> np.ndarray:
    """x >= 0 minimising ||A x - h||, A the patterns' length counts, by multiplicative updates."""
    row = {n: i for i, n in enumerate(counts)}
    r = np.array([row[n] for p in patterns for n, _ in p])
    c = np.array([j for j, p in enumerate(patterns) for _ in p])
    v = np.array([m for p in patterns for _, m in p], dtype=float)
    h = np.array(list(counts.values()), dtype=float)
    goal = np.bincount(c, weights=v * h[r], minlength=len(patterns))
    x = goal / np.maximum(1e-12, np.bincount(c, weights=v * np.bincount(r, weights=v, minlength=len(h))[r], minlength=len(patterns)))
    for _ in range(rounds):
        ax = np.bincount(r, weights=v * x[c], minlength=len(h))
        x *= goal / np.maximum(1e-12, np.bincount(c, weights=v * ax[r], minlength=len(patterns)))
    return x


def plan(counts: dict[int, int], capacity: int, window: float = WINDOW) -> list[tuple[Pattern, int]]:
    """(pattern, times used) that use every item of `counts` (length -> items, lengths 1..capacity) once."""
    left = {n: k for n, k in sorted(counts.items()) if k > 0}
    out: list[tuple[Pattern, int]] = []

    def use(p: Pattern, wanted: int) -> None:
        times = min([wanted, *(left.get(n, 0) // m for n, m in p)])
        if times > 0:
            out.append((p, times))
            for n, m in p:
                left[n] -= m * times
                if not left[n]:
                    del left[n]

    patterns = combinations(list(left), capacity, window)
    if patterns:
        x = nnls(patterns, dict(left))
        order = np.argsort(-x, kind="stable")
        for j in order:
            use(patterns[j], int(x[j] + 1e-9))
        for j in order:  # what rounding down left of the planned combinations
            use(patterns[j], 1 + int(x[j]))
    lengths = sorted(left)
    while lengths:
        free, chosen = capacity, []
        top = len(lengths)
        while top:
            n = lengths[top - 1]
            m = min(left[n], free // n)
            if m:
                chosen.append((n, m))
                free -= n * m
            top = min(top - 1, bisect_right(lengths, free))
        use(tuple(chosen), max(left.values()))
        lengths = [n for n in lengths if n in left]
    return out


class Places:
    """Containers by (pack, length, number of the item), as flat arrays in one order."""

    def __init__(self, histogram: dict[int, dict[int, int]], sizes: dict[int, int], window: float) -> None:
        self.packs = sorted(sizes)
        self.width = max(sizes.values()) + 1
        self.planned: dict[int, int] = {}
        runs: list[tuple[int, int, int, int]] = []
        for at, p in enumerate(self.packs):
            used: dict[int, int] = {}
            base = 0
            for pattern, times in plan({n: k for n, k in histogram[p].items() if 0 < n < sizes[p]}, sizes[p], window):
                for n, m in pattern:
                    runs.append((at * self.width + n, used.get(n, 0), base, m))
                    used[n] = used.get(n, 0) + m * times
                base += times
            self.planned[p] = base
        table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
        self.keys, self.starts, self.bases, self.each = (table[:, 0] << NUMBER_BITS) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def container_of(places: dict, pack: np.ndarray, length: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The planned container of each item; `places` holds the attributes of Places."""
    code = np.searchsorted(places["packs"], pack) * places["width"] + length
    i = np.searchsorted(places["keys"], (code << NUMBER_BITS) + number, side="right") - 1
    return places["bases"][i] + (number - places["starts"][i]) // places["each"][i]


def numbered(tokens: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(doc_id, part, pack_id, piece, start_token, n_tokens, number): whole items, and cuts of those over the capacity.

    number counts the items of one length within a partition (`part`), from 0. A null n_tokens is 0.
    """
    packs = sorted(sizes.items())
    more = [StructField("part", IntegerType()), *[StructField(c, LongType()) for c in ("pack_id", "piece", "start_token", "n_tokens", "number")]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        met = {p: np.zeros(c + 1, dtype=np.int64) for p, c in packs}
        for batch in batches:
            n = batch.column("n_tokens").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for p, c in packs:
                full, rest = n // c, n % c
                count = full + ((rest > 0) | (n == 0))
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                size = np.where(piece < full[row], c, rest[row])
                order = np.argsort(size, kind="stable")
                ranked = size[order]
                first = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, dtype=bool)
                at = np.flatnonzero(first)
                within = np.arange(len(ranked)) - np.repeat(at, np.diff(np.r_[at, len(ranked)]))
                number = np.empty(len(size), dtype=np.int64)
                number[order] = within + met[p][ranked]
                met[p] += np.bincount(size, minlength=c + 1)
                same = lambda v: pa.array(np.full(len(size), v, dtype=np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), same(part).cast(pa.int32()), same(p), pa.array(piece), pa.array(piece * c), pa.array(size), pa.array(number)],
                    names=["doc_id", *[f.name for f in more]],
                )

    return tokens.select("doc_id", "n_tokens").mapInArrow(cut, StructType([tokens.schema["doc_id"], *more]))


def pack(tokens: DataFrame, sizes: dict[int, int], window: float = WINDOW) -> DataFrame:
    """(pack_id, container_id, doc_id, piece, start_token, n_tokens) for each capacity of `sizes`.

    `tokens` has doc_id and n_tokens. Only items longer than a capacity are cut, into full
    containers and a rest. Items without tokens go to container 0. Repeated rows are items of their
    own. An empty table, or no sizes, gives no rows.
    """
    if any(not 0 < c <= MAX_CAPACITY for c in sizes.values()):
        raise ValueError(f"capacities are 1 to {MAX_CAPACITY} tokens")
    columns = ("doc_id", "piece", "start_token", "n_tokens")
    if not sizes:
        return numbered(tokens, {0: 1}).where(F.lit(False)).select("pack_id", F.lit(0).cast("bigint").alias("container_id"), *columns)
    items = checkpointed(numbered(tokens, sizes))  # written once, so numbers stay what they were counted as
    per_part = checkpointed(items.groupBy("pack_id", "n_tokens", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram: dict[int, dict[int, int]] = {p: {} for p in sizes}
    for r in per_part.groupBy("pack_id", "n_tokens").agg(F.sum("n").alias("n")).collect():  # at most a row per token of capacity
        histogram[r["pack_id"]][r["n_tokens"]] = r["n"]
    places = Places(histogram, sizes, window)
    shipped = tokens.sparkSession.sparkContext.broadcast(vars(places))  # plain arrays, which workers read without this class

    @F.pandas_udf("bigint")
    def container(pack_id: pd.Series, length: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(container_of(shipped.value, pack_id.to_numpy(), length.to_numpy(), number.to_numpy()))

    # a row per partition that holds a length
    before = Window.partitionBy("pack_id", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        F.col("part").alias("__part"), F.col("pack_id").alias("__pack"), F.col("n_tokens").alias("__n"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")
    )
    side = F.broadcast(offsets) if per_part.count() <= OFFSET_ROWS else offsets
    met = items.join(side, (F.col("part") == F.col("__part")) & (F.col("pack_id") == F.col("__pack")) & (F.col("n_tokens") == F.col("__n")))
    number = (F.col("__before") + F.col("number")).cast("bigint")
    of_pack = lambda values: F.try_element_at(F.create_map(*[x for p, v in sorted(values.items()) for x in (F.lit(p).cast("bigint"), F.lit(v).cast("bigint"))]), F.col("pack_id"))
    is_full, has_room = F.col("n_tokens") == of_pack(sizes), F.col("n_tokens") == 0
    planned = container("pack_id", "n_tokens", number)
    placed = met.withColumn("__number", number)
    # full cuts come after all planned containers, one each; items without tokens need no room
    alone = F.when(has_room, F.lit(0).cast("bigint")).when(is_full, of_pack(places.planned) + F.col("__number"))
    rest = placed.where(~is_full & ~has_room).select("pack_id", planned.alias("container_id"), *columns)
    return rest.unionByName(placed.where(is_full | has_room).select("pack_id", alone.alias("container_id"), *columns))


def fill(packed: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(pack_id, capacity, containers, least_containers, tokens, fill, cut_items) of a packing."""
    capacity = F.create_map(*[x for p, c in sorted(sizes.items()) for x in (F.lit(p).cast("bigint"), F.lit(c).cast("bigint"))])
    each = packed.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count_if(F.col("piece") == 1).alias("cut"))
    total = each.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("cut").alias("cut_items"))
    size = F.try_element_at(capacity, F.col("pack_id"))
    return total.select(
        "pack_id", size.alias("capacity"), "containers", F.ceil(F.col("tokens") / size).alias("least_containers"), "tokens", "fullest",
        (F.col("tokens") / (F.col("containers") * size)).alias("fill"), "cut_items",
    )
