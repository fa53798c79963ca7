"""Filling fixed-capacity containers with items: minimum bin slack on the histogram of lengths.

Only lengths matter to packing, so the heuristic runs on the histogram (at most one entry per length up to the
capacity, whatever the corpus size). Each window takes the longest remaining length and fills what is left by a
bitset subset-sum over the remaining multiset; the fill closest to capacity is backtracked to counts per length
and repeated as often as the remaining counts allow. Items then find their container by their rank within their
length, counted per (length, salt) with as many salts as the length's own number of items asks for, so that a length
shared by a third of all items (full pieces of long texts, say) is ranked in many tasks.

Defined results: an item longer than the capacity is cut into full pieces and one rest, others never; items
without tokens take no room and are put into container 0; null texts count as empty. The result is the same
whatever the partitioning. Empty input gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import RANKS, token_counts

CAPACITY = 2048
#: Items of one length that are ranked in one task, about.
RANKED = 100_000


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts per length of the multiset with the greatest sum of at most ``room``; longer lengths are tried first.

    Bit s of ``reach`` says that sum s can be made. Multiplicities go in as powers of two, each kept with the
    state before it for the way back.
    """
    reach, trail = 1, []
    full, goal = (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0 and not reach & goal:
            take = min(part, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts per length, how many containers are filled so), covering the histogram exactly."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    out = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        window = best_fill(rest, capacity - longest)
        window[longest] = window.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in window.items())
        for x, n in window.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((window, times))
    return out


def slots(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first container, items of this length per container), sorted; every rank of a
    length falls to exactly one row."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for window, times in patterns(histogram, capacity):
        for x, n in window.items():
            rows.append((x, used.get(x, 0), container, n))
            used[x] = used.get(x, 0) + n * times
        container += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(documents: DataFrame, capacity: int = CAPACITY, ranks: str = RANKS, ranked: int = RANKED) -> DataFrame:
    """doc_id, piece, token_from, tokens, container_id."""
    return pack_counts(token_counts(documents, "doc_id", "text", ranks), capacity, ranked)


def pack_counts(counts: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """As ``pack`` for a table of doc_id and tokens."""
    spark = counts.sparkSession
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    items = counts.withColumn("__n", pieces).select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("piece"))
    items = items.select(
        "doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("token_from"),
        F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece").cast("bigint") * capacity).alias("tokens"),
    )
    # Read three times (histogram, salts, assignment) and costly to make, so it is written once where executors may be lost.
    items = cut_lineage(items)
    # One row per length, at most capacity + 1; one per length and ``ranked`` items of it.
    sizes = {r[0]: r[1] for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = spark.createDataFrame([(x, -(-n // ranked)) for x, n in sizes.items()], "tokens bigint, __salts bigint")
    items = items.join(F.broadcast(shares), "tokens").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__salts")))
    per_salt = items.groupBy("tokens", "__salt").agg(F.count(F.lit(1)).alias("n")).collect()
    first_of = np.zeros(capacity + 2, dtype=np.int64)
    for x, n in sizes.items():
        first_of[x + 1] = -(-n // ranked)
    first_of = np.cumsum(first_of)
    starts, seen = np.zeros(int(first_of[-1]) + 1, dtype=np.int64), {}
    for r in sorted(per_salt, key=lambda r: (r[0], r[1])):
        starts[first_of[r[0]] + r[1]] = seen.get(r[0], 0)
        seen[r[0]] = seen.get(r[0], 0) + r[2]
    table = spark.sparkContext.broadcast((slots({x: n for x, n in sizes.items() if x > 0}, capacity), first_of, starts))
    ranks = items.withColumn("__rank", F.row_number().over(Window.partitionBy("tokens", "__salt").orderBy("doc_id", "piece")).cast("bigint") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, base, first = table.value
        keys = rows[:, 0] << 40 | rows[:, 1]
        for b in batches:
            tokens, salt, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
            rank = rank + first[base[tokens] + salt]
            container = np.zeros(len(tokens), dtype=np.int64)
            some = tokens > 0
            hit = np.searchsorted(keys, tokens[some] << 40 | rank[some], side="right") - 1
            container[some] = rows[hit, 2] + (rank[some] - rows[hit, 1]) // rows[hit, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(container)], names=["doc_id", "piece", "token_from", "tokens", "container_id"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    return ranks.select("doc_id", "piece", "token_from", "tokens", "__salt", "__rank").mapInArrow(place, f"doc_id {kind}, piece int, token_from bigint, tokens bigint, container_id bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, least possible number, tokens, and the share of room left over."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"))
    out = per.agg(F.count_if(F.col("t") > 0).alias("n_containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"))
    return out.select("n_containers", F.ceil(F.col("n_tokens") / capacity).alias("least_possible"), "n_tokens", "fullest", F.round(F.try_divide(F.lit(1.0) * F.col("n_containers") * capacity - F.col("n_tokens"), F.lit(1.0) * F.col("n_containers") * capacity), 6).alias("room_left"))
