"""Filling fixed-capacity containers: a configuration linear program over the length histogram.

Covering LP: choose how often to use each configuration (a multiset of lengths within the capacity) so that all items
are covered with the fewest containers. Multiplicative weights keep a price per length; each round a knapsack dynamic
program finds the configuration of the highest price. The averaged solution is rounded down and what is left over is
placed by best fit. Only the histogram (at most ``capacity`` rows) reaches the driver; items are then assigned by
their rank within their length, which is computed in two distributed passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value for each room, and the length that is taken there (-1: leave one free)."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = upto[c]
        value[c] = value[c - 1]
        if n:
            offers = prices[:n] + value[c - lengths[:n]]
            best = int(offers.argmax())
            if offers[best] > value[c]:
                value[c], pick[c] = offers[best], best
    return value, pick


def configuration(first: int, pick: np.ndarray, lengths: np.ndarray, by_value: np.ndarray, supply: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset that holds length ``first``, with at most ``supply`` of each; room that this frees is filled again."""
    out = np.zeros(len(lengths), dtype=np.int64)
    out[first], room, c = 1, capacity - int(lengths[first]), capacity - int(lengths[first])
    while c > 0:
        at = int(pick[c])
        if at < 0:
            c -= 1
            continue
        c -= int(lengths[at])
        if out[at] < supply[at]:
            out[at] += 1
            room -= int(lengths[at])
    while True:  # the largest lengths that fit, so that little stays free
        fits = np.flatnonzero((lengths <= room) & (out < supply))
        if not len(fits):
            return out
        at = int(fits[-1])
        out[at] += 1
        room -= int(lengths[at])


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, each: int, step: float, near: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """The covering LP by multiplicative weights: configurations and how often each is used, together about the demand.

    A length's weight falls with how far it is covered. Each round prices the configurations once and takes, of the best ones that
    hold each of the ``each`` lengths of the highest weight, those within ``near`` of the best price.
    """
    weight = np.ones(len(lengths))
    covered = np.zeros(len(lengths))
    found: dict[bytes, int] = {}
    configs: list[np.ndarray] = []
    uses: list[float] = []
    for _ in range(rounds):
        prices = weight * lengths / lengths.sum()
        value, pick = knapsack(lengths, prices, capacity)
        tried = [configuration(int(first), pick, lengths, prices, demand, capacity) for first in np.argsort(-weight, kind="stable")[:each]]
        worth = np.array([c @ prices for c in tried])
        # those that come near the best price; supply may keep all from it, then the best of them
        for config in (c for c, w in zip(tried, worth) if w >= (1 - near) * min(value[capacity], worth.max())):
            load = config / demand
            amount = 1.0 / (load.max() * max(1, rounds // 8))
            at = found.setdefault(config.tobytes(), len(configs))
            if at == len(configs):
                configs.append(config)
                uses.append(0.0)
            uses[at] += amount
            covered += load * amount
        weight = np.exp(-step * (covered - covered.min()))
    x = np.array(uses)
    return np.stack(configs), x * (demand * lengths).sum() / max(1e-12, (np.stack(configs) @ lengths * x).sum())


def solve(histogram: dict[int, int], capacity: int, rounds: int = 16, each: int = 32, step: float = 2.0, waste: float = 0.01, little: float = 0.004) -> list[tuple[dict[int, int], int, str]]:
    """Configurations, how many containers use each, and what they come from; together they hold exactly the histogram's items.

    'lp': rounded from the fractional solution, which is solved again for what is left until that is ``little`` of all.
    A use is rounded down; what that leaves is taken by the configurations of the largest remainders, whole, as the supply
    allows, if they leave at most ``waste`` of a container free. 'rest': the last few, filled one by one with the largest
    lengths that fit.
    """
    lengths = np.array(sorted(h for h in histogram if 0 < h <= capacity and histogram[h] > 0), dtype=np.int64)
    left = np.array([histogram[int(h)] for h in lengths], dtype=np.int64)
    plan: list[tuple[dict[int, int], int, str]] = []

    def take(at: np.ndarray, config: np.ndarray, times: int, source: str) -> None:
        nz = np.flatnonzero(config)
        plan.append(({int(lengths[at[i]]): int(config[i]) for i in nz}, times, source))
        left[at[nz]] -= times * config[nz]

    most = little * int((lengths * left).sum())
    while left.any():
        at = np.flatnonzero(left)
        if plan and int((lengths * left).sum()) <= most:
            break
        # few lengths need more rounds until their prices tell them apart
        configs, uses = fractional(lengths[at], left[at], capacity, rounds if len(at) > each else 10 * rounds, min(each, len(at)), step)
        free = capacity - configs @ lengths[at]
        before = left.sum()
        for whole in (True, False):
            # full containers first, then by use, or by what rounding down left of it
            for k in np.lexsort((-uses if whole else np.floor(uses) - uses, free > waste * capacity)):
                nz = configs[k] > 0
                room = int((left[at][nz] // configs[k][nz]).min())
                times = min(room, int(uses[k])) if whole else min(room, 1) if free[k] <= waste * capacity else 0
                if times:
                    take(at, configs[k], times, "lp")
        if left.sum() == before:
            break
    while left.any():
        at = np.flatnonzero(left)
        config = configuration(len(at) - 1, np.full(capacity + 1, -1, dtype=np.int64), lengths[at], lengths[at], left[at], capacity)
        nz = config > 0
        take(at, config, int((left[at][nz] // config[nz]).min()), "rest")
    return plan


def pack(items: DataFrame, *, id_col: str = "doc_id", size_col: str = "tokens", capacity: int = 2048) -> DataFrame:
    """Containers of all items: (id, piece_no, size, container_id).

    An item over the capacity is divided into full containers and one rest; no other item is divided. Items of null or
    zero size take no room and get a null container. Repeated rows are packed as often as they occur. The size of each
    container is within the capacity. Lengths may be skewed: ranks within a length come from per-partition counts.
    """
    spark = items.sparkSession
    pieces = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("_n"))
    cap = F.lit(capacity)
    rest = F.pmod(F.col("_n"), cap)
    whole = F.floor(F.col("_n") / cap).cast("long")
    n_pieces = F.when(F.col("_n") <= 0, F.lit(1)).otherwise(whole + F.when(rest > 0, 1).otherwise(0))
    pieces = pieces.select("id", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)).alias("piece_no"), "_n", whole.alias("_whole"))
    pieces = pieces.select("id", F.col("piece_no").cast("int").alias("piece_no"), F.when(F.col("piece_no") < F.col("_whole"), cap).otherwise(F.pmod(F.col("_n"), cap)).cast("int").alias("size"))
    pieces = cut(pieces.withColumn("_part", F.spark_partition_id()))
    counts = pieces.where("size > 0").groupBy("size", "_part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = solve(histogram, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    nxt: dict[int, int] = {}
    base = 0
    for config, uses, _ in plan:
        for length, per in config.items():
            slots.setdefault(length, []).append((nxt.get(length, 0), base, per))
            nxt[length] = nxt.get(length, 0) + per * uses
        base += uses
    # the plan: at most (rounds + lengths) configurations of at most `capacity` lengths each
    held = spark.sparkContext.broadcast({k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in slots.items()})
    before = counts.select("size", "_part", (F.sum("n").over(_by_size()) - F.col("n")).alias("_base"))
    before = before.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("size", "_base"))).alias("_bases"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            size, part = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            base = batch.column(4).to_pylist()
            out = []
            for s, p, first in zip(size, part, base, strict=True):
                if s <= 0:
                    out.append(None)
                    continue
                local = seen.get((p, s), 0)
                seen[p, s] = local + 1
                rank = first + local
                starts, bases, per = table[s]
                at = int(np.searchsorted(starts, rank, side="right")) - 1
                out.append(int(bases[at] + (rank - starts[at]) // per[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int64())], ["id", "piece_no", "size", "container_id"])

    # the rank of a row is its base (per partition and size) plus its position there; the join keeps a partition's rows together
    firsts = before.select(F.col("_part"), F.explode("_bases").alias("size", "_base"))
    placed = pieces.join(firsts, ["_part", "size"], "left").repartition("_part", "size").select("id", "piece_no", "size", "_part", "_base")
    kind = dict(pieces.dtypes)["id"]
    return placed.mapInArrow(place, f"id {kind}, piece_no int, size int, container_id long")


def _by_size():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
