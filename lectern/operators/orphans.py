"""References to records that do not exist: direct kinds, and a fixpoint down the foreign-key graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import cut


#: A key with more rows than this, and than this share of its table, is spread over several tasks: at most 1 / share keys are.
HOT, HOT_SHARE = 100_000, 0.001


@dataclass(frozen=True)
class ForeignKey:
    """``child.child_col`` refers to ``parent.parent_col``; with times, to a parent that is there by the child's time."""

    child: str
    child_col: str
    parent: str
    parent_col: str
    child_time: str | None = None
    parent_time: str | None = None


def _lost_rows(child: DataFrame, parent: DataFrame, fk: ForeignKey, salts: int, many: float) -> DataFrame:
    """Rows of ``child`` whose non-null reference no row of ``parent`` holds in time, with whether it is held later (``late``).

    The child's keys are pre-aggregated to one row each, and the broken ones are found among these, so a hot key is one row
    there. The rows then meet broken keys only; a broken key of many rows is spread over ``salts`` parts, others are not copied.
    """
    col, at = f"k_{fk.child_col}", f"k_{fk.child_time}" if fk.child_time else None
    since = F.min(f"k_{fk.parent_time}") if fk.parent_time else F.lit(None).cast("timestamp")
    held = parent.where(F.col(f"k_{fk.parent_col}").isNotNull()).groupBy(F.col(f"k_{fk.parent_col}").alias(col)).agg(since.alias("_since"), F.lit(True).alias("_held"))
    first = F.min(at) if at else F.lit(None).cast("timestamp")
    asked = child.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    broken = asked.join(held, col, "left").where(F.col("_held").isNull() | (F.col("_since") > F.col("_first")))
    parts = F.when(F.col("_n") > many, F.lit(salts)).otherwise(F.lit(1))
    broken = broken.select(col, "_since", F.coalesce("_held", F.lit(False)).alias("late"), (parts > 1).alias("_hot"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    hot = broken.where("_hot").select(col, F.col("_hot").alias("_spread")).distinct()
    # at most 1 / HOT_SHARE keys: they tell which rows are spread
    rows = child.where(F.col(col).isNotNull()).join(F.broadcast(hot), col, "left")
    rows = rows.withColumn("_part", F.when(F.col("_spread"), F.pmod(F.xxhash64("record_id"), F.lit(salts))).otherwise(0).cast("int"))
    joined = rows.join(broken.drop("_hot"), [col, "_part"])
    return (joined.where(~F.col("late") | (F.col("_since") > F.col(at))) if at else joined).drop("_since", "_part", "_spread")


def orphan_cascade(
    tables: Mapping[str, DataFrame],
    keys: Sequence[ForeignKey],
    ids: Mapping[str, Column | str],
    max_rounds: int = 1000,
    salts: int = 8,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Orphans of every table of a foreign-key graph: (table_name, record_id, inherited, late, via, *carry).

    A row is a direct orphan if one of its non-null references is held by no row of the parent table (or, where the key has
    times, by none in its time); it is inherited if every parent row that holds it is itself an orphan. The rounds go on until
    no table gains an orphan, so cycles in the graph end too; more than ``max_rounds`` rounds raise instead of giving a part.
    ``via`` is the least 'parent.column' that broke; ``late`` says that all that broke is held, only later. A null time is never
    late. Rows with null references only are sound. ``carry``: key columns of the children to give out as well, as ``k_`` and name.
    Each round joins pre-aggregated distinct keys of the tables below one that lost rows, and its state is cut to the shared
    folder. A table without rows holds nothing. Repeated rows come out once.
    """
    by_child: dict[str, list[ForeignKey]] = {}
    for fk in keys:
        by_child.setdefault(fk.child, []).append(fk)
    parents = {fk.parent for fk in keys}
    sound: dict[str, DataFrame] = {}
    for name, df in tables.items():
        rid = ids[name] if isinstance(ids[name], Column) else F.col(ids[name])
        needed = {c for k in keys for t, cs in ((k.child, (k.child_col, k.child_time)), (k.parent, (k.parent_col, k.parent_time))) if t == name for c in cs if c}
        needed |= {c for c in carry if name in by_child}
        sound[name] = df.select(rid.cast("string").alias("record_id"), *[F.col(c).alias(f"k_{c}") for c in sorted(needed)])
        if name in by_child:
            sound[name] = sound[name].distinct()
    many = {name: max(HOT, HOT_SHARE * tables[name].count()) for name in by_child}
    carried = [f"k_{c}" for c in carry]
    found: list[DataFrame] = []
    changed = set(tables)
    for round_no in range(max_rounds):
        broken_now: dict[str, DataFrame] = {}
        for child, fks in by_child.items():
            parts = [
                _lost_rows(sound[child], sound[fk.parent], fk, salts, many[child]).select("record_id", *carried, "late", F.lit(f"{fk.parent}.{fk.parent_col}").alias("via"))
                for fk in fks
                if fk.parent in changed
            ]
            if parts:
                lost = cut(reduce(DataFrame.unionByName, parts).groupBy("record_id", *carried).agg(F.min("late").alias("late"), F.min("via").alias("via")))
                if not lost.isEmpty():
                    broken_now[child] = lost
                    found.append(lost.select(F.lit(child).alias("table_name"), "record_id", F.lit(round_no > 0).alias("inherited"), "late", "via", *carried))
        changed = set(broken_now) & parents
        if not changed:
            break
        for child, lost in broken_now.items():
            sound[child] = cut(sound[child].join(lost.select("record_id").distinct(), "record_id", "left_anti"))
    else:
        raise RuntimeError(f"the cascade has not ended after {max_rounds} rounds")
    if not found:
        first = next(iter(by_child))
        none = sound[first].limit(0)
        return none.select(F.lit(first).alias("table_name"), "record_id", F.lit(False).alias("inherited"), F.lit(False).alias("late"), F.lit("").alias("via"), *carried)
    return reduce(DataFrame.unionByName, found)


def broken_references(
    tables: Mapping[str, DataFrame], parents: DataFrame, removals: DataFrame | None, *, key: str, row_id: str = "id", time: str = "created_at"
) -> DataFrame:
    """Broken references of several tables to one: (table_name, period, record_id, kind), from the direct orphans of ``orphan_cascade``.

    kind is 'deleted' (parent missing, removal logged), 'missing' (neither) or 'late' (the parent was created after the row).
    Keys compare exactly as stored. Rows with a null key refer to nothing and never come out; a null time on either side is
    never 'late', and a null row time gives a null period. Rows delivered twice come out once. An empty parent table makes
    every reference missing or deleted. Other columns, whatever their names, are ignored.
    """
    graph = {"_parents": parents.select(F.col(key), F.col(time))} | {n: t.select(row_id, key, time) for n, t in tables.items()}
    edges = [ForeignKey(n, key, "_parents", key, time, time) for n in tables]
    ids = {"_parents": key} | {n: row_id for n in tables}
    lost = orphan_cascade(graph, edges, ids, carry=[key, time]).where(~F.col("inherited"))
    removed = F.lit(False)
    if removals is not None:
        gone = removals.where(F.col(key).isNotNull()).select(F.col(key).alias(f"k_{key}"), F.lit(True).alias("_gone")).distinct()
        lost, removed = lost.join(gone, f"k_{key}", "left"), F.coalesce("_gone", F.lit(False))
    kind = F.when(F.col("late"), F.lit("late")).when(removed, F.lit("deleted")).otherwise(F.lit("missing"))
    id_type = dict(next(iter(tables.values())).dtypes)[row_id]
    return lost.select("table_name", F.date_format(f"k_{time}", "yyyy-MM").alias("period"), F.col("record_id").cast(id_type).alias("record_id"), kind.alias("kind")).distinct()
