"""Nearest neighbours by cosine distance: exact in blocks, and an inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut

BLOCK = 2_000
DIGITS = 9


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; rows of another size than the longest, and nulls, are zero vectors."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(column) and not column.null_count and lengths[0] and (lengths == lengths[0]).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = column.to_pylist()
    size = max((len(r) for r in rows if r), default=1)
    out = np.zeros((len(rows), size), dtype=np.float64)
    for i, r in enumerate(rows):
        if r and len(r) == size:
            out[i] = r
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(rows: DataFrame, block: list[tuple], k: int, lists: bool) -> DataFrame:
    """Best k per query of each task; with lists, a query only sees the rows of its own cells."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [q[0] for q in held.value]
        queries = _unit(np.array([q[1] for q in held.value], dtype=np.float64)) if ids else np.zeros((0, 1))
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        of_cell: dict[int, list[int]] = {}
        for i, q in enumerate(held.value):
            for c in q[2] if lists else ():
                of_cell.setdefault(c, []).append(i)
        for batch in batches:
            if not ids or not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            vectors = _unit(_matrix(batch.column(1)))
            if vectors.shape[1] != queries.shape[1]:
                continue
            groups = [(np.arange(len(ids)), np.arange(len(keys)))]
            if lists:
                cells = np.array(batch.column(2).to_pylist(), dtype=np.int64)
                groups = [(np.array(of_cell[c]), np.flatnonzero(cells == c)) for c in np.unique(cells).tolist() if c in of_cell]
            for who, where in groups:
                distance = np.round(1.0 - queries[who] @ vectors[where].T, DIGITS)
                for row, q in enumerate(who):
                    d = distance[row]
                    near = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                    near = np.flatnonzero(d <= d[near].max()) if len(d) > k else near  # all ties of the last place
                    best[q] = sorted(best[q] + list(zip(d[near].tolist(), keys[where[near]].tolist())))[:k]
        out = [(ids[q], i, d) for q, found in enumerate(best) for d, i in found]
        cols = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "distance"])

    return rows.mapInArrow(run, "query_id long, id long, distance double")


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    for row in queries.toLocalIterator(prefetchPartitions=True):
        block.append(tuple(row))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def exact_neighbours(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query: (query_id, id, distance, rank); ties go to the lesser id.

    ``queries`` (query_id, embedding) is a stated set, broadcast in blocks of bounded size against all ``rows`` (id, embedding):
    one matrix product per batch; each task keeps its own best k per query. Null vectors and ids are left out; vectors of
    another size match nothing; zero vectors are at distance 1.
    """
    source = rows.where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    found = None
    for block in _blocks(asked):
        part = _search(source, block, k, lists=False)
        found = part if found is None else found.unionByName(part)
    return _rank(_search(source, [], k, lists=False) if found is None else found, k)


def fit_cells(rows: DataFrame, cells: int, *, sample: int = 20_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of the cells, fitted on at most ``sample`` rows (those with the least hashed ids): a bounded, documented sample."""
    picked = rows.where("embedding is not null").select("embedding").orderBy(F.xxhash64("id")).limit(sample).collect()
    data = _unit(np.array([r[0] for r in picked], dtype=np.float64)) if picked else np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    centres = data[rng.permutation(len(data))[: max(1, min(cells, len(data)))]]
    for _ in range(rounds):
        home = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, data)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def build_index(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every row with its cell: (id, embedding, cell)."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _unit(_matrix(batch.column(1)))
            cell = (m @ held.value.T).argmax(axis=1) if m.shape[1] == held.value.shape[1] else np.zeros(len(m), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "embedding", "cell"])

    source = rows.where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return source.mapInArrow(run, "id long, embedding array<float>, cell int")


def index_neighbours(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """About the k nearest rows of each query: only the rows of its ``probes`` nearest cells are compared, those exactly."""
    asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    found = None
    for block in _blocks(asked):
        units = _unit(np.array([q[1] for q in block], dtype=np.float64))
        near = np.argsort(-(units @ centres.T), axis=1)[:, :probes]
        placed = [(q[0], q[1], near[i].tolist()) for i, q in enumerate(block)]
        cells = sorted({c for _, _, cs in placed for c in cs})
        part = _search(index.where(F.col("cell").isin(cells)), placed, k, lists=True)
        found = part if found is None else found.unionByName(part)
    return _rank(_search(index, [], k, lists=True) if found is None else found, k)


def best_per_id(found: DataFrame, k: int, key: str = "question_id") -> DataFrame:
    """Results of several variants of one question flattened: each id once at its best distance, the best k of those."""
    best = found.groupBy(key, "id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy(key).orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def checkpointed_index(rows: DataFrame, cells: int) -> tuple[DataFrame, np.ndarray]:
    """An index that is kept in the shared folder, with its centres."""
    centres = fit_cells(rows, cells)
    return cut(build_index(rows, centres)), centres
