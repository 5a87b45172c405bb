"""Near-duplicate records with small edits: token-combination prefixes, then exact checks.

Every text becomes the set of its shingles (the tokens of the search), ordered rare first by their frequency over all texts.
A pair that reaches the threshold differs in few tokens, so much of the beginning of that order is shared. Rare tokens of
that prefix are indexed alone, frequent ones as combinations of two of one class (classes by hash, as many as the text's size
asks for). The prefix is extended until no choice of differing tokens can leave a qualifying pair with fewer common index
entries than asked for, so the search is complete whatever the frequencies are: these decide only how much it costs.
Pairs with enough common entries are verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.sketch import gather, packed_slices, sum_slices
from lectern.llm.textutil import U64, mix, shingle_rows
from lectern.session import cut

#: Entries of one index key that are paired in one piece; longer runs are cut into blocks of this size, each pair of blocks on its own.
BLOCK = 4096
#: Shingles of distinct texts whose index entries (about 0.7 of their number) fill one partition.
SHINGLES_A_PART = 1_250_000
#: Pairs of sets that a task holds before it counts and gives them.
HELD = 1_000_000
#: Bits of a packed index entry that hold its key within its partition; two more say on which side of a pair it may stand.
KEY_BITS = 38


class Scheme:
    """How texts of a size are indexed: by the octave b of the size, classes M and surplus d.

    ``classes`` M and ``surplus`` d with M + d + 1 <= threshold * 2**b guarantee that some prefix is long enough: of n tokens in
    at most M classes, n - M come second or later in their class; each of these that a pair shares beyond the first costs it one
    more common combination. Sizes too small for that index all tokens alone.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        octave = 2.0 ** np.arange(64)
        self.alone = octave < 5 / threshold
        self.classes = np.maximum(1, np.floor(np.minimum(0.7 * threshold * octave, 2**40))).astype(np.int64)
        self.surplus = np.where(self.alone, 0, np.floor(np.minimum(0.1 * threshold * octave, 2**40))).astype(np.int64)

    def least(self, smaller: np.ndarray, larger: np.ndarray) -> np.ndarray:
        """Tokens that sets of these sizes share at least if they reach the threshold."""
        return np.ceil(self.threshold / (1 + self.threshold) * (smaller + larger) - 1e-9).astype(np.int64)


def octaves(size: np.ndarray) -> np.ndarray:
    return np.frexp(size.astype(np.float64))[1].astype(np.int64) - 1


def _set_keys(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row that has tokens: (row, first place, size, key of the set). Equal sets have equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(starts, len(rows)))
    key = mix(np.bitwise_xor.reduceat(mix(hashes + np.repeat(size, size).astype(np.uint64)), starts)) if len(rows) else np.zeros(0, dtype=np.uint64)
    return rows[starts], starts, size, key.view(np.int64)


def index_entries(token: np.ndarray, level: np.ndarray, size: np.ndarray, scheme: Scheme, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of sets: (set, key, as smaller, as larger).

    ``token`` holds the sets one after the other, each in the common order; ``level`` their quantised frequencies (0: in one
    text only, so shared with none), ``size`` the sizes. Of a pair the smaller set is found by its entries in the octave of
    the larger one.
    """
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(token)) - first[owner]
    lead = np.bincount(owner, weights=level == 0, minlength=len(size)).astype(np.int64)  # surely not shared
    own = octaves(size)
    parts = []
    reach = 0
    while True:
        octave = own + reach
        span = np.ldexp(1.0, octave)
        chosen = (span * scheme.threshold <= size + 1e-9) & (size > 0)
        if reach and not chosen.any():
            break
        # how many tokens a set may lack in its partner
        as_smaller = size - scheme.least(size, np.maximum(size, span))
        as_larger = size - np.ceil(scheme.threshold * size - 1e-9).astype(np.int64) if reach == 0 else np.full(len(size), -1)
        target = lambda lacks: np.where(lacks - lead >= 0, lacks - lead + 1 + scheme.surplus[octave], 0)
        smaller, larger = target(as_smaller), target(as_larger)
        held = np.flatnonzero((chosen & (np.maximum(smaller, larger) > 0))[owner] & (place >= lead[owner]))
        t, o, p = token[held], owner[held], place[held]
        alone = (level[held] <= rare) | scheme.alone[octave[o]]
        group = np.where(alone, -1, (mix(t ^ U64(0x5851F42D4C957F2D)) >> U64(20)).astype(np.int64) % scheme.classes[octave[o]])
        order = np.argsort((o << 40) + group + 1, kind="stable")  # within a class by place
        same = np.zeros(len(order), dtype=bool)
        go, oo = group[order], o[order]
        same[1:] = (go[1:] == go[:-1]) & (oo[1:] == oo[:-1])
        counted = np.empty(len(order), dtype=bool)
        counted[order] = same
        counted |= alone
        before = np.cumsum(counted) - counted
        start = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, dtype=np.int64)
        before = before - np.repeat(before[start], np.diff(np.append(start, len(o))))
        in_smaller, in_larger = before < smaller[o], before < larger[o]
        salt = mix(octave.astype(np.uint64) + U64(1))
        picked = np.flatnonzero(alone & (in_smaller | in_larger))
        parts.append((o[picked], mix(t[picked] + salt[o[picked]]), in_smaller[picked], in_larger[picked]))
        order = order[(~alone & (in_smaller | in_larger))[order]]
        go, oo = group[order], o[order]
        at, gap = np.arange(len(order)), 1
        while True:
            at = at[at + gap < len(order)]
            at = at[(go[at] == go[at + gap]) & (oo[at] == oo[at + gap])]
            if not len(at):
                break
            one, two = order[at], order[at + gap]
            parts.append((o[two], mix(mix(t[one] + salt[o[one]]) * U64(0x9E3779B97F4A7C15) + t[two]), in_smaller[two], in_larger[two]))
            gap += 1
        reach += 1
    return tuple(np.concatenate(c) for c in zip(*parts))  # type: ignore[return-value]


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    raw[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return raw.reshape(-1).view("<u8")


ENTRIES = "part int, owners binary, sizes binary, counts binary, entries binary"


def _entry_rows(keys: np.ndarray, sizes: np.ndarray, found: tuple, parts: int) -> pa.RecordBatch:
    """Index entries by the partition of their key: the sets that have some there, how many each, and the packed entries."""
    owner, key, smaller, larger = found
    part = ((key >> U64(48)) % U64(parts)).astype(np.int64)
    packed = ((key & U64((1 << KEY_BITS) - 1)) << U64(2)) | (larger.astype(np.uint64) << U64(1)) | smaller.astype(np.uint64)
    order = np.argsort(part * (len(keys) + 1) + owner, kind="stable")
    part, owner, packed = part[order], owner[order], packed[order]
    edge = np.searchsorted(part, np.arange(parts + 1))
    rows: list[list] = [[], [], [], [], []]
    for i in np.flatnonzero(np.diff(edge)):
        who, n = np.unique(owner[edge[i] : edge[i + 1]], return_counts=True)
        for column, value in zip(rows, (int(i), keys[who].tobytes(), sizes[who].astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), _pack(packed[edge[i] : edge[i + 1]]))):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["part", "owners", "sizes", "counts", "entries"])


PAIRED = "a long, b long, common int, least int"
BLOCKED = "keys binary, sizes binary, sides binary, other_keys binary, other_sizes binary, other_sides binary"


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches))


def _partition(group: pa.Table) -> tuple[np.ndarray, ...]:
    """Entries of a partition sorted by (key, size, set): (index key, set, size, sides); copies of a set count once."""
    columns = [[v for c in group.column(n).chunks for v in c.to_pylist()] for n in ("owners", "sizes", "counts", "entries")]
    join = lambda i, kind: np.concatenate([np.frombuffer(b, dtype=kind) for b in columns[i]])
    owners, sizes, counts = join(0, np.int64), join(1, np.int32), join(2, np.int32)
    entries = np.concatenate([_unpack(b) for b in columns[3]])
    ranked = np.lexsort((owners, sizes))
    rank = np.empty(len(owners), dtype=np.int64)
    fresh = np.ones(len(ranked), dtype=bool)
    fresh[1:] = owners[ranked][1:] != owners[ranked][:-1]
    rank[ranked] = np.cumsum(fresh) - 1
    table = ranked[fresh]
    at = np.repeat(rank, counts)
    order = np.lexsort((at, entries >> U64(2)))
    key, at, side = entries[order] >> U64(2), at[order], (entries[order] & U64(3)).astype(np.uint8)
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    return key[keep], at[keep], side[keep], owners[table], sizes[table].astype(np.int64)


def _paired(at: np.ndarray, to: np.ndarray, owners: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> pa.RecordBatch:
    """Pairs of sets with the number of their common entries here and the number that they need."""
    both, n = np.unique(at * len(owners) + to, return_counts=True)
    at, to = both // max(1, len(owners)), both % max(1, len(owners))
    need = 1 + scheme.surplus[octaves(sizes[to])] if len(to) else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(owners[at]), pa.array(owners[to]), pa.array(n.astype(np.int32)), pa.array(need.astype(np.int32))], ["a", "b", "common", "least"])


def _lengths(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _meet(group: pa.Table, scheme: Scheme, block: int, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Pairs of a partition's sets that share an entry of a key with at most ``block`` entries.

    Many entries of many keys make far more pairs than entries, so these come in pieces of about ``most``; a pair may stand in
    several, each with a part of its count.
    """
    key, at, side, owners, sizes = _partition(group)
    starts, n = _lengths(key)
    fits = np.repeat(n <= block, n)
    key, at, side = key[fits], at[fits], side[fits]
    size = sizes[at]
    one, two, held = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    i, gap = np.flatnonzero(side & 1), 1  # the smaller set comes first
    while True:
        i = i[i + gap < len(key)]
        i = i[key[i] == key[i + gap]]
        i = i[size[i] + 1e-9 >= scheme.threshold * size[i + gap]]
        if not len(i):
            break
        hit = i[side[i + gap] & 2 > 0]
        one.append(at[hit])
        two.append(at[hit + gap])
        held += len(hit)
        gap += 1
        if held >= most:
            yield _paired(np.concatenate(one), np.concatenate(two), owners, sizes, scheme)
            one, two, held = one[:1], two[:1], 0
    yield _paired(np.concatenate(one), np.concatenate(two), owners, sizes, scheme)


def _blocks(group: pa.Table, scheme: Scheme, block: int) -> Iterator[pa.RecordBatch]:
    """Of keys with more than ``block`` entries: each pair of blocks of these whose sizes can meet, one row a batch."""
    names = ["keys", "sizes", "sides", "other_keys", "other_sizes", "other_sides"]
    # sorting the keys alone is cheap and tells whether there is any such key
    raw = np.sort(np.concatenate([_unpack(b) >> U64(2) for c in group.column("entries").chunks for b in c.to_pylist()]))
    if (_lengths(raw)[1] > block).any():
        key, at, side, owners, sizes = _partition(group)
        starts, n = _lengths(key)
        for start, many in zip(starts[n > block], n[n > block]):
            cuts = [slice(start + k, min(start + k + block, start + many)) for k in range(0, many, block)]
            packed = [(owners[at[c]].tobytes(), sizes[at[c]].tobytes(), side[c].tobytes()) for c in cuts]  # as large as the entries, its pairs are not held
            for i, left in enumerate(cuts):
                for j in range(i, len(cuts)):
                    if sizes[at[left.stop - 1]] + 1e-9 < scheme.threshold * sizes[at[cuts[j].start]]:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed[i] + packed[j]], names)


def _meet_blocks(row: list[bytes], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Pairs between two blocks of one key, or within one where both are the same."""
    ka, kb = np.frombuffer(row[0], dtype=np.int64), np.frombuffer(row[3], dtype=np.int64)
    sa, sb = np.frombuffer(row[1], dtype=np.int64), np.frombuffer(row[4], dtype=np.int64)
    da, db = np.frombuffer(row[2], dtype=np.uint8), np.frombuffer(row[5], dtype=np.uint8)
    within = row[0] == row[3]
    for i in np.flatnonzero(da & 1):
        first = i + 1 if within else 0
        j = first + np.flatnonzero((db[first:] & 2 > 0) & (sa[i] + 1e-9 >= scheme.threshold * sb[first:]))
        if len(j):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(j), ka[i])), pa.array(kb[j]), pa.array(np.ones(len(j), dtype=np.int32)), pa.array((1 + scheme.surplus[octaves(sb[j])]).astype(np.int32))],
                ["a", "b", "common", "least"],
            )


def linked_representatives(
    docs: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    min_words: int = 1,
    rare: int = 8,
    sketch_bits: int = 22,
    ids_unique: bool = False,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Links between texts and the membership of copies: (a, b, jaccard) with a < b, and (id, rep).

    Null texts and texts under ``min_words`` words are in neither. Rows whose id is null are left out. Texts with the
    same shingle set have one representative, their least id; only representatives are searched. Ids delivered
    twice count once (the least text). Columns other than the two named are ignored. The links are complete: ``rare`` (up to
    how many texts may hold a token that is indexed alone), ``sketch_bits`` (2**bits counters of how many texts hold a
    token) and ``block`` (entries of one key paired by one task) change only the cost. ``ids_unique`` states that the id is a
    key, which saves a shuffle.
    """
    spark = docs.sparkSession
    scheme = Scheme(threshold)
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not ids_unique:
        base = base.groupBy("id").agg(F.min("text").alias("text"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << sketch_bits, dtype=np.uint32)
        names = ["id", "same", "size", "slice", "counts"]
        for batch in batches:
            for rows, tokens in shingle_rows(batch.column(1).to_pylist(), shingle, min_words):
                np.add.at(total, (tokens >> U64(48 - sketch_bits)).astype(np.int64), np.uint32(1))
                row, _, size, key = _set_keys(rows, tokens)
                nothing = pa.nulls(len(row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key), pa.array(size), nothing.cast(pa.int32()), nothing.cast(pa.binary())], names)
        counted = packed_slices(total)
        nothing = pa.nulls(counted.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, *counted.columns], names)

    surveyed = cut(base.mapInArrow(survey, "id long, same long, size long, slice int, counts binary"))
    held = sum_slices(surveyed.where("slice is not null").select("slice", "counts"), 1 << sketch_bits)
    members = surveyed.where("slice is null").select("id", "same")
    reps = members.groupBy("same").agg(F.min("id").alias("rep"))
    total = surveyed.where("slice is null").groupBy("same").agg(F.max("size").alias("size")).agg(F.sum("size")).first()[0]
    parts = max(8, -(-(total or 0) // SHINGLES_A_PART))
    # eight levels for each doubling of the frequency; one text is level 0
    levels = spark.sparkContext.broadcast(np.minimum(255, np.round(8 * np.log2(np.maximum(held, 1)))).astype(np.uint8))
    alone = int(np.floor(8 * np.log2(rare))) if rare > 0 else -1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows, tokens in shingle_rows(batch.column(0).to_pylist(), shingle, min_words):
                row, _, size, key = _set_keys(rows, tokens)
                new = np.zeros(len(row), dtype=bool)
                for i, k in enumerate(key.tolist()):  # copies in one task are indexed once
                    if k not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(k)
                        new[i] = True
                kept = np.repeat(new, size)
                tokens, rows, size, key = tokens[kept], np.repeat(np.arange(new.sum()), size[new]), size[new], key[new]
                if not len(size):
                    continue
                level = levels.value[(tokens >> U64(48 - sketch_bits)).astype(np.int64)]
                order = np.argsort((rows << 8) + level, kind="stable")  # within a level by hash
                yield _entry_rows(key, size, index_entries(tokens[order], level[order], size, scheme, alone), parts)

    entries = base.select("text").mapInArrow(index, ENTRIES).repartition(parts, "part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meet(_table(batches), scheme, block)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(_table(batches), scheme, block)

    met = entries.groupBy("part").applyInArrow(meet, PAIRED)
    hot = entries.groupBy("part").applyInArrow(blocks, BLOCKED)

    def meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one pair of blocks at a time
                yield from _meet_blocks([c[i].as_py() for c in batch.columns], scheme)

    met = met.unionByName(hot.repartition(parts).mapInArrow(meet_blocks, PAIRED))
    enough = met.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("least").alias("least")).where("common >= least").select("a", "b")
    side = lambda s: reps.select(F.col("same").alias(s), F.col("rep").alias(f"r{s}"))
    pairs = cut(enough.join(side("a"), "a").join(side("b"), "b").select("ra", "rb"))

    def note(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        marks = np.zeros(1 << sketch_bits, dtype=np.uint32)
        for batch in batches:
            for column in batch.columns:
                marks[_cell(column)] = 1
        return marks

    def _cell(ids: pa.Array) -> np.ndarray:
        return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> U64(64 - sketch_bits)).astype(np.int64)

    # texts outside every pair are left out before their sets are made; marks of fixed size, and the join drops the rest
    marks = spark.sparkContext.broadcast(np.packbits(gather(pairs, note, 1 << sketch_bits) > 0))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cell(batch.column(0))
            wanted = np.flatnonzero((marks.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1)
            batch = batch.take(pa.array(wanted))
            for rows, tokens in shingle_rows(batch.column(1).to_pylist(), shingle, min_words):
                row, first, size, _ = _set_keys(rows, tokens)
                held = [tokens[f : f + n].tobytes() for f, n in zip(first, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(held, pa.binary())], ["id", "tokens"])

    sets = base.mapInArrow(sets_of, "id long, tokens binary")
    sides = [sets.select(F.col("id").alias(f"r{s}"), F.col("tokens").alias(f"t{s}")) for s in "ab"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared and shared + 1e-9 >= threshold * (len(x) + len(y) - shared):
                    out.append((min(a, b), max(a, b), shared / (len(x) + len(y) - shared)))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "jaccard"])

    full = pairs.join(sides[0], "ra").join(sides[1], "rb").select("ra", "rb", "ta", "tb")
    linked = full.mapInArrow(verify, "a long, b long, jaccard double")
    copies = members.join(reps, "same").select("id", "rep")
    return linked, copies


def near_duplicate_pairs(docs: DataFrame, **options: object) -> DataFrame:
    """All pairs (id_a, id_b, jaccard), id_a < id_b, of texts that reach the threshold, copies included.

    Options and edge cases as in ``linked_representatives``. Use ``near_duplicate_summary`` where copies need no expansion.
    """
    linked, copies = linked_representatives(docs, **options)
    twins = copies.where("id <> rep")
    # most texts have no copies: only representatives with copies are expanded
    groups = twins.select("rep").distinct().select("rep", F.lit(True).alias("many"))
    expanded = copies.join(groups, "rep", "left_semi")
    ea = expanded.select(F.col("rep").alias("a"), F.col("id").alias("ca"))
    eb = expanded.select(F.col("rep").alias("b"), F.col("id").alias("cb"))
    crossed = (
        linked.join(ea, "a", "left").join(eb, "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"), "jaccard")
    )
    within = ea.join(eb.withColumnRenamed("b", "a"), "a").where("ca < cb").select(F.col("ca").alias("x"), F.col("cb").alias("y"), F.lit(1.0).alias("jaccard"))
    both = crossed.unionByName(within)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "jaccard")


def near_duplicate_summary(docs: DataFrame, *, id_col: str = "id", **options: object) -> DataFrame:
    """One row per document: (id, class_id, links), without expanding copies into pairs.

    links counts the documents that a document is a near duplicate of: its copies, and the linked representatives with all
    their copies. class_id is the least id of its class; documents without partners are alone, with 0 links.
    """
    linked, copies = linked_representatives(docs, id_col=id_col, **options)
    linked = cut(linked)
    sizes = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    ends = linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(linked.select(F.col("b").alias("u"), F.col("a").alias("v")))
    around = ends.join(sizes.select(F.col("rep").alias("v"), "size"), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("size").alias("near"))
    classes = near_duplicate_classes(linked.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")), sizes, id_col="rep")
    per_rep = sizes.join(around, "rep", "left").join(classes.select(F.col("id").alias("rep"), "class_id"), "rep")
    per_rep = per_rep.select("rep", "class_id", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    every = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    joined = every.join(copies, "id", "left").join(per_rep, "rep", "left")
    return joined.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def near_duplicate_classes(pairs: DataFrame, docs: DataFrame, *, id_col: str = "id", max_rounds: int = 200) -> DataFrame:
    """One row per document: (id, class_id, links). class_id is the least id that links reach.

    Label propagation with pointer jumping over the links; every round is cut to the shared folder, nothing is
    collected. Documents without links form their own class with 0 links. Null ids are left out. More than ``max_rounds`` rounds
    (each at least doubles what a label has reached) raise instead of giving unfinished classes.
    """
    edges = cut(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).unionByName(pairs.select(F.col("id_b").alias("u"), F.col("id_a").alias("v"))).distinct())
    degree = edges.groupBy("u").agg(F.count(F.lit(1)).alias("links"))
    label = edges.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("lab"))
    for _ in range(max_rounds):
        offered = edges.join(label.select(F.col("id").alias("v"), "lab"), "v").groupBy(F.col("u").alias("id")).agg(F.min("lab").alias("offer"))
        nxt = label.join(offered, "id", "left").select("id", F.least("lab", F.coalesce("offer", "lab")).alias("new"), "lab")
        jump = nxt.select(F.col("id").alias("new"), F.col("new").alias("far"))
        nxt = cut(nxt.join(jump, "new", "left").select("id", F.coalesce("far", "new").alias("lab"), F.col("lab").alias("old")))
        moved = nxt.where("lab <> old").limit(1).count()
        label = nxt.select("id", "lab")
        if not moved:
            break
    else:
        raise RuntimeError(f"the classes are not complete after {max_rounds} rounds")
    return (
        docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
        .join(label, "id", "left")
        .join(degree.select(F.col("u").alias("id"), "links"), "id", "left")
        .select("id", F.coalesce("lab", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    )
