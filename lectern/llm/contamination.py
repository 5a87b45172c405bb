"""Evaluation texts leaking into training text: an FM-index per shard of documents, searched backwards.

Each task indexes its documents in shards: the words become symbols of the evaluation vocabulary, the shard's
symbol string gets a suffix order, its Burrows-Wheeler transform a wavelet matrix with rank blocks, and every
``sample``-th text position is kept. All evaluation phrases of ``n`` words are searched at once; occurrences are located
by walking to sampled positions, and the spans of one document and item are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textutil import WORD, fold


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling over the groups that are still tied."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width, active = 1, np.arange(n)
    while True:
        sorted_rank = rank[order]
        first = np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]
        starts = np.flatnonzero(first)
        rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
        tied = ~(first & np.r_[first[1:], True])
        active = np.flatnonzero(tied)  # places in the order whose suffix is not yet alone
        if not len(active) or width >= n:
            return order
        at = order[active]
        follow = at + width
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        sub = np.lexsort((second, rank[at]))
        order[active] = at[sub]
        key1, key2 = rank[at][sub], second[sub]
        new = np.r_[True, (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])]
        heads = np.flatnonzero(new)
        rank[at[sub]] = np.repeat(active[heads], np.diff(np.r_[heads, len(sub)]))
        width *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector with block counts per bit of the alphabet."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.bits = len(seq), max(1, int(sigma - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        current = seq.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = ((current >> b) & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = bit
            word = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(word)
            self.blocks.append(np.r_[0, np.cumsum(np.bitwise_count(word), dtype=np.int64)][:-1])
            self.zeros.append(self.n - int(bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block, off = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << off) - np.uint64(1)
        return self.blocks[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[q] before position i[q], for all q."""
        start, end = np.zeros_like(i), i
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            s1, e1 = self._ones(level, start), self._ones(level, end)
            start = np.where(bit, self.zeros[level] + s1, start - s1)
            end = np.where(bit, self.zeros[level] + e1, end - e1)
        return end - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = ((self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            out = out * 2 + bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return out


class FMIndex:
    """Backward search and location over one shard's symbols; symbol 0 separates and ends the text."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        text = np.r_[text, 0]
        order = suffix_order(text)
        bwt = text[order - 1]
        self.matrix = WaveletMatrix(bwt, sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.n = len(text)
        self.kept = np.full(self.n, -1, dtype=np.int64)
        at = np.flatnonzero((order % sample == 0) | (text[order - 1] == 0))
        # symbol 0 occurs many times, so rows before a separator are kept too and no walk passes one
        self.kept[at] = order[at]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of all phrases (one per row of the matrix), by backward search."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            lo[alive] = self.first[c] + self.matrix.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.matrix.rank(c, hi[alive])
            gone = lo[alive] >= hi[alive]
            hi[alive[gone]] = lo[alive[gone]]
            alive = alive[~gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk backwards to a kept position."""
        out = np.full(len(rows), -1, dtype=np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.kept[row] >= 0
            out[todo[hit]] = self.kept[row[hit]] + steps
            todo, row = todo[~hit], row[~hit]
            if len(todo):
                c = self.matrix.access(row)
                row = self.first[c] + self.matrix.rank(c, row)
                steps += 1
        return out


def _char_spans(text: str) -> list[tuple[int, int]]:
    """Offsets of the folded words in the original text."""
    folded, source = [], []
    for i, c in enumerate(text):
        f = fold(c)
        folded.append(f)
        source += [i] * len(f)
    return [(source[m.start()], source[m.end() - 1] + 1) for m in WORD.finditer("".join(folded))]


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "passage",
    n: int = 13,
    shard_symbols: int = 400_000,
    block_items: int = 5_000,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """Spans (doc_id, item_id, words, start_char, end_char) of documents that hold n or more consecutive words of an item.

    Case, accents, punctuation and white space do not count. Overlapping phrases of one document and item are merged to
    one span; one row per span. Passages under n words, null texts and null passages match nothing; a null doc id
    keeps its null id. Repeated rows give repeated spans. Items are a stated query set, taken in blocks of at most
    ``block_items`` items and ``block_chars`` characters (a longer passage is a block of its own), which bounds what is
    broadcast at a time; every block runs over all documents. No shuffle.
    """
    spark = docs.sparkSession
    source = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    result: DataFrame | None = None
    block: list[tuple[int, str]] = []

    def run_block(block: list[tuple[int, str]]) -> DataFrame:
        vocab: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, passage in block:
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in WORD.findall(fold(passage))]
            for i in range(len(ids) - n + 1):
                owners.setdefault(tuple(ids[i : i + n]), set()).add(item)
        phrases = np.array(list(owners), dtype=np.int64).reshape(len(owners), n)
        shared = spark.sparkContext.broadcast((vocab, phrases, [sorted(v) for v in owners.values()]))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, phrases, owned = shared.value
            get, sigma = vocab.get, len(vocab) + 1
            texts: list[tuple[int | None, str]] = []
            runs: list[np.ndarray] = []
            place: list[tuple[int, int]] = []  # document and first word of each run
            size = 0

            def emit() -> pa.RecordBatch | None:
                rows: list[tuple] = []
                if runs and len(phrases):
                    text = np.concatenate([np.r_[0, r] for r in runs])
                    starts = np.cumsum([0] + [len(r) + 1 for r in runs[:-1]]) + 1
                    index = FMIndex(text, sigma)
                    lo, hi = index.search(phrases)
                    hit = np.flatnonzero(hi > lo)
                    at_rows = np.concatenate([np.arange(lo[h], hi[h]) for h in hit]) if len(hit) else np.zeros(0, np.int64)
                    which = np.repeat(hit, (hi - lo)[hit])
                    where = index.locate(at_rows)
                    run = np.searchsorted(starts, where, side="right") - 1
                    spans: dict[tuple[int, int], list[int]] = {}
                    for p, w, r in zip(which.tolist(), where.tolist(), run.tolist(), strict=True):
                        doc, first = place[r]
                        for item in owned[p]:
                            spans.setdefault((doc, item), []).append(first + w - int(starts[r]))
                    chars: dict[int, list[tuple[int, int]]] = {}
                    for (doc, item), words in sorted(spans.items()):
                        rid, original = texts[doc]
                        if doc not in chars:
                            chars = {doc: _char_spans(original)}
                        words.sort()
                        a = b = words[0]
                        for w in [*words[1:], None]:
                            if w is not None and w <= b + n:
                                b = w
                                continue
                            cs = chars[doc]
                            exact = len(cs) >= b + n
                            rows.append((rid, item, b + n - a, cs[a][0] if exact else None, cs[b + n - 1][1] if exact else None))
                            if w is not None:
                                a = b = w
                cols = list(zip(*rows)) if rows else [()] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "words", "start_char", "end_char"])

            for batch in batches:
                for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.fromiter((get(w, 0) for w in WORD.findall(fold(text))), dtype=np.int64)
                    edge = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0]))
                    kept = False
                    # a stretch of fewer than n known words holds no phrase and is left out of the index
                    for a, b in zip(edge[::2], edge[1::2]):
                        if b - a >= n:
                            runs.append(ids[a:b])
                            place.append((len(texts), int(a)))
                            size += b - a + 1
                            kept = True
                    if kept:
                        texts.append((rid, text))
                    if size >= shard_symbols:
                        yield emit()
                        texts, runs, place, size = [], [], [], 0
            yield emit()

        return source.mapInArrow(find, "doc_id long, item_id long, words int, start_char int, end_char int")

    rows = items.where(F.col(item_col).isNotNull() & F.col(passage_col).isNotNull()).select(F.col(item_col).cast("long"), passage_col)
    held = 0
    for row in rows.toLocalIterator():
        if block and (len(block) >= block_items or held + len(row[1]) > block_chars):
            part = run_block(block)
            result = part if result is None else result.unionByName(part)
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    if block or result is None:
        part = run_block(block)
        result = part if result is None else result.unionByName(part)
    return result
