"""Exact token counts under a public byte-pair vocabulary, in time linear in the text.

A trie over the vocabulary carries failure links with precomputed emissions: where the longest match cannot go on, the
link says how many tokens the matched bytes give up and in which state matching goes on (longest match without
backtracking). A byte-pair tokenizer differs from longest match on some words. A segmentation is the tokenizer's own
if each pair of neighbouring tokens is what the merges make of the two; words whose longest match fails that test are
merged by rank instead, so all counts are exact.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary file of ``folder`` (by default the installed public_tokenizers)."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class LongestMatch:
    """Longest-match segmentation over a vocabulary of byte strings: trie, failure links, emissions."""

    def __init__(self, vocabulary: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        parent, byte, depth = [0], [0], [0]
        for rank, word in enumerate(vocabulary):
            state = 0
            for c in word:
                to = self.next[state].get(c)
                if to is None:
                    to = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                    parent.append(state)
                    byte.append(c)
                    depth.append(depth[state] + 1)
                state = to
            self.token[state] = rank
        #: emit[s]: tokens given up when matching cannot go on from s; fail[s]: the state it goes on from (-1: none).
        self.fail = [-1] * len(self.next)
        self.emit: list[tuple[int, ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=depth.__getitem__):
            if self.token[state] >= 0:
                self.fail[state], self.emit[state] = 0, (self.token[state],)
                continue
            emitted, back = list(self.emit[parent[state]]), self.fail[parent[state]]
            while back >= 0 and byte[state] not in self.next[back]:
                emitted += self.emit[back]
                back = self.fail[back] if back else -1
            if back >= 0:
                self.fail[state], self.emit[state] = self.next[back][byte[state]], tuple(emitted)

    def segment(self, word: bytes) -> list[int] | None:
        """Ranks of the longest-match tokens; None if some byte is in no token."""
        out: list[int] = []
        state, nxt, fail, emit = 0, self.next, self.fail, self.emit
        for c in word:
            to = nxt[state].get(c)
            while to is None:
                if state == 0 or fail[state] < 0:
                    return None
                out += emit[state]
                state = fail[state]
                to = nxt[state].get(c)
            state = to
        while state:
            if fail[state] < 0:
                return None
            out += emit[state]
            state = fail[state]
        return out


class TokenCounter:
    """Counts of tokens per text, equal to encoding it with the vocabulary's own tokenizer."""

    def __init__(self, path: str, pattern: str | None = None, cache: int = 500_000):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranked = sorted((int(rank), base64.b64decode(word)) for word, rank in map(bytes.split, f))
        self.words = [word for _, word in ranked]
        self.rank = {word: rank for rank, word in ranked}
        self.match = LongestMatch(self.words)
        self.pattern = regex.compile(pattern)
        self.own = lru_cache(200_000)(self._own)
        self.cache: dict[str, int] = {}
        self.limit = cache
        self.merged = 0

    def _own(self, left: int, right: int) -> bool:
        """Whether the merges keep the two neighbours apart."""
        a, b = self.words[left], self.words[right]
        return self.merge(a + b) == [a, b]

    def merge(self, word: bytes) -> list[bytes]:
        """Byte-pair merging by rank."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def count_word(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.match.segment(raw)
        if ids is not None and all(self.own(a, b) for a, b in zip(ids, ids[1:])):
            return len(ids)
        self.merged += 1
        if len(raw) > 400:  # merging is quadratic; the library's own merge loop is not
            return len(self._library().encode_single_piece(raw))
        return len(self.merge(raw))

    def _library(self):  # noqa: ANN202
        import tiktoken

        if not hasattr(self, "_core"):
            self._core = tiktoken.Encoding("own", pat_str=self.pattern.pattern, mergeable_ranks=self.rank, special_tokens={})._core_bpe
        return self._core

    def count(self, text: str | None) -> int:
        """Tokens of one text; a null or empty text has none."""
        if not text:
            return 0
        cache, total = self.cache, 0
        for word in self.pattern.findall(text):
            n = cache.get(word)
            if n is None:
                n = self.count_word(word)
                if len(cache) >= self.limit:
                    cache.clear()
                cache[word] = n
            total += n
        return total


@lru_cache(4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def with_token_counts(docs: DataFrame, keep: list[str], text_col: str, *, vocabulary: str | None = None, out: str = "tokens") -> DataFrame:
    """Columns ``keep`` and the exact number of tokens of ``text_col`` (0 for null and empty). No shuffle."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = counter(path)
        for batch in batches:
            counts = [tokenizer.count(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(counts, pa.int64())], [*keep, out])

    source = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, `{out}` long")


def token_budget(counted: DataFrame, groups: list[str], *, tokens: str = "tokens") -> DataFrame:
    """Totals per group: (*groups, documents, tokens, mean_tokens). Null group values form their own group.

    The sums combine map-side before the shuffle, so a hot group is one partial row per task.
    """
    totals = counted.groupBy(*groups).agg(F.count(F.lit(1)).alias("documents"), F.sum(tokens).alias("tokens"))
    return totals.withColumn("mean_tokens", F.round(F.col("tokens") / F.col("documents"), 6))
