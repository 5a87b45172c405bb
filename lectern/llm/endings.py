"""Whether a text ends where it was meant to: how often its last words end a sentence elsewhere in the corpus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lectern.llm.sketch import gather
from lectern.llm.textutil import U64, mix

UNIT = re.compile(r"\n+|[.!?。！？…]+(?=\s|$|[\"”’»)\]])|[^\W\d_]+(?:[’'\-][^\W\d_]+)*|\d+(?:[.,:]\d+)*|[^\w\s]")
CLOSED = re.compile(r"[.!?。！？…]+[\"”’'»)\]*_]*$|[\])»”]$")
OPEN = re.compile(r"(?:[,;:–—\-(\[{“„«¿¡&/+=<]|\bN°|�)$")
MARKER = re.compile(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-*•–])\s*$")
#: A list item, which needs no closing sign.
ITEM = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)])\s+\S")
ITEM_MARK = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+")
#: Endings that need no sign: a link, and a text that is only a name.
LINK = re.compile(r"(?:https?://|www\.)\S{6,}$")
NAME = re.compile(r"(?:[^\W\d_a-zß-ÿ][\w’'.\-]+\s+){1,3}[^\W\d_a-zß-ÿ][\w’'\-]{2,}")
ELLIPSIS = re.compile(r"(?:…|\.{3,})$")
BITS = 21
#: Letters of a word up to which its beginnings are counted; no word of these languages is longer.
LONGEST = 64
#: Straight quotes that a record was wrapped in.
WRAP = re.compile(r"[\"'`]+$")


def units(text: str, raw: list[str] | None = None) -> list[str]:
    """Words, numbers (one symbol) and signs of a text, names as one symbol; sentence ends and line ends become '¶'.

    ``raw``: takes the words as they stand."""
    out = []
    for line in text.split("\n"):
        found = UNIT.findall(line)
        if raw is not None:
            raw += found
        for u in found:
            first = u[0]
            if first in ".!?。！？…":
                out.append("¶")
            elif first.isdigit():
                out.append("0" if "." not in u else "0.0")
            elif first.isupper() and out and out[-1] not in "¶¤" and not u.isupper():
                out.append("<N>")  # names inside a line are one symbol
            else:
                out.append(u.lower())
        if line.strip():
            out.append("¶" if any(map(str.islower, line)) else "¤")  # a heading's end is no sentence end
    return out


def _is_word(unit: str) -> bool:
    return unit[0].isalpha()


def item_units(line: str) -> list[str]:
    """Words, numbers and signs of a list item without its mark and its closing sign."""
    units = [u.lower() if not u[0].isdigit() else "0" for u in UNIT.findall(ITEM_MARK.sub("", line))]
    while units and units[-1][0] in ".!?。！？…":
        units.pop()
    return units


class _Words(dict):
    """64-bit hashes of units, the same in every process; kept for units seen before."""

    def __missing__(self, unit: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[unit] = xxhash.xxh64_intdigest(unit)
        return value


_HASH = _Words()
_FACTOR = U64(0x9E3779B97F4A7C15)


def _hashed(listed: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, listed), dtype=np.uint64, count=len(listed))


def _joined(before: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Hashes of contexts that are longer by one unit."""
    return mix(before * _FACTOR + unit)


def _places(contexts: np.ndarray) -> np.ndarray:
    """Places of contexts in the two rows, one after the other; the lesser count is never under the true one."""
    low = contexts & U64((1 << BITS) - 1)
    return np.concatenate([low, U64(1 << BITS) + ((contexts >> U64(32)) & U64((1 << BITS) - 1))]).astype(np.int64)


def _context(words: list[str]) -> np.ndarray:
    h = mix(_hashed(words))
    out = h[:1]
    for k in range(1, len(words)):
        out = _joined(out, h[k : k + 1])
    return out


def _contexts(h: np.ndarray, run: np.ndarray, most: int, salt: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``most``: the places at which a context of so many units of one run ends, and its hash."""
    at, single, out = np.arange(len(h)), mix(h), []
    first = single if salt is None else _joined(salt, single)
    for n in range(1, most + 1):
        at = at[at >= n - 1]
        at = at[run[at] == run[at - n + 1]]
        context = first[at - n + 1]
        for k in range(n - 2, -1, -1):
            context = _joined(context, single[at - k])
        out.append((at, context))
    return out


def ending_counts(texts: DataFrame) -> np.ndarray:
    """For contexts of one to three units: how often a sentence ends after them and how often it goes on.

    ``texts``: one string column. 4 x 2**21 counters over all texts; each text's own end is left out, as it may be cut.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(4 << BITS, dtype=np.int64)

        def count(h: np.ndarray, run: np.ndarray, counted: np.ndarray, ends: np.ndarray, most: int, salt: np.ndarray | None = None) -> None:
            for at, context in _contexts(h, run, most, salt):
                picked = counted[at]
                at, places = at[picked], _places(context[picked])
                np.add.at(total, places + np.tile(np.where(ends[at], 0, 2 << BITS), 2), 1)

        def add(listed: list[str], items: list[str], words: Counter[str]) -> None:
            if listed:
                h, sign = _hashed(listed), np.array([u in "¶¤" for u in listed])
                full = np.array([u == "¶" for u in listed])
                last = np.array([u == "" for u in listed])  # between texts
                stop = sign | last
                follows = np.append(full[1:], False)
                # a text's own end is left out, as it may be cut
                count(h, 2 * np.cumsum(stop) - stop, ~stop & ~np.append(last[1:], True), follows, 3)
            if items:
                h, last = _hashed(items), np.array([u == "" for u in items])
                count(h, 2 * np.cumsum(last) - last, ~last, np.append(last[1:], True), 2, mix(_hashed(["i"])))
            if words:
                n = np.fromiter(words.values(), dtype=np.int64, count=len(words))
                lead = mix(_hashed(["w"]))
                np.add.at(total, _places(_joined(lead, mix(_hashed(list(words))))), np.tile(n, 2))
                starts: Counter[str] = Counter()
                for word, times in words.items():
                    for k in range(1, min(len(word), LONGEST)):
                        starts[word[:k]] += times
                if starts:
                    n = np.fromiter(starts.values(), dtype=np.int64, count=len(starts))
                    np.add.at(total, (2 << BITS) + _places(_joined(lead, mix(_hashed(list(starts))))), np.tile(n, 2))

        for batch in batches:
            listed: list[str] = []
            items: list[str] = []
            words: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                raw: list[str] = []
                u = units(text, raw)
                while u and u[-1] in "¶¤":
                    u.pop()
                listed += u
                listed.append("")
                words.update(map(str.lower, filter(_is_word, raw[:-1])))
                for line in text.rstrip().split("\n")[:-1]:
                    if ITEM.match(line):
                        items += item_units(line)
                        items.append("")
                if len(listed) > 500_000 or len(words) > 200_000:
                    add(listed, items, words)
                    listed, items, words = [], [], Counter()
            add(listed, items, words)
        return total

    return gather(texts, fill, 4 << BITS)


class Endings:
    """Chance that a text is complete, from ``ending_counts``."""

    def __init__(self, counts: np.ndarray):
        self.ends, self.goes = counts[: 2 << BITS], counts[2 << BITS :]

    def __call__(self, text: str) -> float:
        """About 1 for a closed text, about 0 for one that surely goes on or stops inside a word."""
        body = text.rstrip()
        if body.count('"') % 2:
            body = WRAP.sub("", body).rstrip()
        shown = ELLIPSIS.sub("", body).rstrip()
        if shown and shown != body:  # an ellipsis closes nothing: what stands before it decides
            return 0.0 if not CLOSED.search(shown) and self(shown) < 0.99 else 1.0
        if not body:
            return 1.0
        if body.endswith("�"):
            return 0.0
        last_line = body.rsplit("\n", 1)[-1]
        aside = body[-1] in "–—" and last_line.count(body[-1]) % 2 == 0  # an inserted remark that closes
        if aside:
            return 1.0
        if LINK.search(body) or NAME.fullmatch(body):
            return 1.0
        if MARKER.search(body) or OPEN.search(body):
            return 0.0
        if CLOSED.search(body):
            return 1.0
        if not any(c.islower() for c in last_line) and any(c.isalpha() for c in last_line):
            return 0.0
        u = units(body)
        while u and u[-1] in "¶¤":
            u.pop()
        if not u:
            return 1.0
        raw = UNIT.findall(last_line)[-1]
        if raw[0].isalpha():
            whole, longer = self._seen(["w", raw.lower()])  # as a word, and as the beginning of longer words
            if not whole or longer >= 20 * whole and longer >= 3:
                return 0.02
        best = 0.5
        if ITEM.match(last_line) and "\n" in body:
            # items close without a sign: held against the items of the corpus, not against sentences
            item = item_units(last_line)
            for n in (1, 2):
                e, g = self._seen(["i", *item[-n:]]) if len(item) >= n else (0, 0)
                if e + g:
                    best = (e + 2 * best) / (e + g + 2)
            return best
        for n in (1, 2, 3):
            if len(u) < n or (n > 1 and u[-n] in "¶¤"):
                break
            e, g = self._seen(u[-n:])
            if n == 2 and e + g == 0 and raw[0].isalpha() and longer >= 2 * whole:
                return 0.02  # after this word nobody writes it, and longer words begin so
            if e + g < (3 if n > 1 else 1):
                break
            best = (e + 2 * best) / (e + g + 2)
        return best

    def _seen(self, words: list[str]) -> tuple[int, int]:
        p, q = _places(_context(words))
        return int(min(self.ends[p], self.ends[q])), int(min(self.goes[p], self.goes[q]))


def with_completeness(rows: DataFrame, keep: list[str], text_col: str, counts: np.ndarray, out: str = "complete") -> DataFrame:
    """Columns ``keep`` and the chance of completeness; null texts get null."""
    from pyspark.sql import functions as F

    held = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge: Callable[[str], float] = Endings(held.value)
        for batch in batches:
            got = [None if t is None else judge(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(got, pa.float64())], [*keep, out])

    source = rows.select(*keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, `{out}` double")
