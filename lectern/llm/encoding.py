"""Garbled text from wrong character encodings: found and restored by noisy-channel decoding.

A suspicious token becomes a lattice over its characters. Arcs keep a character, read several characters back as the
bytes they came from, or stand for lost bytes (a wildcard over the letters that can be there). A beam Viterbi search
takes the path that is best under the channel's costs and the word frequencies of the whole corpus, which count inside the
search, at the end of each word. The frequencies live in a count sketch of fixed size, made over all documents.
"""

from __future__ import annotations

import base64
import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.sketch import gather
from lectern.llm.textutil import WORD

#: Codecs that UTF-8 or Western bytes are commonly misread with.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-15", "koi8-r", "cp866")
WESTERN_READ_AS = (("cp1251", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("koi8-r", "cp1252"), ("cp1250", "cp1252"), ("iso8859-7", "cp1252"), ("cp866", "cp1252"))
#: What may stand for a lost character in Western text.
WILD = "éèêëàâäáãåæçñíìîïóòôöõøœúùûüßýÿ¿¡ÉÈÀÂÄÁÇÑÍÓÖÚÜŒ’‘“”„«»–—…€°"
PUNCT = set("’‘“”„«»–—…€°¿¡•™©®ºª·  †‡‰‹›§±µ×½¼¾£¥²³")
ELIDED = {"l", "d", "j", "n", "s", "c", "m", "t", "qu", "jusqu", "lorsqu", "puisqu", "quelqu"}
TOKEN = re.compile(r"[^ \t\r\n]+")
ENTITY = re.compile(r"&(?:[A-Za-z]+[0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);")
UTF7 = re.compile(r"\+([A-Za-z0-9/]{3,})-?")
BEAM = 48
#: The sign for a lost character, and the wildcard that stands for it in the lattice.
LOST, ANY = "\ufffd", "\ufffc"
#: Wildcards in one word that are filled by looking up all words that fit, the fewest times such a word occurs, and how many go on.
WILDCARDS, KNOWN, FILLS = 2, 2, 4
INNER = re.compile(r"\w[¿¡„«“»”…‘°€—–](?=\w)")
#: Log of the corpus size that a word's frequency is held against; a path pays it for each word.
WORD_COST = 14.0
OPENING, CLOSING = set("¿¡„«‘"), set("”»…")


@lru_cache(32)
def _byte_of(codec: str) -> dict[str, int]:
    """Characters of the upper half of a codec; bytes that it leaves undefined show as control characters."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(1)
def _leads() -> dict[str, list[tuple[str, int]]]:
    """Characters that may be a UTF-8 lead byte, with the codecs that show it so."""
    out: dict[str, list[tuple[str, int]]] = {}
    for codec in UTF8_READ_AS:
        for char, b in _byte_of(codec).items():
            if 0xC2 <= b <= 0xF4:
                out.setdefault(char, []).append((codec, b))
    return out


def _script(c: str) -> str:
    o = ord(c)
    if not c.isalpha():
        return ""
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000:
        return "east"
    return "other"


def _stray(c: str) -> bool:
    return ord(c) > 127 and not c.isalpha() and c not in PUNCT and c != ANY


def _plausible(c: str) -> bool:
    o = ord(c)
    return c in PUNCT or (0xA1 <= o < 0x180 and (c.isalpha())) or _script(c) in ("east", "cyrillic", "greek") or 0x3000 <= o <= 0x303F or 0x1F300 <= o < 0x1FAFF


class Frequencies:
    """Word counts in a sketch of two rows: never under the true count."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.mask = rows, rows.shape[1] - 1

    def __call__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        return int(min(self.rows[0, h & self.mask], self.rows[1, (h >> 32) & self.mask]))


def word_frequencies(docs: DataFrame, text_col: str, bits: int = 20) -> np.ndarray:
    """Counts of all lower-case words of all texts: 2 x 2**bits counters, whatever the corpus holds."""
    size = 1 << bits

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total: Counter[str] = Counter()
        flat = np.zeros(2 * size, dtype=np.int64)

        def flush() -> None:
            if total:
                h = np.fromiter((xxhash.xxh64_intdigest(w) for w in total), dtype=np.uint64, count=len(total))
                n = np.fromiter(total.values(), dtype=np.int64, count=len(total))
                np.add.at(flat, (h & np.uint64(size - 1)).astype(np.int64), n)
                np.add.at(flat, size + ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64), n)
                total.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(WORD.findall(text.lower()))
            if len(total) > 300_000:
                flush()
        flush()
        return flat

    return gather(docs.select(text_col), fill, 2 * size).reshape(2, size)


def _swapped(token: str) -> tuple[str, int]:
    """Runs whose two bytes per character were swapped, put back; and how many characters that was."""
    out, fixed, at = [], 0, 0
    while at < len(token):
        end = low = 0
        for end in range(at, len(token) + 1):
            if end == len(token):
                break
            o = ord(token[end])
            back = ((o & 0xFF) << 8) | (o >> 8)
            if o > 0xFFFF or o < 0x100 or not (0x20 <= back < 0x180 or 0x2010 <= back <= 0x203A or back == 0x20AC):
                break
            low += o & 0xFF == 0
        n = end - at
        if n >= 3 and low >= max(3, 0.75 * n):
            out.append("".join(chr(((ord(c) & 0xFF) << 8) | (ord(c) >> 8)) for c in token[at:end]))
            fixed += n
            at = end
        else:
            out.append(token[at])
            at += 1
    return "".join(out), fixed


def _utf7(token: str) -> tuple[str, int]:
    fixed = 0

    def back(m: re.Match) -> str:
        nonlocal fixed
        b64 = m.group(1)
        bits = len(b64) * 6
        try:
            raw = base64.b64decode(b64 + "A" * (-len(b64) % 4) if len(b64) % 4 else b64)
        except ValueError:
            return m.group(0)
        size = bits // 16 * 2
        if bits % 16 >= 6 or any(raw[size:]):
            return m.group(0)
        try:
            text = raw[:size].decode("utf-16-be")
        except UnicodeDecodeError:
            return m.group(0)
        if text and all(ord(c) >= 0x80 and _plausible(c) for c in text) and (m.group(0).endswith("-") or len(b64) == 3):
            fixed += len(text)
            return text
        return m.group(0)

    return UTF7.sub(back, token), fixed


class Restorer:
    """Decides on tokens and remembers its decisions."""

    def __init__(self, freq: Callable[[str], int], rounds: int = 3):
        self.freq, self.rounds = freq, rounds
        self.memo: dict[str, tuple[str, bool]] = {}
        self.table_of: dict[str, int] = {}  # by which table a token was read back
        pairs = []
        for read, true in WESTERN_READ_AS:
            table = {}
            for char, b in _byte_of(read).items():
                try:
                    back = bytes([b]).decode(true)
                except UnicodeDecodeError:
                    continue
                if back != char and (back.isalpha() or back in "’‘“”«»„¿¡–—"):
                    table[char] = back
            pairs.append(table)
        self.western = pairs

    def word_score(self, w: str) -> float:
        """Log likelihood of one word: its frequency in the corpus, less what speaks against it as a word."""
        total = math.log(self.freq(w.lower()) + 0.05) - WORD_COST
        if len({s for s in map(_script, w) if s}) > 1:
            total -= 6.0
        return total - 0.8 * sum(b.isupper() and a.islower() and ord(b) > 127 for a, b in zip(w, w[1:]))

    def score(self, text: str) -> float:
        """Log likelihood of the words of a token; letters of several scripts in one word and stray symbols count against it."""
        return -7.0 * sum(map(_stray, text)) + sum(map(self.word_score, WORD.findall(text)))

    def _filled(self, word: str) -> list[tuple[str, float]]:
        """A word with wildcards as the words of the corpus that fit it: (text, score), best first, at most ``FILLS``.

        Wildcards stay sets of letters until the whole word is read; then every filling is looked up. What no known word fits
        keeps U+FFFD, and so does a word with more than ``WILDCARDS``: too many words would fit it.
        """
        n = word.count(ANY)
        lost = (word.replace(ANY, LOST), -9.0 * n + sum(map(self.word_score, WORD.findall(word.replace(ANY, LOST)))))
        if not n:
            return [(word, self.word_score(word))]
        parts = word.split(ANY)
        elided = parts[0].lower() in ELIDED  # what follows is a word of its own
        if n > WILDCARDS + elided:
            return [lost]
        choices = []
        for k, (left, right) in enumerate(zip(parts, parts[1:])):
            before, after = left or k > 0, right or k + 2 < len(parts)
            capital = not before or left[-1:].isupper()
            letters = [c for c in WILD if c.isalpha() and (c.islower() or capital)]
            choices.append(["’"] if n > WILDCARDS and k == 0 else letters + (["’"] if before and after else list("“„«¿¡‘") if after else list("”»’…") if before else list("–—…€°«»")))
        found = []
        for filling in product(*choices):
            text = "".join(a + b for a, b in zip(parts, (*filling, "")))
            pieces = WORD.findall(text)
            counts = [self.freq(w.lower()) for w in pieces]
            # single letters and short pieces fit anything: they prove nothing
            if counts and min(counts) >= KNOWN and (len(pieces) == 1 or max(map(len, pieces)) >= 3) and word.strip(ANY):
                found.append((text, sum(map(self.word_score, pieces)) - 2.0 * n))
        return sorted(found, key=lambda f: -f[1])[:FILLS] + [lost]

    def _paths(self, token: str) -> list[tuple[str, float, bool]]:
        """Best readings of a token: (text, channel cost, whether some arc read bytes back).

        Viterbi over the lattice of its characters with a beam: a state is the text up to its last whole word, the open word, and
        its score under the channel and the corpus' word frequencies, which each word adds as it ends.
        """
        leads = _leads()
        states: list[dict[tuple[str, str, bool], tuple[float, float]]] = [{} for _ in range(len(token) + 1)]
        states[0][("", "", False)] = (0.0, 0.0)

        def reach(to: int, key: tuple[str, str, bool], score: float, cost: float) -> None:
            known = states[to].get(key)
            if known is None or score > known[0]:
                states[to][key] = (score, cost)

        def extend(to: int, done: str, word: str, read: bool, score: float, cost: float, piece: str) -> None:
            ways = [(done, word, score)]
            for char in piece:
                if char == ANY or char.isalnum():
                    ways = [(d, w + char, s) for d, w, s in ways]
                else:
                    stray = 7.0 * _stray(char)
                    ways = [(d + text + char, "", s + add - stray) for d, w, s in ways for text, add in (self._filled(w) if w else [("", 0.0)])]
            for d, w, s in ways:
                reach(to, (d, w, read), s, cost)

        for i, c in enumerate(token):
            here = states[i].items()
            if len(here) > BEAM:
                here = sorted(here, key=lambda kv: -kv[1][0])[:BEAM]
            if not here:
                continue
            arcs: list[tuple[int, str, float, bool]] = [(i + 1, c, 0.0, False)]
            if c == LOST:
                # one lost character for each sign, or one for the two or three bytes that it had
                run = len(token) - i - len(token[i:].lstrip(LOST))
                arcs = [(i + n, ANY, 0.0, True) for n in (1, 2, 3) if n <= run]
            for codec, lead in leads.get(c, ()):
                need = 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
                table = _byte_of(codec)
                raw = [lead]
                for d in token[i + 1 : i + 1 + need]:
                    b = table.get(d, -1)
                    if not 0x80 <= b < 0xC0:
                        break
                    raw.append(b)
                if len(raw) == need + 1:
                    try:
                        text = bytes(raw).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if _plausible(text) or text in _byte_of("cp1252") or 0x80 <= ord(text) < 0xA0:
                        cost = -4.0 if _plausible(text) and _script(text) in ("", "latin") else -1.0
                        arcs.append((i + need + 1, text, cost, True))
                elif len(token) > 1 and (len(raw) == 2 and need > 1 or need == 1 and codec in ("cp1252", "latin-1", "cp1251")):
                    # the last byte was lost: anything that begins with these bytes
                    for w in WILD + "à":
                        enc = w.encode()
                        if len(enc) == need + 1 and list(enc[: len(raw)]) == raw:
                            arcs.append((i + len(raw), w, 3.0 if need == 1 else -1.0, True))
            for to, text, cost, read in arcs:
                for (done, word, was), (score, paid) in here:
                    extend(to, done, word, was or read, score - cost, paid + cost, text)
        last: dict[tuple[str, bool], tuple[float, float]] = {}
        for (done, word, read), (score, cost) in states[-1].items():
            for text, add in self._filled(word) if word else [("", 0.0)]:
                key = (done + text, read)
                if key not in last or score + add > last[key][0]:
                    last[key] = (score + add, cost)
        ranked = sorted(last.items(), key=lambda kv: -kv[1][0])[: BEAM * 4]
        return [(text, cost, read) for (text, read), (_, cost) in ranked]

    def _once(self, token: str) -> tuple[str, bool]:
        fixed, n = _swapped(token)
        if n:
            return fixed, True
        fixed, n = _utf7(token)
        if n and self.score(fixed) > self.score(token):
            return fixed, True
        if "&" in token and ENTITY.search(token):
            plain = html.unescape(token)
            if plain != token and not plain.isascii():
                back, garbled = self._once(plain)
                if garbled:
                    return back, True
            return token, False
        if token.isascii():
            return token, False
        best, flagged = token, False
        if "�" in token or any(c in _leads() for c in token):
            own = self.score(token)
            top = own - 9.0 * token.count(LOST)
            for text, cost, read in self._paths(token):
                if not read or text == token:
                    continue
                if not self._coherent(token, text):
                    continue
                cost += 3.0 * len(INNER.findall(text)) + 2.0 * (text[-1] in OPENING or text[0] in CLOSING)
                s = self.score(text) - cost - 9.0 * text.count(LOST) - 2.0 * (token.count(LOST) > text.count(LOST))
                if s > top + 1.0:
                    top, best, flagged = s, text, True
            if "�" in token:
                flagged = True
        if not flagged and any(0x80 <= ord(c) < 0xA0 and c != "\x85" for c in token):
            flagged = True
            try:
                best = "".join(bytes([ord(c)]).decode("cp1252") if 0x80 <= ord(c) < 0xA0 else c for c in token)
            except UnicodeDecodeError:
                best = token
        if not flagged:
            best, flagged = self._single_byte(token)
        return best, flagged

    def _coherent(self, token: str, text: str) -> bool:
        """Readings that leave letters of a foreign script beside restored Latin ones, or one lone Eastern sign, are chance."""
        scripts = [s for s in map(_script, text) if s]
        east = scripts.count("east")
        if east and (east < 3 or "latin" in scripts and east < len(scripts) - 1 and east < 4):
            return False
        for s in ("cyrillic", "greek"):
            n = scripts.count(s)
            if n and (n < 3 or n < 0.8 * len(scripts)):
                return False
        return True

    def _single_byte(self, token: str) -> tuple[str, bool]:
        """Western single bytes shown in another single-byte table, judged by the words that come out."""
        words = WORD.findall(token)
        own = [self.freq(w.lower()) for w in words]
        best, gain, by = token, 0.0, -1
        for at, table in enumerate(self.western):
            text = "".join(table.get(c, c) for c in token)
            if text == token:
                continue
            fresh = WORD.findall(text)
            if not fresh or not all(_plausible(c) or ord(c) < 128 for c in text):
                continue
            counts = [self.freq(w.lower()) for w in fresh]
            if not self._word_like(text, fresh):
                continue
            changed = [n for w, n in zip(fresh, counts) if w not in words]
            before = [n for w, n in zip(words, own) if w not in fresh]
            if not changed or not before:
                continue
            mixed = any(len({s for s in map(_script, w) if s}) > 1 for w in words) or len(words) > len(fresh)
            ratio = min(changed) / (min(before) + 0.5)
            if min(changed) >= (2 if mixed else 5) and ratio >= (3 if mixed else 12) and ratio > gain:
                best, gain, by = text, ratio, at
        if gain > 0:
            self.table_of[token] = by
        return best, gain > 0

    @staticmethod
    def _word_like(text: str, fresh: list[str]) -> bool:
        if max(map(len, fresh)) < 3:
            return False
        inner = re.findall(r"(\w+)([^\w\s])(?=\w)", text)
        return all(p == "’" and a.lower() in ELIDED or ord(p) < 128 for a, p in inner)

    def token(self, token: str) -> tuple[str, bool]:
        known = self.memo.get(token)
        if known is None:
            text, garbled = token, False
            for _ in range(self.rounds):
                text2, again = self._once(text)
                garbled |= again
                if text2 == text:
                    break
                text = text2
            known = (text, garbled)
            if len(self.memo) > 300_000:
                self.memo.clear()
                self.table_of.clear()
            self.memo[token] = known
        return known

    def text(self, text: str | None) -> tuple[str | None, int]:
        """The restored text and how many tokens of it were garbled; null stays null with 0."""
        if not text or (text.isascii() and "&" not in text and "+" not in text):
            return text, 0
        n = 0
        tables: Counter[int] = Counter()

        def back(m: re.Match) -> str:
            nonlocal n
            t = m.group(0)
            if t.isascii() and "&" not in t and "+" not in t:
                return t
            fixed, garbled = self.token(t)
            n += garbled
            if t in self.table_of:
                tables[self.table_of[t]] += 1
            return fixed

        fixed = TOKEN.sub(back, text)
        if not tables:
            return fixed, n
        # words too short to judge alone follow the table that the rest of the text was read by
        table = self.western[tables.most_common(1)[0][0]]

        def follow(m: re.Match) -> str:
            nonlocal n
            t = m.group(0)
            if t.isascii() or len(t) > 3 or not any(c in table for c in t):
                return t
            other = "".join(table.get(c, c) for c in t)
            if self.freq(other.lower()) > 10 * self.freq(t.lower()) + 2:
                n += 1
                return other
            return t

        return TOKEN.sub(follow, fixed), n


def restore_encoding(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 20) -> DataFrame:
    """Documents with garbled text: (doc_id, garbled_tokens, lost, restored).

    lost: characters that stay U+FFFD in the restored text. Null, empty and clean texts do not come out; repeated rows
    come out as often as they occur; null ids stay null. One pass counts the words of all documents (fixed-size sketch),
    the second decodes; nothing else is shuffled.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = docs.sparkSession.sparkContext.broadcast(word_frequencies(source, "text", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(lru_cache(200_000)(Frequencies(sketch.value)))
        for batch in batches:
            rows = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fixed, n = restorer.text(text)
                if n:
                    rows.append((rid, n, fixed.count("�"), fixed))
            cols = list(zip(*rows)) if rows else [()] * 4
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "garbled_tokens", "lost", "restored"])

    return source.mapInArrow(run, "doc_id long, garbled_tokens int, lost int, restored string")
