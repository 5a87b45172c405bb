"""Splitting oversized texts at natural boundaries by packing a structure tree.

The tree of a text has the levels section, paragraph, line, sentence, word and stretch. Sibling subtrees that fit
are merged bottom-up to the limit; only nodes over the limit are descended into. A stretch (what lies
between two neighbouring natural boundaries) is cut by force only if it alone is over the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOPS = ".!?。！？"
#: Ways to divide a node, coarse first: the child starts where the pattern's match ends.
LEVELS = (
    re.compile(r"\n(?=[^\S\n]*(?:#{1,6}\s|[A-Z][A-Z /&-]{3,}:?[^\S\n]*\n))"),  # headings
    re.compile(r"\n[^\S\n]*\n\s*"),  # paragraphs
    re.compile(r"\n"),  # lines: list items, speaker turns
    re.compile(rf"[{STOPS}]+[\"'”’»)\]]*\s+|[。！？]"),  # sentences
    re.compile(r"[,;:—–]\s+"),  # clauses
    re.compile(r"\s+"),  # words
    re.compile(rf"[{STOPS}]"),  # stretches
)
BOUNDARY = re.compile(rf"\s|[{STOPS}]")


def _length(text: str, start: int, end: int) -> int:
    """Code points of the node without white space at its ends."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return end - start


def _pack(text: str, start: int, end: int, level: int, body: int, limit: int, out: list[tuple[int, int, bool]]) -> None:
    """Append (start, end, forced) of the cores of one node."""
    if level < len(LEVELS):
        edges = [start]
        edges += [m.end() for m in LEVELS[level].finditer(text, start, end) if start < m.end() < end]
        edges.append(end)
    else:
        if _length(text, start, end) <= limit:
            out.append((start, end, False))
            return
        out += [(at, min(at + body, end), True) for at in range(start, end, body)]
        return
    if len(edges) == 2:
        _pack(text, start, end, level + 1, body, limit, out)
        return
    open_at = -1
    for a, b in zip(edges, edges[1:]):
        if open_at >= 0 and _length(text, open_at, b) > body:
            out.append((open_at, a, False))
            open_at = -1
        if open_at < 0:
            if _length(text, a, b) > body:
                _pack(text, a, b, level + 1, body, limit, out)
            else:
                open_at = a
    if open_at >= 0:
        out.append((open_at, end, False))


def _merge(text: str, cores: list[tuple[int, int, bool]], body: int) -> list[tuple[int, int, bool]]:
    """Neighbouring cores that together fit, where one is the short rest of a divided node, become one."""
    merged: list[tuple[int, int, bool]] = []
    for core in cores:
        if merged and not core[2] and not merged[-1][2] and _length(text, merged[-1][0], core[1]) <= body:
            merged[-1] = (merged[-1][0], core[1], False)
        else:
            merged.append(core)
    return merged


def split_text(text: str | None, limit: int = 800, overlap: int = 200) -> list[tuple[int, int, int, bool]]:
    """Pieces (start, core_start, end, forced) of at most ``limit`` code points, offsets into ``text``.

    Consecutive pieces share the up to ``overlap`` code points between start and core_start, cut at a natural
    boundary. Null, blank and empty texts give no piece; a text within the limit gives one. White space at the
    ends of the text is outside of all pieces. forced: the piece's core begins or ends inside a stretch.
    """
    if text is None or not text.strip():
        return []
    begin, end = len(text) - len(text.lstrip()), len(text.rstrip())
    if end - begin <= limit:
        return [(begin, begin, end, False)]
    cores: list[tuple[int, int, bool]] = []
    body = max(1, limit - overlap)
    _pack(text, begin, end, 0, body, limit, cores)
    pieces = []
    for at, (a, b, forced) in enumerate(_merge(text, cores, body)):
        while b > a and text[b - 1].isspace():
            b -= 1
        if b == a:
            continue
        start = a
        if at and pieces:
            room = min(overlap, limit - (b - a))
            low = max(pieces[-1][1], a - room, begin)
            if forced and pieces[-1][3]:
                start = low
            elif low < a:
                if low == begin or text[low - 1].isspace() or text[low - 1] in STOPS:
                    start = low
                else:
                    m = BOUNDARY.search(text, low, a)
                    start = m.end() if m else a
            while start < a and text[start].isspace():
                start += 1
        pieces.append((start, a, b, forced))
    return pieces


def split_oversized(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", limit: int = 800, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Pieces of all texts: (id, piece_no, start, core_start, end, forced[, piece]), offsets in code points.

    See ``split_text`` for null, blank and short texts. Rows with a null id keep their null id. Repeated rows give
    repeated pieces. A narrow map: no shuffle, one pass over the text; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece_no", "start", "core_start", "end", "forced"] + ["piece"] * with_text
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for no, (a, c, b, forced) in enumerate(split_text(text, limit, overlap)):
                    rows.append((rid, no, a, c, b, forced, text[a:b]) if with_text else (rid, no, a, c, b, forced))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = "id long, piece_no int, start int, core_start int, end int, forced boolean" + ", piece string" * with_text
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, schema)


def cut_kinds(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", limit: int = 800, overlap: int = 200) -> DataFrame:
    """Texts that had to be cut: (id, cut), cut 'forced' if a piece had to be cut inside a stretch, else 'natural'."""
    pieces = split_oversized(docs, id_col=id_col, text_col=text_col, limit=limit, overlap=overlap, with_text=False)
    kinds = pieces.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("forced").alias("forced"))
    return kinds.where("n > 1").select("id", F.when(F.col("forced"), F.lit("forced")).otherwise(F.lit("natural")).alias("cut"))
