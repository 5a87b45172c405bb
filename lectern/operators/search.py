"""Substring, keyword and metadata search for many questions at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import words

BLOCK = 2_000


def text_matches(text: str, needle: str | Column) -> Column:
    """Case-insensitive substring; wild cards in the needle are ordinary characters."""
    return F.contains(F.lower(F.col(text)), F.lower(F.lit(needle) if isinstance(needle, str) else needle))


def metadata_filter(videos: DataFrame, channels: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, ids: DataFrame | None = None, date_bound: str = "lexical") -> DataFrame:
    """Videos that meet all given conditions.

    Dates compare as text (date_bound='lexical': the last day is excluded once a time follows it) or include the last day
    ('inclusive_day'). Null fields never match a condition on them.
    """
    out = videos
    if channels:
        out = out.where(F.col("channel").isin(*channels))
    if date_from:
        out = out.where(F.col("watch_date") >= date_from)
    if date_to:
        out = out.where((F.col("watch_date") if date_bound == "lexical" else F.substring("watch_date", 1, 10)) <= date_to)
    return out if ids is None else out.join(ids.select("video_id"), "video_id", "left_semi")


def keyword_search(questions: DataFrame, texts: DataFrame, *, k: int = 10, least: int = 3) -> DataFrame:
    """The ``k`` best texts of each question: (query_id, video_id, row_id, score, rank).

    ``questions`` (query_id, question) is a stated query set, taken in blocks of bounded size; ``texts`` (video_id, row_id, text)
    is scanned once per block. score counts the question's words (repeats count again) that occur in the text as
    substrings; texts of score 0 do not come out. Every task keeps its own best ``k`` per question before anything
    is shuffled. Ties go to the lesser video and row. Null texts and questions match nothing.
    """
    spark = texts.sparkSession
    asked = questions.where("question is not null").select("query_id", words("question", least).alias("words")).where(F.size("words") > 0)
    source = texts.where("text is not null").select("video_id", "row_id", F.lower("text").alias("text"))
    blocks: list[DataFrame] = []

    def scan(block: list[tuple[int, list[str]]]) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import heapq

            vocabulary = sorted({w for _, ws in held.value for w in ws})
            best: dict[int, list] = {q: [] for q, _ in held.value}
            for batch in batches:
                for video, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    inside = {w for w in vocabulary if w in text}
                    if not inside:
                        continue
                    for q, ws in held.value:
                        score = sum(w in inside for w in ws)
                        if score:
                            item = (score, _Down((video or "", row)), video, row)
                            heap = best[q]
                            heapq.heappush(heap, item) if len(heap) < k else heapq.heappushpop(heap, item)
            rows = [(q, v, r, s) for q, heap in best.items() for s, _, v, r in heap]
            cols = list(zip(*rows)) if rows else [()] * 4
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["query_id", "video_id", "row_id", "score"])

        return source.mapInArrow(run, "query_id long, video_id string, row_id long, score int")

    block: list[tuple[int, list[str]]] = []
    for row in asked.toLocalIterator():
        block.append((row["query_id"], list(row["words"])))
        if len(block) == BLOCK:
            blocks.append(scan(block))
            block = []
    if block or not blocks:
        blocks.append(scan(block))
    found = blocks[0]
    for more in blocks[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "video_id", "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Down:
    """Reverses an order within a heap."""

    __slots__ = ("value",)

    def __init__(self, value: tuple):
        self.value = value

    def __lt__(self, other: _Down) -> bool:
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Down) and self.value == other.value
