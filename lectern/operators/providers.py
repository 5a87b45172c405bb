"""Providers of generated artefacts: an interface, and deterministic ones that need no network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"(?:[A-Z][\w’'-]+)(?:\s+[A-Z][\w’'-]+)+")
SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")


class Provider(Protocol):
    """What a generator offers; a hosted model implements the same methods."""

    def brief(self, text: str, title: str | None, channel: str | None, date: str | None) -> str: ...

    def questions(self, text: str, title: str | None, n: int) -> list[str]: ...

    def entities(self, text: str, title: str | None) -> list[dict]: ...

    def rewrites(self, question: str) -> list[str]: ...

    def answer(self, question: str, context: str) -> str: ...


class Extractive:
    """Takes everything from the text itself: leading sentences, what-is questions about its names, the context as answer."""

    def brief(self, text: str, title: str | None = None, channel: str | None = None, date: str | None = None, sentences: int = 6) -> str:
        picked = [s.strip() for s in SENTENCE.split(text) if s.strip()][:sentences]
        return "CONTEXT\n" + "\n".join(f"- {s}" for s in picked)

    def questions(self, text: str, title: str | None = None, n: int = 10) -> list[str]:
        return [f"What is said about {name}?" for name in self._names(text)[:n]]

    def entities(self, text: str, title: str | None = None) -> list[dict]:
        return [{"name": name, "type": "concept", "aliases": []} for name in self._names(text)]

    def rewrites(self, question: str) -> list[str]:
        bare = " ".join(w for w in re.findall(r"[^\W_]+", question) if len(w) > 3)
        return [bare] if bare and bare != question else []

    def answer(self, question: str, context: str) -> str:
        return context

    @staticmethod
    def _names(text: str) -> list[str]:
        return list(dict.fromkeys(m.group(0) for m in NAME.finditer(text)))


def generate(sources: DataFrame, provider: Provider, *, n: int = 10) -> DataFrame:
    """Brief, questions and entities of each source (video_id, title, channel, date, text): one pass, one Python hop.

    Null and blank texts come out with ``error`` set and nothing generated; an exception of the provider becomes the row's
    error, so one bad row never stops a job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for video, title, channel, date, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not (text or "").strip():
                    rows.append((video, None, None, None, "no text"))
                    continue
                try:
                    listed = [{"name": e["name"], "type": e["type"], "aliases": list(e.get("aliases") or [])} for e in provider.entities(text, title)]
                    rows.append((video, provider.brief(text, title, channel, date), provider.questions(text, title, n)[:n], listed, None))
                except Exception as problem:  # noqa: BLE001
                    rows.append((video, None, None, None, str(problem)[:500]))
            entity = pa.struct([("name", pa.string()), ("type", pa.string()), ("aliases", pa.list_(pa.string()))])
            cols = list(zip(*rows)) if rows else [()] * 5
            types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(entity), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["video_id", "brief", "questions", "entities", "error"])

    schema = "video_id string, brief string, questions array<string>, entities array<struct<name:string,type:string,aliases:array<string>>>, error string"
    return sources.select("video_id", "title", "channel", "date", "text").mapInArrow(run, schema)


def generated_rewrites(questions: DataFrame, provider: Provider) -> DataFrame:
    """Questions (question_id, question, video_ids) with the provider's ``rewrites``; null questions have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [provider.rewrites(q) if q else [] for q in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.string()))], ["question_id", "question", "video_ids", "rewrites"])

    source = questions.select(F.col("question_id").cast("long").alias("question_id"), "question", "video_ids")
    return source.mapInArrow(run, "question_id long, question string, video_ids array<string>, rewrites array<string>")
