"""Broken references of the library's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.orphans import ForeignKey, broken_references, orphan_cascade
from lectern.tables import table

CHILDREN = ("transcripts", "synthetic_questions", "entities")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the child tables whose video is deleted, missing or late: the direct orphans of the cascade."""
    return broken_references({n: table(spark, d, n) for n in CHILDREN}, table(spark, d, "videos"), table(spark, d, "video_removals"), key="video_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table, month and kind."""
    return p3_found(spark, d).groupBy("table_name", "period", "kind").agg(F.count(F.lit(1)).alias("records"))


def p3_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month, direct and inherited.

    All refer to a video that must be there in their time; questions, entities and queued tasks are also made from its transcripts,
    so they inherit when their video is sound but all its transcripts are orphans.
    """
    names = ("videos", "transcripts", "synthetic_questions", "entities", "processing_queue")
    tables = {n: table(spark, d, n) for n in names}
    keys = [ForeignKey(n, "video_id", "videos", "video_id", "created_at", "created_at") for n in names[1:]]
    keys += [ForeignKey(n, "video_id", "transcripts", "video_id") for n in names[2:]]
    ids = {n: "id" for n in names[1:]} | {"videos": "video_id"}
    found = orphan_cascade(tables, keys, ids)
    months = [tables[n].select(F.lit(n).alias("table_name"), F.col(ids[n]).cast("string").alias("record_id"), F.date_format("created_at", "yyyy-MM").alias("period")).groupBy("table_name", "record_id").agg(F.min("period").alias("period")) for n in names[1:]]
    dated = found.join(reduce(DataFrame.unionByName, months), ["table_name", "record_id"])
    return dated.groupBy("table_name", "period").agg(F.count(F.when(~F.col("inherited"), 1)).alias("direct"), F.count(F.when(F.col("inherited"), 1)).alias("inherited"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_cascade": p3_cascade}

_FOUND = """
    SELECT DISTINCT c.table_name, strftime(c.created_at, '%Y-%m') AS period, c.id AS record_id,
           CASE WHEN v.video_id IS NULL AND r.video_id IS NOT NULL THEN 'deleted'
                WHEN v.video_id IS NULL THEN 'missing' ELSE 'late' END AS kind
    FROM (SELECT 'transcripts' AS table_name, id, video_id, created_at FROM transcripts
          UNION ALL SELECT 'synthetic_questions', id, video_id, created_at FROM synthetic_questions
          UNION ALL SELECT 'entities', id, video_id, created_at FROM entities) c
    LEFT JOIN (SELECT video_id, min(created_at) AS since FROM videos WHERE video_id IS NOT NULL GROUP BY 1) v ON c.video_id = v.video_id
    LEFT JOIN (SELECT DISTINCT video_id FROM video_removals) r ON c.video_id = r.video_id
    WHERE c.video_id IS NOT NULL AND (v.video_id IS NULL OR v.since > c.created_at)
"""
SQL = {
    "p3_found": _FOUND,
    "p3_report": f"SELECT table_name, period, kind, count(*) AS records FROM ({_FOUND}) GROUP BY ALL",
    "p3_cascade": """
        WITH v AS (SELECT video_id, min(created_at) AS since FROM videos WHERE video_id IS NOT NULL GROUP BY 1),
        rows AS (SELECT 'transcripts' AS table_name, id, video_id, created_at FROM transcripts
                 UNION ALL SELECT 'synthetic_questions', id, video_id, created_at FROM synthetic_questions
                 UNION ALL SELECT 'entities', id, video_id, created_at FROM entities
                 UNION ALL SELECT 'processing_queue', id, video_id, created_at FROM processing_queue),
        seen AS (SELECT r.*, r.video_id IS NOT NULL AND (v.video_id IS NULL OR coalesce(v.since > r.created_at, false)) AS lost
                 FROM rows r LEFT JOIN v ON v.video_id = r.video_id),
        every AS (SELECT DISTINCT video_id FROM transcripts WHERE video_id IS NOT NULL),
        sound AS (SELECT DISTINCT video_id FROM seen WHERE table_name = 'transcripts' AND NOT lost AND video_id IS NOT NULL),
        kid AS (SELECT table_name, id, strftime(min(created_at), '%Y-%m') AS period,
                       max(CASE WHEN lost OR table_name <> 'transcripts' AND video_id IS NOT NULL AND video_id NOT IN (SELECT video_id FROM every) THEN 1 ELSE 0 END) AS direct,
                       max(CASE WHEN table_name <> 'transcripts' AND video_id IS NOT NULL AND video_id NOT IN (SELECT video_id FROM sound) THEN 1 ELSE 0 END) AS broken
                FROM seen GROUP BY 1, 2)
        SELECT table_name, period, sum(direct)::BIGINT AS direct, sum(CASE WHEN direct = 1 THEN 0 ELSE broken END)::BIGINT AS inherited
        FROM kid WHERE direct = 1 OR broken = 1 GROUP BY 1, 2
    """,
}
