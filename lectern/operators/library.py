"""Read models over the tables of a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import is_blank
from lectern.operators.versions import latest_by_aggregate

UPLOAD_DATE = "$.upload_date"


def counts_by(child: DataFrame, key: str, out: str) -> DataFrame:
    """Rows per key, combined map-side."""
    return child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def briefed(transcripts: DataFrame, missing: str = "null") -> DataFrame:
    """Keys of the videos that have a brief: not null (missing='null'), or not blank ('blank')."""
    has = F.col("shorty").isNotNull() if missing == "null" else ~is_blank("shorty")
    return transcripts.where(has & F.col("video_id").isNotNull()).select("video_id").distinct()


def overview(videos: DataFrame, transcripts: DataFrame, questions: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per video with its flags and counts; three aggregates, three joins on the same key."""
    return (
        videos.join(briefed(transcripts).withColumn("_b", F.lit(True)), "video_id", "left")
        .join(counts_by(questions, "video_id", "_q"), "video_id", "left")
        .join(counts_by(entities, "video_id", "_e"), "video_id", "left")
        .select(
            "video_id", "title", "channel", "watch_date", F.get_json_object("json_metadata", UPLOAD_DATE).alias("upload_date"),
            F.coalesce("_b", F.lit(False)).alias("has_brief"), F.coalesce("_q", F.lit(0)).alias("question_count"), F.coalesce("_e", F.lit(0)).alias("entity_count"), "created_at",
        )
    )


def restrict(videos: DataFrame, transcripts: DataFrame, channel: str | None = None, status: str | None = None) -> DataFrame:
    """Videos of a channel, and with ('has_brief') or without ('missing_brief') a brief."""
    if channel:
        videos = videos.where(F.col("channel") == channel)
    if status == "has_brief":
        return videos.join(briefed(transcripts), "video_id", "left_semi")
    if status == "missing_brief":
        return videos.join(briefed(transcripts), "video_id", "left_anti")
    return videos


def channels(videos: DataFrame) -> DataFrame:
    return videos.where(F.col("channel").isNotNull() & (F.col("channel") != "")).select("channel").distinct()


def stats(videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row of totals; each table is read once."""
    v = videos.agg(F.count(F.lit(1)).alias("videos"), F.count_if("has_transcript").alias("with_transcript"))
    t = transcripts.agg(F.count(F.lit(1)).alias("transcripts"), F.count_if(F.col("shorty").isNotNull()).alias("with_brief"))
    one = F.lit(1).alias("_one")  # both sides are a single row
    return v.select("*", one).join(t.select("*", one), "_one").drop("_one")


def missing_briefs(videos: DataFrame, transcripts: DataFrame, rule: str) -> DataFrame:
    """Keys of videos without a brief, by one of three rules.

    null: no row has one; any_row_null: some row has none; blank: some row with text has a null or blank one.
    """
    if rule == "null":
        return videos.join(briefed(transcripts), "video_id", "left_anti").select("video_id")
    lacks = F.col("shorty").isNull() if rule == "any_row_null" else is_blank("shorty") & ~is_blank("text")
    return videos.join(transcripts.where(lacks).select("video_id"), "video_id", "left_semi").select("video_id")


def status_of(requested: DataFrame, videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    """For each requested video: whether it is known, whether it has a transcript, and its metadata."""
    stored = transcripts.select("video_id").distinct().withColumn("_t", F.lit(True))
    known = videos.select("video_id", "title", "channel", F.lit(True).alias("_v"))
    return requested.join(known, "video_id", "left").join(stored, "video_id", "left").select(
        "video_id", F.coalesce("_v", F.lit(False)).alias("known"), F.coalesce("_t", F.lit(False)).alias("has_transcript"), "title", "channel"
    )


def details(videos: DataFrame, transcripts: DataFrame, questions: DataFrame, entities: DataFrame) -> DataFrame:
    """What a video's page shows, as rows (video_id, part, sort_key, value): newest transcript, questions in order, entities by name.

    Rows, not lists: a video that holds a third of all entities stays spread over tasks. Rows delivered twice come once;
    children of unknown videos are left out.
    """
    newest = latest_by_aggregate(transcripts.where("video_id is not null"), "video_id", ["id"])
    text = newest.select("video_id", F.lit("transcript").alias("part"), F.lit("").alias("sort_key"), F.col("id").cast("string").alias("value"))
    place = F.concat_ws("/", F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("-")), F.lpad(F.coalesce(F.col("question_index").cast("string"), F.lit("-")), 6, "0"), F.col("id").cast("string"))
    asked = questions.select("video_id", F.lit("question").alias("part"), place.alias("sort_key"), F.col("question").alias("value")).distinct()
    named = entities.where("name is not null").select("video_id", F.lit("entity").alias("part"), F.col("name").alias("sort_key"), F.col("name").alias("value")).distinct()
    return text.unionByName(asked).unionByName(named).join(videos.select("video_id"), "video_id", "left_semi")


def segments_to_text(segments: DataFrame, key: str, start: str, text: str) -> DataFrame:
    """Caption segments joined by spaces in order of their start."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(text).alias("t"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"))


def sections(briefs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of sectioned briefs: (key, section, ordinal, line); the head is the section HEADER.

    A heading is a line without lower-case letters that holds a letter and no colon. Blank lines are left out.
    """
    lines = F.filter(F.transform(F.split(F.col(text), r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    placed = briefs.select(key, F.posexplode(lines).alias("ordinal", "line"))
    from pyspark.sql import Window

    heading: Column = F.col("line").rlike(r"\p{Lu}") & ~F.col("line").rlike(r"[\p{Ll}:]") & ~F.col("line").rlike(r"^[\d\-]")
    marked = placed.withColumn("_h", F.when(heading, F.col("line")))
    running = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    named = marked.withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(running), F.lit("HEADER")))
    return named.where("_h is null").select(key, "section", "ordinal", "line")
