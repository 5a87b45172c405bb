"""Queries over changes to tables, files written and read again, estimates, counters and lists."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import entities as E
from lectern.functions import text as X
from lectern.functions.vectors import embed
from lectern.operators import library as L
from lectern.operators import versions as V
from lectern.operators import writes as W
from lectern.operators.providers import Extractive, generate
from lectern.plans.sql import BREAK, WHITE, blank, chunks, strip
from lectern.session import ensure_checkpoint_dir
from lectern.sources import readers as S
from lectern.streaming import queue as Q
from lectern.tables import table

PAGE, BATCH, LISTED = 50, 10, 500
TASKS = ("shorty", "synthetic_questions", "entities")
NOW = "2026-01-01 00:00:00"
PROMPT = "Title: {title}\nChannel: {channel}\n\n{text}"


def _now() -> F.Column:
    return F.to_timestamp(F.lit(NOW)).cast("timestamp_ntz")


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{os.urandom(8).hex()}"


def conformed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an older form of the transcripts under today's schema, and rows with one more column added to them."""
    old = table(spark, d, "transcripts").select("id", "video_id")
    today = W.conform(old, S.bootstrap(spark, "transcripts"), S.DEFAULTS["transcripts"]).select("id", "video_id", "language", "shorty")
    more = table(spark, d, "video_removals").select("video_id", "reason")
    return W.evolve(today, more, {"language": "en"}).select("id", "video_id", "language", "shorty", "reason")


def stored_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Videos and their transcripts after one was stored for each removed video: both states of one change."""
    new = table(spark, d, "video_removals").where("video_id is not null").groupBy("video_id").agg(F.lit(-1).cast("long").alias("id"), F.lit("restored").alias("text"))
    videos, transcripts = W.store_transcripts(table(spark, d, "videos"), table(spark, d, "transcripts"), new, _now())
    flagged = videos.select("video_id", F.col("has_transcript").cast("string").alias("value"), F.date_format("transcript_fetched_at", "yyyy-MM-dd").alias("day"), F.lit("video").alias("part"))
    return flagged.unionByName(transcripts.select("video_id", F.concat_ws("/", F.col("id").cast("string"), "language").alias("value"), F.lit(None).cast("string").alias("day"), F.lit("transcript").alias("part")))


def updated_paths(spark: SparkSession, d: str) -> DataFrame:
    """Videos of one channel after their path, metadata and watch date were set."""
    videos = table(spark, d, "videos")
    meta = F.to_json(F.struct(F.col("title").alias("title"), F.lit(1).alias("version")))
    changes = videos.where("channel = 'Paper Bench'").select("video_id", F.concat(F.lit("files/"), "video_id").alias("local_path"), meta.alias("json_metadata"), F.lit(NOW).alias("watch_date"))
    done = W.update(videos, changes, "video_id", ["local_path", "json_metadata", "watch_date"])
    return done.select("video_id", "local_path", "watch_date", F.get_json_object("json_metadata", "$.title").alias("title"))


def updated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts after the texts of some rows, named by id and video, were replaced; rows of null video keep theirs."""
    rows = table(spark, d, "transcripts")
    changes = rows.where("length(text) > 2000").select("id", "video_id", F.upper(F.substring("text", 1, 40)).alias("text"))
    return W.update(rows, changes, ["id", "video_id"], ["text"]).select("id", F.md5("text").alias("text"))


def appended_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question rows made from lists: the aliases of each entity row, in order, without an index id."""
    rows = table(spark, d, "entities").where("video_id is not null").select("id", "video_id", F.transform("aliases", lambda a: F.concat(F.lit("Who is "), a, F.lit("?"))).alias("questions")).distinct()
    made = W.explode_children(rows.withColumn("video_id", F.concat_ws("/", "video_id", F.col("id").cast("string"))), "video_id", "questions", "question", "question_index")
    return W.conform(made, S.bootstrap(spark, "synthetic_questions")).select("video_id", "question", "question_index", "embedding_id")


def appended_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities as they are appended: rows without name or type skipped, aliases as JSON; with how many of a video there are."""
    rows = table(spark, d, "entities").where(~X.is_blank("name") & ~X.is_blank("type")).select("id", "video_id", "name", "type", F.to_json(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases")).distinct()
    counts = rows.groupBy(F.col("video_id").alias("_video")).agg(F.count(F.lit(1)).alias("added"))
    return rows.join(counts, F.col("video_id").eqNullSafe(F.col("_video"))).drop("_video")


def edited_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities after an edit: name stripped, aliases from one line of commas, an empty type becomes 'manual'."""
    rows = table(spark, d, "entities").select("id", "name", "type", "aliases").distinct()
    line = F.concat_ws(" , ", F.coalesce("aliases", F.array().cast("array<string>")), F.lit(" "))
    edits = rows.select("id", X.strip("name").alias("name"), X.or_default("type", "manual").alias("type"), E.aliases_from_line(line).alias("aliases")).groupBy("id").agg(F.min(F.struct("name", "type", "aliases")).alias("e")).select("id", "e.*")
    return W.update(rows, edits, "id", ["name", "type", "aliases"]).select("id", "name", "type", F.concat_ws("|", "aliases").alias("aliases")).distinct()


def added_entities(spark: SparkSession, d: str) -> DataFrame:
    """The table of entities after one was added by hand for each channel: a name is required, the type defaults to 'manual'."""
    base = table(spark, d, "entities").select("id", "video_id", "name", "type").distinct()
    new = table(spark, d, "videos").select(F.lit(0).cast("long").alias("id"), "video_id", X.strip("channel").alias("name")).where(~X.is_blank("name"))
    return base.unionByName(W.conform(new, base, {"type": "manual"}))


def queue_transitions(spark: SparkSession, d: str) -> DataFrame:
    """The queue after its pending tasks were started, its running ones failed or completed, and others were paused."""
    queue = table(spark, d, "processing_queue").dropDuplicates(["id"])
    to = F.when(F.col("status") == "pending", "started").when(F.col("status") == "failed", "paused").when(F.col("task") == "entities", "failed").otherwise("completed")
    changes = queue.where("status is not null").select("id", to.alias("status"), F.lit("no answer").alias("error"))
    done = W.transition(queue, changes, "id", _now())
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return done.select("id", "status", day("started_at"), day("completed_at"), "error")


def swept_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after a restart: those left pending or running since before a day are errors."""
    return W.sweep(table(spark, d, "ask_jobs"), "status", ["pending", "running"], "error", F.col("updated_at") < F.lit(NOW).cast("timestamp_ntz")).select("id", "status")


def recovered_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose answers were lost from the table and come back from their files, one JSON file per job."""
    jobs = table(spark, d, "ask_jobs")
    folder = _folder(spark, "answers")
    kept = jobs.where("answer is not null").select("id", "answer.answer", "answer.used_context")
    kept.select(F.to_json(F.struct("id", "answer", "used_context"), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)
    files = spark.read.schema("id long, answer string, used_context array<string>").json(folder).select("id", F.struct("answer", "used_context").alias("answer"))
    lost = jobs.withColumn("answer", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("answer"))).withColumn("status", F.when(F.col("id") % 2 == 0, F.lit("running")).otherwise(F.col("status")))
    return S.recover_jobs(lost, files).select("id", "status", F.md5("answer.answer").alias("answer"))


def failure_files(spark: SparkSession, d: str) -> DataFrame:
    """Failed tasks, written as a failure list and read again."""
    folder = _folder(spark, "failures")
    failed = table(spark, d, "processing_queue").where("status = 'failed'").select("video_id", "task", "error").distinct()
    S.write_failures(failed.select("video_id", F.col("task").alias("title"), "error"), folder)
    return S.read_failures(spark, folder).select("video_id", "title", F.coalesce("error", F.lit("")).alias("error"))


def pasted_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Pasted transcripts, written as JSON lines and read with cleaned texts and the reasons against unusable ones."""
    folder = _folder(spark, "pasted")
    texts = table(spark, d, "transcripts").select("id", "video_id", "text").join(table(spark, d, "videos").select("video_id", "url", "title", "channel"), "video_id")
    texts.select("url", F.concat_ws(" / ", F.col("id").cast("string"), "title").alias("title"), "channel", F.col("text").alias("transcript")).write.json(folder)
    return S.read_pasted(spark, folder).select("video_id", "title", "channel", F.md5("text").alias("text"), F.concat_ws(",", "reasons").alias("reasons"))


def csv_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Time sheets of the queue, written as CSV and read under the schema with its defaults."""
    folder = _folder(spark, "sheets")
    rows = table(spark, d, "processing_queue").select("id", "video_id", "task").distinct()
    rows.write.option("header", True).csv(folder)
    return S.load(spark, folder, "processing_queue", "csv", header="true").select("id", "video_id", "task", "status")


def joined_segments(spark: SparkSession, d: str) -> DataFrame:
    """Captions of each transcript, one a line, joined by spaces in the order of their start."""
    rows = table(spark, d, "transcripts").where("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("start", "line"))
    return L.segments_to_text(rows, "id", "start", "line").select("id", F.md5("text").alias("text"))


def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many videos and pages each filter leaves: channel and status, one, both or none of them."""
    videos, transcripts = table(spark, d, "videos"), table(spark, d, "transcripts")
    out = None
    for channel in (None, "Paper Bench"):
        for status in (None, "has_brief", "missing_brief"):
            kept = L.restrict(videos, transcripts, channel, status).agg(F.count(F.lit(1)).alias("videos"))
            pages = kept.select(F.lit(channel).cast("string").alias("channel"), F.lit(status).cast("string").alias("status"), "videos", V.pages("videos", PAGE).alias("pages"), F.ceil(F.col("videos") / BATCH).cast("long").alias("batches"))
            out = pages if out is None else out.unionByName(pages)
    return out


def last_page(spark: SparkSession, d: str) -> DataFrame:
    """A page far beyond the end: the last one comes instead."""
    return V.clamped_page(table(spark, d, "videos"), 1_000_000, PAGE, F.col("created_at").desc_nulls_last(), F.col("video_id")).select("video_id", "title")


def projected_columns(spark: SparkSession, d: str) -> DataFrame:
    """The wanted columns that a table has; those it lacks are not asked for."""
    rows = table(spark, d, "videos")
    return rows.select(*V.present(rows, ["video_id", "title", "duration", "watch_date", "shorty"]))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Tokens in and out that each video's newest transcript is expected to take; 0 and 0 without one."""
    newest = V.latest_by_aggregate(table(spark, d, "transcripts").where("video_id is not null and text is not null"), "video_id", ["text"])
    sized = table(spark, d, "videos").select("video_id").join(newest.select("video_id", X.token_estimate("text").alias("tokens_in")), "video_id", "left")
    out = F.when(F.col("tokens_in").isNull(), 0).otherwise(F.floor(F.col("tokens_in") * 15 / F.lit(100)) + 800).cast("long")
    return sized.select("video_id", F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"), out.alias("tokens_out"), X.show_count(F.coalesce("tokens_in", F.lit(0))).alias("shown"))


def enqueue_counters(spark: SparkSession, d: str) -> DataFrame:
    """What an enqueuing run finds, enqueues and skips, and how many tasks that makes."""
    found = L.missing_briefs(table(spark, d, "videos"), table(spark, d, "transcripts"), "blank").distinct()
    held = table(spark, d, "processing_queue").where("status in ('pending', 'completed') and video_id is not null").select("video_id", F.lit(True).alias("_held")).distinct()
    new = F.col("_held").isNull()
    counted = found.join(held, "video_id", "left").agg(F.count(F.lit(1)).alias("found"), F.count_if(new).alias("enqueued"), F.count_if(~new).alias("skipped"))
    return counted.withColumn("tasks", F.col("enqueued") * len(TASKS))


def newest_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest rows of the library, with their newest transcript, for a check by eye."""
    top = V.page_after(table(spark, d, "videos").where("video_id is not null"), LISTED, "created_at", "video_id").select("video_id", "title", "channel")
    latest = V.latest_by_aggregate(table(spark, d, "transcripts").where("video_id is not null"), "video_id", ["id", "language"])
    return top.join(latest, "video_id", "left").select("video_id", "title", "channel", F.col("id").alias("transcript_id"), "language")


def next_pages(spark: SparkSession, d: str) -> DataFrame:
    """The second page, newest first, found from the last row of the first instead of by counting."""
    rows = table(spark, d, "videos").where("video_id is not null and created_at is not null").select("video_id", "created_at")
    last = V.page_after(rows, PAGE, "created_at", "video_id").orderBy("created_at", "video_id").first()
    return V.page_after(rows, PAGE, "created_at", "video_id", last["created_at"], last["video_id"]).select("video_id")


def oldest_missing(spark: SparkSession, d: str) -> DataFrame:
    """The next videos that need a brief, oldest first."""
    videos = table(spark, d, "videos")
    keys = L.missing_briefs(videos, table(spark, d, "transcripts"), "null").distinct()
    return V.in_order(videos.join(keys, "video_id", "left_semi"), 20, F.col("created_at").asc_nulls_first(), F.col("video_id")).select("video_id", "title")


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """The one form of each video's link, and its metadata's missing parts filled."""
    return table(spark, d, "videos").select("video_id", X.canonical_url("video_id").alias("url"), X.stamp("created_at").alias("stamp"), X.or_default("channel", "Unknown channel").alias("channel"))


def filled_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt made for each transcript, by hash, and the shorter one of its title."""
    rows = table(spark, d, "transcripts").join(table(spark, d, "videos").select("video_id", "title", "channel"), "video_id")
    return rows.select("id", F.md5(X.fill(PROMPT, title="title", channel="channel", text="text")).alias("prompt"))


def fetch_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the queue in plain words."""
    rows = table(spark, d, "processing_queue").where("error is not null").select("id", "error").distinct()
    told = rows.withColumn("error", F.when(F.col("id") % 3 == 0, F.concat(F.lit("No transcript: "), "error")).when(F.col("id") % 3 == 1, F.concat("error", F.lit(" (Video unavailable)"))).otherwise(F.col("error")))
    return told.select("id", X.fetch_error("error").alias("told"))


def streamed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """New transcripts read as a stream, cut and embedded, each micro-batch written to the index; what the index then holds."""
    folder = _folder(spark, "chunks")
    rows = table(spark, d, "transcripts").where("false")
    stream = Q.read_stream(spark, d, "transcripts.parquet", rows).where("text is not null")
    made = stream.select("id", F.inline(X.chunks("text", 800, 200))).withColumn("embedding", embed(X.embed_input("chunk")))
    Q.run_available(made, Q.append_sink(f"{folder}/out"), f"{folder}/log")
    held = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return held.select("id", "ordinal", F.md5("chunk").alias("chunk"), F.size("embedding").alias("dimensions"))


def generated_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch run over the videos that lack a brief: artefacts of all sources in one pass, then the queue's new states.

    The generator is the offline one; blank texts fail, and each task ends as completed or failed with its error.
    """
    newest = V.latest_by_aggregate(table(spark, d, "transcripts").where("video_id is not null"), "video_id", ["text", "shorty"])
    lacking = newest.where(X.is_blank("shorty")).join(table(spark, d, "videos").select("video_id", "title", "channel", F.col("watch_date").alias("date")), "video_id")
    made = generate(lacking, Extractive())
    tasks = lacking.select("video_id", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error"))
    changes = made.select("video_id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error")
    ended = W.transition(tasks, changes, "video_id", F.to_timestamp(F.lit(NOW)))
    return ended.join(made.select("video_id", F.col("brief").isNotNull().alias("brief"), F.size("questions").alias("asked")), "video_id").select(
        "video_id", "status", "error", "brief", F.date_format("completed_at", "yyyy-MM-dd").alias("day"), (F.coalesce("asked", F.lit(0)) <= 10).alias("bounded")
    )


QUERIES = {
    f.__name__: f
    for f in (
        conformed_rows, stored_transcripts, updated_paths, updated_texts, appended_questions, appended_entities, edited_entities, added_entities, queue_transitions,
        swept_jobs, recovered_jobs, failure_files, pasted_transcripts, csv_sheets, joined_segments, filtered_counts, last_page, projected_columns, token_estimates,
        enqueue_counters, newest_list, next_pages, oldest_missing, canonical_urls, filled_prompts, fetch_errors, streamed_chunks, generated_batch,
    )
}

_TSV = lambda x: f"regexp_replace(coalesce({x}, ''), '[\\t\\r\\n]', ' ', 'g')"
_BRIEFED = "SELECT video_id FROM transcripts WHERE shorty IS NOT NULL AND video_id IS NOT NULL"
_BLANK = f"SELECT DISTINCT video_id FROM videos WHERE video_id IN (SELECT video_id FROM transcripts WHERE {blank('shorty')} AND NOT {blank('text')} AND video_id IS NOT NULL)"
_ID = r"coalesce(nullif(regexp_extract(v.url, '(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([^&\n?#]+)', 1), ''), nullif(regexp_extract(v.url, 'youtube\.com/watch\?.*v=([^&\n?#]+)', 1), ''))"
_CLEAN = f"""array_to_string(list_filter(list_transform(string_split_regex(coalesce(t.text, ''), '{BREAK}'), lambda s: {strip('s')}),
    lambda s: s <> '' AND NOT regexp_full_match(s, '\\p{{Nd}}{{1,2}}:\\p{{Nd}}{{2}}(:\\p{{Nd}}{{2}})?{WHITE}*[-–—]?')), chr(10) || chr(10))"""
SQL: dict[str, str] = {
    "conformed_rows": """SELECT id, video_id, 'en' AS language, NULL::VARCHAR AS shorty, NULL::VARCHAR AS reason FROM transcripts
        UNION ALL SELECT NULL, video_id, 'en', NULL, reason FROM video_removals""",
    "stored_transcripts": f"""
        WITH r AS (SELECT DISTINCT video_id FROM video_removals WHERE video_id IS NOT NULL)
        SELECT v.video_id, CASE WHEN r.video_id IS NOT NULL THEN 'true' ELSE has_transcript::VARCHAR END AS value,
               CASE WHEN r.video_id IS NOT NULL THEN '{NOW[:10]}' ELSE strftime(transcript_fetched_at, '%Y-%m-%d') END AS day, 'video' AS part FROM videos v LEFT JOIN r ON r.video_id = v.video_id
        UNION ALL SELECT video_id, concat_ws('/', id::VARCHAR, language), NULL, 'transcript' FROM transcripts
        UNION ALL SELECT video_id, '-1/en', NULL, 'transcript' FROM r""",
    "updated_paths": f"""
        SELECT video_id, CASE WHEN channel = 'Paper Bench' THEN 'files/' || video_id ELSE local_path END AS local_path,
               CASE WHEN channel = 'Paper Bench' THEN '{NOW}' ELSE watch_date END AS watch_date,
               CASE WHEN channel = 'Paper Bench' THEN title WHEN json_valid(json_metadata) THEN json_extract_string(json_metadata, '$.title') END AS title FROM videos""",
    "updated_texts": "SELECT id, md5(CASE WHEN length(text) > 2000 AND video_id IS NOT NULL THEN upper(substring(text, 1, 40)) ELSE text END) AS text FROM transcripts",
    "appended_questions": """
        SELECT video_id || '/' || id AS video_id, 'Who is ' || a || '?' AS question, (i - 1)::INTEGER AS question_index, NULL::VARCHAR AS embedding_id
        FROM (SELECT id, video_id, unnest(aliases) AS a, generate_subscripts(aliases, 1) AS i FROM (SELECT DISTINCT id, video_id, aliases FROM entities WHERE video_id IS NOT NULL))""",
    "appended_entities": f"""
        SELECT *, count(*) OVER (PARTITION BY video_id) AS added FROM (
            SELECT DISTINCT id, video_id, name, type, to_json(coalesce(aliases, []))::VARCHAR AS aliases FROM entities WHERE NOT {blank('name')} AND NOT {blank('type')})""",
    "edited_entities": f"""
        SELECT DISTINCT id, {strip('name')} AS name, coalesce(nullif({strip('type')}, ''), 'manual') AS type,
               array_to_string(list_filter(list_transform(flatten(list_transform(coalesce(aliases, []), lambda a: string_split(a, ','))), lambda a: {strip('a')}), lambda a: a <> ''), '|') AS aliases
        FROM entities""",
    "added_entities": f"""SELECT DISTINCT id, video_id, name, type FROM entities
        UNION ALL SELECT 0, video_id, {strip('channel')}, 'manual' FROM videos WHERE NOT {blank(strip('channel'))}""",
    "queue_transitions": f"""
        WITH q AS (SELECT DISTINCT ON (id) *, CASE WHEN status = 'pending' THEN 'started' WHEN status = 'failed' THEN 'paused' WHEN task = 'entities' THEN 'failed' WHEN status IS NOT NULL THEN 'completed' END AS new FROM processing_queue)
        SELECT id, coalesce(new, status) AS status, CASE WHEN new = 'started' THEN '{NOW}' ELSE strftime(started_at, '%Y-%m-%d %H:%M:%S') END AS started_at,
               CASE WHEN new IN ('completed', 'failed') THEN '{NOW}' ELSE strftime(completed_at, '%Y-%m-%d %H:%M:%S') END AS completed_at,
               CASE WHEN new IN ('completed', 'failed') THEN 'no answer' ELSE error END AS error FROM q""",
    "swept_jobs": f"SELECT id, CASE WHEN status IN ('pending', 'running') AND updated_at < TIMESTAMP '{NOW}' THEN 'error' ELSE status END AS status FROM ask_jobs",
    "recovered_jobs": """SELECT id, CASE WHEN id % 2 = 0 AND answer IS NOT NULL THEN 'completed' WHEN id % 2 = 0 THEN 'running' ELSE status END AS status, md5(answer.answer) AS answer FROM ask_jobs""",
    "failure_files": f"""SELECT {_TSV('video_id')} AS video_id, {_TSV('task')} AS title, {_TSV('error')} AS error
        FROM (SELECT DISTINCT video_id, task, error FROM processing_queue WHERE status = 'failed') WHERE NOT {blank('video_id')}""",
    "pasted_transcripts": f"""
        SELECT video_id, coalesce(nullif({strip('title')}, ''), 'Untitled') AS title, coalesce(nullif({strip('channel')}, ''), 'Unknown channel') AS channel, md5(text) AS text,
               array_to_string(list_filter([CASE WHEN video_id IS NULL THEN 'no video id' END, CASE WHEN text = '' THEN 'no transcript' END], lambda x: x IS NOT NULL), ',') AS reasons
        FROM (SELECT {_ID} AS video_id, concat_ws(' / ', t.id::VARCHAR, v.title) AS title, v.channel, {_CLEAN} AS text FROM transcripts t JOIN videos v ON v.video_id = t.video_id)""",
    "csv_sheets": "SELECT DISTINCT id, video_id, task, 'pending' AS status FROM processing_queue",
    "joined_segments": "SELECT id, md5(replace(text, chr(10), ' ')) AS text FROM transcripts WHERE text IS NOT NULL",
    "filtered_counts": f"""
        SELECT c.channel, s.status, count(*) FILTER (hit) AS videos, greatest(ceil(count(*) FILTER (hit) / {PAGE}.0), 1)::BIGINT AS pages, ceil(count(*) FILTER (hit) / {BATCH}.0)::BIGINT AS batches
        FROM (SELECT c.channel, s.status, (c.channel IS NULL OR coalesce(v.channel = c.channel, false)) AND (s.status IS NULL OR (s.status = 'has_brief') = coalesce(v.video_id IN ({_BRIEFED}), false)) AS hit
              FROM videos v, (VALUES (NULL), ('Paper Bench')) c(channel), (VALUES (NULL), ('has_brief'), ('missing_brief')) s(status)) x, (SELECT 1), LATERAL (SELECT x.channel) c, LATERAL (SELECT x.status) s
        GROUP BY 1, 2""",
    "last_page": f"""SELECT video_id, title FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, video_id NULLS FIRST) AS n, count(*) OVER () AS total FROM videos)
        WHERE n > (greatest(ceil(total / {PAGE}.0), 1) - 1) * {PAGE}""",
    "projected_columns": "SELECT video_id, title, watch_date FROM videos",
    "token_estimates": """
        WITH n AS (SELECT video_id, length(text) // 4 AS t FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM transcripts WHERE video_id IS NOT NULL AND text IS NOT NULL) WHERE rn = 1)
        SELECT v.video_id, coalesce(t, 0) AS tokens_in, CASE WHEN t IS NULL THEN 0 ELSE t * 15 // 100 + 800 END AS tokens_out, '~' || format('{:,}', coalesce(t, 0)) AS shown FROM videos v LEFT JOIN n ON n.video_id = v.video_id""",
    "enqueue_counters": f"""
        WITH f AS ({_BLANK}), h AS (SELECT DISTINCT video_id FROM processing_queue WHERE status IN ('pending', 'completed') AND video_id IS NOT NULL)
        SELECT count(*) AS found, count(*) - count(h.video_id) AS enqueued, count(h.video_id) AS skipped, (count(*) - count(h.video_id)) * 3 AS tasks FROM f LEFT JOIN h ON h.video_id = f.video_id""",
    "newest_list": f"""
        SELECT v.video_id, title, channel, t.id AS transcript_id, t.language FROM (SELECT * FROM videos WHERE video_id IS NOT NULL ORDER BY created_at DESC NULLS LAST, video_id DESC LIMIT {LISTED}) v
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM transcripts WHERE video_id IS NOT NULL) WHERE rn = 1) t ON t.video_id = v.video_id""",
    "next_pages": f"SELECT video_id FROM videos WHERE video_id IS NOT NULL AND created_at IS NOT NULL ORDER BY created_at DESC, video_id DESC LIMIT {PAGE} OFFSET {PAGE}",
    "oldest_missing": f"SELECT video_id, title FROM videos WHERE video_id NOT IN ({_BRIEFED}) ORDER BY created_at NULLS FIRST, video_id LIMIT 20",
    "canonical_urls": f"SELECT video_id, 'https://www.youtube.com/watch?v=' || video_id AS url, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS stamp, coalesce(nullif({strip('channel')}, ''), 'Unknown channel') AS channel FROM videos",
    "filled_prompts": "SELECT t.id, md5('Title: ' || coalesce(title, '') || chr(10) || 'Channel: ' || coalesce(channel, '') || chr(10) || chr(10) || coalesce(text, '')) AS prompt FROM transcripts t JOIN videos v ON v.video_id = t.video_id",
    "fetch_errors": """
        SELECT id, CASE WHEN contains(e, 'No transcript') THEN 'No transcript available for this video' WHEN contains(e, 'Video unavailable') THEN 'Video is unavailable or private' ELSE e END AS told
        FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'No transcript: ' || error WHEN 1 THEN error || ' (Video unavailable)' ELSE error END AS e FROM (SELECT DISTINCT id, error FROM processing_queue WHERE error IS NOT NULL))""",
    "streamed_chunks": f"SELECT key AS id, ordinal, md5(chunk) AS chunk, 128 AS dimensions FROM ({chunks('SELECT id AS key, text FROM transcripts WHERE text IS NOT NULL')})",
    "generated_batch": f"""
        WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM transcripts WHERE video_id IS NOT NULL) WHERE rn = 1),
        t AS (SELECT n.video_id, coalesce({strip('n.text')}, '') = '' AS bad FROM n JOIN videos v ON v.video_id = n.video_id WHERE {blank('n.shorty')})
        SELECT video_id, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 'no text' END AS error, NOT bad AS brief, '{NOW[:10]}' AS day, true AS bounded FROM t""",
}
