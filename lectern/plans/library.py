"""Queries over the library's tables: pages, versions, queues, search, text functions, and changes to tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import entities as E
from lectern.functions import text as X
from lectern.operators import library as L
from lectern.operators import search as S
from lectern.operators import versions as V
from lectern.operators import writes as W
from lectern.sources.readers import with_metadata
from lectern.streaming import queue as Q
from lectern.plans.sql import LIBRARY as SQL  # noqa: F401
from lectern.tables import table

PAGE, SIZE, OVERLAP = 50, 800, 200
KEYWORDS_FROM = 50  # every row whose id is divisible by this is a query
TASKS = ("shorty", "synthetic_questions", "entities")
CHANNELS = ["Lantern Quay Sessions", "Paper Bench"]


def _four(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, n) for n in ("videos", "transcripts", "synthetic_questions", "entities"))


def library_overview(spark: SparkSession, d: str) -> DataFrame:
    """All videos with their flags and counts."""
    return L.overview(*_four(spark, d)).drop("created_at")


def library_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page, newest videos first."""
    newest = V.page(table(spark, d, "videos"), 1, PAGE, F.col("created_at").desc_nulls_last(), F.col("video_id"))
    _, transcripts, questions, entities = _four(spark, d)
    return L.overview(newest, transcripts, questions, entities).drop("created_at")


def library_counts(spark: SparkSession, d: str) -> DataFrame:
    videos, transcripts = table(spark, d, "videos"), table(spark, d, "transcripts")
    marked = videos.select("video_id", "channel").join(L.briefed(transcripts).withColumn("_b", F.lit(True)), "video_id", "left")
    return marked.groupBy("channel").agg(F.count(F.lit(1)).alias("videos"), F.count("_b").alias("with_brief"), F.count_if(F.col("_b").isNull()).alias("missing_brief"))


def channel_list(spark: SparkSession, d: str) -> DataFrame:
    return L.channels(table(spark, d, "videos"))


def library_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.stats(table(spark, d, "videos"), table(spark, d, "transcripts"))


def latest_transcripts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcripts").where("video_id is not null")
    return V.latest_by_aggregate(rows, "video_id", ["id", "language", "confidence"])


def newest_questions(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest questions of each video, oldest of them first."""
    rows = table(spark, d, "synthetic_questions").where("video_id is not null").select("id", "video_id", "question", "created_at").dropDuplicates(["id"])
    ranked = V.newest(rows, "video_id", 10)
    total = F.max("rank").over(_per("video_id"))
    return ranked.withColumn("position", total - F.col("rank") + 1).select("video_id", "position", "id", "question")


def _per(key: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(key)


def missing_briefs(spark: SparkSession, d: str) -> DataFrame:
    """Videos without a brief by each of the three rules."""
    videos, transcripts = table(spark, d, "videos"), table(spark, d, "transcripts")
    parts = [L.missing_briefs(videos, transcripts, rule).select(F.lit(rule).alias("rule"), "video_id") for rule in ("null", "any_row_null", "blank")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def backfill_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks for videos that lack a brief and have none queued or done."""
    missing = L.missing_briefs(table(spark, d, "videos"), table(spark, d, "transcripts"), "blank")
    queued = table(spark, d, "processing_queue").where(F.col("status").isin("pending", "completed")).select("video_id")
    return W.fan_out(missing.join(queued, "video_id", "left_anti"), "video_id", TASKS).distinct()


def queue_next(spark: SparkSession, d: str) -> DataFrame:
    """The next ten tasks, oldest first."""
    waiting = table(spark, d, "processing_queue").where("status = 'pending'").select("id", "video_id", "task", "created_at").distinct()
    return V.in_order(waiting, 10, F.col("created_at").asc_nulls_first(), F.col("id").asc(), F.col("video_id"), F.col("task")).select("id", "video_id", "task")


def queue_batches(spark: SparkSession, d: str) -> DataFrame:
    """All distinct queued rows in batches of ten, oldest first."""
    rows = table(spark, d, "processing_queue").groupBy("id").agg(F.min("created_at").alias("created_at"))
    return V.in_batches(rows, 10, F.col("created_at").asc_nulls_first(), F.col("id")).select("id", "batch_no")


def queue_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by kind and status, and how long the finished ones took."""
    rows = table(spark, d, "processing_queue").distinct()
    seconds = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return rows.groupBy("task", "status").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg(seconds) / 1e6, 3).alias("mean_seconds"), F.max(F.floor(seconds / 1e6)).cast("long").alias("longest_seconds"))


def queue_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed tasks as lines of a tab-separated list."""
    rows = table(spark, d, "processing_queue").where("status = 'failed' and video_id is not null").select("video_id", "error").distinct()
    titled = rows.join(table(spark, d, "videos").select("video_id", "title"), "video_id", "left")
    return titled.select(F.concat_ws("\t", X.tsv_field("video_id"), X.tsv_field("title"), X.tsv_field("error")).alias("line"))


def queue_states(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with their inputs: newest transcript and video in one join each, and what is missing."""
    tasks = table(spark, d, "processing_queue").select("id", "video_id", "task").distinct()
    newest = V.latest_by_aggregate(table(spark, d, "transcripts").where("video_id is not null and text is not null"), "video_id", ["id"]).withColumnRenamed("id", "transcript_id")
    joined = tasks.join(newest, "video_id", "left").join(table(spark, d, "videos").select("video_id", F.lit(True).alias("_v")), "video_id", "left")
    problem = F.when(~F.coalesce(F.col("task").isin(*TASKS), F.lit(False)), "unknown task").when(F.col("transcript_id").isNull(), "no transcript").when(F.col("_v").isNull(), "no video")
    return joined.select("id", "video_id", "task", "transcript_id", problem.alias("problem"))


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of each transcript and their running total by id."""
    rows = table(spark, d, "transcripts").select("id", X.token_estimate("text").alias("tokens"))
    return V.running_total(rows, "tokens", F.col("id"))


def compression(spark: SparkSession, d: str) -> DataFrame:
    """How much shorter briefs are than their transcripts, per language."""
    rows = table(spark, d, "transcripts").where(~X.is_blank("shorty") & ~X.is_blank("text"))
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("briefs"), F.round(F.sum(F.length("shorty")) / F.sum(F.length("text")), 6).alias("ratio"))


def text_search(spark: SparkSession, d: str) -> DataFrame:
    """All transcripts that hold a phrase, with title."""
    rows = table(spark, d, "transcripts").where(S.text_matches("text", "Camera Rig")).select("id", "video_id")
    return rows.join(table(spark, d, "videos").select("video_id", "title"), "video_id").select("id", "video_id", "title")


def text_search_top(spark: SparkSession, d: str) -> DataFrame:
    """The first ten of them by title."""
    return V.in_order(text_search(spark, d), 10, F.col("title").asc_nulls_first(), F.col("id"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best briefs of every fiftieth question, against all briefs."""
    asked = table(spark, d, "ask_jobs").where(F.col("id") % KEYWORDS_FROM == 0).select(F.col("id").alias("query_id"), "question")
    briefs = table(spark, d, "transcripts").where(~X.is_blank("shorty")).join(table(spark, d, "videos").select("video_id", "title"), "video_id")
    texts = briefs.select("video_id", F.col("id").alias("row_id"), F.concat(F.col("shorty"), F.lit(" "), F.coalesce("title", F.lit(""))).alias("text"))
    return S.keyword_search(asked, texts).select("query_id", "video_id", "row_id", "score", "rank")


def metadata_search(spark: SparkSession, d: str) -> DataFrame:
    """Videos of two channels in a range of days, both ways to read the last day."""
    videos = table(spark, d, "videos").where("video_id is not null")
    parts = [
        S.metadata_filter(videos, channels=CHANNELS, date_from="2025-01-01", date_to="2025-12-31", date_bound=bound).select(F.lit(bound).alias("bound"), "video_id", "channel", "watch_date")
        for bound in ("lexical", "inclusive_day")
    ]
    return parts[0].unionByName(parts[1])


def chunk_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of all transcripts."""
    rows = table(spark, d, "transcripts").where("text is not null")
    return rows.select("id", F.inline(X.chunks("text", SIZE, OVERLAP)))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_transcripts(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"))
    return rows


def clean_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts without lines of time stamps."""
    return table(spark, d, "transcripts").where("text is not null").select("id", X.strip_stamps("text").alias("text"))


def question_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ask_jobs").where("question is not null")
    return rows.select("id", F.array_join(X.words("question", 3), " ").alias("words"))


def video_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the JSON metadata; malformed JSON gives nulls."""
    typed = with_metadata(table(spark, d, "videos"))
    return typed.select("video_id", F.get_json_object("json_metadata", "$.upload_date").alias("upload_date"), F.col("metadata.view_count").alias("view_count"), F.size(F.coalesce("metadata.tags", F.array().cast("array<string>"))).alias("tags"))


def link_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers in the links of all documents' text, by both rules.

    Links are rewritten to the two forms that the rules know, as these tables use their own host.
    """
    links = F.regexp_extract_all("text", F.lit(r"https?://clips\.example/(\S+)"), F.lit(1))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(links).alias("place", "link"))
    url = F.concat(F.lit("https://www.youtube.com/"), "link")
    return rows.select("doc_id", "place", X.video_id(url).alias("loose_id"), X.video_id(url, strict=True).alias("strict_id"))


def entity_types(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities")
    return rows.groupBy(E.entity_type("type").alias("canonical")).agg(F.count(F.lit(1)).alias("rows"))


def entity_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of each entity row as one line."""
    rows = table(spark, d, "entities").select("id", F.to_json("aliases").alias("raw")).distinct()
    return rows.select("id", E.alias_display("raw").alias("aliases"))


def listed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions parsed from the documents that list them, all of them."""
    rows = table(spark, d, "documents").where("doc_kind = 'question_list' and text is not null")
    return rows.select("doc_id", F.posexplode(E.questions_from_response("text", 1_000_000)).alias("place", "question"))


def response_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entity rows as responses in each form (fenced list, object, bare list in text, lone object, cut off) and parsed back: counts per video and form."""
    rows = table(spark, d, "entities").where("video_id is not null and name is not null")
    one = F.to_json(F.struct("name", "type", "aliases"))
    forms = {
        "fenced": F.concat(F.lit("```json\n["), one, F.lit("]\n```")), "object": F.concat(F.lit('{"entities": ['), one, F.lit(", "), one, F.lit("]}")),
        "bare": F.concat(F.lit("Here you are: ["), one, F.lit("] - done")), "lone": one, "broken": F.expr("substring(" + "to_json(struct(name, type, aliases)), 1, 9)"),
    }
    each = rows.select("video_id", F.explode(F.array(*[F.struct(F.lit(n).alias("form"), r.alias("raw")) for n, r in forms.items()])).alias("r")).select("video_id", "r.*")
    parsed = each.select("video_id", "form", F.explode(E.entities_from_response("raw")).alias("e"))
    return parsed.groupBy("video_id", "form").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.size("e.aliases")).alias("aliases"))


def brief_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all briefs by section."""
    rows = table(spark, d, "transcripts").where(~X.is_blank("shorty"))
    return L.sections(rows, "id", "shorty").groupBy("section").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("id").alias("briefs"))


def brief_headers(spark: SparkSession, d: str) -> DataFrame:
    """The header of a brief for every video."""
    rows = table(spark, d, "videos")
    return rows.select("video_id", X.brief_header("title", "channel", F.get_json_object("json_metadata", "$.upload_date")).alias("header"))


def video_details(spark: SparkSession, d: str) -> DataFrame:
    """The page of every video, as rows."""
    return L.details(*_four(spark, d))


def video_status(spark: SparkSession, d: str) -> DataFrame:
    """What is known of every video that the queue names."""
    wanted = table(spark, d, "processing_queue").where("video_id is not null").select("video_id").distinct()
    return L.status_of(wanted, table(spark, d, "videos"), table(spark, d, "transcripts"))


def replace_videos(spark: SparkSession, d: str) -> DataFrame:
    """Videos after those of one channel were added again by five columns, by both ways to upsert."""
    videos = table(spark, d, "videos")
    again = videos.where("channel = 'Lantern Quay Sessions'").select("video_id", F.concat(F.lit("new "), F.coalesce("title", F.lit(""))).alias("title"), "channel", "url", "created_at")
    parts = [W.upsert(videos, again, "video_id", mode, {"has_transcript": False}).select(F.lit(mode).alias("mode"), "video_id", "title", "has_transcript", "watch_date") for mode in ("replace", "merge")]
    return parts[0].unionByName(parts[1])


def update_briefs(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts after a new brief for each removed video's rows: the latest row only, and all rows."""
    rows = table(spark, d, "transcripts").select("id", "video_id", "shorty", "created_at")
    news = table(spark, d, "video_removals").where("video_id is not null").select("video_id").distinct().withColumn("shorty", F.lit("(withdrawn)"))
    parts = [W.update_versions(rows, news, "video_id", ["shorty"], scope).select(F.lit(scope).alias("scope"), "id", F.md5("shorty").alias("brief")) for scope in ("latest", "all")]
    return parts[0].unionByName(parts[1])


def replace_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions after those of each video with a removal were regenerated, one per video."""
    rows = table(spark, d, "synthetic_questions").select("id", "video_id", "question").distinct()
    parents = table(spark, d, "video_removals").where("video_id is not null").select("video_id").distinct()
    fresh = parents.select(F.lit(-1).cast("long").alias("id"), "video_id", F.lit("What happened?").alias("question"))
    return W.replace_children(rows, fresh, "video_id")


def patched_metadata(spark: SparkSession, d: str) -> DataFrame:
    """All fields of the videos' metadata after the upload date was set from the watch date (removed where there is none)."""
    rows = table(spark, d, "videos").withColumn("day", F.regexp_replace(F.substring("watch_date", 1, 10), "-", ""))
    patched = rows.select("video_id", W.patch_json("json_metadata", "upload_date", "day").alias("j"))
    fields = F.explode_outer(F.try_variant_get(F.try_parse_json("j"), "$", "map<string,variant>")).alias("field", "value")
    return patched.select("video_id", fields).select("video_id", "field", F.to_json("value").alias("value"))


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a rule of their table, by rule."""
    videos = W.with_reasons(table(spark, d, "videos"), {"no title": X.is_blank("title"), "no channel": X.is_blank("channel"), "no url": X.is_blank("url")})
    jobs = W.with_reasons(table(spark, d, "ask_jobs"), {"no question": X.is_blank("question")})
    texts = W.with_reasons(table(spark, d, "transcripts"), {"no text": X.is_blank("text"), "no video": F.col("video_id").isNull()})
    parts = [df.select(F.lit(n).alias("table_name"), F.explode("reasons").alias("reason")) for n, df in (("videos", videos), ("ask_jobs", jobs), ("transcripts", texts))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("rows"))


def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """Events counted by day and type through a stream that stops when all is read."""
    from lectern.session import cut, ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    state = f"{shared}/stream-{os.urandom(8).hex()}"
    source = Q.read_stream(spark, d, "events.parquet", table(spark, d, "events"))
    Q.run_available(Q.windowed_counts(source, "ts", "event_type"), Q.append_sink(f"{state}/out"), f"{state}/log", mode="complete")
    last = spark.read.option("basePath", f"{state}/out").parquet(f"{state}/out")
    newest = last.agg(F.max("batch")).first()[0]
    return cut(last.where(F.col("batch") == newest).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"))


QUERIES = {
    f.__name__: f
    for f in (
        library_overview, library_page, library_counts, channel_list, library_stats, latest_transcripts, newest_questions, missing_briefs, backfill_tasks,
        queue_next, queue_batches, queue_rollup, queue_failures, queue_states, token_totals, compression, text_search, text_search_top, keyword_search,
        metadata_search, chunk_transcripts, chunk_stats, clean_transcripts, question_words, video_metadata, link_ids, entity_types, entity_aliases,
        listed_questions, response_entities, brief_sections, brief_headers, video_details, video_status, replace_videos, update_briefs, replace_questions,
        patched_metadata, quarantine, stream_events,
    )
}
