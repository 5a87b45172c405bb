"""The layered retrieval of a library: index records, layer searches, and the context of each question."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import chunks, context_block, embed_input, is_blank, record_id
from lectern.functions.vectors import cosine, embed
from lectern.operators.nearest import best_per_id, exact_neighbours
from lectern.operators.providers import Provider
from lectern.operators.search import keyword_search
from lectern.operators.versions import latest_by_aggregate
from lectern.session import cut

LAYERS = ("chunk", "shorty", "synthetic_question")
# Fixed value: what is said where nothing was found.
NOTHING = "I could not find any relevant information in your indexed videos to answer that."
SEPARATOR = "\n---\n"
FIRST_DAY = "2005-01-01"


def question_records(questions: DataFrame) -> DataFrame:
    """Question rows with their index records: (id, video_id, question, ordinal, record_id), one per row id.

    The ordinal is the place among the questions of a video, in the order of their index. Blank questions and null videos have no record.
    """
    once = questions.where(F.col("video_id").isNotNull() & ~is_blank("question")).dropDuplicates(["id"])
    place = Window.partitionBy("video_id").orderBy(F.col("question_index").asc_nulls_last(), "created_at", "id")
    placed = once.select("id", "video_id", "question", (F.row_number().over(place) - 1).alias("ordinal"))
    return placed.select("*", record_id("video_id", "sq", "ordinal").alias("record_id"))


def index_records(transcripts: DataFrame, questions: DataFrame, *, size: int = 800, overlap: int = 200) -> DataFrame:
    """All records of the index: (record_id, video_id, kind, ordinal, document).

    Chunks and brief come from a video's newest transcript, questions from its question rows (delivered twice: once), in
    the order of their index. Blank documents and null videos have no record. Derived in one job, the index is
    never older than its tables.
    """
    newest = latest_by_aggregate(transcripts.where("video_id is not null and text is not null"), "video_id", ["text", "shorty"])
    chunk = newest.where(~is_blank("text")).select("video_id", F.inline(chunks("text", size, overlap))).select(
        record_id("video_id", "chunk", "ordinal").alias("record_id"), "video_id", F.lit("chunk").alias("kind"), "ordinal", F.col("chunk").alias("document")
    )
    brief = newest.where(~is_blank("shorty")).select(
        record_id("video_id", "shorty").alias("record_id"), "video_id", F.lit("shorty").alias("kind"), F.lit(None).cast("int").alias("ordinal"), F.col("shorty").alias("document")
    )
    asked = question_records(questions).select("record_id", "video_id", F.lit("synthetic_question").alias("kind"), "ordinal", F.col("question").alias("document"))
    return reduce(DataFrame.unionByName, (chunk, brief, asked))


def with_vectors(records: DataFrame, size: int = 128) -> DataFrame:
    """Records with ``id`` (a hash of the record id) and ``embedding``."""
    return records.withColumn("id", F.xxhash64("record_id")).withColumn("embedding", embed(embed_input("document"), size))


def variants(questions: DataFrame, most: int = 4) -> DataFrame:
    """Query variants, the question itself first: (question_id, query_id, variant, query).

    ``questions``: (question_id, question[, rewrites]). Repeats are dropped, at most ``most`` are kept; without
    rewrites the question stands alone. Null questions have no variant.
    """
    extra = F.col("rewrites") if "rewrites" in questions.columns else F.array().cast("array<string>")
    listed = F.slice(F.array_distinct(F.concat(F.array("question"), F.coalesce(extra, F.array().cast("array<string>")))), 1, most)
    out = questions.where("question is not null").select("question_id", F.posexplode(listed).alias("variant", "query"))
    return out.select("question_id", (F.col("question_id") * most + F.col("variant")).alias("query_id"), "variant", "query")


def layer_search(asked: DataFrame, records: DataFrame, kind: str, k: int, *, dedupe: bool = False, prefilter: DataFrame | None = None) -> DataFrame:
    """Nearest records of one layer for every variant: (question_id, id, distance, place).

    Results of all variants of a question are merged by distance; without ``dedupe`` a record can come once per variant.
    ``prefilter`` (video_id) restricts the records before the search.
    """
    layer = records.where(F.col("kind") == kind)
    if prefilter is not None:
        layer = layer.join(prefilter.select("video_id"), "video_id", "left_semi")
    found = exact_neighbours(asked.select("query_id", "embedding"), layer.select("id", "embedding"), k)
    flat = found.withColumnRenamed("rank", "variant_rank").join(asked.select("query_id", "question_id", "variant"), "query_id")
    if dedupe:
        return best_per_id(flat, k).select("question_id", "id", "distance", F.col("rank").alias("place"))
    order = Window.partitionBy("question_id").orderBy(F.coalesce("distance", F.lit(1e9)), "variant", "variant_rank")
    return flat.select("question_id", "id", "distance", F.row_number().over(order).alias("place"))


def retrieve(
    questions: DataFrame,
    records: DataFrame,
    *,
    k: int = 4,
    briefs: int = 10,
    candidates: DataFrame | None = None,
    wanted: DataFrame | None = None,
    prefilter: bool = False,
    asked: DataFrame | None = None,
) -> DataFrame:
    """All layers of all questions: (question_id, layer, place, video_id, ordinal, document, distance).

    ``candidates`` (question_id, video_id) restricts the brief layer of the questions that it names, with ``prefilter`` all their
    layers; questions without candidates are not restricted. ``wanted`` (question_id, video_id) filters the results of those
    questions that name videos, after the search. ``asked`` (question_id, query_id, variant, embedding): the variants with their
    vectors, where they are not to be made from ``questions``.
    """
    if asked is None:
        asked = variants(questions).withColumn("embedding", embed(embed_input("query")))
    asked = cut(asked)  # all layers read it
    parts = []
    for layer in LAYERS:
        brief = layer == "shorty"
        n = briefs if brief else k
        free = asked
        if candidates is not None and (brief or prefilter):
            free = asked.join(candidates.select("question_id").distinct(), "question_id", "left_anti")
            parts.append(restricted_search(asked, records, layer, candidates, n).withColumn("layer", F.lit(layer)))
        parts.append(layer_search(free, records, layer, n, dedupe=brief).withColumn("layer", F.lit(layer)))
    hits = reduce(DataFrame.unionByName, parts).join(records.select("id", "video_id", "ordinal", "document"), "id")
    if wanted is not None:
        naming = wanted.select("question_id").distinct()
        unbound = hits.join(naming, "question_id", "left_anti")
        bound = hits.join(naming, "question_id", "left_semi").join(wanted.select("question_id", "video_id").distinct(), ["question_id", "video_id"], "left_semi")
        hits = unbound.unionByName(bound.select(*unbound.columns))
    again = Window.partitionBy("question_id", "layer").orderBy("place")
    kept = hits.withColumn("place", F.row_number().over(again))
    return kept.where((F.col("layer") == "shorty") | (F.col("place") <= k)).select("question_id", "layer", "place", "video_id", "ordinal", "document", "distance")


def passages(vector_hits: DataFrame, keyword_hits: DataFrame, mode: str = "auto") -> DataFrame:
    """The passages that answer: those of the vector layers ('vector'), of the keyword layer ('keyword'), or with 'auto' the latter
    for the questions of which the vector layers hold nothing."""
    if mode == "vector":
        return vector_hits
    if mode == "keyword":
        return keyword_hits
    if mode != "auto":
        raise ValueError("mode is 'vector', 'keyword' or 'auto'")
    return vector_hits.unionByName(keyword_hits.join(vector_hits.select("question_id").distinct(), "question_id", "left_anti").select(*vector_hits.columns))


def inferred_filters(questions: DataFrame, videos: DataFrame, *, block: int = 2_000) -> DataFrame:
    """What a question says about metadata: (question_id, channels, date_from, date_to).

    Channels are the library's channel names that occur in the question (no case); dates are its ISO days, least and greatest.
    Questions are a stated set, held in blocks against the distinct channels. Without a hint the fields are null.
    """
    names = videos.where(~is_blank("channel")).select("channel").distinct()
    spark = videos.sparkSession
    found = spark.createDataFrame([], "question_id long, channel string")
    held: list[tuple[int, str]] = []

    def scan(part: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(q, c) for c in batch.column(0).to_pylist() for q, text in shared.value if c.strip().lower() in text]
                cols = list(zip(*hits)) if hits else [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], ["question_id", "channel"])

        return names.mapInArrow(run, "question_id long, channel string")

    for row in questions.where("question is not null").select("question_id", F.lower("question")).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block:
            found, held = found.unionByName(scan(held)), []
    if held:
        found = found.unionByName(scan(held))
    days = F.regexp_extract_all("question", F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0))
    dated = questions.select("question_id", F.array_min(days).alias("date_from"), F.array_max(days).alias("date_to"))
    return dated.join(found.groupBy("question_id").agg(F.array_sort(F.collect_set("channel")).alias("channels")), "question_id", "left")


def candidate_videos(filters: DataFrame, videos: DataFrame) -> DataFrame:
    """Videos of each question's filters: (question_id, video_id). Questions without a filter or a match have no rows."""
    known = videos.where("video_id is not null").select("video_id", "channel", "watch_date")
    day = F.substring("watch_date", 1, 10)
    bounds = (F.col("date_from").isNull() | (day >= F.col("date_from"))) & (F.col("date_to").isNull() | (day <= F.col("date_to")))
    named = filters.where("channels is not null").withColumn("channel", F.explode("channels")).join(known, "channel").where(bounds)
    # dates alone: joined by month, so the range join is an equi-join; a range open at one end goes from the first video or to today
    low, high = F.coalesce(F.try_to_date("date_from"), F.lit(FIRST_DAY).cast("date")), F.coalesce(F.try_to_date("date_to"), F.current_date())
    months = F.explode(F.when(low <= high, F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr("interval 1 month"))))
    valid = filters.where("channels is null and (try_to_date(date_from) is not null or try_to_date(date_to) is not null)")
    dated = valid.withColumn("month", months).join(known.withColumn("month", F.trunc(F.try_to_date(day), "month")), "month").where(bounds)
    return named.select("question_id", "video_id").unionByName(dated.select("question_id", "video_id")).distinct()


def restricted_search(asked: DataFrame, records: DataFrame, kind: str, candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest records of each question among its own candidates: (question_id, id, distance, place), each record once."""
    pairs = candidates.join(records.where(F.col("kind") == kind).select("video_id", "id", "embedding"), "video_id")
    variants_of = asked.select("question_id", F.col("embedding").alias("_q"))
    scored = pairs.join(variants_of, "question_id").select("question_id", "id", F.round(1 - F.coalesce(cosine("embedding", "_q"), F.lit(0.0)), 9).alias("distance"))
    return best_per_id(scored, k).select("question_id", "id", "distance", F.col("rank").alias("place"))


def answers(contexts_df: DataFrame, provider: Provider) -> DataFrame:
    """Answers of a provider from contexts: (question_id, answer, used_context); an empty context answers itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qid, question, context, used = (batch.column(i).to_pylist() for i in range(4))
            made = [provider.answer(q or "", c) if u else c for q, c, u in zip(question, context, used)]
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(made, pa.string()), batch.column(3)], ["question_id", "answer", "used_context"])

    source = contexts_df.select(F.col("question_id").cast("long"), "question", "context", "used_context")
    return source.mapInArrow(run, "question_id long, answer string, used_context array<string>")


def keyword_layer(questions: DataFrame, transcripts: DataFrame, videos: DataFrame, k: int = 10) -> DataFrame:
    """The brief layer without vectors: keyword overlap with brief and title, in the shape of ``retrieve``."""
    titled = transcripts.where(~is_blank("shorty")).join(videos.select("video_id", "title"), "video_id")
    texts = titled.select("video_id", F.col("id").alias("row_id"), F.concat_ws(" ", "shorty", F.coalesce("title", F.lit(""))).alias("text"))
    found = keyword_search(questions.select(F.col("question_id").alias("query_id"), "question"), texts, k=k)
    documents = transcripts.select(F.col("id").alias("row_id"), F.col("shorty").alias("document"))
    return found.join(documents, "row_id").select(
        F.col("query_id").alias("question_id"), F.lit("shorty").alias("layer"), F.col("rank").alias("place"), "video_id",
        F.lit(None).cast("int").alias("ordinal"), "document", (-F.col("score")).cast("double").alias("distance"),
    )


def contexts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question its passages, layer by layer, and the merged context: (question_id, question, used_context, context)."""
    layer_no = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    block = F.struct(layer_no.alias("n"), "place", context_block("layer", "video_id", "ordinal", "document").alias("block"))
    merged = hits.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]).alias("used_context"))
    empty = F.array().cast("array<string>")
    out = questions.join(merged, "question_id", "left").select("question_id", "question", F.coalesce("used_context", empty).alias("used_context"))
    return out.withColumn("context", F.when(F.size("used_context") > 0, F.array_join("used_context", SEPARATOR)).otherwise(F.lit(NOTHING)))
