"""Queries over vectors and the layered index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine
from lectern.operators import nearest as N
from lectern.functions.text import is_blank
from lectern.operators import retrieval as R
from lectern.operators import writes as W
from lectern.operators.providers import Extractive, generated_rewrites
from lectern.plans.sql import RETRIEVAL as SQL  # noqa: F401
from lectern.session import cut
from lectern.tables import table

QUERY_FROM, K, CELLS, PROBES = 50, 10, 64, 40


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rows.where(F.col("id") % QUERY_FROM == 0).select(F.col("id").alias("query_id"), "embedding"), rows


def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth one."""
    found = N.exact_neighbours(*_vectors(spark, d), K)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def knn_index(spark: SparkSession, d: str) -> DataFrame:
    """The same through the inverted-file index over all rows."""
    queries, rows = _vectors(spark, d)
    index, centres = N.checkpointed_index(rows, CELLS)
    return N.index_neighbours(queries, index, centres, K, PROBES)


def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the exact neighbours the index finds."""
    exact, approximate = knn_exact(spark, d).select("query_id", "id"), knn_index(spark, d).select("query_id", "id")
    hits = exact.join(approximate.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("neighbours"), F.count("_hit").alias("found"), F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"))


def knn_best(spark: SparkSession, d: str) -> DataFrame:
    """Results of all query vectors of one label flattened: each vector once at its best distance, the ten best."""
    found = N.exact_neighbours(*_vectors(spark, d), K)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("question_id"))
    best = N.best_per_id(found.drop("rank").join(labels, "query_id"), K)
    return best.select("question_id", "id", F.round("distance", 6).alias("distance"), "rank")


def self_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with its own label's mean vector."""
    rows = table(spark, d, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda p: p["m"]).alias("centre"))
    return rows.join(centre, "label").select("vec_id", F.round(cosine("embedding", "centre"), 6).alias("similarity"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.index_records(table(spark, d, "transcripts"), table(spark, d, "synthetic_questions"))


def index_records(spark: SparkSession, d: str) -> DataFrame:
    """All records of the index, their documents by hash."""
    return _records(spark, d).select("record_id", "video_id", "kind", "ordinal", F.md5("document").alias("document"))


def question_ids(spark: SparkSession, d: str) -> DataFrame:
    """The question rows with their index ids written back; rows without a record keep what they had."""
    rows = table(spark, d, "synthetic_questions")
    return W.write_back_ids(rows, R.question_records(rows), ["id"]).select("id", "embedding_id").distinct()


def dangling_ids(spark: SparkSession, d: str) -> DataFrame:
    """How many question rows have an id after the write-back, and how many of these ids the index lacks."""
    rows = table(spark, d, "synthetic_questions")
    made = W.write_back_ids(rows, R.question_records(rows), ["id"]).where(F.col("video_id").isNotNull() & ~is_blank("question")).select("id", F.col("embedding_id").alias("record_id")).distinct()
    held = _records(spark, d).select("record_id", F.lit(True).alias("_held"))
    return made.join(held, "record_id", "left").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("_held").isNull()).alias("absent"), F.count_distinct("record_id").alias("ids"))


def index_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records of the index by kind."""
    return _records(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("records"))


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The index after the records of some videos were made again from other tables: their old ones go, the new ones come."""
    old = _records(spark, d)
    again = table(spark, d, "transcripts").where("video_id is not null and text is not null and id % 10 = 0")
    fresh = R.index_records(again, table(spark, d, "synthetic_questions").limit(0))
    return W.replace_children(old, fresh, "video_id", again.select("video_id")).select("record_id", "kind", F.md5("document").alias("document"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ask_jobs").where(F.col("id") % QUERY_FROM == 0).select(F.col("id").alias("question_id"), "question", "video_ids")


def _candidates(asked: DataFrame, videos: DataFrame) -> DataFrame:
    """Videos that a question's own words restrict it to."""
    return R.candidate_videos(R.inferred_filters(asked, videos), videos)


def layered_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Passages of every fiftieth question, with its rewrites and the videos that it names, from all layers of the whole index."""
    videos = table(spark, d, "videos")
    asked = generated_rewrites(_asked(spark, d), Extractive())
    wanted = asked.select("question_id", F.explode("video_ids").alias("video_id"))
    # written once: all layers and the documents read it
    records = cut(R.with_vectors(_records(spark, d)))
    hits = R.retrieve(asked, records, wanted=wanted, candidates=_candidates(asked, videos))
    return hits.select("question_id", "layer", "place", "video_id", "ordinal", F.round("distance", 6).alias("distance"))


def _layered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth question with its passages, where the table of vectors stands for embedded records and variants.

    Record n is vector n, of the video of transcript n, of a kind in turn; the variants of question n are the vectors n to n + 2.
    Every second of the questions is restricted to the briefs of one channel.
    """
    asked, vectors = _asked(spark, d).where("question is not null"), table(spark, d, "embeddings")
    kind = F.element_at(F.array(*[F.lit(x) for x in R.LAYERS]), (F.col("vec_id") % 3 + 1).cast("int"))
    owner = table(spark, d, "transcripts").select(F.col("id").alias("vec_id"), "video_id")
    records = cut(vectors.join(owner, "vec_id", "left").select(F.col("vec_id").alias("id"), "video_id", kind.alias("kind"), (F.col("vec_id") % 7).cast("int").alias("ordinal"), F.concat(F.lit("passage "), "vec_id").alias("document"), "embedding"))
    each = asked.select("question_id", F.posexplode(F.sequence(F.col("question_id"), F.col("question_id") + 2)).alias("variant", "vec_id"))
    variants = each.join(vectors.select("vec_id", "embedding"), "vec_id").select("question_id", (F.col("question_id") * 4 + F.col("variant")).alias("query_id"), "variant", "embedding")
    channel = table(spark, d, "videos").where("channel = 'Lantern Quay Sessions' and video_id is not null").select("video_id", "channel")
    half = asked.where("question_id % 100 = 0").select("question_id", F.lit("Lantern Quay Sessions").alias("channel"))
    wanted = asked.select("question_id", F.explode("video_ids").alias("video_id"))
    return asked, R.retrieve(asked, records, wanted=wanted, candidates=half.join(channel, "channel").select("question_id", "video_id"), asked=variants)


def layered_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Passages from all layers: variants merged, candidates and named videos applied."""
    return _layered(spark, d)[1].select("question_id", "layer", "place", "video_id", "ordinal", F.round("distance", 6).alias("distance"))


def answered_questions(spark: SparkSession, d: str) -> DataFrame:
    """Answers in each mode (vector, keyword, auto) from the passages that it finds: how many were used, and the answer by hash."""
    asked, found = _layered(spark, d)
    found, words = cut(found), cut(R.keyword_layer(asked, table(spark, d, "transcripts"), table(spark, d, "videos")))
    parts = [R.answers(R.contexts(asked, R.passages(found, words, mode)), Extractive()).select(F.lit(mode).alias("mode"), "question_id", F.size("used_context").alias("passages"), F.md5("answer").alias("answer")) for mode in ("vector", "keyword", "auto")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """The keyword layer in the shape of the others: a lower distance is better."""
    hits = R.keyword_layer(_asked(spark, d), table(spark, d, "transcripts"), table(spark, d, "videos"))
    return hits.select("question_id", "layer", "place", "video_id", "distance")


def keyword_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The context of every fiftieth question, from the keyword layer."""
    asked = _asked(spark, d)
    hits = R.keyword_layer(asked, table(spark, d, "transcripts"), table(spark, d, "videos"))
    return R.contexts(asked, hits).select("question_id", F.size("used_context").alias("passages"), F.md5("context").alias("context"))


QUERIES = {f.__name__: f for f in (knn_exact, knn_index, knn_recall, knn_best, self_similarity, index_records, index_counts, index_upsert, question_ids, dangling_ids, layered_retrieval, layered_vectors, answered_questions, keyword_hits, keyword_contexts)}
