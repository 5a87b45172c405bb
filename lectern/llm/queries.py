"""Queries over a library folder, one group per problem, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.contamination import leaked_passages
from lectern.llm.encoding import restore_encoding
from lectern.llm.names import name_classes, spelling_pairs
from lectern.llm.near_duplicates import near_duplicate_pairs, near_duplicate_summary
from lectern.llm.packing import pack
from lectern.llm.pairs import pair_defects
from lectern.llm.splitting import cut_kinds, split_oversized
from lectern.llm.tokens import token_budget, with_token_counts
from lectern.llm.truncation import truncated_texts
from lectern.tables import table

CHUNK, OVERLAP, CONTAINER = 800, 200, 2048
NEAR = {"shingle": 3, "threshold": 0.6, "min_words": 20, "ids_unique": True}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spelling_pairs(name_classes(table(spark, d, "entities")))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every name with its class and the number of spellings in it."""
    classes = name_classes(table(spark, d, "entities"))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("spellings"))
    return classes.join(sizes, "class_id").select("name", "kind", "class_id", "spellings")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "ask_jobs").where("status = 'completed'")
    return pair_defects(done).select(F.col("id").alias("job_id"), "defect")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = cut_kinds(table(spark, d, "transcripts"), limit=CHUNK, overlap=OVERLAP)
    return kinds.select(F.col("id").alias("transcript_id"), "cut")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all transcripts, with their text."""
    pieces = split_oversized(table(spark, d, "transcripts"), limit=CHUNK, overlap=OVERLAP)
    return pieces.withColumnRenamed("id", "transcript_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicate_pairs(table(spark, d, "transcripts").select("id", "text"), **NEAR)
    return pairs.select("id_a", "id_b")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per transcript: its class of near-duplicates and the number of its links."""
    docs = table(spark, d, "transcripts").select("id", "text")
    return near_duplicate_summary(docs, **NEAR)


def p6_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of all transcripts by channel, language and topic; a transcript counts once for each tag of its video."""
    counted = with_token_counts(table(spark, d, "transcripts"), ["id", "video_id", "language"], "text")
    videos = table(spark, d, "videos")
    tags = F.from_json("json_metadata", "tags array<string>")["tags"]
    topics = F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    channel = F.lower(F.regexp_replace(F.trim("channel"), r"(?U)[\s\-_]+", " "))
    slices = videos.select(
        "video_id",
        F.coalesce(F.nullif(channel, F.lit("")), F.lit("(none)")).alias("channel"),
        F.when(F.size(F.coalesce(topics, F.array())) > 0, topics).otherwise(F.array(F.lit("(none)"))).alias("topics"),
    )
    # first totals per video and language, so a hot video is one row before the join
    language = F.coalesce(F.nullif(F.lower(F.substring(F.trim("language"), 1, 2)), F.lit("")), F.lit("(none)"))
    per_video = counted.select("video_id", language.alias("language"), "tokens").groupBy("video_id", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    joined = per_video.join(slices, "video_id", "left").select(
        F.coalesce("channel", F.lit("(none)")).alias("channel"), "language", F.explode(F.coalesce("topics", F.array(F.lit("(none)")))).alias("topic"), "n", "tokens"
    )
    totals = joined.groupBy("channel", "language", "topic").agg(F.sum("n").alias("documents"), F.sum("tokens").alias("tokens"))
    return totals.withColumn("mean_tokens", F.round(F.col("tokens") / F.col("documents"), 6))


def p6_document_sources(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of all documents by source, language and kind."""
    return token_budget(with_token_counts(table(spark, d, "documents"), ["source", "lang", "doc_kind"], "text"), ["source", "lang", "doc_kind"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    cuts = truncated_texts(table(spark, d, "transcripts"))
    return cuts.where("truncated").select(F.col("id").alias("transcript_id"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each channel's briefs break off."""
    cuts = truncated_texts(table(spark, d, "transcripts"), extra=["video_id"])
    per_video = cuts.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("briefs"), F.count(F.when(F.col("truncated"), 1)).alias("truncated"), F.count(F.when(F.col("truncated") & F.col("at_limit"), 1)).alias("at_limit")
    )
    channel = F.lower(F.regexp_replace(F.trim("channel"), r"(?U)[\s\-_]+", " "))
    videos = table(spark, d, "videos").select("video_id", F.nullif(channel, F.lit("")).alias("channel"))
    joined = per_video.join(videos, "video_id", "left").groupBy("channel").agg(F.sum("briefs").alias("briefs"), F.sum("truncated").alias("truncated"), F.sum("at_limit").alias("at_limit"))
    return joined.withColumn("rate", F.round(F.col("truncated") / F.col("briefs"), 6))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document (or piece of one over the capacity) with its container."""
    sized = with_token_counts(table(spark, d, "documents"), ["doc_id"], "text")
    return pack(sized, capacity=CONTAINER).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    spans = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return spans.select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches to remove, in characters of the document."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return restore_encoding(table(spark, d, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their restored text."""
    return restore_encoding(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_classes, p2_found, p4_found, p4_pieces, p5_found, p5_classes, p6_token_budget, p6_document_sources,
        p7_found, p7_rates, p8_containers, p9_found, p9_spans, p10_found, p10_restored,
    )
}
