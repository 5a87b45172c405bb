"""Schemas of the library, and readers and writers of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import is_blank, or_default, strip_stamps, tsv_field, video_id


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType()),
    "answer": T.StructType([T.StructField("answer", T.StringType()), T.StructField("used_context", T.ArrayType(T.StringType()))]),
}


def _schema(text: str) -> T.StructType:
    """From 'name type, ...', without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(", "))])


SCHEMAS = {
    "videos": _schema("video_id string, title string, channel string, url string, has_transcript boolean, transcript_fetched_at timestamp, watch_date string, local_path string, json_metadata string, created_at timestamp"),
    "transcripts": _schema("id bigint, video_id string, text string, language string, confidence double, shorty string, shorty_generated_at timestamp, created_at timestamp"),
    "entities": _schema("id bigint, video_id string, name string, type string, aliases strings, created_at timestamp"),
    "synthetic_questions": _schema("id bigint, video_id string, question string, question_index int, embedding_id string, created_at timestamp"),
    "processing_queue": _schema("id bigint, video_id string, task string, status string, created_at timestamp, started_at timestamp, completed_at timestamp, error string"),
    "ask_jobs": _schema("id bigint, question string, video_ids strings, status string, answer answer, error string, created_at timestamp, updated_at timestamp"),
    "index": _schema("record_id string, video_id string, kind string, ordinal int, document string, embedding floats"),
}
DEFAULTS = {"videos": {"has_transcript": False}, "transcripts": {"language": "en"}, "processing_queue": {"status": "pending"}}
METADATA = "description string, upload_date string, tags array<string>, view_count bigint, like_count bigint, duration bigint, thumbnail string, channel string, title string, chapters array<string>"
FAILURES = _schema("video_id string, title string, error string")


def bootstrap(spark: SparkSession, name: str) -> DataFrame:
    """An empty table with its schema."""
    return spark.createDataFrame([], SCHEMAS[name])


def load(spark: SparkSession, path: str, name: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table of any reader kind under its schema: missing columns come as their default or null."""
    df = spark.read.format(kind).options(**options).load(path)
    out = []
    for field in SCHEMAS[name].fields:
        value = F.col(f"`{field.name}`") if field.name in df.columns else F.lit(DEFAULTS.get(name, {}).get(field.name))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def from_database(spark: SparkSession, url: str, name: str, *, key: str = "id", low: int = 0, high: int = 1, parts: int = 8, **options: str) -> DataFrame:
    """A table over JDBC, read in ``parts`` ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.options(**options).load()


def with_metadata(videos: DataFrame) -> DataFrame:
    """The JSON metadata as a typed ``metadata`` column; malformed JSON gives nulls."""
    return videos.withColumn("metadata", F.from_json("json_metadata", METADATA))


def read_failures(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The failure list: tab-separated, '#' begins a comment, blank lines and lines without an id are skipped."""
    rows = spark.read.schema(FAILURES).csv(path, sep="\t", comment="#", quote="", ignoreLeadingWhiteSpace=True).where(~is_blank("video_id"))
    return rows if limit is None else rows.limit(limit)


def write_failures(failures: DataFrame, path: str) -> None:
    """One line per failed item; tabs and line breaks within fields become spaces."""
    line = F.concat_ws("\t", *[tsv_field(c) for c in FAILURES.names])
    failures.select(line.alias("value")).write.mode("overwrite").text(path)


def read_job_files(spark: SparkSession, path: str) -> DataFrame:
    """Answer files, one JSON object per job, with the job id from the file name."""
    rows = spark.read.schema("answer string, used_context array<string>").json(path, multiLine=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long").alias("id"), F.struct("answer", "used_context").alias("answer"))


def recover_jobs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs whose answer stands in a file but not in the table take it from there."""
    found = files.select("id", F.col("answer").alias("_file"))
    joined = jobs.join(found, "id", "left")
    late = F.col("answer").isNull() & F.col("_file").isNotNull()
    return joined.select(*[F.when(late, F.col("_file")).otherwise(F.col("answer")).alias("answer") if c == "answer" else F.when(late, F.lit("completed")).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in jobs.columns])


def read_pasted(spark: SparkSession, path: str) -> DataFrame:
    """Pasted transcripts (JSON lines: url, title, channel, transcript): cleaned rows with the reasons against them."""
    rows = spark.read.schema("url string, title string, channel string, transcript string").json(path)
    return clean_pasted(rows)


def clean_pasted(rows: DataFrame) -> DataFrame:
    """(video_id, title, channel, text, reasons): stamp lines stripped, defaults filled, unusable rows named."""
    text = strip_stamps(F.coalesce("transcript", F.lit("")))
    out = rows.select(video_id("url").alias("video_id"), or_default("title", "Untitled").alias("title"), or_default("channel", "Unknown channel").alias("channel"), text.alias("text"))
    reasons = F.array_compact(F.array(F.when(F.col("video_id").isNull(), F.lit("no video id")), F.when(F.col("text") == "", F.lit("no transcript"))))
    return out.withColumn("reasons", reasons)


def write_table(df: DataFrame, path: str, *, by: list[str] | None = None, sort: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned by low-cardinality columns and sorted within files so that statistics prune."""
    if sort:
        df = df.sortWithinPartitions(*sort)
    writer = df.write.mode(mode)
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.parquet(path)
