import json
import os

from pyspark.sql import functions as F

from lectern.session import build_session, ensure_checkpoint_dir
from lectern.sources import readers as R
from lectern.streaming import queue as Q


def test_failures_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t\tx", "e\nf"), ("b", None, None)], R.FAILURES)
    R.write_failures(rows, f"{tmp_path}/f")
    with open(f"{tmp_path}/f/extra.txt", "w") as f:
        f.write("# video_id\ttitle\terror\n\n\nc\tt\te\n")
    got = {r["video_id"]: (r["title"], r["error"]) for r in R.read_failures(spark, f"{tmp_path}/f").collect()}
    assert got == {"a": ("t x", "e f"), "b": (None, None), "c": ("t", "e")}
    assert R.read_failures(spark, f"{tmp_path}/f", 1).count() == 1


def test_job_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"answer": f"a{i}", "used_context": []}, indent=1))
    files = R.read_job_files(spark, str(tmp_path))
    jobs = spark.createDataFrame([(1, "running", None), (2, "completed", ("own", [])), (3, "pending", None)], "id long, status string, answer struct<answer:string,used_context:array<string>>")
    got = {r["id"]: (r["status"], r["answer"] and r["answer"]["answer"]) for r in R.recover_jobs(jobs, files).collect()}
    assert got == {1: ("completed", "a1"), 2: ("completed", "own"), 3: ("pending", None)}


def test_load_fills_columns(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "video_id string, other int").write.parquet(f"{tmp_path}/v")
    row = R.load(spark, f"{tmp_path}/v", "videos").first()
    assert row["has_transcript"] is False and row["title"] is None and "other" not in row.asDict()
    assert R.bootstrap(spark, "ask_jobs").schema == R.SCHEMAS["ask_jobs"]


def test_pasted(spark):
    rows = spark.createDataFrame([("https://youtu.be/abc_d-fghij", " ", None, "0:01\nhello"), (None, "t", "c", "0:00")], "url string, title string, channel string, transcript string")
    got = [(r["video_id"], r["title"], r["channel"], r["text"], r["reasons"]) for r in R.clean_pasted(rows).collect()]
    assert got == [("abc_d-fghij", "Untitled", "Unknown channel", "hello", []), (None, "t", "c", "", ["no video id", "no transcript"])]


def test_partitioned_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string")
    R.write_table(df, f"{tmp_path}/t", by=["kind"], sort=["id"])
    R.write_table(df.where("kind = 'a'").withColumn("id", F.lit(9)), f"{tmp_path}/t", by=["kind"])
    assert {(r["id"], r["kind"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(9, "a"), (2, "b")}


def test_stream_log(spark, tmp_path):
    for day in (1, 2):
        spark.createDataFrame([(day, "k", f"s{day}")], "t int, key string, state string").write.parquet(f"{tmp_path}/in/{day}")
    log = spark.read.parquet(f"{tmp_path}/in/1")
    for day in (1, 2):
        for name in os.listdir(f"{tmp_path}/in/{day}"):
            if name.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/flat", exist_ok=True)
                os.rename(f"{tmp_path}/in/{day}/{name}", f"{tmp_path}/flat/{day}-{name}")
    stream = Q.read_stream(spark, f"{tmp_path}/flat", "*.parquet", log, files_per_trigger=1)
    for _ in range(2):  # the second run finds nothing new
        Q.run_available(stream, Q.append_sink(f"{tmp_path}/out"), f"{tmp_path}/check")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 2
    assert Q.current_state(out.drop("batch"), "key", "t", "state").first()["state"] == "s2"


def test_stream_of_a_table_of_many_files(spark, data, tmp_path):
    from lectern.plans.changes import streamed_chunks
    from lectern.plans.library import stream_events

    for name in ("transcripts", "events"):  # a table is one file there, a folder of files here
        spark.read.parquet(f"{data}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (streamed_chunks, stream_events):
        one, many = query(spark, data), query(spark, str(tmp_path))
        assert one.count() > 0
        assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0


def test_session(spark):
    assert build_session() is not None
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
