"""Versions, writes, reads, search and orphans on small tables with nulls, ties, repeats, empty tables and clashing names."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import library as L
from lectern.operators import orphans as O
from lectern.operators import search as S
from lectern.operators import versions as V
from lectern.operators import writes as W

T0, T1, T2 = datetime(2025, 1, 1), datetime(2025, 2, 1), datetime(2025, 3, 1)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a", T0, "x"), (2, "a", T1, None), (3, "a", T1, "z"), (4, "b", None, "w"), (5, "b", T0, "v"), (6, None, T0, "n")], "id long, k string, created_at timestamp, v string")


def test_latest(rows):
    assert {r["k"]: r["id"] for r in V.latest(rows, "k").collect()} == {"a": 3, "b": 5, None: 6}
    assert {r["k"]: r["id"] for r in V.latest_by_aggregate(rows, "k", ["id"]).collect()} == {"a": 3, "b": 5, None: 6}
    assert V.latest(rows.limit(0), "k").count() == 0


def test_pages(rows):
    order = (F.col("created_at").desc_nulls_last(), F.col("id").desc())
    assert [r["id"] for r in V.page(rows, 1, 2, *order).collect()] == [3, 2]
    assert [r["id"] for r in V.page(rows, 0, 2, *order).collect()] == [3, 2]
    assert [r["id"] for r in V.page(rows, 2, 2, *order).collect()] == [6, 5]
    assert [r["id"] for r in V.page_after(rows, 2, "created_at", "id", T1, 2).collect()] == [6, 5]


def test_numbering_and_batches(spark):
    df = spark.range(0, 95).repartition(4)
    got = V.in_batches(df, 10, F.col("id").desc()).collect()
    assert {r["id"]: (r["position"], r["batch_no"]) for r in got} == {i: (94 - i, (94 - i) // 10) for i in range(95)}
    assert V.in_batches(df.limit(0), 10, F.col("id")).count() == 0
    total = V.running_total(df.withColumn("x", F.col("id") % 7), "x", F.col("id")).collect()
    assert {r["id"]: r["running"] for r in total} == {i: sum(j % 7 for j in range(i + 1)) for i in range(95)}


def test_upsert(spark):
    base = spark.createDataFrame([("a", "t", True, "w"), ("b", "u", True, "w")], "k string, title string, flag boolean, watch string")
    new = spark.createDataFrame([("a", "new", "extra"), ("c", "c", "extra")], "k string, title string, other string")
    replaced = {r["k"]: tuple(r) for r in W.upsert(base, new, "k", "replace", {"flag": False}).collect()}
    assert replaced == {"a": ("a", "new", False, None), "b": ("b", "u", True, "w"), "c": ("c", "c", False, None)}
    merged = {r["k"]: tuple(r) for r in W.upsert(base, new, "k", "merge", {"flag": False}).collect()}
    assert merged == {"a": ("a", "new", True, "w"), "b": ("b", "u", True, "w"), "c": ("c", "c", False, None)}
    with pytest.raises(ValueError):
        W.upsert(base, new, "k", "other")


def test_updates_and_deletes(spark, rows):
    news = spark.createDataFrame([("a", "N")], "k string, v string")
    latest = {r["id"]: r["v"] for r in W.update_versions(rows, news, "k", ["v"], "latest").collect()}
    assert latest == {1: "x", 2: None, 3: "N", 4: "w", 5: "v", 6: "n"}
    every = {r["id"]: r["v"] for r in W.update_versions(rows, news, "k", ["v"], "all").collect()}
    assert [every[i] for i in (1, 2, 3)] == ["N"] * 3
    assert sorted(r["id"] for r in W.delete(rows, news.select("k"), "k").collect()) == [4, 5, 6]
    fresh = spark.createDataFrame([(9, "b")], "id long, k string")
    assert sorted(r["id"] for r in W.replace_children(rows, fresh, "k").collect()) == [1, 2, 3, 6, 9]
    assert W.fan_out(news, "k", ["x", "y"]).count() == 2


def test_json_patch(spark):
    rows = [('{"n": 3, "tags": ["a"], "other": {"deep": [1, null, "x"]}}', "d"), ("broken", "d"), (None, "d"), ('{"upload_date": "old", "z": 1.5}', " "), ("[1]", "d"), ("{}", None)]
    df = spark.createDataFrame(rows, "j string, d string")
    got = [r[0] for r in df.select(W.patch_json("j", "upload_date", "d")).collect()]
    assert [json.loads(g) for g in got] == [{"n": 3, "tags": ["a"], "other": {"deep": [1, None, "x"]}, "upload_date": "d"}, {"upload_date": "d"}, {"upload_date": "d"}, {"z": 1.5}, {"upload_date": "d"}, {}]


def test_transitions(spark):
    queue = spark.createDataFrame([(1, "pending", None, None, None), (2, "started", T0, None, None), (3, "started", T0, None, "old"), (4, None, None, None, None), (5, "pending", None, None, "kept")], "id long, status string, started_at timestamp, completed_at timestamp, error string")
    changes = spark.createDataFrame([(1, "started", "x"), (2, "completed", None), (3, "failed", "bad"), (4, None, "x"), (9, "failed", "x")], "id long, status string, error string")
    got = {r["id"]: tuple(r)[1:] for r in W.transition(queue, changes, "id", F.lit(T2)).collect()}
    assert got == {1: ("started", T2, None, None), 2: ("completed", T0, T2, None), 3: ("failed", T0, T2, "bad"), 4: (None, None, None, None), 5: ("pending", None, None, "kept")}
    assert W.transition(queue.limit(0), changes, "id", F.lit(T2)).count() == 0


def test_clamped_page(spark):
    df = spark.range(95)
    assert [r["id"] for r in V.clamped_page(df, 99, 10, F.col("id")).collect()] == [90, 91, 92, 93, 94]
    assert [r["id"] for r in V.clamped_page(df, -1, 10, F.col("id")).collect()] == list(range(10))
    assert V.clamped_page(df.limit(0), 3, 10, F.col("id")).count() == 0
    assert V.present(df, ["x", "id"]) == ["id"]


def test_evolve_and_reasons(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, None)], "x int, y string")
    assert sorted(tuple(r) for r in W.evolve(a, b, {"y": "d"}).collect()) == [(1, "d"), (2, "d")]
    assert [r["reasons"] for r in W.with_reasons(b, {"no y": F.col("y").isNull(), "null rule": F.col("y") == "a"}).collect()] == [["no y"]]


def test_missing_brief_rules(spark):
    videos = spark.createDataFrame([(c,) for c in "abcdef"], "video_id string")
    rows = [("b", None, "t"), ("c", "", "t"), ("d", "x", "t"), ("e", None, "t"), ("e", "x", "t"), ("f", None, " ")]
    t = spark.createDataFrame(rows, "video_id string, shorty string, text string")
    found = lambda rule: sorted(r[0] for r in L.missing_briefs(videos, t, rule).collect())
    assert found("null") == ["a", "b", "f"]
    assert found("any_row_null") == ["b", "e", "f"]
    assert found("blank") == ["b", "c", "e"]


def test_segments_and_sections(spark):
    s = spark.createDataFrame([("v", 2.0, "b"), ("v", 1.0, "a"), ("w", 1.0, None)], "k string, s double, t string")
    assert {r[0]: r[1] for r in L.segments_to_text(s, "k", "s", "t").collect()} == {"v": "a b", "w": ""}
    b = spark.createDataFrame([(1, "TITLE: x\n\nCONTEXT\nline\n- two\nIMPACT/RISKS\nend")], "id int, t string")
    assert [tuple(r)[1:] for r in L.sections(b, "id", "t").orderBy("ordinal").collect()] == [("HEADER", 0, "TITLE: x"), ("CONTEXT", 2, "line"), ("CONTEXT", 3, "- two"), ("IMPACT/RISKS", 5, "end")]


def test_metadata_filter(spark):
    v = spark.createDataFrame([("a", "c", "2026-03-13 00:00:00"), ("b", None, None), ("d", "e", "2026-03-12 01:00:00")], "video_id string, channel string, watch_date string")
    ids = lambda **k: sorted(r[0] for r in S.metadata_filter(v, **k).collect())
    assert ids(date_to="2026-03-13") == ["d"]
    assert ids(date_to="2026-03-13", date_bound="inclusive_day") == ["a", "d"]
    assert ids(channels=["c"]) == ["a"] and ids() == ["a", "b", "d"]
    assert ids(ids=v.where("video_id = 'b'")) == ["b"]


def test_keyword_search(spark):
    q = spark.createDataFrame([(1, "the cat and the dog"), (2, None), (3, "a b"), (4, "zebra")], "query_id long, question string")
    t = spark.createDataFrame([("v1", 1, "Cats and dogs, the lot"), ("v0", 2, "cat"), ("v0", 3, "cat"), (None, 4, None)], "video_id string, row_id long, text string")
    got = [(r["query_id"], r["row_id"], r["score"], r["rank"]) for r in S.keyword_search(q, t, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 5, 1), (1, 2, 1, 2)]
    assert S.keyword_search(q.limit(0), t).count() == 0 and S.keyword_search(q, t.limit(0)).count() == 0


def test_reference_kinds(spark):
    parents = spark.createDataFrame([("p", T1, "x"), ("late", T2, "x"), (None, T0, "x"), ("notime", None, "x")], "video_id string, created_at timestamp, kind string")
    gone = spark.createDataFrame([("gone",), ("gone",), ("late",), (None,)], "video_id string")
    child = spark.createDataFrame(
        [(1, "p", T1), (1, "p", T1), (2, "late", T1), (3, "gone", T1), (3, "gone", T1), (4, "none", None), (5, None, T1), (6, "P", T1), (7, "notime", T1), (8, "late", None)],
        "id long, video_id string, created_at timestamp",
    ).withColumn("kind", F.lit("clash")).withColumn("period", F.lit("clash")).withColumn("_salt", F.lit(0))
    broken = lambda c, p, g: O.broken_references({"c": c}, p, g, key="video_id")
    got = sorted((r["record_id"], r["period"], r["kind"]) for r in broken(child, parents, gone).collect())
    assert got == [(2, "2025-02", "late"), (3, "2025-02", "deleted"), (4, None, "missing"), (6, "2025-02", "missing")]
    assert broken(child.limit(0), parents, gone).count() == 0
    assert {r["kind"] for r in broken(child, parents.limit(0), None).collect()} == {"missing"}
    two = O.broken_references({"c": child, "d": child.where("id = 3")}, parents, gone, key="video_id")
    assert {r["table_name"]: r["n"] for r in two.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).collect()} == {"c": 4, "d": 1}


def test_hot_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(O, "HOT", 100)
    child = spark.range(0, 3000).select("id", F.when(F.col("id") < 2900, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("video_id"), F.lit(T0).alias("created_at"))
    for parents, n in (([("x", T0)], 3000), ([("hot", T0)], 100), ([("hot", T1)], 3000)):
        assert O.broken_references({"c": child}, spark.createDataFrame(parents, "video_id string, created_at timestamp"), None, key="video_id").count() == n


def test_cascade(spark):
    t = {
        "a": spark.createDataFrame([(1, "r"), (2, "r")], "id long, own string"),
        "b": spark.createDataFrame([(1, 1), (2, 9), (3, None), (3, None)], "id long, a_id long"),
        "c": spark.createDataFrame([(1, 1), (2, 2), (3, 7), (4, 3)], "id long, b_id long"),
        "d": spark.createDataFrame([(1, 2), (2, 1)], "id long, c_id long"),
        "e": spark.createDataFrame([], "id long, d_id long"),
    }
    keys = [O.ForeignKey("b", "a_id", "a", "id"), O.ForeignKey("c", "b_id", "b", "id"), O.ForeignKey("d", "c_id", "c", "id"), O.ForeignKey("e", "d_id", "d", "id")]
    got = {(r["table_name"], r["record_id"]): r["inherited"] for r in O.orphan_cascade(t, keys, dict.fromkeys(t, "id")).collect()}
    assert got == {("b", "2"): False, ("c", "3"): False, ("c", "2"): True, ("d", "1"): True}
    sound = {"a": t["a"], "b": t["b"].where("id = 1")}
    assert O.orphan_cascade(sound, keys[:1], dict.fromkeys(sound, "id")).count() == 0


def test_cascade_on_a_cycle(spark):
    t = {"x": spark.createDataFrame([(1, 2), (2, 3), (3, 99)], "id long, up long")}
    got = {r["record_id"]: r["inherited"] for r in O.orphan_cascade(t, [O.ForeignKey("x", "up", "x", "id")], {"x": "id"}).collect()}
    assert got == {"3": False, "2": True, "1": True}
    with pytest.raises(RuntimeError):
        O.orphan_cascade(t, [O.ForeignKey("x", "up", "x", "id")], {"x": "id"}, max_rounds=2)


def test_store_write_back_and_sweep(spark):
    videos = spark.createDataFrame([("a", False, None), ("b", False, None)], "video_id string, has_transcript boolean, transcript_fetched_at timestamp")
    t = spark.createDataFrame([(1, "b", "old", "de")], "id long, video_id string, text string, language string")
    v2, t2 = W.store_transcripts(videos, t, spark.createDataFrame([(2, "a", "new")], "id long, video_id string, text string"), F.lit(T0))
    assert {r["video_id"]: r["has_transcript"] for r in v2.collect()} == {"a": True, "b": False}
    assert {r["id"]: r["language"] for r in t2.collect()} == {1: "de", 2: "en"}
    q = spark.createDataFrame([("a", 0, None), ("a", 1, "x")], "video_id string, question_index int, embedding_id string")
    r = spark.createDataFrame([("a", 0, "a:sq:0")], "video_id string, question_index int, record_id string")
    assert sorted(str(x["embedding_id"]) for x in W.write_back_ids(q, r, ["video_id", "question_index"]).collect()) == ["a:sq:0", "x"]
    jobs = spark.createDataFrame([(1, "running", T0), (2, "running", T2), (3, "done", T0), (4, "running", None)], "id long, status string, t timestamp")
    assert {x["id"]: x["status"] for x in W.sweep(jobs, "status", ["running"], "error", F.col("t") < F.lit(T1)).collect()} == {1: "error", 2: "running", 3: "done", 4: "running"}
