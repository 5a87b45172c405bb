import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine, hash_embed
from lectern.operators import nearest as N
from lectern.operators import providers as P
from lectern.operators import retrieval as R


def test_exact_neighbours(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    m[7] = m[3]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8)], "id long, embedding array<double>").repartition(5)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding").unionByName(spark.createDataFrame([(3, [float(x) for x in m[3]])], "query_id long, embedding array<double>"))
    got = {}
    for r in N.exact_neighbours(queries, rows, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 50, 250, 3):
        d = np.round(1 - u @ u[q], 9)
        assert got[q] == sorted(range(300), key=lambda i: (d[i], i))[:4]
    assert got[3][:2] == [3, 7]
    assert N.exact_neighbours(queries.limit(0), rows, 4).count() == 0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [1.0, 0.0, None, None]
    assert np.allclose(np.linalg.norm(hash_embed(["a b", ""]), axis=1), [1, 0])


def records(spark):
    t = spark.createDataFrame([(1, "v1", "red apples grow " * 80, "brief one", 1), (2, "v2", "blue boats sail", None, 1), (3, "v1", "old text", None, 0), (4, None, "x", "x", 1), (5, "v3", " ", "only brief", 1)], "id long, video_id string, text string, shorty string, t int")
    t = t.withColumn("created_at", F.timestamp_seconds(F.col("t") * 1000))
    q = spark.createDataFrame([(1, "v1", "What grows?", 0), (1, "v1", "What grows?", 0), (2, "v1", "Where?", 1), (3, "v2", " ", 0)], "id long, video_id string, question string, question_index int")
    return t, q.withColumn("created_at", F.timestamp_seconds(F.lit(0)))


def test_index_records(spark):
    got = {r["record_id"]: r["document"] for r in R.index_records(*records(spark)).collect()}
    assert set(got) == {"v1:chunk:0", "v1:chunk:1", "v1:shorty", "v1:sq:0", "v1:sq:1", "v2:chunk:0", "v3:shorty"}
    assert got["v1:sq:1"] == "Where?"


def test_variants(spark):
    df = spark.createDataFrame([(1, "a", ["b", "a", "c", "d", "e"]), (2, "x", None), (3, None, ["y"])], "question_id long, question string, rewrites array<string>")
    got = [(r["question_id"], r["query"]) for r in R.variants(df).orderBy("query_id").collect()]
    assert got == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "x")]


def test_layers(spark):
    index = R.with_vectors(R.index_records(*records(spark)))
    asked = spark.createDataFrame([(1, "red apples grow", None), (2, "blue boats sail", None)], "question_id long, question string, rewrites array<string>")
    hits = R.retrieve(asked, index, k=1)
    top = {(r["question_id"], r["layer"]): r["video_id"] for r in hits.where("place = 1").collect()}
    assert top[1, "chunk"] == "v1" and top[2, "chunk"] == "v2"
    wanted = spark.createDataFrame([(1, "v2")], "question_id long, video_id string")
    filtered = R.retrieve(asked, index, k=1, wanted=wanted)
    assert filtered.where("question_id = 1 and layer = 'chunk'").count() == 0  # the filter comes after the search
    assert R.retrieve(asked, index, k=1, candidates=wanted.limit(0)).count() == hits.count()
    only = R.retrieve(asked, index, k=1, candidates=wanted, prefilter=True)
    assert {r["video_id"] for r in only.where("question_id = 1").collect()} == {"v2"}
    assert only.where("question_id = 2").count() == hits.where("question_id = 2").count()
    words = hits.limit(0).unionByName(hits.withColumn("question_id", F.lit(3).cast("long")))
    assert R.passages(hits, words).count() == 2 * hits.count() and R.passages(hits, hits).count() == hits.count()
    assert R.passages(hits, words, "keyword").select("question_id").distinct().count() == 1 and R.passages(hits, words, "vector").count() == hits.count()
    with pytest.raises(ValueError):
        R.passages(hits, words, "other")
    made = {r["question_id"]: r for r in R.contexts(asked.unionByName(spark.createDataFrame([(3, "none", None)], asked.schema)), hits).collect()}
    assert made[3]["context"] == R.NOTHING and made[1]["used_context"][0].startswith("[chunk] video_id=v1 chunk=0\n")
    assert [b.split("]")[0] for b in made[1]["used_context"]] == sorted([b.split("]")[0] for b in made[1]["used_context"]], key=lambda x: R.LAYERS.index(x[1:]))


def test_keyword_layer(spark):
    t, _ = records(spark)
    videos = spark.createDataFrame([("v1", "Apples"), ("v3", None)], "video_id string, title string")
    asked = spark.createDataFrame([(1, "which brief has apples")], "question_id long, question string")
    got = [(r["video_id"], r["distance"]) for r in R.keyword_layer(asked, t, videos).orderBy("place").collect()]
    assert got == [("v1", -2.0), ("v3", -1.0)]


def test_generation(spark):
    class Failing(P.Extractive):
        def entities(self, text, title=None):
            if "bad" in text:
                raise ValueError("no")
            return super().entities(text, title)

    df = spark.createDataFrame([("a", "t", "c", "d", "Ada Lovelace met Alan Turing. They spoke."), ("b", "t", "c", "d", " "), ("c", None, None, None, "bad")], "video_id string, title string, channel string, date string, text string")
    got = {r["video_id"]: r for r in P.generate(df, Failing()).collect()}
    assert got["a"]["questions"] == ["What is said about Ada Lovelace?", "What is said about Alan Turing?"]
    assert got["b"]["error"] == "no text" and got["c"]["error"] == "no"


def test_filters_and_answers(spark):
    videos = spark.createDataFrame([("v1", "Paper Bench", "2025-03-01 10:00:00"), ("v2", "Paper Bench", "2024-01-01 00:00:00"), ("v3", None, "2025-03-15 00:00:00"), ("v4", "Other", None)], "video_id string, channel string, watch_date string")
    asked = spark.createDataFrame([(1, "What did paper bench say?", None), (2, "What came from 2025-02-27 to 2025-03-15?", None), (3, "What?", None), (4, None, None)], "question_id long, question string, rewrites array<string>")
    filters = R.inferred_filters(asked, videos)
    assert {r["question_id"]: (r["channels"], r["date_from"], r["date_to"]) for r in filters.collect()} == {1: (["Paper Bench"], None, None), 2: (None, "2025-02-27", "2025-03-15"), 3: (None, None, None), 4: (None, None, None)}
    found = R.candidate_videos(filters, videos)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "v1"), (1, "v2"), (2, "v1"), (2, "v3")]
    index = R.with_vectors(R.index_records(*records(spark)))
    vectors = R.variants(asked).withColumn("embedding", R.embed(R.embed_input("query")))
    near = R.restricted_search(vectors, index, "shorty", found, 1).join(index.select("id", "video_id"), "id")
    assert sorted((r["question_id"], r["video_id"]) for r in near.collect()) == [(1, "v1"), (2, "v1" if near.where("question_id = 2").first()["video_id"] == "v1" else "v3")]
    made = R.answers(R.contexts(asked, R.retrieve(asked.limit(1), index, k=1)), P.Extractive())
    got = {r["question_id"]: r["answer"] for r in made.collect()}
    assert got[3] == R.NOTHING and got[1].startswith("[chunk]")
