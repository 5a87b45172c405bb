import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import contamination as C
from lectern.llm.textutil import WORD, fold


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n, sigma in ((1, 3), (50, 2), (300, 4), (200, 1)):
        t = rng.integers(0, sigma, n)
        assert C.suffix_order(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 500)
    w = C.WaveletMatrix(seq, 37)
    at, sym = rng.integers(0, 501, 200), rng.integers(0, 37, 200)
    assert w.rank(sym, at).tolist() == [int((seq[:i] == s).sum()) for s, i in zip(sym, at)]
    assert w.access(np.arange(500)).tolist() == seq.tolist()


def test_search_and_location():
    rng = np.random.default_rng(2)
    parts = [rng.integers(1, 4, rng.integers(3, 60)) for _ in range(20)]
    text = np.concatenate([np.r_[0, p] for p in parts])
    index = C.FMIndex(text, 5)
    phrases = rng.integers(1, 5, (60, 3))
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == p.tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(docs, items, n=13):
    grams = {}
    for i, p in items:
        w = WORD.findall(fold(p or ""))
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall(fold(t or ""))
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def case():
    rng = random.Random(7)
    vocab = ["été", "Straße", "naïve", "x1"] + [f"v{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for i in range(12)] + [(50, None), (51, ""), (None, "a " * 20)]
    docs = []
    for d in range(60):
        filler = lambda: [rng.choice(vocab + ["other"]) for _ in range(rng.randint(0, 30))]
        p = (items[rng.randrange(12)][1]).split()
        a = rng.randrange(len(p))
        piece = p[a : a + rng.choice([12, 13, 14, 30])]
        text = rng.choice([" ", "\n", ", ", "  "]).join(filler() + piece + filler())
        docs.append((d, rng.choice([text, text.upper(), text.replace("é", "é")])))
    return docs + [(100, None), (101, ""), (None, "x")], items


def test_against_brute_force(spark):
    docs, items = case()
    ddf = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    idf = spark.createDataFrame(items, "item_id long, passage string").withColumn("doc_id", F.lit(1))
    want = brute(docs, [i for i in items if i[0] is not None])
    assert len(want) > 10
    for shard, block in ((400_000, 5_000), (60, 4)):
        spans = C.leaked_passages(ddf, idf, shard_symbols=shard, block_items=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in spans} == want
    texts = dict(docs)
    for r in spans:
        inside = texts[r["doc_id"]][r["start_char"] : r["end_char"]]
        assert len(WORD.findall(fold(inside))) == r["words"] >= 13


def test_empty(spark):
    docs, items = case()
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, passage string")
    assert C.leaked_passages(none, spark.createDataFrame(items, "item_id long, passage string")).count() == 0
    assert C.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), no_items).count() == 0
