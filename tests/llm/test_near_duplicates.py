import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.llm import near_duplicates as N
from lectern.llm.textutil import word_hashes, words


def brute(rows, size, threshold, least):
    sets = {}
    for i, t in rows:
        w = words(t)
        if i is not None and t and len(w) >= least:
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or {tuple(w)}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9 and sets[a] & sets[b]:
                out.add((a, b))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 2)
            n += 3
            rows.append((n, " ".join(copy)))
    rows += [(9001, rows[0][1].upper()), (9002, rows[0][1].replace(" ", ", ")), (9003, None), (9004, ""), (9005, "short text"), (9006, "short text"), (None, rows[0][1])]
    return rows


def test_pairs_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + rows[:3], "id long, text string").withColumn("a", F.lit(1)).withColumn("sig", F.lit(2))
    for size, threshold, least in ((3, 0.6, 20), (5, 0.8, 1)):
        found = {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(df, shingle=size, threshold=threshold, min_words=least).collect()}
        want = brute(rows, size, threshold, least)
        assert want and found == want


def test_texts_without_shingles_end_a_batch(spark):
    # empty, one-word and two-word texts last in a batch, in both forms of the result
    for last in ("", "x", "x y", None):
        rows = [(1, "a b c d e f"), (2, "a b c d e f g"), (3, last)]
        df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
        assert [tuple(r)[:2] for r in N.near_duplicate_pairs(df, shingle=3, threshold=0.6, sketch_bits=12).collect()] == [(1, 2)]
        assert {r["id"]: r["links"] for r in N.near_duplicate_summary(df, shingle=3, threshold=0.6, sketch_bits=12).collect()} == {1: 1, 2: 1, 3: 0}


def test_classes(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "id_a long, id_b long")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 8, 9, None, 5)], "id long")
    got = {r["id"]: (r["class_id"], r["links"]) for r in N.near_duplicate_classes(pairs, docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 2), 4: (1, 1), 5: (5, 0), 8: (8, 1), 9: (8, 1)}


def test_summary_agrees_with_pairs(spark):
    df = spark.createDataFrame(corpus(2), "id long, text string")
    options = {"shingle": 3, "threshold": 0.6, "min_words": 20}
    pairs = [(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(df, **options).collect()]
    links = {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    got = {r["id"]: (r["class_id"], r["links"]) for r in N.near_duplicate_summary(df, **options).collect()}
    assert set(got) == {i for i, _ in corpus(2) if i is not None}
    assert {i: n for i, (_, n) in got.items() if n} == links
    assert all(got[a][0] == got[b][0] <= a for a, b in pairs)


def test_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)], "id_a long, id_b long")
    docs = spark.range(41)
    assert {r["class_id"] for r in N.near_duplicate_classes(pairs, docs).collect()} == {0}


def test_empty(spark):
    assert N.near_duplicate_pairs(spark.createDataFrame([], "id long, text string")).count() == 0


def near(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, text string")
    return {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(df, **{"sketch_bits": 12, **options}).collect()}


def test_links_are_complete(spark):
    # pairs right at the threshold and of different sizes, whatever the frequencies say and however keys are cut into blocks
    rng = random.Random(7)
    rows = []
    for n in range(200):
        base = [f"v{rng.randrange(700)}" for _ in range(rng.randrange(20, 90))]
        at = rng.randrange(3, 14)
        rows += [(3 * n, " ".join(base)), (3 * n + 1, " ".join(base[:-at] + [f"v{rng.randrange(700)}" for _ in range(at)])), (3 * n + 2, " ".join(base[: int(len(base) * 0.62)]))]
    want = brute(rows, 1, 0.6, 10)
    assert len(want) > 200
    for options in ({}, {"rare": 0, "block": 3, "sketch_bits": 6}):
        assert near(spark, rows, shingle=1, threshold=0.6, min_words=10, **options) == want
    for threshold in (0.3, 0.8):
        assert near(spark, rows, shingle=1, threshold=threshold) == brute(rows, 1, threshold, 1)


def test_no_pair_at_the_threshold_is_missed(spark):
    # 45 of 75 words in common: exactly 0.6
    rng = random.Random(8)
    rows = []
    for n in range(3000):
        drawn = rng.sample(range(20000), 75)
        rows += [(2 * n, " ".join(f"v{x}" for x in drawn[:60])), (2 * n + 1, " ".join(f"v{x}" for x in drawn[15:]))]
    assert near(spark, rows, shingle=1, threshold=0.6, min_words=20) == {(2 * n, 2 * n + 1) for n in range(3000)}


def test_tiny_sets(spark):
    rows = list(enumerate(["a", "b", "a b", "a b c", "a b c d", "b c d", "a a b", "c", "d c b a", ""]))
    for threshold in (0.4, 0.6):
        assert near(spark, rows, shingle=1, threshold=threshold) == brute(rows, 1, threshold, 1)


def test_word_hashes_follow_words():
    rng = random.Random(3)
    signs = "aBz09_ -.\n\tÄßéΣςİ日本語\u0301\x00٣½Ⅷ𝔸"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(500)] + ["", "x", "ΑΣ"]
    hashes, counts = word_hashes(texts)
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    known = dict(zip(flat, hashes.tolist()))
    assert [known[w] for w in flat] == hashes.tolist() and len(set(known.values())) == len(known)


def test_a_task_gives_its_pairs_in_pieces():
    """Keys of many entries make far more pairs than entries; a task must never hold all of them."""
    n, keys = 300, 20
    scheme, sets = N.Scheme(0.6), np.arange(n, dtype=np.uint64)
    owner, key = np.repeat(np.arange(n), keys), np.tile(np.arange(keys, dtype=np.uint64), n)
    both = np.ones(len(owner), dtype=bool)
    group = pa.Table.from_batches([N._entry_rows(sets, np.full(n, 100), (owner, key, both, both), 1)])
    pieces = list(N._meet(group, scheme, 4096, most=10_000))
    assert len(pieces) > 10 and max(p.num_rows for p in pieces) <= 10_000 + n * keys
    total = pa.Table.from_batches(pieces).group_by(["a", "b"]).aggregate([("common", "sum")]).to_pydict()
    assert len(total["a"]) == n * (n - 1) // 2 and set(total["common_sum"]) == {keys}
    # keys with more entries than a block: each pair of blocks is a row of its own
    rows = list(N._blocks(group, scheme, 50))
    assert len(rows) == keys * 6 * 7 // 2 and {r.num_rows for r in rows} == {1}
    met = pa.Table.from_batches([p for r in rows for p in N._meet_blocks([c[0].as_py() for c in r.columns], scheme)])
    total = met.group_by(["a", "b"]).aggregate([("common", "sum")]).to_pydict()
    assert len(total["a"]) == n * (n - 1) // 2 and set(total["common_sum"]) == {keys}
