import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import packing, splitting, tokens

TEXT = "# One\n\nFirst para. It has two sentences!\n- item one\n- item two\n\nTWO\nこれは文です。次の文！ " + "long words here " * 90 + "x" * 950 + " end. " + "y" * 799 + "."


@pytest.mark.parametrize("limit,overlap", [(800, 200), (50, 10), (7, 0), (800, 0)])
@pytest.mark.parametrize("text", [TEXT, "a" * 3000, "a b " * 800, "。".join("字" * 40 for _ in range(60)), " \n" + "word. " * 500 + "\t"])
def test_pieces(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    joined = "".join(text[c:b] for _, c, b, _ in pieces)
    assert "".join(joined.split()) == "".join(text.split())
    for n, (start, core, end, _) in enumerate(pieces):
        assert end - start <= limit and core - start <= overlap and start <= core < end
        if n:
            assert pieces[n - 1][2] <= core
            assert start >= pieces[n - 1][1]
    stretches = re.findall(r"[^\s.!?。！？]*[.!?。！？]|[^\s.!?。！？]+", text)
    if len(text.strip()) > limit:
        assert any(f for *_, f in pieces) == (max(map(len, stretches)) > limit)


def test_split_small_cases(spark):
    assert splitting.split_text(None) == splitting.split_text("") == splitting.split_text(" \n") == []
    assert splitting.split_text(" ab ") == [(1, 1, 3, False)]
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "a " * 900, "c"), (3, "a " * 900, "c"), (None, "x", "c"), (4, "z" * 801, "c")], "id long, text string, cut string")
    got = {r["id"]: r["cut"] for r in splitting.cut_kinds(df).collect()}
    assert got == {3: "natural", 4: "forced"}
    pieces = splitting.split_oversized(df)
    assert pieces.where("id = 3").count() == 2 * len(splitting.split_text("a " * 900))
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_prefers_structure():
    text = "\n\n".join(("Paragraph %d. " % i) + "word " * 60 for i in range(6))
    starts = {m.start() for m in re.finditer("Paragraph", text)}
    assert {c for _, c, _, _ in splitting.split_text(text)} <= starts


def library(path):
    tiktoken = pytest.importorskip("tiktoken")
    c = tokens.counter(path)
    return c, tiktoken.Encoding("own", pat_str=c.pattern.pattern, mergeable_ranks=c.rank, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_counts_equal_the_tokenizer(name):
    c, encoder = library(tokens.vocabulary_path(name))
    rng = random.Random(3)
    letters = "etaoinshrdlu  ETXQZ.,!?'12345\n\té漢字カ🙂ß​<|endoftext|>"
    texts = ["", " ", "a" * 5000, "ab" * 900, "don't stop", TEXT] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    assert [c.count(t) for t in texts] == [len(encoder.encode_ordinary(t)) for t in texts]
    assert c.count(None) == 0


def test_longest_match_against_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        vocab = [bytes([x]) for x in b"abc"] + list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(12)})
        m = tokens.LongestMatch(vocab)
        for _ in range(30):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
            want, at = [], 0
            while at < len(word):
                best = max((v for v in vocab if word.startswith(v, at)), key=len)
                want.append(vocab.index(best))
                at += len(best)
            assert m.segment(word) == want
        assert m.segment(b"axb") is None


def test_budget(spark):
    df = spark.createDataFrame([("a", "one two"), ("a", None), (None, "x"), (None, "x")], "g string, text string").withColumn("tokens", F.lit("clash"))
    counted = tokens.with_token_counts(df, ["g"], "text")
    got = {r["g"]: (r["documents"], r["tokens"]) for r in tokens.token_budget(counted, ["g"]).collect()}
    assert got == {"a": (2, 2), None: (2, 2)}


def check_plan(histogram, capacity):
    plan = packing.solve(histogram, capacity)
    held = {}
    for config, uses, _ in plan:
        assert sum(k * v for k, v in config.items()) <= capacity
        for k, v in config.items():
            held[k] = held.get(k, 0) + v * uses
    assert held == {k: v for k, v in histogram.items() if 0 < k <= capacity and v}
    return sum(uses for _, uses, _ in plan)


def test_solver():
    assert packing.solve({}, 10) == [] and packing.solve({11: 4, 0: 3, 5: 0}, 10) == []
    assert check_plan({10: 3}, 10) == 3
    assert check_plan({5: 7}, 10) == 4
    assert check_plan({6: 10, 4: 10}, 10) == 10
    assert check_plan({7: 30, 3: 30, 5: 20, 2: 10}, 10) <= 42
    rng = random.Random(2)
    for capacity in (50, 300):
        h = {}
        for _ in range(3000):
            n = min(capacity, int(rng.paretovariate(1.1) * capacity / 20) + 1)
            h[n] = h.get(n, 0) + 1
        least = -(-sum(k * v for k, v in h.items()) // capacity)
        big = sum(v for k, v in h.items() if k > capacity / 2)
        assert check_plan(h, capacity) <= max(least, big) * 1.02 + 1


def test_the_program_carries_the_packing():
    # nearly all containers are rounded configurations, at any number of items, within 1 % of the lower bound
    rng = random.Random(6)
    for times in (1, 10, 100):
        h = {}
        for _ in range(4000):
            n = min(512, int(rng.lognormvariate(4, 0.8)) + 1)
            h[n] = h.get(n, 0) + times
        plan = packing.solve(h, 512)
        total = sum(uses for _, uses, _ in plan)
        assert sum(uses for _, uses, source in plan if source == "lp") >= 0.95 * total
        assert total <= 1.01 * -(-sum(k * v for k, v in h.items()) // 512)


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 90)) for i in range(400)] + [(500, 250), (501, 0), (502, None), (503, 100), (503, 100), (None, 5)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long").repartition(4), capacity=100).collect()
    loads, sizes = {}, {}
    for r in got:
        sizes[r["id"]] = sizes.get(r["id"], 0) + r["size"]
        if r["size"]:
            loads[r["container_id"]] = loads.get(r["container_id"], 0) + r["size"]
        else:
            assert r["container_id"] is None
    assert max(loads.values()) <= 100
    assert [r["size"] for r in sorted((r for r in got if r["id"] == 500), key=lambda r: r["piece_no"])] == [100, 100, 50]
    assert sizes[503] == 200 and sizes[501] == 0 and sum(loads.values()) == sum(n or 0 for _, n in rows)
    assert all(sum(1 for r in got if r["id"] == i) == 1 for i in range(400))
    assert len(loads) <= sum(loads.values()) / 100 * 1.05 + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long")).count() == 0
