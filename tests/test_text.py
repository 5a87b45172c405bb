import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def stamps_by_hand(text):
    lines = [x for x in text.split("\n") if not re.fullmatch(r"\s*\d{1,2}:\d{2}(:\d{2})?\s*[-–—]?\s*", x)]
    kept = [x.strip() for line in lines for x in line.splitlines() if x.strip()]
    return "\n\n".join(kept)


def test_stamp_lines(spark):
    pieces = ["0:00", "1:02:33", "12:34 -", "3:33 –", "123:45", "9:9", "10:00 hi", "", "\t", " words ", "．"]
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(200)]
    assert values(spark, X.strip_stamps("x"), texts) == [stamps_by_hand(t) for t in texts]
    assert values(spark, X.strip_stamps("x"), ["0:00\n1:11", None, ""]) == ["", None, ""]


def chunks_by_hand(text, size=800, overlap=200):
    text = text.strip()
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while True:
        out.append(text[at : at + size].strip())
        if at + size >= len(text):
            return [c for c in out if c]
        at += size - overlap


@pytest.mark.parametrize("n", [0, 1, 799, 800, 801, 1400, 1401, 2000, 5003])
def test_chunks(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice("ab é\n") for _ in range(n))
    got = values(spark, X.chunks("x"), [text])[0]
    assert [c["chunk"] for c in got] == chunks_by_hand(text)
    assert [c["ordinal"] for c in got] == list(range(len(got)))


def test_chunks_drop_blank_windows(spark):
    text = "a" * 500 + " " * 1500 + "b" * 500
    assert [c["chunk"] for c in values(spark, X.chunks("x"), [text])[0]] == chunks_by_hand(text)
    assert values(spark, X.chunks("x"), [None]) == [None]


def test_video_ids(spark):
    base = "https://www.youtube.com/"
    urls = [f"{base}watch?v=abc_d-fghij&t=1", f"{base}watch?list=1&v=abc_d-fghij", "https://youtu.be/abc_d-fghij?x", f"{base}embed/abc_d-fghij", "https://youtu.be/short", "https://youtu.be/abc_d-fghijEXTRA", "x", None]
    key = "abc_d-fghij"
    assert values(spark, X.video_id("x"), urls) == [key, key, key, key, "short", key + "EXTRA", None, None]
    assert values(spark, X.video_id("x", strict=True), urls) == [key, None, key, None, None, key, None, None]


def test_words_and_blanks(spark):
    assert values(spark, X.words("x", 3), ["What date, WHAT Été_1 ab?"]) == [["what", "date", "what", "été_1"]]
    assert values(spark, X.is_blank("x"), [None, "", "  ", "a", "\n"]) == [True, True, True, False, False]
    assert values(spark, X.or_default("x", "d"), [None, " \n", " a "]) == ["d", "d", "a"]


def test_headers_blocks_and_prompts(spark):
    df = spark.createDataFrame([("t", None, "2025", 3)], "t string, c string, d string, n int")
    row = df.select(X.brief_header("t", "c", "d"), X.context_block("t", "c", "n", "d"), X.fill("{a}-{b}", a="t", b="c"), X.record_id("t", "chunk", "n"), X.record_id("c", "shorty")).first()
    assert row[0] == "SOURCE: t\nCHANNEL: Unknown channel\nDATE: 2025\nCREATOR: Unknown channel\n\n"
    assert row[1] == "[t] video_id=unknown_video chunk=3\n2025\n"
    assert row[2:] == ("t-", "t:chunk:3", None)


def test_small_formats(spark):
    assert values(spark, X.token_estimate("x"), ["a" * 7, "", None]) == [1, 0, 0]
    assert values(spark, X.show_count(F.length("x")), ["a" * 1234]) == ["~1,234"]
    assert values(spark, X.fetch_error("x"), ["No transcript x", "Video unavailable", "e"]) == ["No transcript available for this video", "Video is unavailable or private", "e"]
    assert values(spark, X.tsv_field("x"), ["a\tb\nc", None]) == ["a b c", ""]
    assert values(spark, X.canonical_url("x"), ["k"]) == ["https://www.youtube.com/watch?v=k"]
