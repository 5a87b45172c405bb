import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import language, pairs, truncation
from lectern.llm.endings import Endings, ending_counts

SUBJECTS = ["The archivist", "A former student", "The night shift", "Our sound technician", "The city council"]
VERBS = ["repaired", "inspected", "borrowed", "abandoned", "catalogued"]
THINGS = ["the wooden kiln", "the remote loom", "the quiet radio mast", "the public parser", "the rusty beehive"]
PLACES = ["along the canal", "in the cold store", "near the old quay", "outside the workshop", "on the island"]
ENDS = ["because the cables were swapped", "since the manual was missing two pages", "and the alarm stayed silent", "while the rain kept coming"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(THINGS)} {rng.choice(PLACES)}, {rng.choice(ENDS)}."


def briefs(n=400, limit=500):
    rng = random.Random(3)
    rows, broken = [], set()
    for i in range(n):
        text = "TITLE: x\n\nCONTEXT\n" + "\n".join(f"- {sentence(rng)}" for _ in range(rng.randint(2, 9)))
        if i % 3 == 0 and len(text) > limit:
            text = text[:limit]
            if not text.rstrip().endswith("."):
                broken.add(i)
        elif i % 5 == 0:
            text = text[:-1]  # no closing sign
        elif i % 11 == 0:
            cut = rng.randrange(120, len(text) - 5)
            text = text[:cut].rstrip() + rng.choice(["", "…", "�"])
            if not text.endswith("."):
                broken.add(i)
        rows.append((i, text))
    return rows, broken


def test_truncated_briefs(spark):
    rows, broken = briefs()
    dirty = [(9000, None), (9001, " \n"), (9002, "x"), (None, "The archivist repaired the")]
    df = spark.createDataFrame(rows + dirty, "id long, shorty string").withColumn("length", F.lit("clash")).withColumn("truncated", F.lit(1))
    got = truncation.truncated_texts(df).collect()
    found = {r["id"] for r in got if r["truncated"]} - {None, 9002}
    hit = len(found & broken)
    assert hit >= 0.93 * len(broken) and hit >= 0.95 * len(found)
    assert {r["id"] for r in got} >= set(range(400)) and not {9000, 9001} & {r["id"] for r in got}
    assert any(r["at_limit"] and r["length"] == 500 for r in got)
    assert truncation.truncated_texts(df.limit(0)).count() == 0


def ended(spark, rows):
    return spark.createDataFrame(rows, "length int, complete double")


def test_spikes(spark):
    rng = random.Random(1)
    sound = [(rng.randint(100, 900), rng.choice([1.0, 1.0, 1.0, 0.5])) for _ in range(3000)]
    limits = [(512, 0.1)] * 30 + [(530, 0.1)] * 40 + [(700, 0.0)] * 20
    assert {r["length"] for r in truncation.length_spikes(ended(spark, sound + limits + [(None, 0.1), (400, None)])).collect()} == {512, 530, 700}
    assert truncation.length_spikes(ended(spark, [])).count() == 0
    assert truncation.length_spikes(ended(spark, sound)).count() == 0


def test_lumps_of_sound_texts_are_no_limits(spark):
    # templates pile up at some lengths; more rows of the same kind make these no limits
    rng = random.Random(4)
    lengths, weights = [100 + 7 * i for i in range(60)], [rng.uniform(0.5, 2) for _ in range(60)]
    for n in (400, 4_000, 40_000):
        assert truncation.length_spikes(ended(spark, [(x, rng.choice([1.0] * 9 + [0.6])) for x in rng.choices(lengths, weights, k=n)])).count() <= 1


def test_no_spikes_at_the_ends(spark):
    # as many broken texts of each length from 700 to 900: none is a limit, the first and the last ones neither
    df = spark.range(0, 20_100).select((F.col("id") % 201 + 700).cast("int").alias("length"), F.lit(0.5).alias("complete"))
    assert truncation.length_spikes(df).count() == 0
    more = df.unionByName(spark.range(0, 400).select(F.lit(900).alias("length"), F.lit(0.5).alias("complete")))
    assert [(r["length"], r["broken"]) for r in truncation.length_spikes(more).collect()] == [(900, 500)]


def test_tail():
    direct = 1 - sum(math.exp(-3) * 3**k / math.factorial(k) for k in range(7))
    assert abs(truncation._tail(7, 3.0, 1.0) - direct) < 1e-9
    assert truncation._tail(7, 3.0, 4.0) > 2 * direct and truncation._tail(0, 3.0, 1.0) == 1.0


@pytest.mark.parametrize("text,lang", [
    ("What happened to the loom in the cold store?", "en"), ("Was geschah mit dem Gewächshaus und wer war dabei?", "de"), ("Que s’est-il passé avec la ruche dans la réserve ?", "fr"),
    ("¿Qué ocurrió con el telar en el viejo almacén?", "es"), ("これはなんですか。", "ja"), ("12 34", None), (None, None), ("", None),
])
def test_language(text, lang):
    assert language.language(text) == lang


@pytest.mark.parametrize("question,asked", [("Please answer in German: who?", {"de"}), ("(Reply in Spanish) Who?", {"es"}), ("Bitte auf Englisch antworten: Wer?", {"en"}), ("Répondez en anglais : qui ?", {"en"}), ("Responde en inglés: ¿quién?", {"en"}), ("What did the German team say?", set())])
def test_requested(question, asked):
    assert language.requested(question) == asked


Q = "Who repaired the wooden kiln along the canal in the first trial?"
CASES = [
    (None, "empty"), ("", "empty"), (" \n\xa0", "empty"), ("N/A", "empty"), ("...", "empty"), ("[no answer]", "empty"), ("TODO", "empty"),
    (Q, "copy"), (Q.upper(), "copy"), ("Question: " + Q, "copy"), (Q.replace(" wooden", ""), "copy"),
    ("Sorry — I can't help with that request. Is there anything else?", "refusal"), ("Je suis désolé, je ne peux pas répondre à cette demande.", "refusal"), ("Es tut mir leid, aber diese Frage darf ich nicht beantworten.", "refusal"), ("Lo siento, no puedo ayudar con esa petición.", "refusal"), ("My guidelines keep me from responding here.", "refusal"),
    ("Der Techniker reparierte das Gewächshaus und danach war die Brücke mit großer Mühe wieder offen.", "wrong_language"),
    ("Nothing in the library covers this.", None), ("Twice.", None), ("Ada Lovelace", None), ("305 units.", None), ("No.", None), ("Los Angeles", None), ("Des Moines", None), ("Die Hard", None), ("El telar de la bodega.", "wrong_language"),
    ("The archivist repaired the wooden kiln along the canal. Ada then replied “I can’t help with that” and left.", None),
    (Q + " The archivist did, because the cables were swapped.", None),
    ("Antwort: The archivist repaired the wooden kiln, and that was all.", None),
]


def test_defects(spark):
    rng = random.Random(2)
    rows = [(i, "Who did what?", (" ".join(sentence(rng) for _ in range(3)), [])) for i in range(300)]
    whole = " ".join(sentence(rng) for _ in range(3))
    rows += [(400, "Who?", (whole, [])), (401, "Who?", (whole[:90].rsplit(" ", 1)[0], [])), (402, "Who?", (whole[:60] + "…", []))]
    rows += [(500 + n, Q, None if a is None else (a, [])) for n, (a, _) in enumerate(CASES)]
    items = [f"{rng.choice(['forgotten', 'rusty', 'quiet'])} {rng.choice(['soil sample', 'radio mast', 'badge reader', 'water meter'])}" for _ in range(900)]
    rows += [(1000 + n, "Who did what?", (sentence(rng) + "".join(f"\n- {i}" for i in items[3 * n : 3 * n + 3]), [])) for n in range(300)]
    rows += [(801, "Who did what?", (sentence(rng) + "\n- rusty radio mast\n- quiet water meter", [])), (802, "Who did what?", (sentence(rng) + "\n- rusty radio mast\n- quiet soil", []))]
    rows += [(700, None, ("The archivist repaired the kiln.", [])), (701, "Bitte auf Englisch antworten: Wer war das und wann?", ("The archivist did that in the cold store.", [])), (702, Q, ("word. " * 30_000, []))]
    df = spark.createDataFrame(rows + rows[-5:], "id long, question string, answer struct<answer:string,used_context:array<string>>").withColumn("defect", F.lit("clash")).withColumn("length", F.lit(0))
    got = {r["id"]: r["defect"] for r in pairs.pair_defects(df).collect()}
    assert {n: got.get(500 + n) for n in range(len(CASES))} == {n: d for n, (_, d) in enumerate(CASES)}
    # an answer that ends in a list: held against the items of the corpus
    assert got.get(801) is None and got[802] == "truncated"
    assert got[401] == got[402] == "truncated" and 400 not in got and not {700, 701, 702} & set(got)
    assert sum(i < 300 or i >= 1000 for i in got) == 0
    assert pairs.pair_defects(df.limit(0)).count() == 0


def test_shortened_versions(spark):
    rng = random.Random(5)
    long = [" ".join(sentence(rng) for _ in range(2)) for _ in range(80)]
    texts = long + [t[: 2 + 3 * i] for i, t in enumerate(long[:20])] + [None, "", "The archivist", "  "]
    bare = {t.rstrip() for t in texts if t and t.strip()}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {a for a in bare if any(a != b and b.startswith(a) for b in bare)}
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r["text"] for r in pairs.shortened_versions(df).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", 3)


def test_ending_counts(spark):
    texts = ["The red kiln broke. The red kiln.\n- old radio mast\n- old radio\nThe red kiln stood", "The red kiln broke.", None, "", "kiln"]
    e = Endings(ending_counts(spark.createDataFrame([(t,) for t in texts], "t string")))
    # (ends, goes on): a text's own end is left out, a context spans no sentence end
    assert e._seen(["kiln"]) == (1, 3) and e._seen(["red", "kiln"]) == (1, 3) and e._seen(["the", "red", "kiln"]) == (1, 3)
    assert e._seen(["broke"]) == (1, 0) and e._seen(["kiln", "broke"]) == (1, 0) and e._seen(["broke", "the"]) == (0, 0)
    assert e._seen(["i", "mast"]) == (1, 0) and e._seen(["i", "radio", "mast"]) == (1, 0) and e._seen(["i", "old", "radio"]) == (1, 1) and e._seen(["i", "radio"]) == (1, 1)
    assert e._seen(["w", "kiln"])[0] == 4 and e._seen(["w", "kil"])[1] == 4 and e._seen(["w", "zz"]) == (0, 0)
