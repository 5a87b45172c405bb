import base64
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import encoding as E

CLEAN = {
    "fr": "L’été dernier, la régisseuse a oublié le carnet à côté de la fenêtre après la répétition",
    "de": "Während der Prüfung vergaß die Kuratorin das Gewächshaus mit großer Mühe",
    "es": "El capitán sustituyó la contraseña según dijo después del apagón el niño",
    "en": "The naïve café kiosk was “quiet” — the team’s estimate was revised",
}
CORPUS = " ".join(CLEAN.values()).lower()
TRAPS = [
    "Ã and Â are single letters", "A irmã pediu ATENÇÃO: a gravação NÃO ficou", "Лампа горела до самого утра", "Τα φώτα έμειναν αναμμένα ως αργά",
    "Zażółcona jaźń – tak brzmiał tytuł", "Đêm qua đèn vẫn sáng", "├── src\n│   └── log", "√(2·n) ± 0.5 µm, see ©-note ®", "Cost+tax: 4+AB- and R&D &amp; more",
    "古池や蛙飛びこむ水の音", "« une répétition »", "C++foo- and a+b", "caf&eacute;", "🙂 ok", "https://x.example/%C3%A9?a=b&copy=1",
]


@pytest.fixture(scope="module")
def restorer():
    from collections import Counter

    counts = Counter(E.WORD.findall(" ".join([CORPUS] * 60 + [t.lower() for t in TRAPS])))
    return E.Restorer(lambda w: counts.get(w, 0))


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("lang", sorted(CLEAN))
def test_round_trip_of_utf8_read_wrongly(restorer, lang, codec):
    table = {v: k for k, v in E._byte_of(codec).items()}
    bad = "".join(chr(b) if b < 128 else table[b] for b in CLEAN[lang].encode())
    fixed, n = restorer.text(bad)
    assert n and fixed == CLEAN[lang]


@pytest.mark.parametrize("lang", sorted(CLEAN))
def test_read_wrongly_twice(restorer, lang):
    table = {v: k for k, v in E._byte_of("cp1252").items()}
    bad = CLEAN[lang]
    for _ in range(2):
        bad = "".join(chr(b) if b < 128 else table[b] for b in bad.encode())
    fixed, n = restorer.text(bad)
    assert n and fixed == CLEAN[lang]


@pytest.mark.parametrize("lang", sorted(CLEAN))
def test_swapped_bytes_and_seven_bit(restorer, lang):
    swapped = CLEAN[lang].encode("utf-16-le").decode("utf-16-be", "surrogatepass")
    assert restorer.text(swapped) == (CLEAN[lang], restorer.text(swapped)[1]) and restorer.text(swapped)[1]
    seven = "".join(c if ord(c) < 128 else "+" + base64.b64encode(c.encode("utf-16-be")).decode().rstrip("=") + "-" for c in CLEAN[lang])
    fixed, n = restorer.text(seven)
    assert n and fixed == CLEAN[lang]


@pytest.mark.parametrize("read,lang", [("cp1251", "fr"), ("mac_roman", "de"), ("mac_roman", "fr"), ("cp437", "es")])
def test_western_bytes_in_another_table(restorer, read, lang):
    table = {v: k for k, v in E._byte_of(read).items()}
    bad = "".join(c if ord(c) < 128 else table[c.encode("cp1252")[0]] for c in CLEAN[lang])
    fixed, n = restorer.text(bad)
    assert n and fixed == CLEAN[lang]


@pytest.mark.parametrize("lang", ["de", "es", "fr"])
def test_lost_bytes(restorer, lang):
    bad = "".join(c if ord(c) < 128 or c == "’" else "�" for c in CLEAN[lang])
    fixed, n = restorer.text(bad)
    same = sum(a == b for a, b in zip(fixed.split(), CLEAN[lang].split()))
    assert n and same >= 0.85 * len(CLEAN[lang].split())


@pytest.mark.parametrize("text", [*TRAPS, *CLEAN.values()])
def test_correct_text_stays(restorer, text):
    assert restorer.text(text) == (text, 0)


def test_operator(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(list(CLEAN.values()))) for i in range(40)] + [(100, CLEAN["fr"].encode().decode("latin-1")), (100, CLEAN["fr"].encode().decode("latin-1")), (101, None), (102, ""), (103, TRAPS[0]), (104, "ok " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lost", F.lit(1)).withColumn("restored", F.lit("x"))
    got = E.restore_encoding(df).collect()
    assert [r["doc_id"] for r in got] == [100, 100] and {r["restored"] for r in got} == {CLEAN["fr"]} and got[0]["lost"] == 0
    assert E.restore_encoding(df.limit(0)).count() == 0


def test_word_counts(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("B",)], "t string")
    f = E.Frequencies(E.word_frequencies(df, "t", bits=10))
    assert (f("a"), f("b")) == (2, 2)


def test_lost_letters_come_from_words_of_the_corpus():
    # the right word is in the table: it is found, at any number of other words; otherwise the sign for a lost letter stays
    known = {w: 50 for w in "überprüfung señalización élève répétition größe übung eberprefung".split()} | {"für": 900, "fur": 3}
    r = E.Restorer(lambda w: known.get(w, 0))
    for bad, good in [("�berpr�fung", "überprüfung"), ("�berpr�fung,", "überprüfung,"), ("se�alizaci�n", "señalización"), ("R�p�tition", "Répétition"), ("gr��e", "größe"), ("gr����e", "größe"), ("�bung", "übung"), ("l’�l�ve", "l’élève"), ("l��l�ve", None), ("f�r", "für")]:
        fixed, n = r.text(bad)
        assert n == 1 and (fixed == good if good else "�" in fixed or fixed == "l’élève"), (bad, fixed)
    for unknown in ("qu�rz�x", "b�d", "z�z�z�z"):
        assert r.text(unknown) == (unknown, 1)


def test_restored_equals_the_original_on_planted_damage(spark):
    # sentences of a corpus, damaged in known ways; what is restored is compared with what was there
    rng = random.Random(9)
    words = " ".join(CLEAN.values()).split()
    sentences = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(400)]
    table = {c: {v: k for k, v in E._byte_of(c).items()} for c in ("cp1252", "mac_roman", "cp437")}

    def damage(text, how):
        if how == "lost":
            return "".join(c if ord(c) < 128 or rng.random() < 0.4 or c in "“”—" else "�" for c in text)
        return "".join(chr(b) if b < 128 else table[how][b] for b in text.encode())

    planted = [(1000 + i, damage(s, how), s) for i, (s, how) in enumerate(zip(rng.sample(sentences, 200), ["cp1252", "mac_roman", "cp437", "lost"] * 50))]
    planted = [p for p in planted if p[1] != p[2]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sentences)] + [p[:2] for p in planted], "doc_id long, text string")
    got = {r["doc_id"]: r for r in E.restore_encoding(df).collect()}
    assert set(got) == {p[0] for p in planted}
    whole = [p for p in planted if got[p[0]]["lost"] == 0]
    assert len(whole) >= 0.95 * len(planted)
    assert sum(got[i]["restored"] == s for i, _, s in whole) >= 0.99 * len(whole)
