import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import names as N

GROUPS = [
    ["Margaret Motamovir", "margaret motamovir", "Margaret MOTAMOVIR", "Margaret  Motamovir", "Margaret Mótamovir", "Motamovir, Margaret", "Motamovir Margaret", "Dr. Margaret Motamovir", "Margaret K. Motamovir", "M. Motamovir", "Motamovir, M.", "Peggy Motamovir", "Margaret “Peggy” Motamovir", "@margaretmotamovir", "Margaret Motamivor", "Margraet Motamovir"],
    ["Edward Roriruvan", "Ted Roriruvan", "E Roriruvan"],
    ["Alice Roriruvan"],
    ["Susan Daluskavar"],
    ["Henrik Daluskavar", "Henrik Dalukavar"],
    ["Quezinodus Networks GmbH", "Quezinodus Networks", "QUEZINODUS NETWORKS", "quezinodus networks", "QuezinodusNetworks", "Networks Quezinodus", "Quezinodus Netw.", "Quezinodus Ntworks GmbH", "The Quezinodus Networks GmbH", "Quezinodus"],
    ["Laltagilos Foods GmbH"],
    ["Laltagilos Systems Corp."],
    ["Applied Open Mountain Bureau", "Bureau of Applied Open Mountain", "AOMB", "Applied Open Moubtain Burreau", "App. Open Mount. Bureau", "Applied Open Mountain Bureau (AOMB)", "A.O.M.B."],
    ["Western Harbour Mapping Council", "WHMC"],
    ["LalytieangKit", "lalytieang-kit", "Lalytieangkit", "LALYTIEANGKIT", "LalyiteangKit", "Lalytieang Kit"],
    ["LalytieangGuard"],
]
KIND = {"G": "organization", "K": "software"}


def table(spark, groups, extra=()):
    rows, n = [], 0
    for g in groups:
        kind = "software" if "Kit" in g[0] or "Guard" in g[0] else "organization" if any(x in g[0] for x in ("GmbH", "Corp", "Bureau", "Council")) else "person"
        for i, name in enumerate(g):
            for _ in range(3 if i == 0 else 1):
                n += 1
                rows.append((n, name, kind, None if n % 2 else ["the team", ""]))
    rows += list(extra)
    return spark.createDataFrame(rows, "id long, name string, type string, aliases array<string>").withColumn("form", F.lit("clash")).withColumn("kind", F.lit("clash"))


def test_groups(spark):
    df = table(spark, GROUPS)
    found = {(r["name_a"], r["name_b"]) for r in N.spelling_pairs(N.name_classes(df.unionByName(df))).collect()}
    want = {tuple(sorted(p)) for g in GROUPS for p in ((a, b) for a in g for b in g if a < b)}
    assert found == want


def test_ambiguous_initials_and_aliases(spark):
    groups = [["Noor Betesasan", ], ["Nadia Betesasan"], ["N. Betesasan"]]
    assert N.spelling_pairs(N.name_classes(table(spark, groups))).count() == 0
    told = [(99, "N. Betesasan", "person", ["Noor Betesasan", "CEO"])]
    got = [tuple(r) for r in N.spelling_pairs(N.name_classes(table(spark, groups, told))).collect()]
    assert got == [("N. Betesasan", "Noor Betesasan")]


def test_dirty_rows(spark):
    extra = [(1, None, "person", None), (2, "", None, []), (3, "  ", "person", [None]), (4, "Port Lago", " City ", None), (5, "port lago", " City ", None), (6, "!!!", "person", None), (7, "".join(map(str, range(2000))), "person", None), (8, "Ann Lee", "person", ["Susan Daluskavar"])]
    got = [tuple(r) for r in N.spelling_pairs(N.name_classes(table(spark, [["Susan Daluskavar"]], extra))).collect()]
    assert got == []
    empty = spark.createDataFrame([], "id long, name string, type string, aliases array<string>")
    assert N.name_classes(empty).count() == 0


@pytest.mark.parametrize("a,b,d", [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abcd", "badc", 2), ("kitten", "sitting", 3), ("a", "abcdef", 3), ("amc", "aqc", 2), ("loom", "loon", 1)])
def test_edits(a, b, d):
    assert N.osa(a, b, 2) == min(d, 3)


def test_deletes_meet():
    # words within two edits share a deletion of up to two characters
    import random

    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcde") for _ in range(8))
        v = list(w)
        for _ in range(2):
            i = rng.randrange(len(v))
            op = rng.randrange(3)
            v[i : i + (op != 1)] = rng.choice("abcde") if op else ""
        v = "".join(v)
        if N.osa(w, v, 2) <= 2:
            assert N.deletes(w, 2) & N.deletes(v, 2)


def test_long_words():
    import random

    rng = random.Random(2)
    word = "".join(rng.choice("abcdefgh") for _ in range(4000))
    typo = word[:2000] + word[2001:]
    assert N.osa(word, typo, 2) == 1 and N.osa(word, word[::-1], 2) == 3
    assert N.deletes(word, 2) & N.deletes(typo, 2) and len(N.deletes(word, 2)) <= 10


def test_banded_edits_against_full():
    import random

    def full(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                x, y = a[i - 1], b[j - 1]
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (0 if x == y else 1 if (x, y) in N.CLOSE else 2))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abqs") for _ in range(rng.randint(0, 7))) for _ in "xy")
        assert N.osa(a, b, 2) == min(full(a, b), 3)


def test_slips_of_frequent_tokens():
    # the same slip of a frequent given name with several surnames stays a slip, at any size of the table
    for times in (1, 10, 100):
        assert N.align(["pateick", "motamovir"], ["patrick", "motamovir"], [5 * times, 4], [260 * times, 4], False, False, "person") == (True, False)
        assert N.align(["lars", "motamovir"], ["lara", "motamovir"], [9 * times, 4], [34 * times, 4], False, False, "person") == (False, False)


def test_slips_of_frequent_tokens_in_a_table(spark):
    import random

    rng = random.Random(4)
    surnames = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(63)]
    groups = [[f"Patrick {s.title()}", f"Pateick {s.title()}"] if i < 4 else [f"Patrick {s.title()}"] for i, s in enumerate(surnames)]
    found = {(r["name_a"], r["name_b"]) for r in N.spelling_pairs(N.name_classes(table(spark, groups))).collect()}
    assert found == {tuple(sorted(g)) for g in groups[:4]}


def test_ends_outlive_an_edit():
    import random

    rng = random.Random(5)
    for _ in range(3000):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(3, 12)))
        i = rng.randrange(len(w))
        v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcde") + w[i:], w[:i] + rng.choice("abcde") + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
        if len(v) >= 3:
            assert N._ends(w) & N._ends(v), (w, v)


def test_names_of_frequent_tokens_only(spark):
    # maria and schmidt are hot here, and slips and initials of both are found all the same
    import random

    rng = random.Random(6)
    other = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
    groups = [["Maria Schmidt", "Maria Schmdit", "Maria Schmit", "Maria Chmidt", "Aria Schmidt", "Mraia Schmdt", "M. Schmdit"]]
    groups += [[f"Maria {other()}"] for _ in range(45)] + [[f"{other()} Schmidt"] for _ in range(45)]
    groups = [g for g in groups if g[0] == "Maria Schmidt" or not (g[0].startswith("M") and g[0].endswith("Schmidt"))]
    found = {(r["name_a"], r["name_b"]) for r in N.spelling_pairs(N.name_classes(table(spark, groups))).collect()}
    assert found == {(a, b) for a in groups[0] for b in groups[0] if a < b}


def test_long_names(spark):
    groups = [
        ["International Federated Council Bureau of Mountain Harbour Mapping and Weather Records", "International Federated Council Bureau of Mountian Harbour Mapping and Weather Records", "Int. Federated Council Bureau of Mountain Harbour Mapping and Weather Records"],
        ["Western Harbour Mapping Council", "Estern Harbour Mapping Council"],
    ]
    found = {(r["name_a"], r["name_b"]) for r in N.spelling_pairs(N.name_classes(table(spark, groups))).collect()}
    assert found == {(a, b) for g in groups for a in g for b in g if a < b}
    import random

    rng = random.Random(9)
    for _ in range(30):
        costs = [[rng.choice([None, 0.0, 0.5, 1.0, 2.0]) for _ in range(7)] for _ in range(7)]
        totals = [sum(costs[i][j] for i, j in enumerate(p)) for p in N.permutations(range(7)) if all(costs[i][j] is not None for i, j in enumerate(p))]
        got = N._assign(costs)
        assert (got is None) == (not totals) and (got is None or sum(costs[i][j] for i, j in enumerate(got)) == min(totals))


def test_long_words_share_a_key_after_any_two_edits():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(300):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(N.LONG + 3, 90)))
        other = word
        for at in sorted(rng.sample(range(len(word)), 2), reverse=True):
            other = other[:at] + rng.choice(["", rng.choice(letters), rng.choice(letters) + other[at]]) + other[at + 1 :]
        assert N.deletes(word, 2) & N.deletes(other, 2)


def test_the_index_is_not_sent_through_the_driver(spark):
    rows = [(1, 7, False, False), (2, 7, False, True), (3, 7, True, False), (2, 8, True, True), (4, 8, True, False)]
    met = N._met(spark.createDataFrame(rows, "form long, key long, wide boolean, seeks boolean"))
    assert {tuple(r) for r in met.collect()} == {(1, 2), (2, 3), (2, 4)}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
