import json

from lectern.functions import entities as E

ONE = json.dumps({"name": " A ", "type": "agency", "aliases": ["x", " ", 3]})
GOOD = [{"name": "A", "type": "organization", "aliases": ["x"]}]


USABLE = [f"[{ONE}]", f"text [{ONE}] more", '{"entities": [%s]}' % ONE, '{"entity": [%s]}' % ONE, f"```json\n[{ONE}]\n```", f"```\n[{ONE}]\n```", f"Here:\n```json\n[{ONE}]\n```", ONE, f"as of [1]: [{ONE}]", f"[3, {ONE}, null, [], {{}}]"]
UNUSABLE = [None, "", " ", '{"entities":[]}', '[{"name":" "},3]', "[{]", "none", "[1, 2]", "```", "[" * 2000, '{"name": null}']


def test_responses(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(USABLE + UNUSABLE)], "i int, r string")
    got = {r["i"]: [e.asDict() for e in r["e"]] for r in df.select("i", E.entities_from_response("r").alias("e")).collect()}
    assert got == {i: GOOD if i < len(USABLE) else [] for i in range(len(USABLE + UNUSABLE))}


def test_unknown_types(spark):
    df = spark.createDataFrame([('[{"name":"a","type":"Gadget"},{"name":"b"},{"name":7,"type":"App"}]',)], "r string")
    assert [(e["name"], e["type"]) for e in df.select(E.entities_from_response("r")).first()[0]] == [("a", "Gadget"), ("b", "concept"), ("7", "software")]
    assert [e["name"] for e in df.select(E.entities_from_response("r", unknown_type="drop")).first()[0]] == ["7"]


def test_columns(spark):
    df = spark.createDataFrame([("agency",), ("App",), (" City ",), ("theme",), ("technique",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(E.entity_type("t")).collect()] == ["organization", "software", "location", "concept", None, None, None]
    rows = [('["a?"," b? ",3,""]',), ("- What?\nnot a question\n Why?",), ('{"q":1}',), (None,), ("\n".join(f"{i}?" for i in range(12)),)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(E.questions_from_response("t")).collect()]
    assert got[1] == ["What?", "Why?"] and got[2] == [] and len(got[4]) == 10
    assert got[0][:2] == ["a?", "b?"]
    shown = spark.createDataFrame([('["a","b"]',), ("raw",), (None,)], "t string").select(E.alias_display("t")).collect()
    assert [r[0] for r in shown] == ["a, b", "raw", ""]
    assert spark.createDataFrame([("a, ,b ",)], "t string").select(E.aliases_from_line("t")).first()[0] == ["a", "b"]
    parsed = spark.createDataFrame([(f"[{ONE}]",), (None,)], "t string").select(E.entities_from_response("t")).collect()
    assert parsed[0][0][0]["name"] == "A" and parsed[1][0] == []
