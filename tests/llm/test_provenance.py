"""Files nobody wrote by hand, on a small made corpus."""

import random

from orelode.llm import provenance as p

SCHEMA = "file_id bigint, path string, language string, content string, labelled string"


def hand(r):
    w = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 9)))
    return "\n".join(f"def {w()}_{w()}({w()}, {w()}):\n    # {w()} {w()} the {w()}\n    {w()} = {w()}.get(\"{w()}\")\n    if {w()} > {r.randint(1, 99)}:\n        return {w()}({w()})\n    return None\n" for _ in range(r.randint(3, 8)))


def made(r):
    w = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    return "class Stub:\n" + "\n".join(f"    def get_{x}(self):\n        return self._d['{x}']\n\n    def set_{x}(self, v):\n        self._d['{x}'] = v\n" for x in (w() for _ in range(r.randint(8, 16))))


def test_forest_finds_generated_files_without_their_notice(spark):
    r = random.Random(3)
    rows = [(i, f"src/a{i}.py", "python", hand(r), "c") for i in range(300)]
    rows += [(1000 + i, f"src/b{i}.py", "Python", ("# Code generated by stubs. DO NOT EDIT.\n" if i % 2 else "") + made(r), "c") for i in range(80)]
    release = hand(random.Random(99))
    rows += [(2000, "lib/x.py", "python", release, "c"), (2001, "lib/y.py", "python", "X = [\n" + ",\n".join(f'    ("{k * 7919 % 1000}", {k}.5)' for k in range(200)) + "]\n", "c")]
    rows += [(3000, "a.py", "python", None, "c"), (3001, "b.py", "python", " \n", "c"), (3002, "c.png", "other", "x", "c"), (3003, None, "python", "note = 'do not edit, generated by hand'\n", "c"), (1, "src/a1.py", "python", rows[1][3], "c")]
    got = p.find_unwritten(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(release,), (None,)], "content string")).collect()
    found = [x["file_id"] for x in got if x["unwritten"]]
    assert len(got) == 384 and {2000, 2001} <= set(found)
    assert sum(1000 <= x < 1080 for x in found) >= 76 and sum(x < 1000 or x >= 3000 for x in found) <= 3


def test_notices_are_seen_and_cut_away():
    for text in ("# @generated by x\nimport a\n", "import a\n# Autogenerated with x. Do not modify by hand!\n", "// AUTOMATISCH ERZEUGT von x\nimport a\n", "a()\n//# sourceMappingURL=a.js.map\n"):
        noticed, body = p.split_notice(text)
        assert noticed and "enerat" not in body and "ERZEUGT" not in body and "source" not in body
    for text in ("x = 'do not edit'\n# about generated ids\n", "# Copyright the team\n# Internal use only\nimport a\n", ""):
        assert not p.split_notice(text)[0]


def test_no_label_and_empty(spark):
    df = spark.createDataFrame([(1, "a.py", "python", "a = 1", "c")], SCHEMA)
    none = spark.createDataFrame([], "content string")
    assert [x["unwritten"] for x in p.find_unwritten(df, none).collect()] == [False]
    assert p.find_unwritten(df.limit(0), none).count() == 0
