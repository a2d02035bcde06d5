"""Core operators on small made tables: nulls, ties, repeats, empty tables, extra columns, long texts."""

import random
import time
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from orelode.functions import paths, text
from orelode.operators import chunks, findings, pysource, retrieval, rules, scoring
from orelode.plans import finding_queries, retrieval_queries, source_queries
from orelode.sources import archives
from orelode.streaming import limits


def one(spark, expression, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in values.items())).select(expression.alias("x")).first()["x"], names


@pytest.mark.parametrize("path, safe", [("a/b.py", True), ("../a", False), ("a/../../b", False), ("/a", False), ("C:\\a", False), ("c:/a", False), ("a/" * 19 + "b", True), ("a/" * 20 + "b", False), ("a\\..\\b", False), ("a..b/c", True)])
def test_unsafe_paths(spark, path, safe):
    assert one(spark, ~paths.unsafe(F.col("p")), p=path)[0] is safe


@pytest.mark.parametrize("path, language", [("a/b.PY", "python"), (".py", "other"), ("x.test.tsx", "typescript"), ("Makefile", "other"), ("a.d/b", "other"), ("h.hpp", "cpp")])
def test_language_by_extension(spark, path, language):
    assert one(spark, paths.language(F.col("p")), p=path)[0] == language


def test_path_predicates(spark):
    rows = [("tests/a.py",), ("src/test_a.py",), ("a_test.py",), ("b.spec.ts",), ("contest.py",), ("x/package.json",), ("Dockerfile",), (".github/workflows/ci.yml",), ("node_modules/x/a.js",), (None,)]
    got = spark.createDataFrame(rows, "p string").select("p", paths.is_test(F.col("p")).alias("t"), paths.is_config(F.col("p")).alias("c"), paths.is_deployment(F.col("p")).alias("d"), paths.ignored_part(F.col("p")).alias("i")).collect()
    assert [r["p"] for r in got if r["t"]] == [r[0] for r in rows[:4]]
    assert [r["p"] for r in got if r["c"]] == ["x/package.json"] and [r["p"] for r in got if r["d"]] == ["Dockerfile", ".github/workflows/ci.yml"]
    assert [r["i"] for r in got if r["i"]] == ["node_modules"]


def test_archives_round_trip_and_admission(spark, tmp_path):
    def make(name, entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, body in entries:
                z.writestr(n, body)

    make("good.zip", [("top/a.py", "x = 1\n"), ("top/b/c.js", "let é")])
    make("bad.zip", [("../a.py", "x")])
    make("twice.zip", [("a.py", "1"), ("./a.py", "2")])
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    entries = archives.read_archives(spark, str(tmp_path)).withColumn("archive", F.regexp_extract("archive", "[^/]*$", 0)).cache()
    assert {r["archive"]: r["reason"] for r in archives.admission(entries).collect()} == {"good.zip": None, "bad.zip": "unsafe path", "twice.zip": "duplicate path"}
    assert [r["error"] for r in entries.where("archive = 'broken.zip'").collect()] == ["no readable archive"]
    assert {r["archive"]: r["prefix"] for r in archives.common_top(entries.where("name is not null"), "archive", "name").collect()}["good.zip"] == "top/"
    files = spark.createDataFrame([("p", "a.py", "x"), ("p", ".git/b", "y"), ("p", "c.env", "z"), ("p", "../d", "z"), ("q/../r", "e.py", None)], "project_id string, path string, content string")
    (tmp_path / "out").mkdir()
    got = {r["project_id"]: (r["archive"], r["files"]) for r in archives.write_archives(files, str(tmp_path / "out")).collect()}
    assert got["p"][1] == 1 and zipfile.ZipFile(got["p"][0]).namelist() == ["a.py"] and got["q/../r"][0].startswith(str(tmp_path / "out"))
    assert archives.admission(entries.limit(0)).count() == 0


def test_dependencies(spark):
    rows = [("p", "requirements.txt", 1, "a==1 # x\n\n-r b.txt\n--flag\nA==2\nc\n!!"), ("p", "w/package.json", 2, '{"dependencies": {"k": "^1"}, "devDependencies": {"k": "2"}}'), ("p", "package.json", 3, "{broken"), ("p", "x/requirements.txt", 4, None)]
    got = {(r["name"], r["version"], r["source"]) for r in archives.dependencies(spark.createDataFrame(rows, "project_id string, path string, file_ord int, content string")).collect()}
    assert got == {("a", "==1", "requirements.txt"), ("c", "", "requirements.txt"), ("k", "^1", "w/package.json:dependencies"), ("k", "2", "w/package.json:devDependencies")}


def test_upsert_keeps_creation(spark):
    old = spark.createDataFrame([("a", 1, "x", "t0"), ("b", 1, "y", "t0")], "rule_id string, version int, body string, created_at string")
    new = spark.createDataFrame([("a", 1, "z", "t1"), ("c", 1, "w", "t1"), ("c", 1, "w", "t1")], "rule_id string, version int, body string, created_at string")
    after, counts = archives.upsert(old, new, ["rule_id", "version"])
    assert {(r["rule_id"], r["body"], r["created_at"]) for r in after.collect()} == {("a", "z", "t0"), ("b", "y", "t0"), ("c", "w", "t1")}
    assert tuple(counts.first()) == (1, 1)


def test_repository_names(spark):
    for said, want in (("https://github.com/a/b.git", "a/b"), ("a/b", "a/b"), ("github.com/a/b/", "a/b"), ("a b", None), ("", None)):
        assert one(spark, archives.repository(F.col("t")), t=said)[0] == want


def test_every_rule_finds_its_case_only(spark):
    rows, want = [], set()
    for k, r in enumerate(rules.RULES):
        yes, no = finding_queries.CASES[r.key]
        rows += [(k, r.languages[0], "\n\n" + yes + "\n", "c"), (1000 + k, r.languages[0], no, "c")]
        want.add((k, r.name))
    rows += [(5000, "python", None, "c"), (5001, "python", "", "c")]
    got = {(r["id"], r["rule"]) for r in rules.scan(spark.createDataFrame(rows, "id int, language string, content string, line string").drop("line"), ["id"]).collect()}
    assert want <= got and not {(k, r) for k, r in got if k >= 1000 and r == rules.RULES[k - 1000].name}
    precision = len(want) / len({(k, r) for k, r in got if k < 1000} | want)
    assert precision > 0.8


def test_rule_lines_and_scale(spark):
    body = "x = 1\n" * 50_000 + "password = 'zq81xkd0'\n" + "y = 2\n" * 50_000
    df = spark.createDataFrame([(1, "python", body)], "id int, language string, content string")
    secret = (rules.RULES[0],)
    rules.scan(df, ["id"], secret).collect()
    t = time.time()
    assert [r["line"] for r in rules.scan(df, ["id"], secret).collect()] == [50_001]
    assert time.time() - t < 5


def test_merge_near_follows_the_moving_line(spark):
    rows = [("f", 10, "sql_concat", "deterministic_pattern", 1), ("f", 12, "sql_injection", "ast_source_sink", 2), ("f", 14, "sql_concat", "deterministic_pattern", 3), ("f", 15, "sql_concat", "deterministic_pattern", 4), ("f", None, "ssrf", "x", 5), ("g", 10, "todo_marker", "x", 6), ("g", 10, "todo_marker", "x", 7)]
    df = spark.createDataFrame([("p", *r) for r in rows], "project_id string, file string, line int, rule string, evidence_type string, emit_ord int")
    got = sorted((r["file"], r["line"] or 0, r["rule"]) for r in findings.merge_near(df, ["project_id"], "emit_ord").collect())
    assert got == [("f", 0, "ssrf"), ("f", 12, "sql_injection"), ("f", 15, "sql_concat"), ("g", 10, "todo_marker"), ("g", 10, "todo_marker")]
    assert findings.merge_near(df.limit(0), ["project_id"], "emit_ord").count() == 0


def test_stable_id_ignores_spacing_and_case(spark):
    rows = [("r", "f", 1, " A  b"), ("r", "f", 1, "a B "), ("r", "f", 2, "a b"), (None, None, None, None)]
    ids = [r["x"] for r in spark.createDataFrame(rows, "r string, f string, l int, e string").select(findings.stable_id(F.col("r"), F.col("f"), F.col("l"), F.col("e")).alias("x")).collect()]
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 24 for i in ids)


def test_gate(spark):
    rows = [("hardcoded_secret", "f", 1), ("todo_marker", "f", 1), ("sql_concat", "", 1), ("sql_concat", "f", 0), ("sql_concat", None, None), (None, "f", 1), ("ssrf_untrusted_url", "f", 3)]
    got = [(r["rule"], r["rule_id"], r["cwe"]) for r in findings.gate(spark.createDataFrame(rows, "rule string, file string, line int")).collect()]
    assert got == [("hardcoded_secret", "SEC-HARDCODED-SECRET", "CWE-798"), ("ssrf_untrusted_url", "SEC-SSRF", "CWE-918")]


def test_band_join_equals_brute_force(spark):
    r = random.Random(1)
    a = [(i, r.choice("fg"), r.randrange(60)) for i in range(120)]
    b = [(i, r.choice("fg"), r.randrange(60)) for i in range(120)]
    got = {(x["i"], x["j"]) for x in findings.near_pairs(spark.createDataFrame(a, "i int, file string, line int"), spark.createDataFrame(b, "j int, file string, line int"), ["file"], 2).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) <= 2}


def test_scores(spark):
    projects = spark.createDataFrame([("p",), ("empty",), ("p",)], "project_id string")
    files = spark.createDataFrame([("p", "src/a.py", "time.sleep(1)"), ("p", "b.py", None)], "project_id string, path string, content string")
    ends = spark.createDataFrame([("p",)] * 5, "project_id string")
    issues = spark.createDataFrame([("p", "security", "critical")] * 5 + [("p", "performance", "odd"), ("p", None, "high"), ("q", "security", "low")], "project_id string, category string, severity string")
    s = scoring.score(projects, scoring.project_facts(files, ends), issues)
    got = {(r["project_id"], r["dimension"]): (r["score"], r["status"], r["finding_count"]) for r in s.collect()}
    assert got["p", "security"] == (0, "evaluated", 5) and got["p", "architecture"] == (85, "evaluated", 1) and got["p", "api_design"] == (80, "evaluated", 1)
    assert got["p", "performance"] == (90, "evaluated", 2) and got["p", "testing"] == (60, "evaluated", 1) and got["p", "production_readiness"] == (70, "evaluated", 2)
    assert got["empty", "security"] == (None, "not_evaluated", 0) and len(got) == 14
    o = {r["project_id"]: r["overall_score"] for r in scoring.overall(s).collect()}
    assert o["empty"] is None and abs(o["p"] - (0 * 20 + 100 * 20 + 85 * 15 + 60 * 15 + 80 * 10 + 90 * 10 + 70 * 10) / 100) < 0.06


def test_import_graph_and_neighbours(spark):
    f = spark.createDataFrame([("p", x) for x in ("app/a.py", "app/b.py", "app/c/__init__.py", "web/x.ts", "web/lib/index.ts", "web/y.ts")], "project_id string, path string")
    i = spark.createDataFrame([("p", "app/a.py", "app.b"), ("p", "app/a.py", "c"), ("p", "app/a.py", "os"), ("p", "web/x.ts", "./lib"), ("p", "web/x.ts", "../web/y"), ("p", "web/x.ts", "./x"), ("p", "app/b.py", ".a"), ("q", "app/a.py", "app.b")], "project_id string, file string, module string")
    e = retrieval.import_edges(f, i)
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("app/a.py", "app/b.py"), ("app/a.py", "app/c/__init__.py"), ("web/x.ts", "web/lib/index.ts"), ("web/x.ts", "web/y.ts"), ("app/b.py", "app/a.py")}
    n = {(r["path"], r["related"]): r["hop"] for r in retrieval.neighbours(e, 2).collect()}
    assert n["app/b.py", "app/c/__init__.py"] == 2 and n["web/y.ts", "web/lib/index.ts"] == 2 and ("app/a.py", "app/a.py") not in n


def test_path_mentions_equal_brute_force(spark):
    r = random.Random(7)
    made = lambda n: "".join(r.choice("abA_é/. -𝒳😀\n") for _ in range(r.randrange(n)))
    files = [(r.choice("pq"), made(9)) for _ in range(150)] + [("p", None), (None, "a"), ("p", "readme"), ("p", "README"), ("p", "a/b"), ("q", "."), ("q", "/.env"), ("p", "b")]
    texts = [(r.choice("pqr"), i % 90, made(40)) for i in range(120)] + [("p", 1, None), (None, 2, "a"), ("p", 500, "see xReadMe"), ("p", 501, "aa/bb"), ("q", 502, "x/.env"), ("q", 503, "b" * 3000)]
    want = {(p, i, f) for p, i, t in texts for q, f in files if p and p == q and t and f and f.lower() in t.lower()}
    got = retrieval.path_mentions(spark.createDataFrame(texts, "project_id string, issue_id int, text string"), spark.createDataFrame(files + files[:20], "project_id string, path string"), ["issue_id"]).collect()
    assert len(got) == len(want) > 200 and {tuple(x) for x in got} == want


def test_path_mentions_of_a_large_project(spark, tmp_path):
    n = 40_000
    path = F.concat(F.lit("src/m"), (F.col("id") % 97).cast("string"), F.lit("/part_"), F.col("id").cast("string"), F.lit(".py"))
    spark.range(n).select(F.col("id").alias("file_id"), F.lit("p").alias("project_id"), F.col("id").cast("int").alias("file_ord"), path.alias("path"), F.lit("x").alias("content")).write.parquet(f"{tmp_path}/files.parquet")
    spark.range(n).select(F.col("id").alias("issue_id"), F.lit("p").alias("project_id"), F.lit("The value reaches the log without a check.").alias("issue"), path.alias("file")).write.parquet(f"{tmp_path}/issues.parquet")
    t = time.time()
    assert retrieval_queries.QUERIES["s23_path_mentions"](spark, str(tmp_path)).count() == n
    assert time.time() - t < 45


def test_grounding_and_patches(spark):
    src = "def total_sum(a):\n    return a + 1\n"
    for line, quote, source, want in ((1, "return  A + 1", "ai_quality", None), (9, "x", "ai_quality", "line_out_of_range"), (1, "", "ai_quality", "no_evidence"), (1, None, "deterministic", None), (1, "uses overSpend", "ai_quality", "unknown_identifier"), (None, "plain words only", "ai_quality", None), (3, "x", "y", "line_out_of_range")):
        df = spark.createDataFrame([(src, line, quote, source)], "c string, l int, q string, s string")
        assert df.select(text.grounding(*map(F.col, "clqs")).alias("x")).first()["x"] == want
    for content, original, fixed, want in (("aXb", "X", "Y", "aYb"), ("aXbX", "X", "Y", None), ("aaa", "aa", "b", None), ("x\r\ny", "y", "a\nb", "x\r\na\r\nb")):
        df = spark.createDataFrame([(content, original, fixed)], "c string, o string, f string")
        assert df.select(text.patched(*map(F.col, "cof")).alias("x")).first()["x"] == want


def test_unified_diff(spark):
    from orelode.operators.diffs import unified

    rows = [(1, "a\nb\n", "a\nc\n"), (2, "a", "a"), (3, None, "x\n")]
    got = {r["k"]: r["diff"] for r in unified(spark.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b").collect()}
    assert "-b\n+c\n" in got[1] and got[2] == "" and "+x\n" in got[3]


def test_python_rules_and_flows():
    found = missed = 0
    for rule, (yes, line, no) in source_queries.CASES.items():
        hits = {(r[1], r[2]) for r in pysource.read(yes) if r[0] in ("rule", "flow")}
        found += (rule, line) in hits
        missed += rule in {r[1] for r in pysource.read(no) if r[0] in ("rule", "flow")}
    assert found == len(source_queries.CASES) and missed == 0
    assert pysource.read("def f(:")[0][0] == "error" and pysource.read("\0")[0][0] == "error"


def test_flow_semantics():
    def sinks(body):
        return [r[1] for r in pysource.read("from flask import request\nimport os\n" + body) if r[0] == "flow" and r[1] == "command_injection"]

    assert sinks("r = request\nx = r.args['a']\nos.system(x)\n") and sinks("x = request.args['a']\ny = f'{x}'\nos.system(y)\n")
    assert not sinks("x = request.args['a']\nx = 'b'\nos.system(x)\n") and not sinks("x = validate_it(request.args['a'])\nos.system(x)\n")
    assert sinks("def validate_it(v):\n    return v\nx = validate_it(request.args['a'])\nos.system(x)\n")
    assert not sinks("x = request.args['a']\nif not is_valid_name(x):\n    raise E\nos.system(x)\n")
    assert sinks("for x in request.json['a']:\n    os.system(x)\n") and sinks("def g(v):\n    return 'a' + v\nos.system(g(request.form['x']))\n")


def test_taint_of_a_long_file():
    body = "from flask import request\nimport os\n" + "".join(f"v{i} = {i}\n" for i in range(5000)) + "os.system(request.args['a'])\n"
    t = time.time()
    assert any(r[0] == "flow" for r in pysource.read(body)) and time.time() - t < 2


def test_line_packs(spark):
    lines = ["x" * 40] * 10 + ["y" * 500] + ["z"] * 3
    got = [tuple(p) for p in spark.createDataFrame([(lines,), ([],)], "ls array<string>").select(chunks.packs(F.col("ls"), 100).alias("p")).collect()[0]["p"]]
    assert got == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 11), (12, 14)]


def test_chunks_cover_nested_symbols(spark):
    s = spark.createDataFrame([(1, "C", 3, 10), (1, "m", 4, 6), (1, "f", 12, 12), (1, "f", 12, 12), (1, "x", None, 3), (1, "y", 9, 2)], "file_id int, name string, start_line int, end_line int")
    got = sorted((r["start_line"], r["end_line"], r["name"]) for r in chunks.spans(chunks.cover(s), spark.createDataFrame([(1, 20), (2, 3)], "file_id int, lines int")).where("file_id = 1").collect())
    assert got == [(1, 2, "module"), (3, 10, "C"), (11, 11, "module"), (12, 12, "f"), (13, 20, "module")]


def test_rate_limit_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, r.choice([1, 1, 2, None]), r.randrange(300)) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {x["event_id"]: x["accepted"] for x in limits.allowed(df, 5, 60).collect()}
    want = {}
    for u in (1, 2):
        seen: deque = deque()
        for i, _, s in sorted((x for x in rows if x[1] == u), key=lambda x: (x[2], x[0])):
            want[i] = limits.decide(seen, s, 5, 60)
    assert got == want and not all(got.values())


def test_entry_and_queries():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and "s24_scores" in q and len(q) > 150
