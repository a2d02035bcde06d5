"""Places of credentials, what is none, and masked texts. All secrets are invented."""

import base64
import random
import string

import pytest

from orelode.llm import credentials as c

RAND = "".join(random.Random(7).choices(string.ascii_letters + string.digits, k=40))
GH = "gh" + "p_" + RAND[:36]
BODY = "\n".join(RAND + RAND[:24] for _ in range(3))
PEM = f"-----BEGIN RSA PRIVATE KEY-----\n{BODY}\n-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize("path, text, line", [
    ("a.py", 'x = 1\nDB_PASSWORD = "harbor-copper-lane42"\n', 2),
    ("a.py", f"# curl -H 'Authorization: Bearer {RAND}' /x\n", 1),
    ("a.py", "# old login, password=Copper#lane4242 for now\n", 1),
    ("a.js", f"const k = '{GH}';", 1),
    ("a.js", f"const h = {{ 'X-Api-Key': '{RAND}' }};", 1),
    ("a.js", f"const t = process.env.APP_TOKEN || '{RAND}';", 1),
    ("a.ts", "let dsn = 'redis://svc:Copper.lane42@cache.internal.example:6379/q';", 1),
    ("a.cpp", 'auto c = connect("app", /* password */ "copper-lane-harbor7");', 1),
    ("a.cpp", 'auto s = "Server=db;Uid=app;Pwd=Copper_lane42;";', 1),
    ("a.js", "run('login --user app --password f4TeyKW4Cx.k');", 1),
    ("a.py", f"\nKEY = '''{PEM}'''\n", 2),
    ("a.py", 'v = "' + base64.b64encode(f"token={GH}".encode()).decode() + '"', 1),
    ("a.py", 'h = "Basic ' + base64.b64encode(b"app:Copper-lane42").decode() + '"', 1),
    ("a.py", 'r = get(u, auth=("app", "Copper-lane42"))', 1),
    ("b/.env.example", "A=1\nexport TOKEN=" + RAND, 2),
    ("Dockerfile", "FROM x\nENV API_KEY " + RAND, 2),
    ("r.yaml", "- key: ADMIN_PASSWORD\n  value: copper-lane42\n", 2),
    ("p.xml", "<passwd>Copper-lane42</passwd>", 1),
])
def test_found_and_masked(path, text, line):
    assert c.lines_of(text, path) == [line]
    hidden = c.mask(text, path)
    assert len(hidden) == len(text) and hidden.count("\n") == text.count("\n")
    assert not any(x in hidden for x in (GH, RAND, "opper", "f4Te")) and c.lines_of(hidden, path) in ([], [line] if "BEGIN" in text else [])


@pytest.mark.parametrize("path, text", [
    ("a.py", 'password = os.environ["DB_PASSWORD"]\ntoken = prompt_secret(name="token_1")'), ("a.py", '# example: api_key=YOUR_KEY_HERE\n# Authorization: Bearer <token>'),
    ("a.js", "const separatorToken = 'BEGIN_BLOCK1';\nconst passwordLabel = 'X-Api-Key2';"), ("a.py", 'PUBLIC_KEY = "-----BEGIN PUBLIC KEY-----\\n' + RAND + '\\n"'),
    ("a.js", f"const contentSha256 = '{'3fa9' * 16}';\nconst id = 'e7cc09e5-11e2-4bb0-ad21-626f58788b47';"), ("a.cpp", 'auto u = "postgres://user:password@host:5432/name";'),
    (".env", "TOKEN=changeme\nSECRET=${SECRET1}\nKEY=\nPASSWORD=xxxxxxxx"), ("a.js", f"const logo = 'data:image/png;base64,{RAND}{RAND}';"), ("a.py", None), ("a.py", ""),
])
def test_nothing_found(path, text):
    assert c.lines_of(text, path) == [] and c.mask(text, path) == text


def test_queries(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(1, "a.py", f'k = "{GH}"\nx = 1\ny = "{GH}"\n'), (2, "a.py", None), (3, "a.py", "x = 1\r\n")]
    spark.createDataFrame(rows, "file_id bigint, path string, content string").write.parquet(f"{tmp_path}/files.parquet")
    assert sorted(map(tuple, queries()["p5_found"](spark, str(tmp_path)).collect())) == [(1, 1), (1, 3)]
    assert dict(map(tuple, queries()["p5_redacted"](spark, str(tmp_path)).collect())) == {i: t and t.replace(GH, "*" * 40) for i, _, t in rows}
