"""Catalogue rules: every match of a rule's pattern in a text, with its line and evidence.

The catalogue is data: rule, languages, severity, category, pattern, guards. One pass tests every rule of a file's language; only files and
rules that hit are expanded, then matches are cut out with ``split`` and ``regexp_extract_all``, whose pieces give the place of each match.
All of it stays in the JVM. Guards look at the surroundings of one match: placeholder values, comments, strings, words nearby.

Defined cases: null contents yield nothing; an empty text is scanned; a text of any length is scanned whole; matches may
cross lines and have the line they begin on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.session import spread

PY, JS, ANY = ("python",), ("javascript", "typescript"), ("python", "javascript", "typescript", "java", "cpp", "other")


@dataclass(frozen=True)
class Rule:
    name: str
    languages: tuple[str, ...]
    severity: str
    category: str
    pattern: str
    guards: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        """The name, with the languages where several rows share a name."""
        return self.name if self.languages == ANY else f"{self.name}_{'py' if self.languages == PY else 'js'}"


# The rules with their patterns.
RULES = (
    Rule("hardcoded_secret", ANY, "critical", "security", r"""(?i)(password|secret(?:[_-]?key)?|api[_-]?key|token)\s*=\s*['"]([^'"]{4,})['"]""", ("real_value", "no_sample", "python_code")),
    Rule("dangerous_eval", PY, "critical", "security", r"\b(eval|exec)\s*\(", ("code",)),
    Rule("dangerous_eval", JS, "critical", "security", r"\beval\s*\(", ("code",)),
    Rule("empty_exception_handler", PY, "medium", "best_practice", r"(?m)^\s*except\s*:\s*$"),
    Rule("empty_exception_handler", JS, "medium", "best_practice", r"catch\s*\([^)]*\)\s*\{\s*\}"),
    Rule("sql_concat", ANY, "critical", "security", r"""(?i)(select|insert|update|delete)\b(?:[^"'\n]*(?:["'][^"'\n]*\+|\{[^{}"'\n]*\}[^"'\n]*["'])|[^\n]*\{[^{}\n]+\})""", ("sql_sink",)),
    Rule("subprocess_shell_true", JS, "high", "security", r"\b(?:child_process|childProcess|cp)\s*\.\s*(?:exec|execSync)\s*\(|\brequire\(['\"]child_process['\"]\)\s*\.\s*(?:exec|execSync)\s*\(", ("code",)),
    Rule("spawn_shell_true", JS, "high", "security", r"\bspawn(?:Sync)?\s*\([^()]*\bshell\s*:\s*true", ("code",)),
    Rule("tls_verification_disabled", JS, "high", "security", r"""NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0""", ("code",)),
    Rule("unsafe_deserialization", JS, "high", "security", r"node-serialize|\bunserialize\s*\("),
    Rule("todo_marker", ANY, "low", "best_practice", r"(?i)#\s*(TODO|FIXME)|//\s*(TODO|FIXME)"),
    Rule("insecure_auth_cookie", JS, "high", "security", r"""(?i)\b(?:res|response)\.cookie\s*\(\s*['"]([^'"]*(?:auth|session|token|jwt)[^'"]*)['"]\s*,[^,{}]+\s*,\s*\{([^{}]*)\}""", ("code", "open_cookie")),
    Rule("nosql_untrusted_filter", JS, "high", "security", r"((?:\b(?:db|mongo|mongoose)\b(?:\.[A-Za-z_$][\w$]*)+|\b[A-Z][A-Za-z0-9_$]*\b|\b[A-Za-z_$][\w$]*(?:Collection|Model)\b))\.(find|findOne|findMany|findOneAndUpdate|updateOne|updateMany|deleteOne|deleteMany)\s*\(\s*((?:req|request)\.(?:body|query))\b", ("code",)),
    Rule("unsafe_archive_extract", JS, "high", "security", r"\bextractAllTo\s*\([^)]*(req\.|request\.)"),
    Rule("ssrf_untrusted_url", JS, "high", "security", r"\b(?:fetch|got|request|axios(?:\.(?:get|post|put|patch|delete|request))?)\s*\(\s*(?:req|request)\.(?:query|body|params)\b", ("code",)),
    Rule("permissive_cors", JS, "high", "security", r"""\bcors\s*\(\s*\{(?:[^{}]*\borigin\s*:\s*['"]\*['"][^{}]*\bcredentials\s*:\s*true|[^{}]*\bcredentials\s*:\s*true[^{}]*\borigin\s*:\s*['"]\*['"])""", ("code",)),
    Rule("xss_unsafe_html_sink", JS, "high", "security", r"\b(innerHTML|outerHTML)\s*=\s*[^;]*(req\.|request\.|props\.|state\.|location\.|document\.location)"),
    Rule("react_dangerous_html", JS, "medium", "security", r"dangerouslySetInnerHTML\s*=\s*\{\s*\{[^}]*(__html|html)\s*:"),
    Rule("debug_config_enabled", JS, "medium", "best_practice", r"""\b(DEBUG|NODE_ENV)\s*=\s*['"]development['"]|debug\s*:\s*true"""),
    Rule("weak_crypto_hash", JS, "medium", "security", r"""\bcreateHash\s*\(\s*['"](md5|sha1)['"]\s*\)""", ("code", "hash_context")),
    Rule("insecure_random_secret", JS, "medium", "security", r"\bMath\.random\s*\(", ("code", "token_context")),
    Rule("sensitive_logging", JS, "medium", "security", r"(?i)\b(console|logger)\.(log|info|warn|error|debug)\s*\([^)]*(password|secret|token|api[_-]?key)"),
    Rule("blocking_call_in_async", JS, "medium", "performance", r"(?s)async\s+(function\s+\w+|\([^)]*\)\s*=>|\w+\s*\([^)]*\)\s*\{)(?:(?!\n\s*async\s+function).)*\b(execSync|spawnSync|readFileSync|writeFileSync)\s*\("),
    Rule("unsafe_tempfile", JS, "medium", "security", r"\b(tmp\.tmpNameSync|os\.tmpdir\s*\(\s*\)\s*\+)"),
    Rule("unsafe_redirect", JS, "medium", "security", r"\bres\.redirect\s*\(\s*(req\.(query|body|params)|request\.(query|body|params))"),
    Rule("frontend_token_storage", JS, "medium", "security", r"""(?i)\b(localStorage|sessionStorage)\.setItem\s*\(\s*['"][^'"]*(token|jwt|secret|session)[^'"]*['"]"""),
    Rule("plaintext_password_handling", JS, "high", "security", r"(?i)(password)\s*=\s*(req\.body|request\.body)"),
    Rule("mongoose_money_number_no_validation", JS, "medium", "data_integrity", r"(?i)\b(balance|amount|price|total|subtotal|credit|debit|fee|cost)\w*\s*:\s*\{[^{}]*type\s*:\s*Number(?![^{}]*(min\s*:|validate\s*:))[^{}]*\}"),
    Rule("js_numeric_coercion_default", JS, "medium", "logic", r"\bNumber\s*\([^)]*\)\s*\|\|\s*0\b"),
    Rule("js_date_slice_without_validation", JS, "low", "logic", r"\.\s*(date|createdAt|updatedAt)\s*\.slice\s*\("),
    Rule("js_zero_baseline_fallback", JS, "low", "logic", r"if\s*\(\s*!\s*(previous|prev|oldValue|baseline)\s*\)\s*return\s+0\s*;"),
    Rule("js_unknown_type_default", JS, "low", "logic", r"""(?s)if\s*\([^)]*\.type\s*={2,3}\s*['"][^'"]+['"][^)]*\)\s*\{[^{}]*\}\s*else\s*\{"""),
    Rule("process_global_auth_cache", JS, "high", "security", r"(?s)\b(?:let|var)\s+(?:cachedUser|currentUser)\b.*?\b(?:req|request)\.user\s*="),
    Rule("nosql_untrusted_filter", PY, "high", "security", r"((?:\b(?:db|mongo|database)\b(?:\.[A-Za-z_]\w*)+|\b(?:self\.)?[A-Za-z_]\w*(?:_collection|_repo(?:sitory)?)\b|\bcollection\b))\.(find_one|find|find_many|find_one_and_update|update_one|update_many|delete_one|delete_many)\s*\(\s*(request\.(?:json|args)|request\.get_json\s*\([^)]*\)|req\.(?:json|args))", ("code",)),
    Rule("unsafe_archive_extract", PY, "high", "security", r"\b(zipfile\.)?ZipFile\s*\([^)]*\)\.extractall\s*\(|\.extractall\s*\("),
    Rule("debug_config_enabled", PY, "medium", "best_practice", r"\b(debug\s*=\s*True|DEBUG\s*=\s*True|app\.run\s*\([^)]*debug\s*=\s*True)"),
    Rule("weak_crypto_hash", PY, "medium", "security", r"\b(hashlib\.(md5|sha1)\s*\(|Crypto\.Hash\.(MD5|SHA1)\b)", ("code", "hash_context")),
    Rule("insecure_random_secret", PY, "medium", "security", r"\brandom\.(random|randint|choice|choices|randrange)\s*\(", ("code", "token_context")),
    Rule("sensitive_logging", PY, "medium", "security", r"(?i)\b(log|logger)\.(debug|info|warning|error|exception)\s*\([^)]*(password|secret|token|api[_-]?key)"),
    Rule("blocking_call_in_async", PY, "medium", "performance", r"(?s)async\s+def\s+\w+\s*\([^)]*\):(?:(?!\n\s*async\s+def).)*\btime\.sleep\s*\("),
    Rule("unsafe_tempfile", PY, "medium", "security", r"\btempfile\.mktemp\s*\("),
    Rule("unsafe_redirect", PY, "medium", "security", r"\bredirect\s*\(\s*(request\.(args|form|json)|req\.(args|form|json))"),
    Rule("plaintext_password_handling", PY, "high", "security", r"(?i)password\s*=\s*(request\.(json|form)|req\.(json|form)|input\s*\()"),
)
# Values that stand for no real credential.
PLACEHOLDERS = (
    "hello", "test", "example", "changeme", "password", "admin", "adminadmin", "12345", "123456", "1234567", "12345678", "123456789", "qwerty", "letmein",
    "welcome", "secret", "default", "changeit", "placeholder", "xxx", "xxxx", "yourpassword", "yourapikey", "your_api_key", "yourtoken", "your_token",
    "testpassword", "testtoken", "testsecret", "dummy", "fakekey", "fake", "notarealsecret", "notarealkey", "sample", "foobar", "foo", "bar",
)
# Words around a match that decide about it.
SAMPLE_HOST = r"(?i)\b(example|sample|dummy|fake|placeholder)\.[a-z]{2,}\b"
SAMPLE_WORD = r"(?i)(example|sample|dummy|fake|placeholder|documentation|test fixture)"
HASH_WORD = r"(?i)(password|token|secret|signature|auth|credential|session)"
TOKEN_WORD = r"(?i)(token|secret|password|api[_-]?key|session|reset|otp|nonce)"
SQL_SINK = r"\.\s*execute(?:many|script)?\s*\(|\braw\s*\("
EVIDENCE_CHARS, NEAR, SQL_NEAR = 120, 180, 250
# Whole strings and comments; what is left of a prefix without them shows whether it ends inside one.
PY_LEXEMES = r'(?s)"""(?:[^"\\]|\\.|"{1,2}[^"\\]|"{1,2}\\.)*"""|' + r"'''(?:[^'\\]|\\.|'{1,2}[^'\\]|'{1,2}\\.)*'''|" + r'"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'|#[^\n]*\n"
JS_LEXEMES = r'(?s)"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*\n|/\*.*?\*/"


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def weak_value(value: Column) -> Column:
    """Whether a credential's value is a placeholder word, with or without digits behind it, or one repeated character."""
    plain = F.lower(F.regexp_replace(value, r"[\s_\-]", ""))
    return plain.isin(*PLACEHOLDERS) | F.regexp_replace(plain, r"\d+$", "").isin(*PLACEHOLDERS) | plain.rlike(r"^(.?)\1*$")


def catalogue(spark) -> DataFrame:
    """The rules as a table."""
    rows = [(r.key, r.name, list(r.languages), r.severity, r.category, r.pattern, list(r.guards)) for r in RULES]
    return spark.createDataFrame(rows, "rule_key string, rule string, languages array<string>, severity string, category string, pattern string, guards array<string>")


def _guard(name: str) -> Column:
    """The condition of a guard over: content, language, before (text up to the match), evidence_full, after (text behind it)."""
    before, after, match = F.col("before"), F.col("after"), F.col("match")
    line_head = F.regexp_extract(before, r"[^\n]*$", 0)
    line_tail = F.regexp_extract(after, r"^[^\n]*", 0)
    line = F.concat(line_head, match, line_tail)

    def near(radius: int) -> Column:
        ahead = F.substr(before, F.greatest(F.lit(1), F.length(before) - F.length(line_head) - radius + 1))
        return F.concat(ahead, match, F.substr(after, F.lit(1), F.length(line_tail) + radius))

    def with_two_lines_before(word: str) -> Column:
        return F.concat(F.regexp_extract(before, r"(?:[^\n]*\n){0,2}[^\n]*$", 0), match, line_tail).rlike(word)

    inside_py = F.regexp_replace(before, PY_LEXEMES, "").rlike("[\"'#]")
    inside_js = F.regexp_replace(before, JS_LEXEMES, "").rlike("[\"'`]|//|/\\*")
    python = F.col("language") == "python"
    return {
        "real_value": ~weak_value(F.regexp_extract(match, RULES[0].pattern, 2)),
        "no_sample": ~(F.trim(line).rlike(r"^\s*(#|//|/\*|\*)") | F.regexp_replace(near(NEAR), SAMPLE_HOST, "").rlike(SAMPLE_WORD)),
        "python_code": ~python | ~inside_py,
        "code": F.when(python, ~inside_py).otherwise(~inside_js),
        "sql_sink": near(SQL_NEAR).rlike(SQL_SINK),
        "hash_context": with_two_lines_before(HASH_WORD),
        "token_context": with_two_lines_before(TOKEN_WORD),
        "open_cookie": match.rlike(r"(?i)\b(httpOnly|secure)\s*:\s*false\b"),
    }[name]


def scan(files: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, guarded: bool = True) -> DataFrame:
    """Every match: the columns ``keep``, rule, severity, category, line, evidence, emit_ord.

    ``files`` has ``language`` (a canonical name) and ``content``. emit_ord orders a file's matches by rule, then place.
    """
    hits = [F.when(F.col("language").isin(*r.languages) & F.col("content").rlike(r.pattern), F.lit(k)) for k, r in enumerate(rules)]
    need = files.where(F.col("content").isNotNull()).select(*keep, "language", "content")
    found = (spread(need) if len(rules) > 10 else need).select("*", F.explode(F.array_compact(F.array(*hits))).alias("k"))
    look = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("k") + 1)
    found = found.withColumn("pattern", look(lambda r: r.pattern))
    found = found.withColumn("pieces", F.expr("split(content, pattern, -1)")).withColumn("matches", F.expr("regexp_extract_all(content, pattern, 0)"))
    before = F.concat(*[F.coalesce(x, F.lit("")) for x in (F.array_join(F.transform(F.slice("pieces", 1, F.col("i") + 1), lambda p, j: F.concat(p, F.when(j < F.col("i"), F.get(F.col("matches"), j)).otherwise(""))), ""),)])
    placed = found.select(*keep, "language", "content", "k", "pieces", "matches", F.posexplode("matches").alias("i", "match")).withColumn("before", before)
    if guarded and any(r.guards for r in rules):
        placed = placed.withColumn("after", F.substr("content", F.length("before") + F.length("match") + 1))
        conditions = {g for r in rules for g in r.guards}
        for g in sorted(conditions):
            placed = placed.where(~F.col("k").isin(*[k for k, r in enumerate(rules) if g in r.guards]) | _guard(g))
    return placed.select(
        *keep, look(lambda r: r.name).alias("rule"), look(lambda r: r.severity).alias("severity"), look(lambda r: r.category).alias("category"),
        (newlines(F.col("before")) + 1).cast("int").alias("line"), F.substring("match", 1, EVIDENCE_CHARS).alias("evidence"), (F.col("k") * 100_000 + F.col("i")).cast("int").alias("emit_ord"),
    )


def re2(pattern: str) -> bool:
    """Whether a pattern needs no look-around, so that other engines can run it."""
    return not re.search(r"\(\?[!=<]", pattern)
