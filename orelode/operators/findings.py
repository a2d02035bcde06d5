"""Findings: identity, exact and semantic merging, gate, joins with dimensions, before/after diff.

A finding has file, line, rule, severity, category, evidence and an order of emission. Joins with the fixed maps (some dozens of rows) are
written as literal maps, so nothing is shuffled for them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rule families, their weaknesses, and the rules that belong to them.
CWE = {
    "SEC-HARDCODED-SECRET": "CWE-798", "SEC-SQL-INJECTION": "CWE-89", "SEC-NOSQL-INJECTION": "CWE-943", "SEC-COMMAND-INJECTION": "CWE-78", "SEC-SSRF": "CWE-918", "SEC-PATH-TRAVERSAL-FILE": "CWE-22",
    "SEC-UNSAFE-DESERIALIZATION": "CWE-502", "SEC-EVAL-EXEC": "CWE-95", "SEC-TLS-CORS-MISCONFIG": "CWE-295", "SEC-WEAK-CRYPTO-RANDOM": "CWE-330", "SEC-AUTH-SESSION": "CWE-287", "SEC-DEPENDENCY-RISK": "CWE-1104",
}
CANONICAL = {
    "hardcoded_secret": "SEC-HARDCODED-SECRET", "sql_concat": "SEC-SQL-INJECTION", "nosql_untrusted_filter": "SEC-NOSQL-INJECTION", "subprocess_shell_true": "SEC-COMMAND-INJECTION",
    "os_system_call": "SEC-COMMAND-INJECTION", "spawn_shell_true": "SEC-COMMAND-INJECTION", "ssrf_untrusted_url": "SEC-SSRF", "path_traversal_file": "SEC-PATH-TRAVERSAL-FILE",
    "unsafe_archive_extract": "SEC-PATH-TRAVERSAL-FILE", "unsafe_deserialization": "SEC-UNSAFE-DESERIALIZATION", "dangerous_eval": "SEC-EVAL-EXEC", "tls_verification_disabled": "SEC-TLS-CORS-MISCONFIG",
    "permissive_cors": "SEC-TLS-CORS-MISCONFIG", "weak_crypto_hash": "SEC-WEAK-CRYPTO-RANDOM", "insecure_random_secret": "SEC-WEAK-CRYPTO-RANDOM", "jwt_signature_verification_disabled": "SEC-AUTH-SESSION",
    "jwt_algorithm_verification_bypass": "SEC-AUTH-SESSION", "insecure_auth_cookie": "SEC-AUTH-SESSION", "jwt_insecure_secret_fallback": "SEC-HARDCODED-SECRET", "frontend_token_storage": "SEC-AUTH-SESSION",
    "plaintext_password_handling": "SEC-AUTH-SESSION", "process_global_auth_cache": "SEC-AUTH-SESSION",
}
SEMANTIC_GROUPS = {
    "sql_injection": ("sql_injection", "sql_concat"), "command_injection": ("command_injection", "subprocess_shell_true", "os_system_call"), "ssrf": ("ssrf", "ssrf_untrusted_url"),
    "xss_unsafe_html_sink": ("xss_unsafe_html_sink",),
}
ROOT_OF_RULE = {
    "subprocess_shell_true": "command_execution", "os_system_call": "command_execution", "spawn_shell_true": "command_execution", "unsafe_deserialization": "unsafe_deserialization",
    "permissive_cors": "permissive_cors", "blocking_call_in_async": "blocking_async", "ssrf_untrusted_url": "ssrf", "dangerous_eval": "dynamic_code_execution", "sql_concat": "sql_injection",
    "sensitive_logging": "sensitive_logging", "weak_crypto_hash": "weak_crypto_random", "insecure_random_secret": "weak_crypto_random",
}
ROOT_OF_WORDS = {
    "shell true": "command_execution", "command injection": "command_execution", "yaml load": "unsafe_deserialization", "pickle": "unsafe_deserialization", "cors": "permissive_cors",
    "time.sleep": "blocking_async", "blocking": "blocking_async", "written to logs": "sensitive_logging", "logged in plaintext": "sensitive_logging", "credential leakage": "sensitive_logging",
    "token is logged": "sensitive_logging", "sensitive data": "sensitive_logging", "weak hash": "weak_crypto_random", "weak cryptographic": "weak_crypto_random",
    "password hashing using md5": "weak_crypto_random", "hashing using md5": "weak_crypto_random", "brute force": "weak_crypto_random", "md5": "weak_crypto_random", "sha1": "weak_crypto_random",
}
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
NEAR_LINES = 2


def looked_up(table: dict, key: Column, default: Column | None = None) -> Column:
    """The value of a small fixed map; null or the default for other keys."""
    value = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return value if default is None else F.coalesce(value, default)


def squeezed(c: Column) -> Column:
    """White space runs as one blank, none at the ends, lower case; "" for null."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def stable_id(rule: Column, file: Column, line: Column, evidence: Column) -> Column:
    """24 hex digits that do not change with wording elsewhere or with order."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat_ws("\x1f", text(rule), text(file), F.coalesce(line, F.lit(0)).cast("string"), squeezed(evidence)), 256), 1, 24)


def has_place(file: Column, line: Column) -> Column:
    return F.coalesce((file != "") & (line > 0), F.lit(False))


def gate(findings: DataFrame) -> DataFrame:
    """Findings of the known families with a real place; rule_id, cwe, evidence_type and deterministic_evidence are added."""
    family = looked_up(CANONICAL, F.col("rule"))
    return (
        findings.withColumn("rule_id", family).where(F.col("rule_id").isNotNull() & has_place(F.col("file"), F.col("line")))
        .withColumn("cwe", looked_up(CWE, F.col("rule_id"))).withColumn("deterministic_evidence", F.lit(True))
        .withColumn("evidence_type", F.when(F.col("rule_id") == "SEC-HARDCODED-SECRET", "literal_secret").otherwise("ast_call"))
    )


def exact_distinct(findings: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """The first of each (file, line, rule, evidence); nulls count as equal."""
    first = F.row_number().over(Window.partitionBy(*within, "file", "line", "rule", "evidence").orderBy(*order))
    return findings.withColumn("_n", first).where("_n = 1").drop("_n")


def semantic_group(rule: Column) -> Column:
    return looked_up({r: g for g, rs in SEMANTIC_GROUPS.items() for r in rs}, rule)


def merge_near(findings: DataFrame, within: list[str], order: str) -> DataFrame:
    """Findings of one semantic group within two lines of a kept one are merged into it, in order of emission.

    A flow finding replaces the kept row (and its line), as does any finding if the kept row is no flow; otherwise the newcomer goes. The line moves
    with the replacement, so this is a fold over order. Only rows of a semantic group are folded, by file and group, so a task holds one file's
    findings of one group; all other rows pass by.
    """
    marked = findings.withColumn("_group", semantic_group(F.col("rule")))
    schema = marked.schema

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in rows.sort_values(order, kind="stable").to_dict("records"):
            line = int(row["line"]) if pd.notna(row["line"]) else 0
            near = next((k for k in kept if abs((int(k["line"]) if pd.notna(k["line"]) else 0) - line) <= NEAR_LINES), None)
            if near is None:
                kept.append(row)
            elif row["evidence_type"] == "ast_source_sink" or near["evidence_type"] != "ast_source_sink":
                at = near[order]
                near.update(row)
                near[order] = at
        return pd.DataFrame(kept, columns=rows.columns)

    merged = marked.where("_group is not null").groupBy(*within, "file", "_group").applyInPandas(fold, schema)
    return marked.where("_group is null").unionByName(merged).drop("_group")


def root_group(rule: Column, message: Column, category: Column) -> Column:
    """Group of findings with one cause: by rule, else by words in rule and message, else the category, rule or text."""
    words = squeezed(F.concat_ws(" ", F.coalesce(rule, F.lit("")), F.coalesce(message, F.lit(""))))
    by_words = F.coalesce(*[F.when(words.contains(w), g) for w, g in ROOT_OF_WORDS.items()])
    full = lambda c: F.when(c != "", c)
    return F.coalesce(looked_up(ROOT_OF_RULE, rule), by_words, full(category), full(rule), words)


def merge_key(file: Column, group: Column, line: Column, evidence: Column) -> Column:
    return F.concat_ws("\x1f", F.coalesce(file, F.lit("")), group, F.floor(F.coalesce(line, F.lit(0)) / 3).cast("string"), F.substring(squeezed(evidence), 1, 90))


def joined_source(source: Column) -> Column:
    """A combined source with its parts in order, each once."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(source, r"\+"))), "+")


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], lines: int) -> DataFrame:
    """Band join: rows of equal keys at most ``lines`` lines apart.

    Both sides are cut into buckets of lines+1 lines; a left row looks into its bucket and its neighbours. So the equi-join key is (keys, bucket)
    and a file with very many findings is spread over its buckets.
    """
    size = lines + 1
    bucket = F.floor(F.col("line") / size)
    a = left.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = right.withColumn("_b", bucket).withColumnRenamed("line", "other_line")
    return a.join(b, [*keys, "_b"]).where(F.abs(F.col("line") - F.col("other_line")) <= lines).drop("_b")


def diff_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state): resolved, remaining or new."""
    sides = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a")))
    seen = sides.groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return seen.select(*keys, F.when(F.col("a") == 0, "resolved").when(F.col("b") == 0, "new").otherwise("remaining").alias("state"))


def severity_rank(severity: Column) -> Column:
    return looked_up(SEVERITY_RANK, severity, F.lit(0))
