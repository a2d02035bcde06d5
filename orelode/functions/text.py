"""Expressions on texts: tokens, snippets, redaction, language by syntax, JSON, patches, grounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-zA-Z_][a-zA-Z0-9_]{2,}"
# Words that say nothing in a question.
STOPWORDS = tuple("the is at which on a an and or of to in for this that does do how what where when why are was were be it its with from as has have".split())
# Parts of words that mark a question for guidance.
GUIDANCE = ("production", "ready", "readiness", "secure", "security", "vulnerab", "scale", "scalab", "architecture", "database", "deploy", "deployment", "improve", "improvement", "best practice", "reliab", "performance", "risky", "risk")
# A secret in running text.
SECRET = r"""(?i)(password|secret|token|api[_-]?key)\s*[=:]\s*['"][^'"]+['"]"""


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.transform(words(text), F.lower))


def question_tokens(text: Column) -> Column:
    return F.array_except(tokens(text), F.array(*map(F.lit, STOPWORDS)))


def singular(word: Column) -> Column:
    return F.when((F.length(word) > 4) & word.endswith("s"), F.substring(word, 1, F.length(word) - 1)).otherwise(word)


def singular_tokens(text: Column, stop: tuple[str, ...] = STOPWORDS, stop_first: bool = False) -> Column:
    """Distinct words, plural s taken off, without stop words, which are compared before or after that."""
    t, s = tokens(text), F.array(*map(F.lit, stop))
    cut = lambda a: F.transform(a, singular)
    return F.array_distinct(cut(F.array_except(t, s))) if stop_first else F.array_except(F.array_distinct(cut(t)), s)


def identifiers(text: Column) -> Column:
    """Distinct words that look like names in code, in lower case: five characters or more, with "_" or a capital inside."""
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: (F.length(w) >= 5) & (w.contains("_") | w.rlike("[a-z][A-Z]"))), F.lower))


def squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def redacted(text: Column, chars: int = 1200) -> Column:
    return F.substring(F.regexp_replace(text, SECRET, '$1 = "[REDACTED]"'), 1, chars)


def asks_for_guidance(question: Column) -> Column:
    return F.lower(question).rlike("|".join(GUIDANCE))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def frame(text: Column, line: Column, before: int, after: int, head: int) -> Column:
    """The lines around a line, joined; the first ``head`` lines where the line is no positive number."""
    ls = lines(text)
    first = F.greatest(F.lit(1), line - before)
    return F.when(line > 0, F.array_join(F.slice(ls, first, F.greatest(F.lit(0), line + after - first + 1)), "\n")).otherwise(F.array_join(F.slice(ls, 1, head), "\n"))


def syntax_language(text: Column) -> Column:
    """Language by strong signs of its syntax, TypeScript before JavaScript before Python; null without any."""
    ts = r"(?m)\binterface\s+\w+\s*\{|:\s*(string|number|boolean|any)\b[^\n]*[;,)=]|\bimport\s+type\b|\b(private|public|readonly)\s+\w+\s*:"
    js = r"(?m)\b(const|let|var)\s+\w+\s*=|\bfunction\s*\w*\s*\(|=>|\brequire\s*\("
    py = r"(?m)^\s*(def|class)\s+\w+.*:\s*$|^\s*(from\s+\S+\s+)?import\s+\w+|\belif\b|^\s*(if|for|while|try|except)\b.*:\s*$"
    return F.when(text.rlike(ts), "typescript").when(text.rlike(js), "javascript").when(text.rlike(py), "python")


def json_or_block(text: Column) -> Column:
    """A JSON value: the text itself, else what stands from its first "{" to its last "}", else null."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def file_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def mail(text: Column) -> Column:
    return F.lower(F.trim(text))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of a place counted from 0."""
    return newlines(F.substr(text, F.lit(1), offset)) + 1


def grounding(content: Column, line: Column, evidence: Column, source: Column) -> Column:
    """Why a claim about a source text is refused, null if it stands.

    The line must exist, a reviewer's claim must quote, and a quote either stands in the text (spacing and case aside) or names nothing that is not there.
    """
    n = F.greatest(F.lit(1), F.size(F.split(F.regexp_replace(F.coalesce(content, F.lit("")), r"\r?\n$", ""), "\n")))
    quote = F.trim(F.coalesce(evidence, F.lit("")))
    missing = F.array_except(identifiers(quote), tokens(content))
    return (
        F.when((line != 0) & ((line < 1) | (line > n)), "line_out_of_range").when((quote == "") & (source == "ai_quality"), "no_evidence").when(quote == "", None)
        .when(squeezed(content).contains(squeezed(quote)), None).when(F.size(missing) > 0, "unknown_identifier")
    )


def patch_place(content: Column, original: Column) -> Column:
    """Place, from 1, of the one occurrence of a text; 0 if there is none, -1 if there are several (overlapping ones count)."""
    first = F.locate("", original) * 0 + F.call_function("instr", content, original)
    again = F.call_function("instr", F.substr(content, first + 1), original)
    return F.when(first == 0, 0).when(again > 0, -1).otherwise(first)


def patch_status(content: Column, original: Column, fixed: Column, expected_hash: Column) -> Column:
    """malformed_fix, stale_source, target_not_found, ambiguous_target or ok, tested in this order."""
    place = patch_place(content, original)
    return (
        F.when(original.isNull() | (original == "") | fixed.isNull() | (original == fixed), "malformed_fix").when(expected_hash.isNotNull() & (expected_hash != F.sha2(content, 256)), "stale_source")
        .when(place == 0, "target_not_found").when(place < 0, "ambiguous_target").otherwise("ok")
    )


def with_line_ends_of(content: Column, fixed: Column) -> Column:
    """A replacement with the line ends of the text it goes into."""
    crlf = F.lit("\r\n")
    unix = F.replace(fixed, crlf, F.lit("\n"))
    return F.when(content.contains("\r\n") & fixed.contains("\n"), F.replace(unix, F.lit("\n"), crlf)).otherwise(fixed)


def patched(content: Column, original: Column, fixed: Column) -> Column:
    place = patch_place(content, original)
    return F.when(place > 0, F.concat(F.substr(content, F.lit(1), place - 1), with_line_ends_of(content, fixed), F.substr(content, place + F.length(original))))
