"""Source files that do not follow the grammar of their language.

Every text is parsed by the grammar of the language it is filed under. If that fails, the other languages are ranked by
the share of the text's tokens that are typical of them, and all their grammars are tried in this order: a language that accepts
the text shows a wrong label or extension, none that the text itself is broken.

No shuffle: one pass; only the rates are grouped, with partial sums. Defined cases: null and empty (or blank) contents and files of no
supported language are never cases; a byte order mark at the start is no fault; a nesting too deep for a parser is no fault of the text;
copies count each for themselves; very long texts are parsed in whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.llm import grammar
from orelode.session import spread

# Spellings of the languages, in lower case without white space.
SPELLINGS = {
    "python": "python", "python3": "python", "py": "python", "javascript": "javascript", "js": "javascript", "jsx": "javascript", "node": "javascript", "nodejs": "javascript", "ecmascript": "javascript",
    "typescript": "typescript", "ts": "typescript", "tsx": "typescript", "java": "java", "cpp": "cpp", "c++": "cpp", "cxx": "cpp", "cc": "cpp", "cplusplus": "cpp",
}
# Tokens typical of a language.
TYPICAL = {
    "python": frozenset("def elif None True False self import from lambda except pass with as raise not and or in is : print __init__ yield".split()),
    "javascript": frozenset("function const let var => === !== async await export import from require module null undefined typeof ; {".split()),
    "typescript": frozenset("interface type readonly enum const let => === export import from any string number boolean private public implements ; {".split()),
    "java": frozenset("public private static final class void new package import throws extends implements String Override List Map ; {".split()),
    "cpp": frozenset("#include std :: -> const auto void int long namespace template typename nullptr return struct size_t using ; {".split()),
}
_TOKEN = re.compile(r"#include|[A-Za-z_]\w*|=>|===?|!==?|::|->|[:;{]")


def language_of(c: Column) -> Column:
    """The supported language a label names, spelling aside; null for all others."""
    plain = F.regexp_replace(F.lower(c), r"[\s_\-]+", "")
    return F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])[plain]


def ranked(text: str) -> list[str]:
    """The languages, the one most typical of the text's tokens first."""
    seen = Counter(_TOKEN.findall(text))
    share = {k: sum(seen[t] for t in seen.keys() & v) for k, v in TYPICAL.items()}
    return sorted(grammar.LANGUAGES, key=lambda k: (-share[k], k))


def _follows(text: str, language: str) -> bool:
    try:
        return grammar.follows(text, language)
    except (RecursionError, MemoryError):
        return True


def status(text: str, language: str) -> tuple[bool, str, str | None]:
    """(whether the text follows its language's grammar, cause, first other language in rank order that accepts it)."""
    if _follows(text, language):
        return True, "valid", None
    for other in ranked(text):
        if other != language and _follows(text, other):
            return False, "other_language", other
    return False, "broken", None


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            found = [status(t.as_py(), k) for t, k in zip(part.column(3), part.column(2).to_pylist())]
            valid, cause, other = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(valid, pa.bool_()), pa.array(cause, pa.string()), pa.array(other, pa.string())],
                ["file_id", "project_id", "language", "valid", "cause", "parsed_as"],
            )


def check_files(files: DataFrame) -> DataFrame:
    """(file_id, project_id, language, valid, cause, parsed_as) of every file with a text and a supported language."""
    need = files.select(F.col("file_id").cast("bigint"), F.col("project_id").cast("string"), language_of(F.col("language")).alias("language"), "content")
    need = need.where(F.col("language").isNotNull() & F.col("content").rlike(r"\S"))
    return spread(need).mapInArrow(_run, "file_id bigint, project_id string, language string, valid boolean, cause string, parsed_as string")


def rates(checked: DataFrame) -> DataFrame:
    """(project_id, language, files, broken, other_language, rate) of the result of ``check_files``."""
    return checked.groupBy("project_id", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("cause") == "other_language").alias("other_language"),
    ).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
