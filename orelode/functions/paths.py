"""Expressions on file paths and the tables of an archive's admission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of an archive and its paths.
MAX_ARCHIVE_BYTES, MAX_EXPANDED_BYTES, MAX_FILE_BYTES = 300 * 1024 * 1024, 600 * 1024 * 1024, 15 * 1024 * 1024
MAX_ENTRIES, MAX_DEPTH, LARGE_CHARS = 2000, 20, 100_000
# Names of folders that are left out.
IGNORED_DIRS = (".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "coverage", ".cache")
# Languages by extension.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".h": "cpp", ".hpp": "cpp"}
SOURCE_LANGUAGES = ("python", "javascript", "typescript", "java", "cpp")
# File names with a meaning.
CONFIG_NAMES = ("requirements.txt", "pyproject.toml", "package.json", "setup.py", "pom.xml", "build.gradle", ".env.example", "tsconfig.json")
DEPLOYMENT_NAMES = ("Dockerfile", "docker-compose.yml", "docker-compose.yaml", "render.yaml", "vercel.json", "Procfile")
TEST_DIRS = ("tests", "__tests__")
# Words in a path by layer, in order of priority.
LAYERS = {"routes": ("route", "api", "controller", "handler"), "services": ("service", "logic", "manager", "client"), "database": ("repo", "db", "database", "query", "store")}
#: Base names of tests, as one pattern.
TEST_NAME = r"^(test_.*\.py|.*_test\.py|.*\.(test|spec)\.(js|jsx|ts|tsx))$"


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    """The parts of a path; empty ones and "." inside do not count."""
    return F.filter(F.split(slashed(path), "/"), lambda p: (p != "") & (p != "."))


def base_name(path: Column) -> Column:
    return F.try_element_at(parts(path), F.lit(-1))


def canonical(path: Column) -> Column:
    """The one form a path is stored in."""
    s = slashed(path)
    joined = F.array_join(parts(path), "/")
    return F.when(s.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def extension(path: Column) -> Column:
    """Extension with its dot, in lower case; "" for names without one and for names that only begin with dots."""
    return F.lower(F.regexp_extract(F.element_at(F.split(slashed(path), "/"), -1), r"^\.*[^.].*?(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)], F.lit("other"))


def unsafe(path: Column) -> Column:
    """Whether a path leaves its root, is absolute, names a drive or lies too deep."""
    s = slashed(path)
    return F.array_contains(F.split(s, "/"), "..") | (F.size(parts(path)) + s.startswith("/").cast("int") > MAX_DEPTH) | s.startswith("/") | s.rlike("^.:")


def ignored_part(path: Column) -> Column:
    """The first part of the path that is left out; null if there is none."""
    return F.get(F.filter(parts(path), lambda p: p.isin(*IGNORED_DIRS)), 0)


def is_test(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, TEST_DIRS))) | F.coalesce(base_name(path).rlike(TEST_NAME), F.lit(False))


def is_config(path: Column) -> Column:
    return F.coalesce(base_name(path).isin(*CONFIG_NAMES), F.lit(False))


def is_deployment(path: Column) -> Column:
    return F.coalesce(base_name(path).isin(*DEPLOYMENT_NAMES), F.lit(False)) | slashed(path).contains(".github/workflows/")


def read_as_text(path: Column, lang: Column) -> Column:
    return lang.isin(*SOURCE_LANGUAGES) | F.coalesce(base_name(path).isin(*CONFIG_NAMES, *DEPLOYMENT_NAMES), F.lit(False))


def layer(path: Column) -> Column:
    """Layer of a file by words in its path, the first that fits."""
    p = F.lower(path)
    has = lambda words: p.rlike("|".join(words))
    return F.coalesce(*[F.when(has(words), name) for name, words in LAYERS.items()], F.lit("modules"))
