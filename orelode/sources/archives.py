"""Archives as a source and sink, admission, derived tables, content store, upserts.

An archive's entries are rows (archive, name, size); every check is one partial aggregation over them, so that an archive with a third of all entries
is checked map-side. Contents travel only after admission.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions import paths

ENTRY_SCHEMA = "archive string, name string, size bigint, content binary, error string"
# A repository's name or address.
REPOSITORY = r"^(?:https?://)?(?:www\.)?(?:github\.com/)?([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?/?$"


def _unzip(max_file: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for e in z.infolist():
                            if e.is_dir():
                                continue
                            with z.open(e) as f:
                                body = f.read(max_file + 1)
                            rows.append((path, e.filename, e.file_size, None if len(body) > max_file else body, "file too large" if len(body) > max_file else None))
                            if len(rows) >= 64:
                                yield pd.DataFrame(rows, columns=["archive", "name", "size", "content", "error"])
                                rows = []
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, ValueError):
                    rows = [(path, None, None, None, "no readable archive")]
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "name", "size", "content", "error"])

    return run


def read_archives(spark: SparkSession, folder: str, max_archive: int = paths.MAX_ARCHIVE_BYTES, max_file: int = paths.MAX_FILE_BYTES) -> DataFrame:
    """The entries of every ZIP archive under a folder (ENTRY_SCHEMA). Archives beyond the size limit give one row with an error and are not opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder)
    large = found.where(F.col("length") > max_archive).select(F.col("path").alias("archive"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("content"), F.lit("archive too large").alias("error"))
    return found.where(F.col("length") <= max_archive).select("path", "content").mapInPandas(_unzip(max_file), ENTRY_SCHEMA).unionByName(large)


def admission(entries: DataFrame, key: str = "archive", name: str = "name", size: str = "size") -> DataFrame:
    """(key, entries, total_size, reason): why an archive is refused, null if it is admitted. One violation refuses the whole archive.

    Reasons in order: too many entries, unsafe path, a file too large, too large in all, duplicate path.
    """
    named = entries.where(F.col(name).isNotNull())
    per_path = named.groupBy(key, paths.canonical(F.col(name)).alias("_path")).agg(
        F.count("*").alias("n"), F.bool_or(paths.unsafe(F.col(name))).alias("unsafe"), F.max(size).alias("most"), F.sum(size).alias("sum"))
    r = per_path.groupBy(key).agg(F.sum("n").alias("entries"), F.sum("sum").alias("total_size"), F.max("n").alias("copies"), F.bool_or("unsafe").alias("unsafe"), F.max("most").alias("most"))
    reason = (
        F.when(F.col("entries") > paths.MAX_ENTRIES, "too many entries").when(F.col("unsafe"), "unsafe path").when(F.col("most") > paths.MAX_FILE_BYTES, "file too large")
        .when(F.col("total_size") > paths.MAX_EXPANDED_BYTES, "too large in all").when(F.col("copies") > 1, "duplicate path")
    )
    return r.select(key, "entries", "total_size", reason.alias("reason"))


def duplicate_paths(entries: DataFrame, key: str, name: str) -> DataFrame:
    return entries.where(F.col(name).isNotNull()).groupBy(key, paths.canonical(F.col(name)).alias("canonical_path")).agg(F.count("*").alias("copies")).where("copies > 1")


def common_top(entries: DataFrame, key: str, name: str) -> DataFrame:
    """(key, prefix): the one top folder that all names with a slash share, with its slash; "" if there is no single one."""
    top = F.when(F.col(name).contains("/"), F.split_part(F.col(name), F.lit("/"), F.lit(1)))
    return entries.groupBy(key).agg(F.min(top).alias("lo"), F.max(top).alias("hi")).select(key, F.when(F.col("lo") == F.col("hi"), F.concat("lo", F.lit("/"))).otherwise("").alias("prefix"))


def ignored_counts(files: DataFrame, key: str, name: str) -> DataFrame:
    return files.select(key, paths.ignored_part(F.col(name)).alias("ignored_dir")).where("ignored_dir is not null").groupBy(key, "ignored_dir").agg(F.count("*").alias("files"))


def dependencies(files: DataFrame) -> DataFrame:
    """(project_id, name, version, source) from requirements.txt and package.json, the first of each (name, source) by file order and place."""
    base = paths.base_name(F.col("path"))
    req = (
        files.where(base == "requirements.txt").select("project_id", "path", "file_ord", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("place", "raw"))
        .withColumn("line", F.trim(F.split_part("raw", F.lit("#"), F.lit(1)))).where("line <> '' and not line like '-r %' and not line like '--%'")
        .where(F.col("line").rlike(r"^[A-Za-z0-9_.-]+\s*([<>=!~].*)?$"))
        .select("project_id", F.regexp_extract("line", r"^([A-Za-z0-9_.-]+)", 1).alias("name"), F.trim(F.regexp_extract("line", r"^[A-Za-z0-9_.-]+\s*([<>=!~].*)?$", 1)).alias("version"), F.col("path").alias("source"), "file_ord", "place")
    )
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    parsed = files.where(base == "package.json").select("project_id", "path", "file_ord", F.from_json("content", "struct<" + ",".join(f"{s}:map<string,string>" for s in sections) + ">").alias("p"))
    js = None
    for k, s in enumerate(sections):
        part = parsed.select("project_id", F.posexplode(F.map_entries(f"p.{s}")).alias("place", "e"), "path", "file_ord").select(
            "project_id", F.trim("e.key").alias("name"), F.trim("e.value").alias("version"), F.concat("path", F.lit(f":{s}")).alias("source"), "file_ord", (F.col("place") + k * 1_000_000).alias("place"))
        js = part if js is None else js.unionByName(part)
    both = req.unionByName(js).where("name <> '' and not name like '#%'")
    first = F.row_number().over(Window.partitionBy("project_id", F.lower("name"), "source").orderBy("file_ord", "place"))
    return both.withColumn("_n", first).where("_n = 1").select("project_id", "name", "version", "source")


def project_metadata(files: DataFrame) -> DataFrame:
    """(project_id, languages, files, project_type): languages are distinct and sorted, without ``other``."""
    lang = paths.language(F.col("path"))
    r = files.groupBy("project_id").agg(F.array_sort(F.collect_set(F.when(lang != "other", lang))).alias("languages"), F.count("*").alias("files"))
    return r.withColumn("project_type", F.when(F.size("languages") == 0, "unknown").when(F.size("languages") == 1, "single-language").otherwise("multi-language"))


def directories(files: DataFrame) -> DataFrame:
    """(project_id, directory): every folder above a file, each once."""
    p = paths.parts(F.col("path"))
    above = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/"))
    return files.where(F.size(p) > 1).select("project_id", F.explode(above).alias("directory")).distinct()


def content_store(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with a reference in place of the content, blobs by hash): equal contents are stored once."""
    ref = F.sha2("content", 256)
    with_ref = files.withColumn("content_ref", ref)
    return with_ref.drop("content"), with_ref.where("content is not null").groupBy("content_ref").agg(F.any_value("content").alias("content"))


def hydrate(files: DataFrame, blobs: DataFrame) -> DataFrame:
    return files.join(blobs, "content_ref", "left")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], created: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(table after the upsert, one row with upserted and matched): rows are replaced by key, the time of creation stays."""
    o, n = old.alias("o"), new.dropDuplicates(keys).alias("n")
    joined = o.join(n, keys, "full")
    fresh = F.lit(False)
    for c in new.columns:
        if c not in keys:
            fresh = fresh | F.col(f"n.{c}").isNotNull()
    columns = [*keys, *[F.when(fresh, F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c == created else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c not in keys]]
    matched = n.join(o.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("matched"))
    total = n.agg(F.count("*").alias("total"))
    return joined.select(*columns), total.crossJoin(matched).select((F.col("total") - F.col("matched")).alias("upserted"), "matched")


def update_where(base: DataFrame, changes: DataFrame, key: str, expected: str, current: str) -> DataFrame:
    """base with changes committed where the expected revision is the current one; ``committed`` is null where there was no change."""
    c = changes.select(key, F.col(expected).alias("_expected"), F.col("owner_user_id").alias("_owner"))
    ok = (F.col("_expected") == F.col(current)) & F.col("owner_user_id").eqNullSafe(F.col("_owner"))
    j = base.join(c, key, "left")
    return j.withColumn("committed", F.when(F.col("_expected").isNotNull(), F.coalesce(ok, F.lit(False)))).withColumn(current, F.col(current) + F.coalesce(F.col("committed").cast("int"), F.lit(0))).drop("_expected", "_owner")


def repository(text: Column) -> Column:
    """owner/name of a repository's name or address; null if it is none."""
    t = F.trim(text)
    return F.when(t.rlike(REPOSITORY), F.concat_ws("/", F.regexp_extract(t, REPOSITORY, 1), F.regexp_extract(t, REPOSITORY, 2)))


def exportable(files: DataFrame) -> DataFrame:
    """The files that go into a rebuilt archive: no ignored first folder, no settings or compiled file, no unsafe path."""
    p = F.col("path")
    return files.where(~F.coalesce(F.get(paths.parts(p), 0).isin(*paths.IGNORED_DIRS), F.lit(False)) & ~p.rlike(r"(\.env|\.pyc)$") & ~paths.unsafe(p))


def write_archives(files: DataFrame, folder: str, key: str = "project_id") -> DataFrame:
    """(key, archive, files): one ZIP archive per project in a shared folder, written by the workers. A project's files meet in one task."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows[key].iloc[0]
        target = f"{folder.removeprefix('file://')}/{''.join(c if c.isalnum() or c in '._-' else '_' for c in str(name))}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p, text in zip(rows["path"], rows["content"]):
                z.writestr(p, text or "")
        return pd.DataFrame({key: [name], "archive": [target], "files": [len(rows)]})

    return exportable(files).select(key, "path", "content").groupBy(key).applyInPandas(write, f"{key} string, archive string, files bigint")


def embedding_text(files: DataFrame, chars: int = 2000) -> DataFrame:
    """(project_id, text): "# path" and the first characters of every file, in file order."""
    piece = F.concat(F.lit("# "), "path", F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    return files.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", piece.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
