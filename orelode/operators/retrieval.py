"""Retrieval over files and vectors: import graph, neighbourhoods, ranking, expansion, hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions import paths, text

# Sizes of results, words of risk and data bases.
TOP, TOTAL, SNIPPET = 5, 8, 1500
RISK = ("risk", "risky", "riskiest", "dangerous", "vulnerable", "vulnerability", "vulnerabilities", "insecure", "security", "secure", "production", "readiness", "worst", "unsafe")
DB_WORDS = ("database", "databases", "db", "sqlite", "sql", "query", "queries")
DB_STEMS = ("db", "database", "database_client", "repository", "repositories", "models")
DB_MARKS = ("sqlite3", "select ", "insert ", "update ", "delete ")
EXTENSION = r"\.(py|js|jsx|ts|tsx)$"


def module_keys(files: DataFrame) -> DataFrame:
    """(project_id, module_key, path, key_ord): the names a file can be imported by: its path without extension, its folder for an index or package file, both with dots too."""
    stem = F.regexp_replace(paths.canonical(F.col("path")), EXTENSION, "")
    folder = F.regexp_replace(stem, r"/(index|__init__)$", "")
    keys = F.array(stem, folder, F.replace(stem, F.lit("/"), F.lit(".")), F.replace(folder, F.lit("/"), F.lit(".")))
    return files.where(F.col("path").rlike(EXTENSION)).select("project_id", "path", F.posexplode(F.array_distinct(keys)).alias("key_ord", "module_key"))


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative path below a folder with "." and ".." resolved: a fold over the parts."""
    all_parts = F.filter(F.concat(F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/")), F.split(relative, "/")), lambda p: (p != "") & (p != "."))
    out = F.aggregate(all_parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(out, "/")


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(project_id, src, dst): imports of (project_id, file, module) that lead to another file of the project, the first candidate that fits.

    Candidates in order: relative to the file's folder, as given, below the file's folder. An equi-join on (project, key); a project with a third of all rows is spread over its keys.
    """
    folder = F.regexp_replace(F.col("file"), "(^|/)[^/]*$", "")
    module = F.regexp_replace(F.col("module"), EXTENSION, "")
    here = F.when(module.rlike(r"^\.{1,2}/"), joined_path(folder, module)).when(module.rlike(r"^\.+\w"), joined_path(folder, F.replace(F.regexp_replace(module, r"^\.", ""), F.lit("."), F.lit("/"))))
    below = F.when(~module.startswith("."), F.when(folder == "", module).otherwise(F.concat_ws("/", folder, F.replace(module, F.lit("."), F.lit("/")))))
    candidates = imports.select("project_id", "file", "module", F.posexplode(F.array(here, F.when(~module.startswith("."), module), below)).alias("try_ord", "module_key")).where("module_key is not null")
    hits = candidates.join(module_keys(files), ["project_id", "module_key"]).where("path <> file")
    best = hits.groupBy("project_id", "file", "module").agg(F.min(F.struct("try_ord", "key_ord", "path")).alias("b"))
    return best.select("project_id", F.col("file").alias("src"), F.col("b.path").alias("dst")).distinct()


def neighbours(edges: DataFrame, hops: int = 1) -> DataFrame:
    """(project_id, path, related, hop): files reached over imports in either direction, without the file itself, with the least number of hops."""
    both = edges.select("project_id", "src", "dst").union(edges.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = both.select("project_id", F.col("src").alias("path"), F.col("dst").alias("related"), F.lit(1).alias("hop"))
    last = reached
    for h in range(2, hops + 1):
        step = last.join(both.select("project_id", F.col("src").alias("related"), "dst"), ["project_id", "related"]).select("project_id", "path", F.col("dst").alias("related"), F.lit(h).alias("hop")).where("path <> related").distinct()
        last = step.join(reached.select("project_id", "path", "related"), ["project_id", "path", "related"], "left_anti")
        reached = reached.union(last)
    return reached


def rank_files(files: DataFrame, questions: DataFrame, names: DataFrame, imports: DataFrame) -> DataFrame:
    """(question_id, project_id, path, file_ord, score) for every file of a question's project with a score above 0.

    questions: question_id, project_id, question. Three times the shared words of path and question, twice those of names and of imports, once each word that stands in the content; floors for data bases and for a path that is mentioned.
    Joined on the project, so a question meets only its own files; the questions are the smaller side and Spark may broadcast them by their size.
    """
    q = questions.select("question_id", "project_id", F.lower("question").alias("asked"), text.question_tokens(F.col("question")).alias("q"))
    n = names.groupBy("project_id", F.col("file").alias("path")).agg(F.collect_set(F.lower("name")).alias("names"))
    i = imports.groupBy("project_id", F.col("file").alias("path")).agg(F.array_distinct(F.flatten(F.collect_list(text.question_tokens(F.col("module"))))).alias("imported"))
    f = files.join(n, ["project_id", "path"], "left").join(i, ["project_id", "path"], "left")
    stem = F.regexp_replace(paths.base_name(F.col("path")), r"\.[^.]*$", "")
    f = f.withColumn("stem", stem).withColumn("path_tokens", text.question_tokens(F.regexp_replace("stem", "[_-]", " ")))
    j = f.join(q, "project_id")
    shared = lambda c: F.coalesce(F.size(F.array_intersect("q", c)), F.lit(0))
    common = lambda c: F.when(F.col(c).isNull(), 0).otherwise(shared(F.col(c)))
    low = F.lower(F.coalesce("content", F.lit("")))
    inside = F.size(F.filter("q", lambda t: low.contains(t)))
    base = 3 * common("path_tokens") + 2 * common("names") + 2 * common("imported") + F.when(low != "", inside).otherwise(0)
    data = F.arrays_overlap("q", F.array(*map(F.lit, DB_WORDS))) & (low != "")
    marks = F.lit(False)
    for m in DB_MARKS:
        marks = marks | low.contains(m)
    score = F.greatest(base, F.when(data & F.lower("stem").isin(*DB_STEMS), 8).otherwise(0), F.when(data & marks, 7).otherwise(0), F.when(F.col("asked").contains(F.lower("path")) & (F.col("path") != ""), 10).otherwise(0))
    return j.select("question_id", "project_id", "path", "file_ord", score.cast("int").alias("score")).where("score > 0")


def path_mentions(texts: DataFrame, files: DataFrame, keep: list[str]) -> DataFrame:
    """(project_id, keep, path): each path of files that stands somewhere in a text (project_id, keep, text) of its project, case aside; no row for null or "".

    A large project has too many paths to try each on each text. A path is cut at its marks (what is no letter, digit or "_"): where it stands, the marks in it follow each
    other in the text, its head ends the word before the first and its tail begins the word after the last. So a project's marks with the lengths
    of head and tail give the few pieces of a text that can be paths, and these are joined with the paths by equality. A path without marks can be any piece of its length of a word.
    """
    word, mark = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    p = files.select("project_id", "path").where("path <> ''").distinct().withColumn("piece", F.lower("path"))
    marks = lambda c: F.regexp_replace(c, word + "+", "")
    head, tail = F.length(F.regexp_extract("piece", f"^{word}*", 0)), F.length(F.regexp_replace("piece", f"(?s)^.*{mark}", ""))
    forms = p.select("project_id", marks(F.col("piece")).alias("marks"), head.alias("head"), tail.alias("tail")).groupBy("project_id", "marks").agg(F.collect_set(F.struct("head", "tail")).alias("ends"))
    forms = forms.groupBy("project_id").agg(F.collect_list(F.struct("marks", "ends")).alias("forms"))
    # Every word of a text with the mark after it; one mark is set after the last word.
    low = F.lower("text")
    t = texts.where("text <> ''").select("project_id", *keep, marks(low).alias("_marks"), F.regexp_extract_all(F.concat(low, F.lit("\n")), F.lit(f"{word}*{mark}"), F.lit(0)).alias("_words"))

    def pieces(form: Column) -> Column:
        n = F.length(form["marks"])
        fits = lambda k: F.filter(form["ends"], lambda e: (e["head"] < F.length(F.get("_words", k - 1))) & (e["tail"] < F.length(F.get("_words", k + n - 1))))
        between = lambda k: F.array_join(F.slice("_words", k + 1, n - 1), "")
        piece = lambda k, e: F.concat(F.substring(F.get("_words", k - 1), -1 - e["head"], e["head"] + 1), between(k), F.substring(F.get("_words", k + n - 1), F.lit(1), e["tail"]))
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_marks") - n + 1)), lambda k: F.substring("_marks", k, n) == form["marks"])
        return F.flatten(F.transform(places, lambda k: F.transform(fits(k), lambda e: piece(k, e))))

    def parts(form: Column) -> Column:
        of = lambda w, e: F.transform(F.sequence(F.lit(1), F.length(w) - e["head"]), lambda k: F.substring(w, k, e["head"]))
        return F.flatten(F.transform("_words", lambda w: F.flatten(F.transform(F.filter(form["ends"], lambda e: e["head"] < F.length(w)), lambda e: of(w, e)))))

    seen = F.filter("forms", lambda f: F.contains("_marks", f["marks"]))
    found = F.flatten(F.transform(seen, lambda f: F.when(f["marks"] == "", parts(f)).otherwise(pieces(f))))
    could = t.join(forms, "project_id").select("project_id", *keep, F.explode(F.array_distinct(found)).alias("piece"))
    return could.join(p, ["project_id", "piece"]).select("project_id", *keep, "path").distinct()


def top(ranked: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each partition to k before the exchange."""
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def expanded(seeds: DataFrame, edges: DataFrame, files: DataFrame, total: int = TOTAL) -> DataFrame:
    """Seeds (question_id, project_id, path, score, place) and the files next to them at half the score, ``total`` in all, the first seen first."""
    near = neighbours(edges).select("project_id", "path", "related")
    exist = files.select("project_id", F.col("path").alias("related")).distinct()
    added = seeds.join(near, ["project_id", "path"]).join(exist, ["project_id", "related"], "left_semi")
    first = added.groupBy("question_id", "project_id", "related").agg(F.min(F.struct("place", "score")).alias("m"))
    new = first.join(seeds.select("question_id", F.col("path").alias("related")), ["question_id", "related"], "left_anti")
    new = new.select("question_id", "project_id", F.col("related").alias("path"), F.round(F.col("m.score") * 0.5, 2).alias("score"), (1000 + F.col("m.place")).alias("seen"))
    rows = seeds.select("question_id", "project_id", "path", F.col("score").cast("double").alias("score"), F.col("place").alias("seen")).unionByName(new)
    kept = top(rows, ["question_id"], ["seen", "path"], total)
    return kept.select("question_id", "project_id", "path", "score", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "seen", "path")).cast("int").alias("place"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, floor: float | None = None, over: int | None = None) -> DataFrame:
    """(query_id, vec_id, label, place, similarity): exact top-k of each query against all rows; with ``over`` as many are taken first, then those under the floor go, then k stay.

    The queries are literals, so every row is scored in one pass; each partition keeps ``over`` rows per query before the exchange.
    """
    q = F.array(*[F.struct(F.lit(i).cast("bigint").alias("query_id"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for i, v in queries])
    scored = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "label", "embedding", F.inline(q)).select("query_id", "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("v")), 6).alias("similarity"))
    taken = top(scored, ["query_id"], [F.desc("similarity"), "vec_id"], over or k)
    if floor is not None:
        taken = taken.where(F.col("similarity") >= floor)
    return taken.where(F.col("place") <= k) if not over else top(taken.drop("place"), ["query_id"], [F.desc("similarity"), "vec_id"], k)
