"""Source files that nobody in the project wrote by hand: generated, minified, vendored, or data stored as code.

Each text becomes a row of numbers: compression ratio, token entropy, identifier lengths, comment density, line shapes, share of
literals, what its path says, and how much of it stands in a known third-party release. A random forest is trained on rows labelled by
header notices ("generated by", minifiers' banners, authors and licence of another project). The notices are cut away before the
features are taken, so the forest finds the same kinds of files without them. Copied-in releases and bodies of data seldom bear notices;
texts that mostly stand in a release, and those that are nearly all literals, are labelled too. Many files of these kinds have lost their notice and stand among the unlabelled rows (learning
from positive and unlabelled rows). So the forest is trained twice: first with all unlabelled rows as hand-written, then without those among them
that score like labelled rows it was not trained on. A file is found if the second forest finds it or if it is labelled.

The training rows are a sample of bounded size (``bound``); the forest then reads every file. Features are written to the checkpoint folder once.
Defined cases: null, empty and blank contents and files of no source language are never cases; without a single labelled row
there is no finding; copies count each for themselves; very long texts are read in whole; an empty release table is allowed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.validity import language_of
from orelode.session import cut_lineage, spread
from orelode.sources.tables import small_rows

#: Rows that the forest is trained on, at most (of about half of it labelled rows, as far as there are any).
BOUND = 20_000
#: Words in a shingle, and the share of a text's shingles in one release from which it is labelled a copy.
SHINGLE, COPIED = 5, 0.8
#: A text of at least BODY characters is labelled a body of data from this share of literal characters on, or from the lower one if hardly any token is a name.
LITERALS, FEW_NAMES, NAMES, BODY = 0.8, 0.5, 0.05, 1_000

#: Share of labelled rows that may score lower than an unlabelled row that is left out of the second training.
MIXED = 0.05
#: The first forest's score beyond which an unlabelled row is never taken for hand-written, and the second's from which a file is found.
DOUBT, CUT = 0.12, 0.3

_HEAD = re.compile(r"\A﻿?(?:#![^\n]*\n)?\s*((?:(?:#|//)[^\n]*(?:\n\s*|\Z)|/\*(?:[^*]|\*(?!/))*\*/\s*)+)")
_NOTICE = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated (?:with|by|from|file|code)|\b(?:code |file )?generated (?:by|with|from|using) (?!hand)[\w@]|do not (?:edit|modify)(?: this file)?(?: by hand)?[.!\s]*$|\bthis file (?:is|was) (?:auto-?)?generated"
    r"|\bmachine[ -](?:made|generated|written)\b|\bautomatisch (?:erzeugt|generiert|erstellt)|\bnicht von hand (?:bearbeiten|ändern)|\b(?:fichier |code )?(?:généré|produit) (?:par|automatiquement)|\bne pas (?:modifier|éditer)"
    r"|\b(?:archivo |código )?(?:generado|producido) (?:por|automáticamente)|\bno (?:editar|modificar)\b"
    r"|\bsource ?mapping ?url=|^/\*!.*\|.*\*/|\(c\) the .{1,60} (?:authors|contributors)|@licen[cs]e\b|SPDX-License-Identifier|\bminified (?:by|with)\b", re.M,
)
_FOOT = re.compile(r"((?:(?:^|\n)[ \t]*(?:#|//)[^\n]*|(?:^|\n)[ \t]*/\*(?:[^*]|\*(?!/))*\*/)+)\s*\Z")
_MAP = re.compile(r"(?://|/\*)[#@]\s*sourceMappingURL=[^\n]*\s*\Z")
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_$\u0080-￿][\w$]*|\d[\w.]*|\S")
_COMMENT = re.compile(r"(?m)^[ \t]*(?:#(?!include|define|if|endif|pragma|else)|//)[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|[ \t](?:# |// )[^\n]*|^[ \t]*\"\"\"[\s\S]*?\"\"\"")
_WORD = re.compile(r"[A-Za-z_$\u0080-￿][\w$]*")
_SKELETON = re.compile(r"[A-Za-z_$\u0080-￿][\w$]*|\"[^\"\n]*\"|'[^'\n]*'")
_VENDOR = frozenset("vendor _vendor vendored third_party third-party thirdparty external extern externals node_modules bower_components contrib deps site-packages".split())
_BUILT = frozenset("dist build out target static public bin release".split())
_GENERATED = frozenset("generated gen autogen __generated__ generated_src".split())
_NAME = re.compile(r"(?i)(?P<min>[.\-_]min\.\w+$|[.\-](?:bundle|chunk|prod)\.\w+$|\.[0-9a-f]{5,20}\.\w+$)|(?P<gen>_pb2(?:_grpc)?\.|\.pb\.|\.g\.|\.designer\.|[._](?:auto)?gen(?:erated)?\.|[._]tab\.|^(?:moc|ui)_)|(?P<version>\d+\.\d+(?:\.\d+)?)")

FEATURES = [
    "compression", "entropy", "evenness", "distinct", "mean_name", "short_names", "long_names", "comments", "mean_line", "max_line", "blank_lines", "spaces", "digits", "literals", "words",
    "skeletons", "top_skeleton", "indented", "log_size", "semicolons_a_line", "longest_literal", "path_vendor", "path_built", "path_generated", "name_min", "name_gen", "name_version", "name_as_folder", "vendored_name", "copied", "covers",
]
SCHEMA = "file_id bigint, labelled boolean, " + ", ".join(f"{f} double" for f in FEATURES)


class Releases:
    """The shingles of known releases."""

    def __init__(self, texts: list[str]):
        self.holders: dict[int, list[int]] = defaultdict(list)
        self.sizes: list[int] = []
        for k, t in enumerate(texts):
            grams = self.shingles(t)
            self.sizes.append(len(grams))
            for g in grams:
                self.holders[g].append(k)

    @staticmethod
    def shingles(text: str) -> set[int]:
        ws = _WORD.findall(text)
        return {hash(g) for g in zip(*(ws[i:] for i in range(SHINGLE)))}

    def best(self, text: str) -> tuple[float, float]:
        """(share of the text's shingles in one release, share of that release's shingles in the text), the best release."""
        holders = self.holders
        if not holders:
            return 0.0, 0.0
        grams = self.shingles(text)
        found = Counter(k for g in grams if g in holders for k in holders[g])
        if not found:
            return 0.0, 0.0
        return max((n / len(grams), n / self.sizes[k]) for k, n in found.items())


def split_notice(text: str) -> tuple[bool, str]:
    """(whether a notice stands at the head or end, the text without the comments there)."""
    head = _HEAD.match(text)
    body = text[head.end():] if head else text
    tail = _MAP.search(body, max(0, len(body) - 4000))
    body = body[: tail.start()] if tail else body
    foot = _FOOT.search(body, max(0, len(body) - 1000))
    body = body[: foot.start()] if foot else body
    return bool(tail or head and _NOTICE.search(head[1]) or foot and _NOTICE.search(foot[1])), body


def features(path: str, text: str, releases: Releases) -> tuple[bool, list[float]]:
    """(labelled, the values of FEATURES)."""
    noticed, body = split_notice(text)
    n = max(1, len(body))
    data = body.encode("utf-8", "replace")
    tokens = _TOKEN.findall(body)
    count = Counter(tokens)
    total = max(1, len(tokens))
    entropy = -sum(c / total * math.log2(c / total) for c in count.values()) if tokens else 0.0
    names = {t: c for t, c in count.items() if t[0].isalpha() or t[0] in "_$"}
    named = max(1, sum(names.values()))
    strings = sum(len(t) * c for t, c in count.items() if t[0] in "\"'" or t[0].isdigit())
    visible = max(1, sum(len(t) * c for t, c in count.items()))
    lines = body.split("\n")
    full = [x for x in lines if x.strip()]
    shapes = Counter(re.sub(r"\d+", "0", _SKELETON.sub("x", x.strip()))[:80] for x in full)
    parts = path.lower().replace("\\", "/").split("/")
    file, folders = parts[-1], set(parts[:-1])
    groups = {k for m in _NAME.finditer(file) for k, v in m.groupdict().items() if v}
    named_so = float(any(re.split(r"[.\-]", file)[0] == re.split(r"[.\-]", x)[0] for x in parts[-3:-1]))
    copied, covers = releases.best(body)
    literals = strings / visible
    row = [
        len(zlib.compress(data, 6)) / max(1, len(data)), entropy, entropy / max(1.0, math.log2(total)), len(count) / total, sum(len(t) * c for t, c in names.items()) / named,
        sum(c for t, c in names.items() if len(t) <= 2) / named, sum(c for t, c in names.items() if len(t) >= 14) / named, sum(m.end() - m.start() for m in _COMMENT.finditer(body)) / n,
        min(2000.0, n / len(lines)), math.log2(1 + max(map(len, lines))), 1 - len(full) / len(lines), (n - visible) / n, sum(map(body.count, "0123456789")) / n, literals, named / total,
        len(shapes) / max(1, len(full)), max(shapes.values(), default=0) / max(1, len(full)), sum(1 for x in full if x[0] in " \t") / max(1, len(full)), math.log2(n), body.count(";") / max(1, len(full)),
        math.log2(1 + max((len(t) for t in count if t[0] in "\"'"), default=0)), float(bool(folders & _VENDOR)), float(bool(folders & _BUILT)), float(bool(folders & _GENERATED)), float("min" in groups),
        float("gen" in groups), float("version" in groups), named_so, float(named_so and bool(folders & _VENDOR)), copied, covers,
    ]
    return noticed or copied >= COPIED or covers >= COPIED or n >= BODY and (literals >= LITERALS or literals >= FEW_NAMES and named <= NAMES * total), row


def _run(texts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        releases = Releases(texts)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                got = [features(p or "", t.as_py(), releases) for p, t in zip(part.column(1).to_pylist(), part.column(2))]
                columns = list(zip(*(row for _, row in got)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([k for k, _ in got], pa.bool_()), *[pa.array(c, pa.float64()) for c in columns]], ["file_id", "labelled", *FEATURES])

    return run


def file_features(files: DataFrame, releases: DataFrame) -> DataFrame:
    """The features of every file of a source language with a text (SCHEMA)."""
    texts = [r[0] for r in small_rows(releases.where("content <> ''").select("content"))]
    # `hash` of a string differs between processes, so shingles are only compared within one worker
    need = files.select(F.col("file_id").cast("bigint"), F.col("path").cast("string"), "content").where(F.col("content").rlike(r"\S") & language_of(files["language"]).isNotNull())
    return spread(need).mapInArrow(_run(texts), SCHEMA)


def find_unwritten(files: DataFrame, releases: DataFrame, bound: int = BOUND, trees: int = 40, depth: int = 12, seed: int = 7) -> DataFrame:
    """(file_id, labelled, score, unwritten) of every file of a source language with a text."""
    rows = cut_lineage(file_features(files, releases))
    counts = rows.groupBy().agg(F.count_if("labelled").alias("yes"), F.count("*").alias("all")).first()
    yes, no = counts["yes"] or 0, (counts["all"] or 0) - (counts["yes"] or 0)
    if not yes or not no:
        return rows.select("file_id", "labelled", F.lit(float(bool(yes))).alias("score"), F.col("labelled").alias("unwritten"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    place = F.pmod(F.xxhash64("file_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("labelled"), min(1.0, bound / 2 / yes)).otherwise(min(1.0, bound / 2 / no))
    held = F.pmod(F.xxhash64("file_id"), F.lit(5)) == 0
    known = vectors.where(place < share).select(F.col("labelled").cast("double").alias("label"), "features", held.alias("held"))
    # classes weigh as they occur among all files, whatever their shares in the sample
    known = known.withColumn("weight", F.when(F.col("label") > 0, yes / max(1.0, min(yes, bound / 2))).otherwise(no / max(1.0, min(no, bound / 2))))
    known = cut_lineage(known)
    score = vector_to_array("probability")[1]

    def fit(sample: DataFrame):
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", maxMemoryInMB=512).fit(sample)

    # first all unlabelled rows count as hand-written; then those among them that score like labelled rows are left out
    first = fit(known.where("not held"))
    low = first.transform(known.where("held and label > 0")).select(F.percentile(score, F.lit(MIXED)).alias("low")).first()["low"]
    doubtful = min(DOUBT, max(DOUBT / 3, low if low is not None else DOUBT))
    sure = first.transform(known).where((F.col("label") > 0) | (score < doubtful)).select("label", "features", "weight")
    sure = sure.withColumn("weight", F.when(F.col("label") > 0, 1.0).otherwise(F.col("weight")))
    model = fit(sure)
    return model.transform(vectors).select("file_id", "labelled", F.round(score, 6).alias("score"), (F.col("labelled") | (score >= CUT)).alias("unwritten"))
