"""Cutting oversized texts at natural boundaries by recursive bisection.

A text longer than the capacity is cut at the strongest boundary near its middle; halves that are still longer than
capacity minus overlap are cut again; then each piece but the first is given the end of the piece before it as overlap.
The parts without their overlaps, put together, are the text again. Lengths are in characters, not bytes.

Defined cases: a null text, an empty one and one within the capacity yield no piece; a text without any boundary is cut
at the middle; "\\r\\n" and a base character with its combining marks are not separated; functions of a file that does not parse are no items.
"""

from __future__ import annotations

import ast
import re
import unicodedata
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.session import spread

# Boundaries from strong to weak: a cut goes to the start of what follows the match.
STRENGTHS = tuple(re.compile(p) for p in (
    r"\n[ \t\r]*\n(?=[^\s])",  # a blank line before something at the margin
    r"\n(?=(?:async def|def|class|function|export|public|private|static|namespace|template|import|@)\b)",
    r"\n[ \t\r]*\n",  # any blank line
    r"\n(?=[^\s)\]}])",  # a line at the margin
    r"\n(?=[ ]{1,4}[^\s)\]}]|\t[^\s)\]}])",  # a line one level in
    r"\n",
    r"[;{}.!?][ \t]+",
    r"[,;:)\]}][ \t]*",
    r"[ \t]+",
))
#: A cut lies in this share of a segment's length on either side of its middle.
REACH = 0.3
#: So many characters beyond the reach are looked at, at most, to recognise a boundary within it.
MARGIN = 400


def _parts(text: str, at: int) -> bool:
    """Whether a cut at this place parts "\\r\\n" or a combining mark from its base."""
    return text[at - 1 : at + 1] == "\r\n" or unicodedata.combining(text[at]) > 0


def _whole(text: str, at: int, low: int, high: int) -> int:
    """The place nearest before at, else after it, that parts nothing; at itself where there is none."""
    return next((x for x in (*range(at, low, -1), *range(at + 1, high)) if not _parts(text, x)), at)


def cut_at(text: str, start: int, end: int) -> int:
    """Where to cut text[start:end]: the strongest boundary near the middle, of equal ones the nearest."""
    middle, reach = (start + end) // 2, int((end - start) * REACH)
    low, high = max(start + 1, middle - reach), min(end - 1, middle + reach)
    # two lines more on either side, so that a boundary at the edge is seen in whole
    first, last = text.rfind("\n", start, text.rfind("\n", start, low) + 1 or low), text.find("\n", high + 1, end)
    first, last = max(start, first, low - MARGIN), min(end, (last if last >= 0 else high) + 2, high + MARGIN)
    for p in STRENGTHS:
        found = (m.end() for m in p.finditer(text, first, last))
        if found := [x for x in found if low <= x <= high and not _parts(text, x)]:
            return min(found, key=lambda x: abs(x - middle))
    return _whole(text, middle, start, end)


def bisect(text: str, capacity: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(start of the overlap, start, end) of each piece, in order; every end - start of the overlap is at most capacity."""
    if not text or len(text) <= capacity:
        return []
    if not 0 <= overlap < capacity:
        raise ValueError("the overlap must be smaller than the capacity")
    room, todo, cores = capacity - overlap, [(0, len(text))], []
    while todo:
        s, e = todo.pop()
        if e - s <= room:
            cores.append((s, e))
        else:
            m = cut_at(text, s, e)
            todo += [(m, e), (s, m)]
    return [(s if not s else _back(text, s, overlap), s, e) for s, e in cores]


def _back(text: str, s: int, overlap: int) -> int:
    """Start of the overlap before s: exactly ``overlap`` characters, fewer only not to part "\\r\\n" or a combining mark."""
    at = max(0, s - overlap)
    while at < s and (text[at - 1 : at + 1] == "\r\n" and at or unicodedata.combining(text[at])):
        at += 1
    return at


_ENDS = re.compile(r"\r\n|\r|\n")


def functions_of(content: str) -> list[tuple[int, str]]:
    """(line of the ``def``, own text) of every function of a Python text; [] if it does not parse.

    A mark of byte order at the start is no fault. A nesting too deep for the parser raises its error instead of losing functions in silence.

    Lines end at "\\n" in the result; the parser also ends lines at a lone "\\r", so its lines are mapped back.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content.removeprefix("\ufeff"))
    except (SyntaxError, ValueError):
        return []
    lines = content.split("\n")
    to = None
    if content.count("\r") != content.count("\r\n"):
        to, n = [1], 1
        for m in _ENDS.finditer(content):
            n += m[0] != "\r"
            to.append(n)
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a, b = (node.lineno, node.end_lineno) if to is None else (to[node.lineno - 1], to[node.end_lineno - 1])
            out.append((a, "\n".join(lines[a - 1 : b])))
    return sorted(out)


PIECE_SCHEMA = "file_id bigint, start_line int, piece_no int, pieces int, char_start bigint, overlap int, n_chars int, piece string"


def _pieces(capacity: int, overlap: int, bodies: bool):
    names = ["file_id", "start_line", "piece_no", "pieces", "char_start", "overlap", "n_chars", "piece"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for fid, text_, python in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                content = text_.as_py()
                for line, text in [(0, content), *(functions_of(content) if python else [])]:
                    cuts = bisect(text, capacity, overlap)
                    out += [(fid, line, i, len(cuts), o, s - o, e - o, text[o:e] if bodies else None) for i, (o, s, e) in enumerate(cuts)]
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def split_oversized(files: DataFrame, capacity: int, overlap: int, bodies: bool = True) -> DataFrame:
    """Pieces of every content, and of every function in a Python content, that is longer than ``capacity`` characters.

    A function is never longer than its file, so the length filter runs before any row reaches Python. No shuffle. One
    content is in memory at a time besides its batch. start_line 0 is the whole content; char_start is where the piece with its
    overlap begins in the item; without ``bodies`` the piece's text is left null.
    """
    python = F.coalesce(F.lower(F.trim("language")) == "python", F.lit(False))
    need = files.where(F.length("content") > capacity).select("file_id", "content", python.alias("python"))
    return spread(need).mapInArrow(_pieces(capacity, overlap, bodies), PIECE_SCHEMA)
