"""Statistics of each document's text, and whether it is mostly running prose.

A text is cut into segments: runs of lines of one shape (plain, bullet, delimited, short, indented) without a blank line
between. Each segment's distribution over word classes (function words, other short and long words, numbers, mixed
tokens, repeats) and over character classes is compared by Jensen-Shannon divergence with profiles of prose of each
language and of the structures that exports bring along; the nearest profile is assigned. A text is prose if segments
with a prose profile hold at least half of its visible characters.

No shuffle and no model file: one pass. Defined cases: a null or blank text has zero counts, profile 'empty' and is neither
prose nor a finding; copies count each for themselves; very long texts are read in whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from orelode.session import spread

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or but if of to in on at by for from with without about into over after before until since as than that this these those it its is are was were be been being has have had do does did not no nor so too very can could will would should may might must there here when where which who whom whose what why how we you they he she i me us them him her our your their my his one only also just more most some any each every all both few many much such own same other another up down out off then once still even yet again because while between through during under above us let says said",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn von zu zum zur in im ins an am auf bei mit ohne für aus nach vor über unter zwischen durch gegen seit bis als wie dass daß dies diese dieser dieses diesem diesen es ist sind war waren wird werden wurde wurden sein hat haben hatte hatten nicht kein keine keinen nur auch noch schon sehr so zu man er sie wir ihr ich mich uns ihn ihm ihnen sich was wer wo wann warum weil da dann denn doch mehr etwa sollte kann können muss müssen jeden jede jeder alle alles bevor zumindest gibt bitte ob um damit sowie siehe",
    "fr": "le la les l un une des du de d et ou mais si que qui quoi dont où à au aux en dans sur sous par pour avec sans chez vers entre avant après depuis comme plus moins très ne pas ni ce cet cette ces c il elle ils elles on nous vous je tu me te se s lui leur y est sont était étaient être été a ont avait avoir fait son sa ses mon ma mes notre nos votre vos quand pourquoi comment parce qu n j aussi même tout tous toute toutes chaque autre trop peut doit faut jusque lors selon",
    "es": "el la los las lo un una unos unas de del y e o u pero si que quien cual donde cuando como a al en con sin por para sobre entre desde hasta hacia antes después más menos muy no ni este esta estos estas ese esa eso esto es son era eran ser sido está están estaba ha han había haber hay se su sus mi mis nos nuestro nuestra le les me te yo tú él ella ellos ellas ya también porque cada todo toda todos todas otro otra demasiado nadie según sea fue",
    "it": "il lo la gli le un uno una di del della dei delle a al alla da dal in nel nella con su per tra fra e o ma se che chi cui non è sono era erano essere stato ha hanno aveva si suo sua suoi mi ti ci vi questo questa quello più meno molto come quando dove perché anche ogni tutto tutti dopo prima",
    "pt": "o a os as um uma de do da dos das em no na nos nas por para com sem e ou mas se que quem não é são era ser foi tem há ao aos à sua seu mais menos muito como quando onde porque também cada todo todos já depois antes até",
    "sv": "och att det som en på är av för med den till inte om ett men de var jag har kan vi så från när hur då där eller efter utan över under ska ingen mer bara också",
    "fi": "ja on ei se että oli en mutta joka kun niin ovat tai jos hän kuin myös ole mitä vain sen ne me minä tämä siitä ennen jälkeen kanssa ilman ollut voi",
    "pl": "i w na z się nie to że do jest od za o jak po co ale czy przez dla już tylko być był była są może które który która gdy przed bez bardzo jego",
    "cs": "a v na se je že to s z o do ale jako za k od po pro tak byl byla jsou nebo který která které když před bez už jen není být by ze ve",
    "ru": "и в не на я что с он а по это как но из у за то от для до мы к бы о же она они так его если когда или только уже нет без при после был была было были есть чтобы где",
    "tr": "ve bir bu da de için ile çok ama daha olarak gibi ne o kadar sonra var yok her mi ya en olan değil ki",
    "nl": "de het een en of maar als van naar in op bij met zonder voor uit na over onder door tot dat die dit deze er is zijn was waren wordt worden werd niet geen ook nog al zeer zo je hij zij wij ik we ze wat wie waar wanneer waarom omdat meer kan moet heeft hebben had",
}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_SETS.values())

# Character classes: letters, capitals, digits, white space, sentence marks, marks of lists and tables, other marks, other letters, odd.
_KINDS = "lUd s,|#xo"


class _Classes(dict):
    def __missing__(self, o: int) -> str:
        c = chr(o)
        if c.isalpha():
            k = "x" if c in "ÃÂðŸ" else "U" if c.isupper() else "l"
        elif c.isdigit():
            k = "d"
        elif c.isspace():
            k = " "
        elif c in ".,;:!?'\"()-’‘“”…–—«»¿¡，。、；：？！（）":
            k = ","
        elif c in "|\t•*+=_~/\\<>[]{}#@$%^&`":
            k = "#"
        else:
            k = "o"
        self[o] = k
        return k


_CLASS = _Classes()
_CLASS.update({9: "|", 124: "|"})
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"\S+")

# Profiles. Words: function, short, long, number, mixed token, repeat. Characters: lower, capital, digit, space, sentence mark, delimiter, symbol, foreign letter, odd.
# The prose profiles of en, de, fr and es are means over running text of each language (11,546, 1,528, 1,544 and 1,089 segments of more than 150 characters, from
# documents all of whose segments were prose); the one without a language stands for the others, whose function words are counted too.
PROFILES = {
    "prose_en": ((0.507, 0.346, 0.135, 0.012, 0.001, 0.0), (0.78, 0.011, 0.005, 0.184, 0.019, 0.0, 0.001, 0.0, 0.0)),
    "prose_de": ((0.482, 0.222, 0.273, 0.024, 0.0, 0.0), (0.761, 0.042, 0.01, 0.159, 0.027, 0.0, 0.001, 0.0, 0.0)),
    "prose_fr": ((0.481, 0.261, 0.23, 0.027, 0.0, 0.0), (0.779, 0.013, 0.012, 0.166, 0.03, 0.0, 0.001, 0.0, 0.0)),
    "prose_es": ((0.481, 0.303, 0.188, 0.027, 0.001, 0.0), (0.773, 0.014, 0.012, 0.173, 0.026, 0.0, 0.001, 0.0, 0.0)),
    "prose": ((0.44, 0.27, 0.22, 0.02, 0.03, 0.02), (0.79, 0.02, 0.01, 0.16, 0.02, 0.0, 0.0, 0.0, 0.0)),
    "prose_terse": ((0.27, 0.30, 0.33, 0.03, 0.05, 0.02), (0.77, 0.03, 0.01, 0.15, 0.03, 0.0, 0.01, 0.0, 0.0)),
    "terms": ((0.03, 0.50, 0.40, 0.02, 0.03, 0.02), (0.85, 0.01, 0.0, 0.13, 0.0, 0.0, 0.01, 0.0, 0.0)),
    "list": ((0.03, 0.33, 0.26, 0.20, 0.16, 0.02), (0.63, 0.02, 0.09, 0.19, 0.04, 0.0, 0.03, 0.0, 0.0)),
    "table": ((0.01, 0.16, 0.14, 0.40, 0.19, 0.10), (0.36, 0.01, 0.29, 0.17, 0.05, 0.12, 0.01, 0.0, 0.0)),
    "log": ((0.04, 0.14, 0.15, 0.04, 0.60, 0.03), (0.46, 0.07, 0.24, 0.11, 0.08, 0.0, 0.04, 0.0, 0.0)),
    "code": ((0.10, 0.18, 0.17, 0.05, 0.48, 0.02), (0.60, 0.04, 0.04, 0.18, 0.08, 0.0, 0.06, 0.0, 0.0)),
    "encoded": ((0.0, 0.02, 0.08, 0.0, 0.90, 0.0), (0.40, 0.41, 0.15, 0.01, 0.0, 0.0, 0.03, 0.0, 0.0)),
    "ruler": ((0.0, 0.0, 0.0, 0.0, 0.60, 0.40), (0.0, 0.0, 0.0, 0.10, 0.45, 0.0, 0.45, 0.0, 0.0)),
    "repeats": ((0.03, 0.02, 0.02, 0.0, 0.0, 0.93), (0.84, 0.01, 0.01, 0.13, 0.01, 0.0, 0.0, 0.0, 0.0)),
    "garbled": ((0.02, 0.30, 0.20, 0.0, 0.48, 0.0), (0.45, 0.02, 0.02, 0.15, 0.01, 0.0, 0.02, 0.20, 0.13)),
    "titles": ((0.12, 0.42, 0.40, 0.0, 0.02, 0.04), (0.66, 0.15, 0.0, 0.18, 0.01, 0.0, 0.0, 0.0, 0.0)),
}
PROSE = ("prose_en", "prose_de", "prose_fr", "prose_es", "prose", "prose_terse", "prose_other")


def _h(p) -> float:
    return -sum(x * math.log2(x) for x in p if x > 0)


_PREPARED = [(name, w, c, _h(w), _h(c)) for name, (w, c) in PROFILES.items()]


def divergence(p, hp: float, q, hq: float) -> float:
    """Jensen-Shannon divergence in bits of two distributions with known entropies."""
    return max(0.0, _h([(a + b) / 2 for a, b in zip(p, q)]) - (hp + hq) / 2)


_BULLET = re.compile(r"[ \t]*(?:[-*+•–▪◦‣]|\(?\d{1,4}[.)]|[a-zA-Z][.)])[ \t]+")
_QUOTE = re.compile(r"(?:[ \t]*>)+[ \t]?")


def _shape(line: str) -> str:
    if _BULLET.match(line):
        return "bullet"
    if line.count("\t") + line.count("|") + line.count(";") + line.count(",") >= 3 and (
        line.count("\t") >= 2 or line.count("|") >= 2 or line.count(" ") * 2 <= line.count(";") + line.count(",")
    ):
        return "delimited"
    if line.startswith(("    ", "\t", "  File ", "Traceback ")):
        return "indented"
    return "plain"


def segments(text: str) -> Iterator[tuple[str, str]]:
    """(shape, segment) of each run of lines of one shape; marks of quotation are taken off."""
    shape, lines = "", []
    for line in text.splitlines():
        if line[:1] == ">" or line[:2] == " >":
            line = _QUOTE.sub("", line, count=1)
        now = _shape(line) if line.strip() else ""
        if now != shape:
            if lines and shape:
                yield shape, "\n".join(lines)
            shape, lines = now, []
        if now:
            lines.append(line)
    if lines and shape:
        yield shape, "\n".join(lines)


def profile(shape: str, segment: str) -> tuple[str, float, int]:
    """Nearest profile of a segment, its divergence, and the segment's visible characters."""
    kinds = segment.translate(_CLASS)
    if kinds.count("U") > kinds.count("l"):  # oddly set: all in capitals
        kinds = segment.lower().translate(_CLASS)
    n = len(kinds)
    chars = [kinds.count(k) / n for k in ("l", "U", "d", " ", ",", "|", "#", "x", "o")]
    visible = n - kinds.count(" ")
    tokens = segment.lower().split()
    words = _WORD.findall(segment.lower())
    total = len(tokens)
    seen = Counter(words)
    # the three most frequent of the other words count as repeats as far as they are more than a fifth of the words each
    often = sum(max(0, c - max(3, len(words) // 5)) for _, c in seen.most_common(3))
    function = sum(c for w, c in seen.items() if w in _ANY)
    alone = [t.strip(".,;:!?'\"()*_`’‘“”…«»¿¡，。；：？！-") for t in tokens]
    plain = sum(1 for t in alone if t.isalpha() or t.replace("'", "").replace("’", "").replace("-", "").replace("_", "").isalpha())
    numbers = sum(1 for t in alone if t and not t.strip("0123456789.,%+-:"))
    mixed = max(0, total - plain - numbers)
    function = min(function, plain)
    content = max(0, plain - function)
    long = min(content, sum(c for w, c in seen.items() if len(w) > 6 and w not in _ANY))
    often = min(often, plain)
    left = max(1, total)
    ws = [max(0, function - often * function / max(1, plain)) / left, (content - long) * (1 - often / max(1, plain)) / left, long * (1 - often / max(1, plain)) / left, numbers / left, mixed / left, often / left]
    s = sum(ws) or 1
    ws = [x / s for x in ws]
    if len(_CJK.findall(segment)) > 0.3 * visible:  # scripts written without spaces: sentences tell prose from lists and tables
        if shape == "delimited":
            return "table", 0.0, visible
        marks = sum(segment.count(c) for c in "。！？!?.،")
        return ("prose" if marks * 80 >= visible and (shape != "bullet" or visible > 15 * (segment.count("\n") + 1)) else "list"), 0.0, visible
    hw, hc = _h(ws), _h(chars)
    best, name = min((1.5 * divergence(ws, hw, w, a) + divergence(chars, hc, c, b), k) for k, w, c, a, b in _PREPARED)
    if name == "terms" and _foreign(segment, function, len(words)):
        name = "prose_other"
    if name in PROSE and (shape == "delimited" or shape == "bullet" and total / (segment.count("\n") + 1) < 7):
        name = "table" if shape == "delimited" else "list"
    return name, best, visible


_SENTENCE = re.compile(r"[^\W\d_][.!?]+(?=\s|$)")


def _foreign(segment: str, function: int, words: int) -> bool:
    """Whether a text of hardly any known function word is running prose of some other language: letters beyond ASCII, and sentences of 3 to 40 words that begin with capitals."""
    if words < 5 or function > 0.2 * words or sum(1 for c in segment if c.isalpha() and ord(c) > 127) < 0.02 * len(segment):
        return False
    ends = len(_SENTENCE.findall(segment))
    return 3 * ends <= words <= 40 * ends and segment.count(",") <= 0.2 * words


NAMES = ["doc_id", "chars", "words", "lines", "mean_word_length", "symbol_ratio", "digit_ratio", "share_lines_end_punctuated", "share_common_words", "share_bullet_lines", "share_repeated_lines", "prose_share", "profile", "divergence", "language", "is_prose"]
SCHEMA = (
    "doc_id bigint, chars bigint, words bigint, lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, "
    "share_lines_end_punctuated double, share_common_words double, share_bullet_lines double, share_repeated_lines double, "
    "prose_share double, profile string, divergence double, language string, is_prose boolean"
)
_TYPES = [pa.int64()] * 4 + [pa.float64()] * 8 + [pa.string(), pa.float64(), pa.string(), pa.bool_()]
_END = tuple(".!?…:;\"'”’)»。！？")


def statistics(text: str | None) -> tuple:
    """The values of NAMES but the id for one text."""
    if text is None or not text.strip():
        return (len(text or ""), 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "empty", 0.0, None, False)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    words = _WORD.findall(text.lower())
    seen = Counter(words)
    n, kinds = len(words), text.translate(_CLASS)
    common = {k: sum(seen[w] for w in seen.keys() & s) for k, s in _SETS.items()}
    language = max(common, key=common.get)
    by: Counter = Counter()
    far, all_ = 0.0, 0
    for shape, segment in segments(text):
        name, d, visible = profile(shape, segment)
        by[name] += visible
        far += d * visible
        all_ += visible
    prose = sum(by[k] for k in PROSE) / max(1, all_)
    rest = {k: v for k, v in by.items() if (k in PROSE) == (prose >= 0.5)}
    return (
        len(text), n, len(lines), sum(len(w) * c for w, c in seen.items()) / max(1, n), (kinds.count("#") + kinds.count("|") + kinds.count("o")) / len(text),
        kinds.count("d") / len(text), sum(x.endswith(_END) for x in lines) / len(lines), common[language] / max(1, n),
        sum(1 for x in lines if _BULLET.match(x + " ")) / len(lines), 1 - len(set(lines)) / len(lines), prose, max(rest, key=rest.get) if rest else "empty", far / max(1, all_),
        language if common[language] >= 0.05 * n > 0 else None, prose >= 0.5,
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 500):
            part = b.slice(s, 500)
            rows = [(i, *(round(x, 6) if isinstance(x, float) else x for x in statistics(t.as_py()))) for i, t in zip(part.column(0).to_pylist(), part.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], NAMES)


def text_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of statistics for each row of ``documents`` (SCHEMA)."""
    return spread(documents.select(documents[key].cast("bigint").alias("doc_id"), documents[text].alias("text"))).mapInArrow(_run, SCHEMA)
