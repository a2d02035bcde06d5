"""Credentials in source and configuration texts, and the texts with them made unreadable.

A lexical finder: private key blocks, tokens of a known form, logins in addresses and connection strings, and values given to a
credential's name, in quotes anywhere, without quotes in configuration and comments. Literals in base64, hex, percent
or backslash encoding are decoded and searched again. Placeholders, look-ups, names, identifiers, checksums and public keys are left out.

No shuffle: one pass, one text at a time. Defined cases: a null or empty text has no credential; copies count each for themselves;
one row per line; masking replaces each visible character of a secret by one "*", so places and line ends stay.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.session import spread

_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_FORM = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w\-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}\b|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|xox[abeprs]-[A-Za-z0-9\-]{10,}|AIza[\w\-]{35}|SG\.[\w\-]{16,}\.[\w\-]{16,}|npm_[A-Za-z0-9]{36}|qx-[A-Za-z0-9]{6,}-[A-Za-z0-9]{16,}"
    r"|eyJ[\w\-]{8,}\.eyJ[\w\-]{4,}\.[\w\-]{16,})"
)
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,30}://[^\s:/@'\"`<>]*:([^\s/@'\"`]+)@(?=[\w\[$])")
_WORD = (
    r"pass(?:word|wd|phrase|wort|code)?|pwd?|secret|token|api[_\-]?key|access[_\-]?key|account[_\-]?key|private[_\-]?key|sign(?:ing)?[_\-]?(?:key|with)|service[_\-]?key"
    r"|secret[_\-]?key|master[_\-]?(?:key|pw)|encryption[_\-]?key|auth[_\-]?key|shared[_\-]?key|auth|bearer|credentials?|kennwort|contrase(?:na|ña)|clave|senha|mdp|mot[_\-]?de[_\-]?passe|parola|wachtwoord"
)
_NAME = r"(?P<name>[\w\-.$]*?(?:" + _WORD + r")(?:[_\-]?(?:value|val|str|string|prod|dev|key|opts)?[_\-]?\d*))"
_PARAM = re.compile(r"(?i)[?&;]\s*" + _NAME + r"=(?P<v>[^\s&;'\"`<>]+)")
_SCHEME = re.compile(r"(?i)\b(?:bearer|basic|token)\s+(?P<v>[A-Za-z0-9+/=_.\-]{12,})")
#: name, quotes around it or a comment's end, a separator, then a literal
_QUOTED = re.compile(
    r"(?i)(?<![\w\-.$])" + _NAME + r"(?:\[\])?[\"'`]?\s*+(?:\*/|\])?(?:\s*+(?::\s*+[A-Za-z_][\w.<>|\[\] ]{0,30}=(?!=)|=>|:=|=(?!=)|:|,|\()|(?<=\*/))\s*+\(?\s*+"
    r"(?:(?:process\.env\.\w+|os\.environ\.get\([^)\n]*\)|os\.getenv\([^)\n]*\)|System\.getenv\([^)\n]*\))\s*+(?:\|\||\?\?|or)\s*+)?[rbuRBU]?(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])+)(?P=q)"
)
_BARE = re.compile(r"(?im)(?:^|(?<=[\s{,]))(?:export\s+|ENV\s+|ARG\s+|-\s+)?[\"']?" + _NAME + r"[\"']?[ \t]*[:=][ \t]*(?P<v>[^\s'\"`,;][^\s'\"`,;]*)[ \t]*(?:$|(?=[ \t,;#]))")
_SPACED = re.compile(r"(?im)^[ \t]*ENV[ \t]+" + _NAME + r"[ \t]+(?P<v>[^\s'\"=]+)[ \t]*$")
_XML = re.compile(r"(?i)<" + _NAME + r">\s*(?P<v>[^<\s]+)\s*</|name=[\"']" + _NAME.replace("<name>", "<name2>") + r"[\"']\s+value=[\"'](?P<v2>[^\"'\s]+)[\"']")
_OPTION = re.compile(r"(?i)(?<![\w\-])--?" + _NAME + r"[ =](?P<v>[^\s'\"`<>]+)")
#: the value taken where a setting is missing
_DEFAULT = re.compile(r"(?i)(?<![\w\-])" + _NAME + r"[\"'\])]*\s*+(?:\|\||\?\?|\bor\b)\s*+(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])+)(?P=q)")
#: a name and its value as two entries of a list of settings
_PAIR = re.compile(r"(?i)\b(?:key|name)[\"']?\s*:\s*[\"']?" + _NAME + r"[\"']?\s*,?\s*[\"']?value[\"']?\s*:[ \t]*[\"']?(?P<v>[^\s'\"]+)")
#: a password set in a statement to a database
_STATEMENT = re.compile(r"(?i)\b(?:ALTER|CREATE)\s+(?:ROLE|USER|LOGIN)\b[^;\n]{0,200}?\b(?P<name>PASSWORD|IDENTIFIED\s+BY)\s*=?\s*\\?['\"]?(?P<v>[^\s'\"`;\\]+)")
_LOGIN = re.compile(r"(?i)\b(?P<name>auth|credentials?|login)\s*[=(:]\s*\(?\s*[\"'][^\"'\n]+[\"']\s*,\s*[\"'](?P<v>[^\"'\n]+)[\"']")
#: literals side by side or added up, one value in pieces
_PIECE = r"(?:\"(?:\\.|[^\"\n\\])*\"|'(?:\\.|[^'\n\\])*')"
_JOINED = re.compile(_PIECE + r"(?:[ \t]*+(?:\+|\\)?[ \t]*+\r?\n?[ \t]*+(?:\+[ \t]*+)?" + _PIECE + r")+")
_PIECES = re.compile(_PIECE)
_ASSIGNED = re.compile(r"(?i)" + _NAME + r"[\"']?\]?\s*+(?::\s*+[\w.<>\[\] ]{1,30}=|:=|=|:)\s*+\(?\s*+$")
_COMMENT = re.compile(r"^[ \t]*(?:#|//|/?\*|--|;|<!--)[^\n]*|(?<=[ \t;{}])(?://|#) [^\n]*", re.M)
_CONFIG = re.compile(r"(?i)(?:^|/)(?:\.env[^/]*|[^/]*Dockerfile[^/]*|[^/]*\.(?:env|ya?ml|toml|ini|cfg|conf|properties|json|xml|txt|example|tf|tfvars|pem|key))$")
_LITERAL = re.compile(r"(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\]){16,4000})(?P=q)|(?<![\w+/=])(?P<v2>[A-Za-z0-9+/]{24,400}={0,2})(?![\w+/=])")

_NO_NAME = re.compile(
    r"(?i)public|pub[_\-]?key|hash|digest|checksum|sha\d|md5|uuid|fingerprint|separator|delimiter|(?:start|end|begin|stop|pad|eos|bos|unk|mask|next|prev|page|cancel|csrf[_\-]?field)[_\-]?token|label|hint|field|header[_\-]?name|column|prompt|count|length|policy|regex|pattern|author|token(?:izer|s\b)|by[_\-]?pass|compass|passed|passenger|passport|path|url$|file"
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*+|\.{2,}|-+|_+|0+|1234\d*|<.*>|\[.*\]|\{.*\}|%.*%|__.*__|\$.*|none|null|nil|true|false|undefined|user|host|pass\w{0,6}|pwd|secret|token|key|string|str|todo|n/?a|tbd|redacted|hidden|masked|(?:my|the|some|your|an?)[_\- ].*)$"
    r"|change[_\-]?(?:me|this|it)|replace[_\-]?(?:me|this|with)|your[_\-]|[_\-]here\b|set[_\-]?me|fill[_\-]?(?:me|in)|placeholder|dummy|example|sample|redacted|insert[_\-]|xxxx|\*{3,}|\.\.\.|\$\{|\{\{|<[a-z_ \-]+>|%\(|\$\("
)
_LOOKUP = re.compile(r"(?i)^(?:[\w.]*(?:environ|getenv|env|vault|config|settings|secrets?|ssm|keyring|process)[.\[(]|arn:|(?:file|env|vault|ssm|secret|op|ref|https?)://?|/[\w./\-]+$|\./|[a-z_]\w*\(|[a-z_]\w*\[|!(?:[a-z]+|\w+ )$|&|\|$|>$)")
_HASHED = re.compile(r"^(?:\$2[abxy]\$|\$argon2|\$[156]\$|pbkdf2|sha\d+[:$\-]|md5[:$]|\{SHA)|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^data:|^ssh-(?:rsa|ed)|BEGIN (?:PUBLIC|CERT)", re.I)


def secret(value: str) -> bool:
    """Whether a value given to a credential's name may be a working one: no placeholder, look-up, name, hash or sentence."""
    v = value.strip()
    if not 6 <= len(v) <= 4000 or re.search(r"\s", v) or _PLACEHOLDER.search(v) or _LOOKUP.search(v) or _HASHED.search(v):
        return False
    lower, upper, digit = (bool(re.search(c, v)) for c in ("[a-z]", "[A-Z]", r"\d"))
    if digit:
        return (lower or upper) and not re.fullmatch(r"v?\d+(?:\.\d+)+\w*|(?:[A-Za-z_]+\.)+[A-Za-z_]*|(?:[a-z_]+\.)+[a-z_]+\d{1,2}|\d+[a-z]{1,2}|0x[0-9a-fA-F]{1,8}", v)
    if re.search(r"[!@#$%^&*+=?~|]", v):
        return len(v) >= 8 and (lower or upper) and not re.search(r"[(){}\[\]<>]", v)
    turns = len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", v))  # letters only: random, not words
    return lower and upper and v.replace(".", "").isalnum() and (len(v) >= 16 and turns > len(v) / 5 and "." not in v or len(v) >= 12 and turns > len(v) * 0.24)


_STEMS = ("pass", "pw", "secret", "token", "auth", "login", "bearer", "credential", "kennwort", "contrase", "clave", "senha", "mdp", "parola", "wachtwoord")
_KEYS = re.compile(r"(?:api|access|account|private|sign|signing|service|secret|master|encryption|auth|shared)[_\-]?key|sign(?:ing)?[_\-]?with")


def names_in(text: str) -> bool:
    """Whether a credential's name can stand in the text; spares most texts the rules that start from names."""
    low = text.casefold()
    return any(x in low for x in _STEMS) or ("key" in low or "with" in low) and bool(_KEYS.search(low))


def _named(name: str, value: str) -> bool:
    return not _NO_NAME.search(name) and secret(value)


def _decoded(v: str) -> Iterator[str]:
    """What a literal says in a common encoding, if that is readable."""
    raws = []
    if re.fullmatch(r"(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}){6,}", v):
        yield "".join(chr(int(x, 16)) for x in re.findall(r"[0-9a-fA-F]{4}|[0-9a-fA-F]{2}", v.replace("\\x", " ").replace("\\u", " ")))
    if re.fullmatch(r"(?:[0-9a-fA-F]{2}){12,}", v):
        raws.append(bytes.fromhex(v))
    elif re.fullmatch(r"[A-Za-z0-9+/_\-]{16,}={0,2}", v):
        try:
            core = v.rstrip("=")
            raws.append(base64.urlsafe_b64decode(core.replace("+", "-").replace("/", "_") + "=" * (-len(core) % 4)))
        except (binascii.Error, ValueError):
            pass
    if v.count("%") >= 2 and (u := unquote(v)) != v:
        yield u
    for raw in raws:
        if all(32 <= c < 127 or c in (9, 10, 13) for c in raw):
            yield raw.decode("ascii")


def _plain(text: str, config: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of the secret values in readable form, key blocks aside."""
    for m in _FORM.finditer(text):
        if not _PLACEHOLDER.search(m[0][4:]):
            yield m.span()
    for m in _URL.finditer(text):
        if not _PLACEHOLDER.search(m[1]) and not _LOOKUP.search(m[1]) and len(m[1]) >= 4 and not m[1].startswith(("{", "%", "<", ":")):
            yield m.span(1)
    names = names_in(text)
    for p in () if not names else (_PARAM, _QUOTED, _DEFAULT, _OPTION, _STATEMENT, _LOGIN, *((_BARE, _SPACED, _XML, _PAIR) if config else ())):
        for m in p.finditer(text):
            g = m.groupdict()
            n, k = (g["name"], "v") if g.get("v") is not None else (g.get("name2"), "v2")
            if n and _named(n, m[k]):
                yield m.span(k)
    for m in _SCHEME.finditer(text):
        v = m["v"]
        if secret(v) and re.search(r"\d", v) and (m[0][:5].lower() != "basic" or any(":" in x for x in _decoded(v))) and (m[0][:5].lower() != "token" or len(v) >= 20):
            yield m.span("v")
    if names and not config:
        for c in _COMMENT.finditer(text):
            for m in _BARE.finditer(c[0]):
                if _named(m["name"], m["v"]):
                    yield c.start() + m.start("v"), c.start() + m.end("v")


def find(text: str | None, path: str | None = None) -> list[tuple[int, int, int]]:
    """(place that the credential begins at, start, end of what must be hidden), in order, without overlaps."""
    if not text:
        return []
    config = bool(_CONFIG.search(path or ""))
    spans = [(m.start(), *m.span(1)) for m in _BLOCK.finditer(text) if _BODY.search(m[1])]
    spans += [(s, s, e) for s, e in _plain(text, config)]
    for m in _LITERAL.finditer(text):
        k = "v" if m["v"] is not None else "v2"
        if any(_FORM.search(x) or _BLOCK.search(x) or any(True for _ in _plain(x, True)) for x in _decoded(m[k])):
            spans.append((m.start(k), *m.span(k)))
    for m in _JOINED.finditer(text):
        pieces = [(p.start() + 1, p.end() - 1) for p in _PIECES.finditer(text, m.start(), m.end())]
        value = "".join(text[a:b] for a, b in pieces)
        head = _ASSIGNED.search(text, max(0, m.start() - 120), m.start())
        if _FORM.fullmatch(value) and not _PLACEHOLDER.search(value[4:]) or head and _named(head["name"], value):
            spans += [(pieces[0][0], a, b) for a, b in pieces]
    out: list[tuple[int, int, int]] = []
    for at, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if not out or s >= out[-1][2]:
            out.append((at, s, e))
        elif e > out[-1][2]:
            out[-1] = (*out[-1][:2], e)
    return out


def lines_of(text: str | None, path: str | None = None) -> list[int]:
    """Lines, from 1, on which a credential begins."""
    return sorted({text.count("\n", 0, at) + 1 for at, _, _ in find(text, path)})


def mask(text: str | None, path: str | None = None) -> str | None:
    """The text with "*" for each visible character of its credentials."""
    if not (spans := find(text, path)):
        return text
    parts, last = [], 0
    for _, s, e in spans:
        parts += [text[last:s], re.sub(r"\S", "*", text[s:e])]
        last = e
    return "".join([*parts, text[last:]])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, line) for i, p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)) for line in lines_of(t.as_py(), p)]
        if rows:
            ids, lines = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32())], ["file_id", "line"])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 100):
            part = b.slice(s, 100)
            texts = [mask(t.as_py(), p) for p, t in zip(part.column(1).to_pylist(), part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["file_id", "content"])


def find_credentials(files: DataFrame) -> DataFrame:
    """(file_id, line): each line on which a credential begins."""
    need = files.where(F.col("content").isNotNull() & (F.col("content") != "")).select(F.col("file_id").cast("bigint"), "path", "content")
    return spread(need).mapInArrow(_run, "file_id bigint, line int")


def redact(files: DataFrame) -> DataFrame:
    """(file_id, content) of every row of ``files``, credentials masked."""
    return spread(files.select(F.col("file_id").cast("bigint"), "path", "content")).mapInArrow(_mask, "file_id bigint, content string")
