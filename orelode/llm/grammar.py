"""Grammars of JavaScript, TypeScript, Java and C++ that decide whether a text follows them.

A text becomes a string with one letter per token. Brackets are then taken away from the inside out: what stands
between two brackets holds no brackets any more, so there each rule of a language is a regular expression over letters.
A bracketed group becomes one letter that says which roles it can play (parameters, block, object ...), and its surroundings
are tested with that letter. Groups with equal token kinds are tested once per worker. Python has its own parser (``ast``).

Grammar only: unknown names, types, imports and headers are no fault. Rules are wide where only the meaning would tell.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable

import regex

_OPEN = {"(": 0xE000, "[": 0xE400, "{": 0xE800}
_CLOSE = {")": "(", "]": "[", "}": "{"}
_ROLE = re.compile("\\[[\ue000-\uefff\\-]+\\]")
_CHOICE = 0xF000
#: Roles that cannot be played without one of some letters, and roles in which no ";" can stand.
_NEEDS = {"switch": "CX", "module": "EM"}
_ONE_LINE = frozenset("args expr params catch type array index pattern tuple sign object import list names ann any caps attr ptr fold".split())
_RUN = re.compile(r"([^,]{1,24},n?)\1{2,}")
_BRACKETS = re.compile(r"([()\[\]{}])")
#: Entries kept per worker in each table of known tokens and groups; the tables are emptied beyond it.
KNOWN = 100_000


def _role(bracket: str, bit: int) -> str:
    """A class of all letters of groups that can play a role."""
    base, step = _OPEN[bracket], 1 << bit
    return "[" + "".join(f"{chr(base + k)}-{chr(base + k + step - 1)}" for k in range(step, 1024, 2 * step)) + "]"


class Grammar:
    """One language: tokens, kinds of words, rules by bracket and role, and the rule of the whole file."""

    def __init__(self, tokens: str, words: dict[str, str], marks: dict[str, str], rules: dict[str, dict[str, str]], macros: dict[str, str], top: str, prepare: Callable[[str, str], list[str]], cut: str, sequences: tuple[str, ...]):
        self.tokens = re.compile(tokens)
        self.fixed = {w: k for w, k in words.items()} | marks
        self.kinds: dict[str, str] = {}
        self.groups: dict[tuple[str, str], str] = {}
        self.macros = {f"{b}{name}": _role(b, i) for b, rs in rules.items() for i, name in enumerate(rs)} | macros
        flat = [(b, name, r) for b, rs in rules.items() for name, r in rs.items()]
        self.rules = {b: [(chr(_CHOICE + k), name in sequences, _NEEDS.get(name, ""), name not in _ONE_LINE or b == "{" and name == "type") for k, (x, name, _) in enumerate(flat) if x == b] for b in rules}
        self.top, self.prepare = chr(_CHOICE + len(flat)), prepare
        self.master = self._master([*[r for _, _, r in flat], top])
        self.pieces: dict[tuple, bool] = {}
        self.cut = re.compile(cut, re.S)

    def expand(self, rule: str) -> str:
        """The rule as a pattern: short macros in place, the others as named groups that are called."""
        called: dict[str, str] = {}
        rule = self._resolve(rule, called)
        return self._defined(called) + rule

    def _resolve(self, text: str, called: dict[str, str]) -> str:
        def one(m: re.Match) -> str:
            name, body = m[1], self.macros[m[1]]
            if "«" not in body and len(body) < 60 or _ROLE.fullmatch(body):
                return body
            if name not in called:
                called[name] = ""
                called[name] = self._resolve(body, called)
            return f"(?&{name})"

        return re.sub("«([^«»]+)»", one, text)

    @staticmethod
    def _defined(called: dict[str, str]) -> str:
        return "(?(DEFINE)" + "".join(f"(?P<{k}>{v})" for k, v in called.items()) + ")" if called else ""

    def _master(self, rules: list[str]) -> regex.Pattern:
        """One pattern for all rules: the first letter of what is matched chooses the rule. So macros are compiled once."""
        called: dict[str, str] = {}
        resolved = [f"{chr(_CHOICE + k)}(?:{self._resolve(r, called)})" for k, r in enumerate(rules)]
        return regex.compile(self._defined(called) + "(?:" + "|".join(resolved) + ")")

    def kind(self, token: str) -> str:
        k = self.fixed.get(token)
        if k is None:
            k = self.other(token)
        if len(self.kinds) > KNOWN:
            self.kinds.clear()
        self.kinds[token] = k
        return k

    def other(self, token: str) -> str:
        c = token[0]
        if c in "\"'":
            return '"' if len(token) > 1 and token[-1] == c else "!"
        if c.isdigit() or c == "." and token[1:2].isdigit():
            return "0"
        if c.isalpha() or c in "_$" or c == "#" and len(token) > 1:
            return "i"
        return "!"

    def letters(self, text: str) -> str:
        known = self.kinds
        return "".join([known.get(t) or (self.kind(t) if t else "") for t in self.tokens.findall(text)])

    def matches(self, rule: str, sequence: bool, form: str) -> bool:
        """Whether the form follows the rule; a sequence of statements or members is tested piece by piece, each piece once."""
        if not sequence:
            return self.master.fullmatch(rule + form) is not None
        known = self.pieces
        for piece in self.cut.findall(form):
            if (ok := known.get((rule, piece))) is None:
                ok = self.master.fullmatch(rule + piece) is not None
                if len(known) > KNOWN:
                    known.clear()
                if len(piece) < 2000:
                    known[rule, piece] = ok
            if not ok:
                return False
        return True

    def group(self, bracket: str, inside: str) -> str:
        """The letter of a group, "" if it can play no role."""
        if len(inside) > 40:  # a list stays what it is if runs of equal entries are shortened
            inside = _RUN.sub(r"\1\1", inside)
        key = (bracket, inside)
        if (c := self.groups.get(key)) is None:
            mask = 0
            for form in dict.fromkeys(self.prepare(inside, bracket)):  # readings, all of which count
                ends = ";" in form
                for bit, (rule, sequence, needs, statements) in enumerate(self.rules[bracket]):
                    if mask >> bit & 1 or ends and not statements or form and needs and not any(c in form for c in needs):
                        continue
                    if self.matches(rule, sequence, form):
                        mask |= 1 << bit
            c = chr(_OPEN[bracket] + mask) if mask else ""
            if len(self.groups) > KNOWN:
                self.groups.clear()
            if len(inside) < 2000:
                self.groups[key] = c
        return c

    def level(self, letters: str) -> str | None:
        """The letters with every bracketed group as one letter; None if a group plays no role or a bracket has no partner."""
        if "!" in letters:
            return None
        stack: list[tuple[str, list[str]]] = [("", [])]
        for piece in _BRACKETS.split(letters):
            if piece in _OPEN:
                stack.append((piece, []))
            elif piece in _CLOSE:
                bracket, parts = stack.pop()
                if bracket != _CLOSE[piece]:
                    return None
                if not (c := self.group(bracket, "".join(parts))):
                    return None
                stack[-1][1].append(c)
            elif piece:
                stack[-1][1].append(piece)
        return "".join(stack[0][1]) if len(stack) == 1 else None

    def follows(self, text: str) -> bool:
        """Whether the whole text follows the grammar."""
        if (whole := self.level(self.letters(text))) is None:
            return False
        return any(self.matches(self.top, True, form) for form in self.prepare(whole, ""))


def _until_stable(pattern: re.Pattern, by: str, s: str) -> str:
    while (t := pattern.sub(by, s)) != s:
        s = t
    return s


# --- JavaScript and TypeScript ---------------------------------------------------------------------------------------
_STR = r"\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"


def _template(depth: int) -> str:
    inner = _template(depth - 1) if depth else r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`"
    body = rf"(?:[^{{}}`\"']|{_STR}|\{{(?:[^{{}}`\"']|{_STR}|{inner})*\}}|{inner})*"
    return rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{body}\}})*`"


_EXPRESSION = re.compile(rf"\\[\s\S]|\$\{{((?:[^{{}}`\"']|{_STR}|\{{(?:[^{{}}`\"']|{_STR}|{_template(1)})*\}}|{_template(1)})*)\}}")
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_JS_NAME = r"[A-Za-z_$\u0080-\uffff][\w$]*"
_JS_TOKENS = (
    r"(?:\A#![^\n]*|((?!(?:return|typeof|case|in|of)\b)" + _JS_NAME + r"|\n\s*|\??\.[ \t\r\n]*#?" + _JS_NAME + "|" + _STR
    + r"|/\*[\s\S]*?\*/|/\*|(?:=>|[=(,:;!&|?{}\[+\-*%<>~^]|return|typeof|case|in|of)[ \t\r\n]*" + _REGEX + r"|\A\s*" + _REGEX
    + r"|(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+\-]?\d+)?)n?(?![\w$])|[;,)}\]]|" + _template(3) + r"|#?" + _JS_NAME
    + r"|\.\.\.|\?\.(?!\d)|=>|===?|!==?|\*\*=?|\+\+|--|<<=?|[<>]=|&&=?|\|\|=?|\?\?=?|[+\-*%&|^]=|/=?(?!/)|[^\s/])|//[^\n]*)[ \t\r\f\v\ufeff\xa0]*|[ \t\r\f\v\ufeff\xa0]+"
)
_JS_WORDS = {
    **dict.fromkeys(("this", "super", "null", "true", "false"), "0"), **dict.fromkeys(("var", "let", "const"), "V"), **dict.fromkeys(("break", "continue"), "K"),
    **dict.fromkeys(("typeof", "void", "delete"), "u"), **dict.fromkeys(("in", "instanceof"), "j"), **dict.fromkeys(("get", "set", "static"), "g"),
    "if": "I", "else": "L", "for": "F", "while": "W", "do": "D", "switch": "S", "case": "C", "default": "X", "return": "R", "throw": "H", "try": "T", "catch": "A",
    "finally": "Y", "function": "f", "class": "c", "extends": "e", "new": "N", "import": "M", "export": "E", "async": "a", "await": "w", "of": "o", "from": "m", "as": "z",
    "yield": "y", "debugger": "d", "enum": "r", "with": "B",
}
_TS_WORDS = _JS_WORDS | {
    **dict.fromkeys(("public", "private", "protected", "readonly", "abstract", "declare", "override", "accessor"), "g"), "type": "q", "interface": "k", "implements": "l",
    "namespace": "J", "module": "J", "keyof": "U", "infer": "U", "is": "z", "satisfies": "z", "asserts": "U",
}
_MARKS = {
    **{c: c for c in "()[]{};,:?.<>@"}, **dict.fromkeys(("+", "-"), "+"), "*": "*", **dict.fromkeys(("/", "%", "^", "**", "==", "===", "!=", "!==", "<=", ">=", "<<", "&&", "||", "??"), "b"),
    **dict.fromkeys(("|", "&"), "|"), **dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", "&&=", "||=", "??="), "Q"), "=": "=", "=>": "Z", "...": "_", "?.": "$",
    "++": "p", "--": "p", "!": "x", "~": "x", "/*": "!", "`": "!", "#": "!", "\\": "!", "'": "!", '"': "!",
}


class _Script(Grammar):
    def other(self, token: str) -> str:
        c = token[0]
        if c == "\n" or token.startswith("/*"):
            return "n" if "\n" in token else ""
        if c == "`":
            return "`" if all(self._holds(e) for e in _EXPRESSION.findall(token) if e is not None and f"${{{e}}}" in token) else "!"
        if c in "?." and (token[-1].isalnum() or token[-1] in "_$") and not token[1:2].isdigit():
            return "h"
        if c == "/" and len(token) > 2:
            return "0"
        if token[-1] == "/" or re.search(r"/[a-z]*$", token) and c not in "\"'":  # a mark or word before a regular expression
            before = re.match(r"=>|[a-z]+|.", token)[0]
            return self.fixed[before] + "0"
        return super().other(token)

    def _holds(self, expression: str) -> bool:
        if not expression.strip():
            return "${}" not in expression and expression != ""
        level = self.level(self.letters("(" + expression + ")"))
        return level is not None


def _script(typed: bool) -> Grammar:
    ident = "[iawogqmzlkJU]" if typed else "[iawogmz]"
    word = "[iawogqmzlkJU0VKujILFWDSCXRHTAYfceNMEyrdB]"
    m = {
        "ID": ident, "WORD": word, "ANYB": "[-]",
        # types
        "TATOM": "(?:u|«ID»(?:h)*G?|[\"0`V]|\\+0|«(type»|«{type»|«[tuple»|uG?«ID»h*|M«(args»h*G?)",
        "TU": "(?:[uUgN]|G?«(params»Z)*«TATOM»(?:«[index»|«[tuple»)*",
        "UN": "(?:\\|?«TU»(?:\\|«TU»)*)",
        "TYPE": "(?:(?:(?:«ID»|0)z)?(?:«UN»e«UN»\\?«UN»:)*«UN»)" if typed else "(?:(?!))",
        "RET": "(?::U?«TYPE»)?" if typed else "",
        "GEN": "G?" if typed else "",
        "DEC": "(?:@«ID»h*(?:«(args»)?n*)*",
        # expressions
        "HEAD": "(?:a?(?:«ID»|«GEN»«(params»«RET»)Z)",
        "PRIM": "(?:a?f\\*?«ID»?«GEN»«(params»«RET»«{block»|«DEC»c(?:«ID»«GEN»)?(?:e«ID»h*«GEN»(?:«(args»)?)?(?:l«TYPE»(?:,«TYPE»)*)?n*«{class»|«HEAD»«{block»|«ID»|[0\"`]|«(expr»|«[array»|«{object»|M«(args»|Mh|Nh)",
        "POST": "(?:h|«(args»|«[index»|`|p|\\$(?:«(args»|«[index»)" + ("|x|G|z«TYPE»" if typed else "") + ")",
        "U": "(?:[x+pwNu" + ("G" if typed else "") + "]|y\\*?|«HEAD»)*«PRIM»«POST»*",
        "BIN": "(?:[b*=Q<|j+]|>{1,3}=?|>{0,2}b)",
        "B": "«U»(?:«BIN»«U»)*+",
        "AE": "(?:«B»(?:\\?«AE»:«AE»)?|y)",
        "EXPR": "«AE»(?:,«AE»)*+",
        "ITEM": "_?«AE»",
        "TARGET": "(?:«ID»|«[pattern»|«{pattern»)",
        "DECLS": "«TARGET»x?(?::«TYPE»)?(?:=«AE»)?(?:,«TARGET»x?(?::«TYPE»)?(?:=«AE»)?)*+",
        "KEY": "(?:«WORD»|[\"0]|«[index»)",
        # statements
        "END": "(?:;|n|$)",
        "PRE": "(?:I«(expr»n*|W«(expr»n*|Fw?«(for»n*|«ID»:n*|B«(expr»n*)",
        "CLASS": "«DEC»" + ("g*" if typed else "") + "c«ID»?«GEN»(?:e«U»)?" + ("(?:n*l«TYPE»(?:,«TYPE»)*+)?" if typed else "") + "n*«{class»",
        "FUNC": "a?f\\*?«ID»?«GEN»«(params»«RET»" + ("(?:«{block»|«END»)" if typed else "«{block»"),
        "DECL": "(?:V«DECLS»«END»|«FUNC»|«CLASS»" + ("|g*(?:q«ID»G?=n*«TYPE»«END»|k«ID»G?(?:e«TYPE»(?:,«TYPE»)*+)?n*«{type»|V?r«ID»n*«{enum»|J(?:\"|«ID»h*)n*(?:«{module»|«{block»)|J(?:«{module»|«{block»)|V«DECLS»«END»|«FUNC»)" if typed else "") + ")",
        "SIMPLE": "(?:«{block»|«DECL»|S«(expr»n*«{switch»|T«{block»n*(?:A(?:«(catch»)?n*«{block»n*(?:Y«{block»)?|Y«{block»)|R(?:«EXPR»)?«END»|H«EXPR»«END»|K«ID»?«END»|d«END»|D n*(?:«PRE»)*(?:«{block»|«EXPR»«END»)n*W«(expr»;?|(?![\ue800-\uebff])«EXPR»«END»|;)".replace("D n*", "Dn*"),
        "STMT": "(?:(?:«PRE»)*«SIMPLE»(?:n*L(?:n*«PRE»)*n*«SIMPLE»)*+)",
        "STMTS": "(?:n|«STMT»)*+",
        "MODULE": "(?:M(?:\"|q?(?:«ID»|\\*z«ID»|«{import»)(?:,(?:\\*z«ID»|«{import»))?m\")(?:B«{object»)?«END»|EX(?:«FUNC»|«CLASS»|" + ("k«ID»G?«{type»|" if typed else "") + "«AE»«END»)|Eq?«{import»(?:m\")?«END»|E\\*(?:z(?:«ID»|X))?m\"«END»|«DEC»E(?:«DECL»)"
        + ("|M«ID»=«AE»«END»|E=«AE»«END»" if typed else "") + ")",
    }
    member = "(?:[;,n]|$)"
    rules = {
        "(": {
            "args": "(?:«ITEM»(?:,«ITEM»)*+,?)?", "expr": "«EXPR»",
            "params": "(?:«P»(?:,«P»)*+,?)?", "for": "(?:(?:V«DECLS»|«EXPR»)?;(?:«EXPR»)?;(?:«EXPR»)?|V?(?:«TARGET»|«ID»h*|0h)(?::«TYPE»)?[oj]«EXPR»)", "catch": "«TARGET»(?::«TYPE»)?", "type": "«TYPE»",
        },
        "[": {"array": "(?:(?:«ITEM»)?,)*+(?:«ITEM»)?", "index": "(?:«EXPR»)?", "pattern": "(?:(?:_?«TARGET»(?:=«AE»)?)?,)*(?:_?«TARGET»(?:=«AE»)?)?", "tuple": "(?:_?(?:«ID»\\??:)?«TYPE»\\??(?:,_?(?:«ID»\\??:)?«TYPE»\\??)*+,?)?", "sign": "«ID»(?::«TYPE»|j«TYPE»(?:z«TYPE»)?)"},
        "{": {
            "block": "«STMTS»", "module": "(?:n|«MODULE»|«STMT»)*+" if typed else "(?!)",
            "object": "(?:«PROP»(?:,«PROP»)*+,?)?",
            "pattern": "(?:(?:«KEY»:«TARGET»|«ID»|_«ID»)(?:=«AE»)?(?:,(?:«KEY»:«TARGET»|«ID»|_«ID»)(?:=«AE»)?)*+,?)?",
            "class": "(?:[;n]|«DEC»(?:g*a?\\*?«KEY»[?x]?«GEN»«(params»«RET»(?:«{block»" + ("|(?:[;n]|$)" if typed else "") + ")|g«{block»|g*«KEY»[?x]?(?::«TYPE»)?(?:=«AE»)?(?:[;n]|$)" + ("|g*«[sign»:«TYPE»(?:[;n]|$)" if typed else "") + "))*+",
            "switch": "n*(?:(?:C«EXPR»|X):«STMTS»)*+",
            "import": "(?:q?(?:«WORD»|\")(?:z(?:«WORD»|\"))?(?:,q?(?:«WORD»|\")(?:z(?:«WORD»|\"))?)*+,?)?",
            "type": "(?:[;,n]|g*(?:(?:\\+?g)?«[sign»\\+?\\??:«TYPE»|N?«GEN»«(params»«RET»|«KEY»\\??(?:«GEN»«(params»)?«RET»)" + member + ")*+" if typed else "(?!)",
            "enum": "(?:(?:«WORD»|\")(?:=«AE»)?(?:,(?:«WORD»|\")(?:=«AE»)?)*+,?)?" if typed else "(?!)",
        },
    }
    m["P"] = "«DEC»" + ("g*" if typed else "") + "_?(?:«TARGET»|0)\\??(?::«TYPE»)?(?:=«AE»)?"
    m["PROP"] = "(?:_«AE»|(?:g|a?\\*?)«KEY»«GEN»«(params»«RET»«{block»|«KEY»:«AE»|«ID»(?:=«AE»)?)"
    top = "(?:n|«MODULE»|«STMT»)*+"
    g: Grammar
    before = re.compile(r"(?<=[,:?b=Q<|j+_Z.$xuN@LDT*])n+")
    after = re.compile(r"n+(?=[h,:?b=Q|j+$ZAY<.>])")

    def prepare(s: str, bracket: str) -> list[str]:
        forms = [s]
        if typed and "<" in s:
            plain = s.replace("n", "") if bracket in ("(", "[") else s
            forms = [_until_stable(generic, "G", plain), s]
        if "n" in s:
            if bracket in ("(", "["):
                return [f.replace("n", "") for f in forms]
            forms = [after.sub("", before.sub("", f)) for f in forms]
            if bracket == "{":  # newlines mean nothing in objects and lists of names
                forms = [x for f in forms for x in (f, f.replace("n", ""))]
                if typed or any("*" in f for f in forms):
                    forms.append(s)
        return forms

    g = _Script(_JS_TOKENS, _TS_WORDS if typed else _JS_WORDS, _MARKS, rules, m, top, prepare, r".+?(?:[\ue800-\uebff]n+(?![nLW])|;n*(?![nLW])|$)", ("block", "class"))
    args = "<n*(?:(?:[gV])?«TYPE»(?:e«UN»)?(?:=«UN»)?)(?:,n*(?:(?:[gV])?«TYPE»(?:e«UN»)?(?:=«UN»)?))*,?n*>"
    generic = regex.compile(g.expand(f"(?<=[iawogqmzlkJUh])(?:{args})(?![i0\"])|(?<![iawogqmzlkJUh0\"G\ue000-\uebff]){args}")) if typed else None
    return g


# --- Java ------------------------------------------------------------------------------------------------------------
_C_SPACE = r"\s+|//[^\n]*\s*|/\*[^*]*(?:\*(?!/)[^*]*)*\*/\s*"
_C_NUMBER = r"(?:0[xX][\da-fA-F_'.]+(?:[pP][+\-]?\d+)?|0[bB][01_']+|(?:\d[\d_']*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+\-]?\d+)?)[uUlLfFdDzZ]*(?!\w)"
_JAVA_TOKENS = (
    r"(?:([A-Za-z_$\u0080-\uffff][\w$]*|\.\s*[A-Za-z_$\u0080-\uffff][\w$]*|[;,(){}\[\]]|\"\"\"[ \t\r]*\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'|" + _C_NUMBER
    + r"|@\s*interface\b|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|<<=|<<|[+\-*%&|^]=|/(?![/*])=?|/\*(?![\s\S]*\*/)|[^\s/])|//[^\n]*|/\*[^*]*(?:\*(?!/)[^*]*)*\*/)\s*|\s+"
)
_JAVA_WORDS = {
    **dict.fromkeys(("public", "private", "protected", "static", "final", "abstract", "native", "transient", "volatile", "strictfp", "sealed", "non"), "m"), "synchronized": "y",
    **dict.fromkeys(("int", "long", "double", "float", "boolean", "char", "byte", "short", "void"), "t"), **dict.fromkeys(("class", "interface"), "c"), "enum": "r", "record": "k",
    **dict.fromkeys(("extends", "implements", "permits"), "e"), "throws": "w", "super": "s", **dict.fromkeys(("this", "null", "true", "false"), "0"), "instanceof": "j", "new": "N", "return": "R",
    "throw": "H", "if": "I", "else": "L", "for": "F", "while": "W", "do": "D", "switch": "S", "case": "C", "default": "X", "break": "K", "continue": "K", "try": "T", "catch": "A", "finally": "Y",
    "import": "M", "package": "g", "assert": "a", **dict.fromkeys(("goto", "const"), "!"),
}
_JAVA_MARKS = _MARKS | {"&": "&", "->": "z", "::": "q", "&&": "b", "||": "b", "=>": "!", "?.": "!", "<=": "b", ">=": "b"}


class _Java(Grammar):
    def other(self, token: str) -> str:
        if token[0] == "." and not token[1:2].isdigit() and token != "...":
            return "h"
        if token[0] == "@" and len(token) > 1:
            return "c"
        if token[0] == '"' and token.startswith('"""') and len(token) > 3:
            return '"'
        return super().other(token)


def _java() -> Grammar:
    m = {
        "ID": "[ik]", "ANN": "(?:@«ID»h*(?:«(ann»)?)", "MOD": "(?:[mXy]|«ANN»)*",
        "DIMS": "(?:«[empty»)*", "NAME": "(?:«ID»(?:G?h)*G?)", "TYPE": "(?:(?:«ANN»)*(?:t|«NAME»)«DIMS»)", "TYPES": "«TYPE»(?:[,&]«TYPE»)*+",
        "HEAD": "(?:(?:«ID»|«(params»|«(names»)z)",
        "PRIM": "(?:N(?:«ANN»)*(?:«NAME»«(args»(?:«{class»)?|G?(?:t|«NAME»)(?:(?:«[index»)+«DIMS»|(?:«[empty»)+«{list»))|«HEAD»«{block»|S«(expr»«{switch»|(?:t|«NAME»)(?:«[empty»)+(?:h|q[iNk])|t[hq][Ni]?|«ID»|[0\"s]|«(expr»)",
        "POST": "(?:h|«(args»|«[index»|p|G?q(?:G?«ID»|N)|\\.G«ID»|G|\\.NG?«NAME»«(args»(?:«{class»)?|j«MOD»«TYPE»(?:«ID»|«(names»|«(params»|«(args»)?)",
        "U": "(?:[x+p]|«(type»|«HEAD»)*«PRIM»«POST»*", "BIN": "(?:[b*=Q<|&+]|>{1,3}=?|>{0,2}b)",
        "B": "«U»(?:«BIN»«U»)*+", "E": "(?:«B»(?:\\?«E»:«E»)?)",
        "INIT": "(?:«E»|«{list»)", "VAR": "«ID»«DIMS»(?:=«INIT»)?", "VARS": "«VAR»(?:,«VAR»)*+",
        "PRE": "(?:I«(expr»|W«(expr»|F«(for»|«ID»:)",
        "TYPEDECL": "«MOD»(?:c«ID»G?(?:e«TYPES»)*«{class»|r«ID»(?:e«TYPES»)?«{enum»|kiG?«(params»(?:e«TYPES»)?«{class»)",
        "SIMPLE": "(?:;|«{block»|«TYPEDECL»|«MOD»«TYPE»«VARS»;|S«(expr»«{switch»|T(?:«(res»)?«{block»(?:A«(catch»«{block»)*(?:Y«{block»)?|R(?:«E»)?;|H«E»;|K«ID»?;|y«(expr»«{block»|a«E»(?::«E»)?;|D«STMT1»W«(expr»;|i«E»;|«E»;)",
        "STMT1": "(?:(?:«PRE»)*(?:«{block»|«E»;|R(?:«E»)?;|H«E»;|K;))",
        "STMT": "(?:(?:«PRE»)*«SIMPLE»(?:L(?:«PRE»)*«SIMPLE»)*+)", "STMTS": "(?:«STMT»)*+",
        "LABEL": "(?:«MOD»«TYPE»«ID»|«E»|X|«NAME»«(params»)",
        "MEMBER": "(?:;|m*«{block»|«TYPEDECL»|«MOD»(?:G)?«MOD»(?:«TYPE»)?«ID»«(params»«DIMS»(?:w«TYPES»)?(?:«{block»|;|X(?:«INIT»|«ANN»);)|«MOD»«ID»«{block»|«MOD»«TYPE»«VARS»;)",
    }
    rules = {
        "(": {
            "args": "(?:«E»(?:,«E»)*+)?", "expr": "«E»", "params": "(?:«MOD»«TYPE»(?:«ANN»)*_?(?:«ID»|0|«ID»h)«DIMS»(?:,«MOD»«TYPE»(?:«ANN»)*_?«ID»«DIMS»)*+)?", "names": "(?:«ID»(?:,«ID»)*+)?",
            "type": "«TYPE»(?:&«TYPE»)*+", "for": "(?:(?:«MOD»«TYPE»«VARS»|«E»(?:,«E»)*+)?;(?:«E»)?;(?:«E»(?:,«E»)*+)?|«MOD»«TYPE»«ID»:«E»)", "catch": "«MOD»«TYPE»(?:\\|«TYPE»)*+«ID»",
            "res": "(?:«MOD»«TYPE»«ID»=«E»|«E»)(?:;(?:«MOD»«TYPE»«ID»=«E»|«E»))*+;?", "ann": "(?:(?:«ID»=)?(?:«E»|«{list»|«ANN»)(?:,(?:«ID»=)?(?:«E»|«{list»|«ANN»))*+)?",
        },
        "[": {"empty": "", "index": "«E»"},
        "{": {
            "block": "«STMTS»", "list": "(?:(?:«INIT»|«ANN»)(?:,(?:«INIT»|«ANN»))*+)?,?", "class": "(?:«MEMBER»)*+",
            "switch": "(?:(?:C«LABEL»(?:,«LABEL»)*(?:i«E»)?|X)(?::«STMTS»|z(?:«{block»|H«E»;|«E»;)))*",
            "enum": "(?:(?:«ANN»)*«ID»(?:«(args»)?(?:«{class»)?(?:,(?:«ANN»)*«ID»(?:«(args»)?(?:«{class»)?)*+)?,?(?:;(?:«MEMBER»)*+)?",
        },
    }
    top = "(?:(?:«ANN»)*g«ID»h*;)?(?:;|Mm?«ID»h*(?:\\.\\*)?;)*(?:;|«TYPEDECL»)*+"

    def prepare(s: str, _bracket: str) -> list[str]:
        return [_until_stable(generic, "G", s), s] if "<" in s else [s]

    g = _Java(_JAVA_TOKENS, _JAVA_WORDS, _JAVA_MARKS, rules, m, top, prepare, r".+?(?:;(?![LW])|$)", ("block", "class"))
    arg = "(?:(?:«ANN»)*\\?(?:[es]«TYPE»)?|«TYPE»(?:e«TYPE»(?:&«TYPE»)*)?)"
    generic = regex.compile(g.expand(f"<(?:{arg}(?:,{arg})*)?>(?![0\"])"))
    return g


# --- C++ -------------------------------------------------------------------------------------------------------------
_CPP_TOKENS = (
    r"(?m)" + _C_SPACE + r"|\\\r?\n|(^[ \t]*#[^\n\\]*(?:\\[\s\S][^\n\\]*)*|/\*|(?:u8|[uUL])?R\"([^()\\\s]{0,16})\((?:[\s\S]*?)\)\2\"|(?:u8|[uUL])?\"(?:[^\"\\\n]|\\[\s\S])*\"|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'|" + _C_NUMBER.replace("_", "")
    + r"|[A-Za-z_\u0080-\uffff]\w*|\[\[|\]\]|\.\.\.|->\*?|::|<=>|==|!=|<=|>=|&&|\|\||\+\+|--|<<=|<<|[+\-*/%&|^]=|\.\*|\S)"
)
_CPP_WORDS = {
    **dict.fromkeys(("const", "constexpr", "static", "inline", "extern", "virtual", "explicit", "friend", "mutable", "volatile", "register", "thread_local", "typename", "constinit", "consteval"), "m"),
    **dict.fromkeys(("int", "long", "double", "float", "bool", "char", "short", "void", "unsigned", "signed", "auto", "wchar_t", "char8_t", "char16_t", "char32_t"), "t"),
    **dict.fromkeys(("class", "struct", "union"), "c"), "enum": "r", "template": "e", "namespace": "g", "using": "u", "typedef": "y", "operator": "o", **dict.fromkeys(("public", "private", "protected"), "v"),
    "new": "N", "delete": "d", "throw": "w", "return": "R", "co_return": "R", "break": "K", "continue": "K", "goto": "J", "if": "I", "else": "L", "for": "F", "while": "W", "do": "D", "switch": "S",
    "case": "C", "default": "X", "try": "T", "catch": "A", **dict.fromkeys(("this", "nullptr", "true", "false"), "0"), **dict.fromkeys(("sizeof", "alignof", "typeid", "co_await", "co_yield"), "s"), "decltype": "V",
    **dict.fromkeys(("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast"), "k"), **dict.fromkeys(("override", "noexcept", "final"), "f"), "static_assert": "a", "alignas": "l",
    **dict.fromkeys(("and", "or", "xor", "bitand", "bitor", "not_eq"), "b"), **dict.fromkeys(("not", "compl"), "x"), "asm": "i", "requires": "q",
}
_CPP_MARKS = _MARKS | {"&": "&", "&&": "&", "|": "b", "->": "z", "->*": "b", ".*": "b", "::": "Z", "||": "b", "~": "~", "<=>": "b", "=>": "!", "?.": "!", "@": "!", "[[": "[[", "]]": "]]", "<=": "b", ">=": "b", "...": "_"}
_DIRECTIVE = re.compile(r"#[ \t]*(?:include(?:_next)?[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\"|\w+)|define[ \t]+\w|undef[ \t]+\w|if[ \t(!]|ifdef\b|ifndef\b|elif\b|elifn?def\b|else\b|endif\b|pragma\b|error\b|warning\b|line\b|import\b|[ \t]*$)")


class _Cpp(Grammar):
    def letters(self, text: str) -> str:
        known = self.kinds
        tokens = [t for t, _ in self.tokens.findall(text)]
        opened = 0
        if "#" in text:
            for t in tokens:
                if "#" in t and (d := t.lstrip())[:1] == "#":
                    opened += bool(re.match(r"#[ \t]*if", d)) - bool(re.match(r"#[ \t]*endif", d))
                    if opened < 0:
                        return "!"
        return "!" if opened else "".join([known.get(t) or (self.kind(t) if t else "") for t in tokens])

    def other(self, token: str) -> str:
        if token.lstrip()[:1] == "#":
            return "" if _DIRECTIVE.match(token.lstrip()) else "!"
        if token[-1] in "\"'" and len(token) > 1 and re.match(r"(?:u8|[uUL])?R?[\"']", token):
            return '"' if token[-1] == '"' else "0"
        return super().other(token)


def _cpp() -> Grammar:
    attr = "(?:«[attr»|l«(args»)*"
    m = {
        "ATTR": attr,
        "BASE": "(?:(?:m|«ATTR»t)*(?:t[tm]*|(?:c|r)?i|V«(args»)m*|m+(?=[*&]|i))",
        "BASE1": "(?:m*(?:t[tm]*|(?:c|r)?i|V«(args»)m*)",
        "PTR": "[*&m]*", "TYPE": "(?:«BASE1»«PTR»_?(?:«(params»(?:m|f)*)?(?:«[any»)*)",
        "LAMBDA": "(?:«[caps»G?(?:«(params»)?[mf]*(?:z«TYPE»)?«{block»)",
        "PRIM": "(?:«LAMBDA»|\"+|0|kG«(expr»|N(?:«(args»)?m*(?:t+|i)[*]*(?:«[any»)*(?:«(args»|«{list»)?|i(?:«{list»)?|t+(?:«(args»|«{list»)|V«(args»|i?«(expr»|«(fold»|q?«{list»|s_?«(type»|w)",
        "POST": "(?:«(args»|«[index»|z~?[id]|\\.~?[ie]|p|\\.oX|_)",
        "U": "(?:[x+p*&~sw]|d(?:«[any»)?|«(type»)*«PRIM»«POST»*", "BIN": "(?:[b*=Q<&+]|>{1,2}=?|>{0,2}b)",
        "B": "«U»(?:«BIN»«U»)*+", "E": "(?:«B»(?:\\?«E»:«E»)?)", "EXPR": "«E»(?:,«E»)*+",
        "NAME": "(?:i|[*&]+m*i|«(ptr»|«[caps»)",
        "VAR": "«PTR»«NAME»(?:«[any»)*(?::«E»)?(?:«(params»[mf]*|=«E»|«{list»|«(args»)?", "VARS": "«VAR»(?:,«VAR»)*+",
        "VARDECL": "«ATTR»«BASE»«VARS»",
        "OPER": "(?:o(?:[x+p*&~b=Q<,]|>{1,3}=?|[Nd](?:«[any»)?|«(params»|«[any»|\"i|z|«TYPE»))",
        "TAIL": "(?:[mf&]|f«(args»|z«TYPE»|«ATTR»[mf])*(?:q«E»)?",
        "BODY": "(?:(?::i(?:«(args»|«{list»)_?(?:,i(?:«(args»|«{list»)_?)*+)?(?:«{block»|T«{block»(?:A«(params»«{block»)+)|=(?:X|d|0);|;)",
        "FUNC": "«ATTR»(?:(?:«BASE»«PTR»)?(?:i|~i)|(?:«BASE»«PTR»|m)?«OPER»|m*~i)«(params»«TAIL»«BODY»",
        "TEMPLATE": "(?:(?:e(?:G|«EMPTYT»)(?:q«E»)?)*)", "EMPTYT": "(?:<>)",
        "BASES": "(?::(?:[vm]*i_?)(?:,[vm]*i_?)*+)?",
        "CLASS": "(?:[my]*c«ATTR»i?f?«BASES»(?:«{class»)?(?:«VARS»)?;|[my]*rc?«ATTR»i?(?::«BASE1»)?(?:«{enum»)?(?:«VARS»)?;)",
        "ALIAS": "(?:u(?:g)?i(?:,i)*;|ui=«TYPE»;|y«BASE»«PTR»(?:i|«(ptr»«(params»)(?:«[any»)*;|a«(args»;)",
        "DECL": "«TEMPLATE»(?:«CLASS»|«FUNC»|«VARDECL»;|«ALIAS»|m\"(?:«{file»|«FUNC»|«VARDECL»;)|m*g«ATTR»(?:i(?:Zi)*)?«{file»|gi=i;|eiG?;|ei«(params»;|i«(args»;?|;)",
        "PRE": "(?:Im?«(cond»|W«(cond»|F«(for»|i:)",
        "SIMPLE": "(?:;|«{block»|R(?:«E»)?;|K;|Ji;|S«(cond»«{switch»|T«{block»(?:A«(params»«{block»)+|D«STMT1»W«(expr»;|«CLASS»|«ALIAS»|«EXPR»;|«VARDECL»;|i«(args»(?=«{block»)|«ATTR»;)",
        "STMT1": "(?:(?:«PRE»)*(?:«{block»|«EXPR»;|R(?:«E»)?;|K;))",
        "STMT": "(?:«ATTR»(?:«PRE»)*«SIMPLE»(?:L(?:«PRE»)*«SIMPLE»)*+)", "STMTS": "(?:«STMT»)*+",
    }
    rules = {
        "(": {
            "args": "(?:«E»(?:,«E»)*+|«TYPE»)?", "expr": "«EXPR»", "params": "(?:«PARAM»(?:,«PARAM»)*+(?:,?_)?|_)?", "type": "«TYPE»", "cond": "(?:(?:«VARDECL»;)?(?:«E»|«VARDECL»)|«E»;«E»)",
            "for": "(?:(?:«VARDECL»|«EXPR»)?;(?:«E»)?;(?:«EXPR»)?|(?:«VARDECL»;)?«ATTR»«BASE»«PTR»(?:i|«[caps»):«E»)", "ptr": "i?[*&]+m*i?(?:«[any»)*", "fold": "(?:«B»«BIN»_|_«BIN»«B»|«B»_«BIN»«B»)",
        },
        "[": {"any": "(?:«E»)?", "index": "(?:«E»)(?:,«E»)*", "caps": "(?:(?:[&=]|[&*]?(?:i|0)_?(?:=«E»)?)(?:,(?:[&]?(?:i|0)_?(?:=«E»)?))*+)?", "attr": "«[names»", "names": "(?:i(?:«(args»)?(?:,i(?:«(args»)?)*+)?"},
        "{": {
            "block": "«STMTS»", "list": "(?:«INIT»(?:,«INIT»)*+)?,?", "class": "(?:v:|«DECL»)*+", "switch": "(?:(?:C«E»(?:_«E»)?|X):«STMTS»)*", "enum": "(?:i«ATTR»(?:=«E»)?(?:,i(?:=«E»)?)*+)?,?", "file": "(?:«DECL»)*+",
        },
    }
    m["INIT"] = "(?:(?:\\.i)+(?:=«E»|«{list»)|«E»_?)"
    m["PARAM"] = "«ATTR»(?:«BASE1»|m+(?=i))«PTR»_?(?:i|«(ptr»(?:«(params»)?|«(params»)?(?:«[any»)*(?:=«E»)?"
    top = "(?:«DECL»)*+"
    qualified = re.compile(r"Z?i(?:G?Ze?[i~]+)*G?(?=Z\*)|Zi|i(?:G?Ze?~?i)+G?(?!G)|iG|mi(?=Z)|iZ(?=o)")

    def prepare(s: str, _bracket: str) -> list[str]:
        def names(x: str) -> str:
            while True:
                y = re.sub(r"(?<![i>G])Z(?=i)", "", x)
                y = re.sub(r"(?<=i)(?<!ei)GZe?|(?<=i)Ze?(?=[i~o])|(?<=i)Z(?=\*)", "Z", y)
                y = re.sub(r"iZi", "i", y)
                y = re.sub(r"iZ(?=~i|o)", "", y)
                if y == x:
                    return y
                x = y
        if "<" not in s:
            return [names(s)]
        x = s
        while True:
            y = names(generic.sub("G", names(x)))
            y = re.sub(r"(?<=i)G(?!Z)", "", y)
            if y == x:
                break
            x = y
        return [x, names(s)]

    g = _Cpp(_CPP_TOKENS, _CPP_WORDS, _CPP_MARKS, rules, m, top, prepare, r".+?(?:;(?![LW])|$)", ("block", "class", "file"))
    arg = "(?:(?:«TEMPLATE»c_?i?(?:=«TYPE»)?|m_?i?(?:=«TYPE»)?|«TYPE»i?(?:=(?:«TYPE»|0))?|«E»))"
    arg = "(?:(?:eG)*[cm]_?i?(?:=«TYPE»)?|«TYPE»_?i?(?:=(?:«TYPE»|\\+?0))?|\\+?0|\"|s«(type»)"
    generic = regex.compile(g.expand(f"(?<=[iek])<(?:{arg}(?:,{arg})*)?>(?![0\"])"))
    return g


_MADE: dict[str, Grammar] = {}


def grammar(language: str) -> Grammar:
    if language not in _MADE:
        _MADE[language] = {"javascript": lambda: _script(False), "typescript": lambda: _script(True), "java": _java, "cpp": _cpp}[language]()
    return _MADE[language]


def python_error(text: str) -> str | None:
    """What the parser of Python 3 finds wrong, None if nothing. A nesting too deep for the parser is no fault of the text."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("\ufeff"))
    except SyntaxError as e:
        return f"line {e.lineno}: {e.msg}"
    except ValueError as e:
        return str(e)
    except (RecursionError, MemoryError):
        return None
    return None


LANGUAGES = ("python", "javascript", "typescript", "java", "cpp")


def follows(text: str, language: str) -> bool:
    """Whether the text, as it stands, follows the grammar of one of LANGUAGES."""
    return python_error(text) is None if language == "python" else grammar(language).follows(text.removeprefix("\ufeff"))
