"""One pass over Python texts: structure, call rules and request-to-sink flows, as rows.

Each text is parsed once per row in an Arrow batch; nothing of it is run. Rows have a kind: import, function, class, method, route, rule, flow, error.
A flow follows values that come from a request through names, formatting, calls and local functions to a sink, statement by statement: branches are joined, a loop's
body is read once, a clean value assigned to a name clears it, checkers and cleaners by name stop a flow unless a local function of that name returns its argument as it is.

Defined cases: null and empty texts yield nothing; a text that does not parse yields one error row; a nesting too deep for the parser too.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.session import spread

# Where requests' values come from, sinks, cleaners.
REQUESTS = ("request", "req")
REQUEST_PARTS = frozenset("args form json query_params query params body".split())
SQL_CALLS = frozenset("execute executemany executescript".split())
HTTP_MODULES, HTTP_CALLS = ("requests", "httpx"), frozenset("get post put patch delete request".split())
SHELL_CALLS = frozenset("run Popen popen call check_call check_output".split())
CLEANERS = ("validate_", "sanitize_", "escape_", "safe_", "is_valid_", "is_allowed_")
PATH_CALLS = frozenset("open os.open os.remove os.unlink os.mkdir os.makedirs send_file FileResponse".split())
PATH_METHODS = frozenset("read_text read_bytes write_text write_bytes unlink mkdir rmdir".split())
ROUTE_METHODS = frozenset("get post put patch delete route".split())
SECRET_ENV = ("jwt", "token", "session", "secret", "signing_key", "signing-key", "signingkey")
SEVERITY = {
    "sql_injection": "critical", "command_injection": "critical", "ssrf": "high", "xss_unsafe_html_sink": "high", "subprocess_shell_true": "high", "os_system_call": "high", "tls_verification_disabled": "high",
    "unsafe_deserialization": "high", "jwt_signature_verification_disabled": "high", "jwt_algorithm_verification_bypass": "high", "jwt_insecure_secret_fallback": "high", "insecure_auth_cookie": "high",
    "path_traversal_file": "high", "ssrf_untrusted_url": "high", "permissive_cors": "high",
}

COLUMNS = {"kind": pa.string(), "name": pa.string(), "line": pa.int32(), "end_line": pa.int32(), "severity": pa.string(), "detail": pa.string(), "path": pa.list_(pa.string())}
DDL = "kind string, name string, line int, end_line int, severity string, detail string, path array<string>"


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return ".".join(["", *reversed(parts)]) if parts else ""


def constant(node: ast.AST | None):
    return node.value if isinstance(node, ast.Constant) else None


@dataclass
class Reader:
    """Rows of one text."""

    source: str
    rows: list[tuple] = field(default_factory=list)
    alias: dict[str, str] = field(default_factory=dict)
    local: dict[str, ast.FunctionDef] = field(default_factory=dict)
    requests: set[str] = field(default_factory=lambda: set(REQUESTS))
    active: set[str] = field(default_factory=set)

    def add(self, kind: str, name: str, node: ast.AST, severity: str | None = None, detail: str | None = None, path: list[str] | None = None) -> None:
        self.rows.append((kind, name, node.lineno, node.end_lineno, severity, detail, path))

    def text(self, node: ast.AST) -> str:
        return (ast.get_source_segment(self.source, node) or "")[:120]

    def name(self, node: ast.AST) -> str:
        """A dotted name with imported names in full."""
        n = dotted(node)
        head, _, rest = n.partition(".")
        full = self.alias.get(head, head)
        return f"{full}.{rest}" if rest else full

    # --- structure
    def structure(self, tree: ast.Module) -> None:
        inside = {id(f) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body}
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    self.add("import", a.name, node)
            elif isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
                self.add("import", module, node, detail=",".join(a.name for a in node.names))
                for a in node.names:
                    self.alias[a.asname or a.name] = f"{module}.{a.name}"
            elif isinstance(node, ast.ClassDef):
                self.add("class", node.name, node, detail=",".join(dotted(b) for b in node.bases))
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
                calls = sorted({n for c in ast.walk(node) if isinstance(c, ast.Call) and (n := dotted(c.func))})
                self.add("method" if id(node) in inside else "function", node.name, node, detail=f"async={isinstance(node, ast.AsyncFunctionDef)};args={','.join(args)};awaits={sum(isinstance(x, ast.Await) for x in ast.walk(node))}", path=calls)
                self.local.setdefault(node.name, node)
                for d in node.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_METHODS and d.args and isinstance(constant(d.args[0]), str):
                        self.add("route", constant(d.args[0]), node, detail=d.func.attr.upper())

    # --- rules on single calls
    def calls(self, tree: ast.Module) -> None:
        for node in ast.walk(tree):
            if isinstance(node, ast.Call):
                for rule in self.broken(node):
                    self.add("rule", rule, node, SEVERITY[rule], self.text(node))

    def broken(self, c: ast.Call) -> Iterator[str]:
        n = self.name(c.func)
        last = n.rsplit(".", 1)[-1]
        kw = {k.arg: k.value for k in c.keywords if k.arg}
        if n.startswith("subprocess.") and last in SHELL_CALLS and constant(kw.get("shell")) is True:
            yield "subprocess_shell_true"
        if n.split(".")[0] in HTTP_MODULES and constant(kw.get("verify")) is False:
            yield "tls_verification_disabled"
        if n in ("pickle.load", "pickle.loads", "yaml.unsafe_load") or n == "yaml.load" and dotted(kw.get("Loader") or (c.args[1] if len(c.args) > 1 else c)).rsplit(".", 1)[-1] not in ("SafeLoader", "BaseLoader", "CSafeLoader"):
            yield "unsafe_deserialization"
        if last == "decode" and "jwt" in n.lower():
            options = kw.get("options")
            if isinstance(options, ast.Dict) and any(constant(k) == "verify_signature" and constant(v) is False for k, v in zip(options.keys, options.values)):
                yield "jwt_signature_verification_disabled"
            algorithms = kw.get("algorithms")
            if isinstance(algorithms, (ast.List, ast.Tuple)) and any(str(constant(x)).lower() == "none" for x in algorithms.elts):
                yield "jwt_algorithm_verification_bypass"
        if n in ("os.getenv", "os.environ.get") and len(c.args) == 2 and isinstance(constant(c.args[0]), str) and isinstance(constant(c.args[1]), str) and constant(c.args[1]):
            if any(w in constant(c.args[0]).lower() for w in SECRET_ENV):
                yield "jwt_insecure_secret_fallback"
        if last == "set_cookie" and c.args and any(w in str(constant(c.args[0])).lower() for w in ("auth", "session", "token", "jwt")) and (constant(kw.get("httponly")) is False or constant(kw.get("secure")) is False):
            yield "insecure_auth_cookie"
        origins = next((kw[k] for k in ("allow_origins", "origins") if k in kw), None)
        wild = constant(origins) == "*" or isinstance(origins, (ast.List, ast.Tuple)) and any(constant(x) == "*" for x in origins.elts)
        if wild and any(constant(kw.get(k)) is True for k in ("allow_credentials", "supports_credentials")):
            yield "permissive_cors"

    # --- flows
    def flows(self, tree: ast.Module) -> None:
        self.block(tree.body, {})
        for f in ast.walk(tree):
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.block(f.body, {})

    def source_of(self, node: ast.AST) -> list[str] | None:
        """The start of a flow if the node reads a request."""
        base = node.func.value if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("get", "get_json", "getlist") else node.value if isinstance(node, ast.Subscript) else node
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get_json" and isinstance(node.func.value, ast.Name) and node.func.value.id in self.requests:
            return [self.text(node)]
        if isinstance(base, ast.Attribute) and base.attr in REQUEST_PARTS and isinstance(base.value, ast.Name) and base.value.id in self.requests:
            return [self.text(node)]
        return None

    def value(self, node: ast.AST | None, env: dict) -> list[str] | None:
        """The path of a value from a request, None for a clean one."""
        if node is None or isinstance(node, (ast.Constant, ast.Lambda)):
            return None
        if s := self.source_of(node):
            return s
        if isinstance(node, ast.Name):
            return env.get(node.id)
        if isinstance(node, ast.Call):
            name = self.name(node.func)
            short = name.rsplit(".", 1)[-1]
            args = [self.value(a, env) for a in (*node.args, *[k.value for k in node.keywords])]
            f = self.local.get(name)
            if f is not None and name not in self.active:
                return self.returned(f, args)
            if short.startswith(CLEANERS):
                return None
            found = next((a for a in args if a), None) or (self.value(node.func.value, env) if isinstance(node.func, ast.Attribute) else None)
            return [*found, f"{name}()"] if found else None
        return next((v for child in ast.iter_child_nodes(node) if (v := self.value(child, env))), None)

    def returned(self, f: ast.FunctionDef, args: list) -> list[str] | None:
        """What a local function gives back for these arguments."""
        names = [a.arg for a in (*f.args.posonlyargs, *f.args.args)]
        self.active.add(f.name)
        try:
            env = {n: [*v, n] for n, v in zip(names, args) if v}
            if f.name.startswith(CLEANERS):  # a cleaner counts unless it gives its argument back as it is
                same = any(isinstance(r, ast.Return) and isinstance(r.value, ast.Name) and r.value.id in env for r in ast.walk(f))
                return next(iter(env.values()), None) if same else None
            found: list = []
            self.block(f.body, env, found)
            return found[0] if found else None
        finally:
            self.active.discard(f.name)

    def block(self, body: list[ast.stmt], env: dict, returns: list | None = None) -> None:
        for s in body:
            for e in ast.iter_child_nodes(s):
                if isinstance(e, ast.expr):
                    for c in ast.walk(e):
                        if isinstance(c, ast.Call):
                            self.sink(c, env)
            if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                got = self.value(s.value, env)
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    for n in ast.walk(t):
                        if isinstance(n, ast.Name):
                            if isinstance(s.value, ast.Name) and s.value.id in self.requests:
                                self.requests.add(n.id)
                            elif got:
                                env[n.id] = [*got, n.id]
                            elif not isinstance(s, ast.AugAssign):
                                env.pop(n.id, None)
            elif isinstance(s, ast.If):
                yes, no = dict(env), dict(env)
                self.block(s.body, yes, returns)
                self.block(s.orelse, no, returns)
                leaves = bool(s.body) and isinstance(s.body[-1], (ast.Return, ast.Raise, ast.Continue, ast.Break))
                env.clear()
                env.update(no if leaves else {**no, **yes})
                test = s.test.operand if isinstance(s.test, ast.UnaryOp) and isinstance(s.test.op, ast.Not) else None
                if leaves and isinstance(test, ast.Call) and self.name(test.func).rsplit(".", 1)[-1].startswith(("is_valid_", "is_allowed_")):
                    for a in test.args:
                        if isinstance(a, ast.Name):
                            env.pop(a.id, None)
            elif isinstance(s, (ast.For, ast.AsyncFor)):
                if got := self.value(s.iter, env):
                    env.update({n.id: [*got, n.id] for n in ast.walk(s.target) if isinstance(n, ast.Name)})
                self.block([*s.body, *s.orelse], env, returns)
            elif isinstance(s, ast.While):
                self.block([*s.body, *s.orelse], env, returns)
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                self.block(s.body, env, returns)
            elif isinstance(s, ast.Try):
                self.block([*s.body, *[x for h in s.handlers for x in h.body], *s.orelse, *s.finalbody], env, returns)
            elif isinstance(s, ast.Return) and returns is not None and (got := self.value(s.value, env)):
                returns.append(got)

    def sink(self, c: ast.Call, env: dict) -> None:
        n = self.name(c.func)
        parts = n.split(".")
        first = self.value(c.args[0], env) if c.args else None
        shell = any(k.arg == "shell" and constant(k.value) is True for k in c.keywords)

        def flow(rule: str, path: list[str]) -> None:
            row = ("flow", rule, c.lineno, c.end_lineno, SEVERITY[rule], self.text(c), [*path, n or parts[-1]])
            if not any(r[:3] == row[:3] for r in self.rows):
                self.rows.append(row)

        if first and len(parts) > 1 and parts[-1] in SQL_CALLS:
            flow("sql_injection", first)
        if first and n in ("os.system", "os.popen"):
            flow("command_injection", first)
            flow("os_system_call", first)
        if first and parts[0] == "subprocess" and parts[-1] in SHELL_CALLS and shell:
            flow("command_injection", first)
        url = self.value(c.args[1], env) if n in ("requests.request", "httpx.request") and len(c.args) > 1 else first
        url = url or next((self.value(k.value, env) for k in c.keywords if k.arg == "url"), None)
        if url and (len(parts) == 2 and parts[0] in HTTP_MODULES and parts[1] in HTTP_CALLS or n == "urllib.request.urlopen"):
            flow("ssrf", url)
            flow("ssrf_untrusted_url", url)
        if first and parts[-1] in ("mark_safe", "Markup"):
            flow("xss_unsafe_html_sink", first)
        target = first if n in PATH_CALLS else self.value(c.func.value, env) if parts[-1] in PATH_METHODS and isinstance(c.func, ast.Attribute) else None
        if target:
            flow("path_traversal_file", target)


def read(text: str) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
        r = Reader(text)
        r.structure(tree)
        r.calls(tree)
        r.flows(tree)
        return r.rows
    except SyntaxError as e:
        return [("error", e.msg, e.lineno, e.lineno, None, None, None)]
    except (ValueError, RecursionError, MemoryError) as e:
        return [("error", type(e).__name__, None, None, None, None, None)]


def _run(keys: list[str], types: list[pa.DataType]):
    names = [*keys, *COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                heads = list(zip(*(part.column(i).to_pylist() for i in range(len(keys)))))
                rows = [(*h, *r) for h, t in zip(heads, part.column(len(keys))) for r in read(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*types, *COLUMNS.values()])], names)

    return run


def read_python(files: DataFrame, keys: dict[str, str], content: str = "content") -> DataFrame:
    """The rows of every Python text of ``files`` (the caller filters by language); keys: column to DDL type (bigint or string) carried along."""
    need = files.where(F.col(content) != "").select(*[F.col(k).cast(t) for k, t in keys.items()], content)
    types = [pa.int64() if t == "bigint" else pa.string() for t in keys.values()]
    return spread(need).mapInArrow(_run(list(keys), types), ", ".join(f"{k} {t}" for k, t in keys.items()) + ", " + DDL)
