"""Valid and broken texts of each language, and the operator on small tables."""

import pytest

from orelode.llm import grammar, validity

VALID = {
    "javascript": [
        "", "// only\n/* comments */\n", "#!/usr/bin/env node\n'use strict'\nlet a = 1\nlet b = a / 2 / 3, c = /[/]x\\//g.test('y')\n",
        "import x, { y as z, default as w } from './m';\nexport default class extends x { #p = 1; static s() { return this.#p } get v() { return 1 } *[Symbol.iterator]() { yield* [1] } }\nexport * as q from 'r'\n",
        "const f = async ({ a, b: [c = 1, ...d] }, ...rest) => { for await (const x of y) { if (x) continue; else break } }\n", "label: for (;;) { break label }\nif (a) b(); else if (c) d()\nelse { e() }\n",
        "const t = `a ${b ? `c ${d}` : { e: 1 }.e} f`;\nx = a ? b ? c : d : e => f\n", "try { a() } catch { b() } finally { c() }\nswitch (x) { case 1: case 'a': y(); break; default: z() }\ndo x++; while (x < 5)\n",
        "a = b\n  .c(d)\n  ?.e?.[f]\n  || g\nvar { h = 2, ...i } = { j, k() {}, get l() { return 1 }, [m + 1]: 2, 'n': 3, async o() {} }\n", "!function (w) { w.x = 1 }(this), void 0;new Foo;new (bar())(1).baz\n",
        "var s = 'a\\\nb', n = 0xFFn + .5e-3 + 1_000;\nif (!x) throw new Error(`no ${x}`)\n",
    ],
    "typescript": [
        "import type { A } from './a';\nexport interface B<T extends A = A> extends C<T>, D { readonly x?: string; [key: string]: any; (y: number): void; m<U>(z: U): U }\n",
        "type F = (a: number, ...b: string[]) => void | Promise<Map<string, Array<number>>>;\ntype G<T> = T extends (infer U)[] ? U : { [K in keyof T]?: T[K] };\n",
        "abstract class K<T> implements L, M<T> { private readonly a: number = 1; constructor(public b: string, protected c?: T) { super() } abstract d(): void; static e = <X,>(x: X): X => x; get f(): number { return this.a! } }\n",
        "enum E { A = 1, B, C = 'x'.length }\ndeclare module 'm' { export function f(x: number): string }\nnamespace N.O { export const p = 1 }\nfunction g(this: W, x: unknown): x is string\n",
        "const x = y as const;\nlet z = <any>w;\nfor (let i = 0; i < n && j > m; i++) f(a < b, c > d);\nconst h = async <T>(a: T): Promise<T[]> => { return [a] satisfies T[] }\n", "@Dec({ a: 1 })\nexport class P { @Input() q!: string; r?: Record<string, { s: number }[]> }\n",
    ],
    "java": [
        "package a.b;\nimport static java.util.Map.*;\npublic final class A<T extends Comparable<T> & B> extends C<List<Map<String, int[]>>> implements D, E { static { x(); } private final int[] f = {1, 2}, g[] = new int[3][]; @Override public <U> A(U u) throws X, Y { super(u); this.f = new int[]{1}; } }\n",
        "interface I { default void m(final String... s) { for (String x : s) { if (x == null) continue; else break; } } int k(); }\nenum E { A(1) { void m() {} }, B; private E(int... i) {} }\nrecord R(int a, String b) implements I { R { if (a < 0) throw new X(); } }\n@interface N { String value() default \"x\"; }\n",
        "class L { void m() { Runnable r = () -> { return; }; F<X, Y> f = (a, b) -> a.c(b) ? (int) a : -b; List<? super X> l = new ArrayList<>() { int q; }; try (A a = b(); C c = d()) { e(); } catch (X | Y z) { } finally { } switch (k) { case 1: case A: x(); break; default -> y(); } } }\n".replace("default -> y();", "default: y();"),
        "class S { Object o = switch (x) { case 1, 2 -> \"a\"; default -> { yield b; } }; boolean t = o instanceof String s && s.length() > 2; String q = \"\"\"\n  text \"block\"\n  \"\"\"; char c = '\\u0041'; int i = a[0]++ + (b) - ~c >>> 2; X::new y; }\n".replace(" X::new y;", " F g = X::new;"),
    ],
    "cpp": [
        "#include <vector>\n#include \"a.h\"\n#define M(x) \\\n  ((x) + 1)\nnamespace a::b { template <typename T, int N = 3> class C final : public D<T>, private virtual E { public: explicit C(int x) noexcept : D<T>(x), y_{x} {} ~C() = default; C& operator=(const C&) = delete; virtual int f() const override = 0; private: int y_ = 0; std::map<std::string, std::vector<int>> m_; }; }\n",
        "static const int kTable[] = {1, 2, 3};\nint main(int argc, char** argv) { for (const auto& [k, v] : m) { if (auto it = x.find(k); it != x.end()) return it->second; } auto l = [&, n = 1](int a) mutable -> bool { return a < n && a > 0; }; std::cout << \"a\" \"b\" << std::endl; delete[] p; return static_cast<int>(x) ? 1 : 0; }\n",
        "enum class Color : int { Red = 1, Green };\nusing V = std::vector<Color>;\ntypedef unsigned long ul;\nextern \"C\" { void f(void); }\ntemplate <> struct S<int> { static constexpr int v = 1; };\nauto g() -> std::string;\nusing namespace std;\nstd::unique_ptr<Foo> a(new Foo(1)), b{nullptr};\nvoid Foo::bar(int&& x) const { do { x--; } while (x); switch (x) { case 1: break; default: throw std::runtime_error(R\"(a)\"); } }\n",
    ],
}
BROKEN = {
    "javascript": ["let a = ;", "if (a { b() }", "function f( { }", "let s = 'x\n';", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x\n", "def f(x):\n    return x\n", "class A { public int x; }", "foo(a b)", "let x: number = 1", "/* open", "{ \"a\": 1, \"b\": 2 }", "return a b;", "for (let i = 0; i < n) {}"],
    "typescript": ["let x: = 1", "interface A { b: }", "function f(a: string {}", "@@ -1,3 +1,4 @@\nlet a = 1", "... rest omitted ...", "const a = [1, 2;", "class A { b(): void { } "],
    "java": ["class A { void f() { int x = 1 } }", "class A { void f( { } }", "public class { }", "int x = 1;", "class A { String s = \"x; }", "class A { void f() { if x > 1 { } } }", "function f() {}", "package a.b\nclass A {}", "class A { void f() { a b c; } }"],
    "cpp": ["int main() { return 0; ", "int f( { }", "class A { int x }", "#includ <a>\nint x;", "int x = ;", "def f():\n  pass\n", "int main() { int a = 1 int b; }", "#if X\nint a;\n", "std::vector<int x;"],
}


@pytest.mark.parametrize("language", list(VALID))
def test_valid_texts_follow(language):
    assert [t for t in VALID[language] if not grammar.follows(t, language)] == []


@pytest.mark.parametrize("language", list(BROKEN))
def test_broken_texts_do_not(language):
    assert [t for t in BROKEN[language] if grammar.follows(t, language)] == []


def test_python_and_marks():
    assert grammar.follows("﻿def f(): return 1\n", "python") and not grammar.follows("print 'x'\n", "python") and not grammar.follows("a\0b", "python")
    assert grammar.follows("﻿let a = 1", "javascript")


def test_operator(spark):
    rows = [(1, "p", "JavaScript ", "let a = 1", "x"), (2, "p", "js", "def f():\n    return 1\n", "x"), (3, "p", "java", "class A {", "x"), (4, "p", "other", "{{{", "x"), (5, None, None, "{{{", "x"), (6, "p", "Python", None, "x"), (7, "p", "python", " \n", "x"), (3, "p", "java", "class A {", "x")]
    df = spark.createDataFrame(rows, "file_id bigint, project_id string, language string, content string, valid string")
    got = validity.check_files(df)
    assert sorted((r["file_id"], r["valid"], r["cause"], r["parsed_as"]) for r in got.collect()) == [(1, True, "valid", None), (2, False, "other_language", "python"), (3, False, "broken", None), (3, False, "broken", None)]
    assert {(r["project_id"], r["language"], r["files"], r["invalid"], r["rate"]) for r in validity.rates(got).collect()} == {("p", "javascript", 2, 1, 0.5), ("p", "java", 2, 2, 1.0)}
    assert validity.check_files(df.limit(0)).count() == 0
