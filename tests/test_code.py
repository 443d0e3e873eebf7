"""Masks and function extraction against plain versions written from their statements."""

import hashlib
import random
import re

import pytest

from rankwright.operators import code
from rankwright.operators import masking as M
from rankwright.plans import catalog
from rankwright.plans.fixtures import BLOCK
from rankwright.session import table

WORD = re.compile(r"\b[A-Za-z_$][A-Za-z0-9_$]*\b")


def symbols(text):
    return WORD.sub(lambda m: m[0] if m[0] in M.KEEP else "ID", text)


def query_symbols(text):
    text = re.sub(r"https?://\S+", "URL", text)
    text = re.sub(r"(?i)\b(?:CVE|CWE)-\d+(?:-\d+)?\b", "ID", text)
    text = re.sub(M.PATH, "PATH", text)

    def one(m):
        t = m[0]
        camel = any(a.islower() and b.isupper() for a, b in zip(t, t[1:]))
        return "ID" if "_" in t or "$" in t or camel or any(c.isdigit() for c in t) else t

    return WORD.sub(one, text)


def api_shape(text):
    """Every question asked anew for every identifier, of the text before and after it."""
    for pattern, name in ((M.URL, "URL"), (M.PATH, "PATH"), (M.LITERAL, "STR")):
        text = re.sub(pattern, name, text)

    def one(m):
        t, before, after = m[0], text[: m.start()], text[m.end() :].lstrip()[:1]
        if t in M.KEEP:
            return t
        line = before[before.rfind("\n") + 1 :].strip()
        last = WORD.findall(before)[-1:]
        if last and last[0] in ("def", "function", "class", "interface", "struct", "enum"):
            declared = True
        elif not line or any(x in line for x in ("=", "(", "[", ".", "->", "return", "if", "while", "for")):
            declared = False
        else:
            declared = bool(WORD.findall(line.replace("*", " ").replace("&", " ")))
        member = before.rstrip()[-1:] == "." or after == "."
        command = not line and after not in ("", "=", ":", ".", "(")
        return t if member or command or (after == "(" and not declared) else "ID"

    return WORD.sub(one, text)


PIECES = ["os.path.islink(p)", "def run(x):", "int main ( void )", "class A", "rm -rf /tmp/x", "https://a.b/c d", 'f"a b"', "'c'", "x = y", "if (diff) {", "return foo(bar)", "CVE-2020-1 cwe-79", "a$b $c d$ e", "toDo x_y z9",
          "*ptr &ref name(", "\n", "\n  ", ";", "notify ", "->m", "[i]", " . ", "été", "éa", "a/b.c/d", "struct\n s (", "x", " ", "\t", "\x1c", "if$", "while", "for$é", "\\", '"']


def test_masks_of_random_code(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(600)] + ["", None, *PIECES]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    got = df.select("k", M.mask_symbols(df.t).alias("a"), M.mask_query_symbols(df.t).alias("b"), M.mask_api_shape("t").alias("c")).collect()
    for r in got:
        t = texts[r.k]
        assert (r.a, r.b, r.c) == ((symbols(t), query_symbols(t), api_shape(t)) if t is not None else (None, None, None)), t


def test_members_calls_and_commands_stay():
    text = "def check(path):\n    if os.path.islink(path):\n        unlink(path)\nchmod 755 target\nint total = size(items)\nint helper(int n)\n"
    assert M.api_shape(text) == "def ID(ID):\n    if os.path.islink(ID):\n        unlink(ID)\nchmod 755 ID\nint ID = size(ID)\nint ID(int ID)\n"


def test_long_lines_take_linear_time():
    import time

    spent = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        M.api_shape("name other(x) " * n)
        spent.append(time.perf_counter() - began)
    assert spent[1] < 12 * spent[0]


def test_keep_list_masking(spark, sf):
    want = []
    for r in table(spark, sf, "documents").collect():
        blocks = [f"  // {line}\n" + "\n".join(BLOCK).replace("@", str(i + 1)) for i, line in enumerate((r.text or "").split("\n"))]
        want += [(r.doc_id, hashlib.sha256(api_shape(t).encode()).hexdigest()) for t in (r.text, "class T {\n" + "\n".join(blocks) + "\n}\n")]
    assert sorted((r.doc_id, r.h) for r in catalog.queries()["keep_list_masking"](spark, sf).collect()) == sorted(want)


def plain_functions(text):
    """Sign by sign: noise goes, then each open brace looks for its own close and its own statement."""
    clean, i = list(text), 0
    while i < len(text):
        if text.startswith("//", i):
            while i < len(text) and text[i] != "\n":
                clean[i] = " "
                i += 1
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            stop = end + 2 if end >= 0 else max(len(text) - 1, i + 2)
            clean[i:stop] = [c if c == "\n" else " " for c in text[i:stop]]
            i = stop
        elif text[i] in "\"'":
            q, j = text[i], i + 1
            while j < len(text) and text[j] != q:
                j += 2 if text[j] == "\\" else 1
            stop = min(j + 1, len(text))
            clean[i:stop] = [c if c == "\n" else " " for c in text[i:stop]]
            i = stop
        else:
            i += 1
    clean, out = "".join(clean), []
    for at, c in enumerate(clean):
        if c != "{":
            continue
        depth, end = 0, None
        for j in range(at, len(clean)):
            depth += (clean[j] == "{") - (clean[j] == "}")
            if depth == 0:
                end = j
                break
        if end is None:
            continue
        begin = max(clean.rfind(x, 0, at) for x in "\n;}") + 1
        head = " ".join(clean[begin:at].split())
        if not head or head.split()[0] in ("if", "for", "while", "switch", "catch", "try", "else") and " " in head:
            continue
        if "=" in head and not re.search(r"\bnew\s+\w+\s*\(", head):
            continue
        m = re.search(r"([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:throws\s+[^{]+)?$", head)
        if m:
            out.append((m[1], text.count("\n", 0, begin) + 1, text.count("\n", 0, end) + 1))
    return out


BITS = ["int f(int a) {", "}", "}", "{", "if (x) {", "if(x) {", " else {", "\n", "\n", ";", "// a } {\n", "/* { \n */", '"}{"', "'{'", "'\\''", '"a\\"}"', "/*", "class A {", "A() throws B, C {", "x = new T() {", "y = g() {", "void h (String s)\n{", "'", '"', "\\", "run(new R() { void g() { } })"]


def test_functions_of_random_code():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))
        assert [(n, a, z) for n, _, a, z in code.functions_in(text)] == plain_functions(text), text


def test_nested_ones_count_and_unclosed_ones_do_not(spark):
    text = "class A {\n  int one(int a) { // }\n    run(new B() { void two() { } });\n  }\n  int open_end(int x) {\n    x = 1;\n"
    rows = spark.createDataFrame([(1, text, None), (2, None, "a.c"), (3, "no code", "x"), (4, "int a(b) { if (x) { } }", "x.c")], "k int, t string, p string")
    got = sorted((r.k, r.symbol, r.start_line, r.end_line) for r in code.extract_functions(rows, "k", "t").collect())
    # a statement begins after a line end, a semicolon or a closing brace: the "if" of row 4 does not stand first in its own
    assert got == [(1, "one", 2, 4), (1, "run", 3, 3), (1, "two", 3, 3), (4, "a", 1, 1), (4, "if", 1, 1)]
    got = sorted((r.k, r.symbol, r.code) for r in code.extract_functions(rows, "k", "t", "p").collect())
    assert got == [(4, "a", "int a(b) { if (x) { } }")]


@pytest.mark.parametrize("path, want", [
    ("A.java", [("one", 2, 4), ("nested", 4, 4), ("last", 12, 14)]),
    ("b.cpp", [("one", 2, 4), ("~Gone", 6, 8), ("operator+=", 9, 9), ("tail", 10, 11), ("last", 12, 14)]),
    ("c.py", []),
])
def test_each_language_has_its_rule(path, want):
    text = """#define X(a) {
static int one(int a,
   String b) { /* }
   */ return "}"; public void nested() { } }
// int no() {
Type ::~Gone() {
  x();
}
T operator+=(T o) { }
auto tail(int n) const noexcept -> int
{ while (n) { n--; } return n; }
public static int last(int z) {
  if (z) {
  while (z) { z--; }
"""
    assert [(n, a, z) for n, _, a, z in code.functions_of(path, text)] == want


def test_deep_nesting_takes_linear_time():
    import time

    spent = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert len(code.functions_in("void f() {\n" * n + "}\n" * n + "void g() {\n" * 50)) == n
        spent.append(time.perf_counter() - began)
    assert spent[1] < 12 * spent[0]
