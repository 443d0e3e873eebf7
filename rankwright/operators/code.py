"""Source code: functions with their lines, by one scan with a stack of open braces; JSON objects in prose.

Character state machines, so Arrow-batched Python: a file is one row and is
scanned once, whatever its nesting. Without a path every closed brace that has
a signature before it is a function, nested ones included. With a path the
language decides: Java wants a modifier, C and C++ a type before the name,
other files hold no functions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.operators.masking import C_WORDS, JAVA_WORDS
from rankwright.session import ship

# a comment that is not closed leaves the last sign of the text; a string goes on over line ends
_NOISE = re.compile(r"//[^\n]*|/\*(?:.*?\*/|.*(?=.\Z)|)|\"(?:\\.|[^\"\\])*\\?(?:\"|\Z)|'(?:\\.|[^'\\])*\\?(?:'|\Z)", re.S)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_STRING = re.compile(r"\"(?:\\.|[^\"\\])*\\?(?:\"|\Z)|'(?:\\.|[^'\\])*\\?(?:'|\Z)", re.S)
_SIGNS = re.compile(r"[{}\n;]")
# fixed values: shapes of signatures, words that open a block and modifiers
_SIGNATURE = re.compile(r"([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:throws\s+[^{]+)?$")
_NEW = re.compile(r"\bnew\s+\w+\s*\(")
_BLOCKS = ("if ", "for ", "while ", "switch ", "catch ", "try ", "else ")
_JAVA = re.compile(r"\b(?P<name>[A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:throws\s+[^{;]+)?\{")
_MODIFIERS = {"public", "protected", "private", "static", "final", "synchronized", "abstract", "default"}
_C = re.compile(
    r"(?P<name>~?[A-Za-z_][A-Za-z0-9_]*|operator\s*[^\s(]+)\s*\([^;{}]*\)\s*(?:(?:const|volatile|override|final)\s*)?"
    r"(?:noexcept(?:\s*\([^)]*\))?\s*)?(?:->\s*[A-Za-z_][A-Za-z0-9_:<>,\s*&\[\]]*)?$"
)
_BEFORE = {"if", "for", "while", "switch", "catch", "return"}
JAVA_FILES, C_FILES = (".java",), (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx")
#: Lines that a signature may span.
JAVA_LINES, C_LINES = 6, 8


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def blank_noise(text: str) -> str:
    """Comments and strings become blanks; length and line ends stay."""
    return _NOISE.sub(_blank, text)


def pairs_of(clean: str) -> tuple[dict[int, int], dict[int, int]]:
    """Where each brace closes, and where the statement of each open brace begins: one pass with a stack."""
    close, begin, stack, last = {}, {}, [], 0
    for m in _SIGNS.finditer(clean):
        at = m.start()
        if m[0] == "{":
            stack.append(at)
            begin[at] = last
        else:
            last = at + 1
            if m[0] == "}" and stack:
                close[stack.pop()] = at
    return close, begin


class _Lines:
    """Line numbers of offsets: one sorted array of line ends."""

    def __init__(self, text: str) -> None:
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def at(self, offset: int) -> int:
        return bisect_right(self.ends, offset - 1) + 1


def functions_in(text: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, first line, last line) of every closed brace with a signature, in their order; nested ones too, unclosed ones not."""
    clean = blank_noise(text)
    close, begin = pairs_of(clean)
    lines, out = _Lines(text), []
    for at in sorted(close):
        head = " ".join(clean[begin[at] : at].split())
        if not head or head.startswith(_BLOCKS) or ("=" in head and not _NEW.search(head)):
            continue
        m = _SIGNATURE.search(head)
        if m:
            kind = "constructor_declaration" if re.search(rf"\bclass\s+{re.escape(m[1])}\b", head) else "method_declaration"
            out.append((m[1], kind, lines.at(begin[at]), lines.at(close[at])))
    return out


def _java_name(head: str) -> str | None:
    m = _JAVA.search(head)
    return m["name"] if m and m["name"] not in JAVA_WORDS and _MODIFIERS & set(head[: m.start("name")].split()) else None


def _c_name(head: str) -> str | None:
    before = head.split("{", 1)[0]
    m = None if ";" in before else _C.search(" ".join(before.split()))
    if not m:
        return None
    name, ahead = m["name"].replace(" ", ""), m.string[: m.start("name")].split()
    return name if ahead and name.lstrip("~") not in C_WORDS and ahead[-1].strip("*&:") not in _BEFORE else None


def functions_of(path: str, text: str) -> list[tuple[str, str, int, int]]:
    """The functions of a file by the rule of its language; one that is not closed runs to the end of the text."""
    java = path.endswith(JAVA_FILES)
    if not java and not path.endswith(C_FILES):
        return []
    clean = _COMMENT.sub(_blank, text)
    close, _ = pairs_of(_STRING.sub(_blank, clean))
    rows = clean.split("\n")
    starts, at = [], 0
    for row in rows:
        starts.append(at)
        at += len(row) + 1
    out: dict[tuple[int, int], tuple[str, str, int, int]] = {}
    lines = _Lines(text)
    for i, row in enumerate(rows):
        if "(" not in row or (not java and row.lstrip().startswith("#")):
            continue
        head = ""
        for j in range(i, min(i + (JAVA_LINES if java else C_LINES), len(rows))):
            head = f"{head} {rows[j].strip()}".strip()
            if "{" in rows[j]:
                name = _java_name(head) if java else _c_name(head)
                if name:
                    end = lines.at(close.get(starts[j] + rows[j].index("{"), len(text) - 1))
                    out.setdefault((i + 1, end), (name, "function", i + 1, end))
                break
    return list(out.values())


def extract_functions(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """One row for each function of each file: key, symbol, kind, start_line, end_line, code (its lines as they stand)."""
    ship(df.sparkSession)
    used = [key, text] + ([path] if path else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, p in zip(b[key], b[text], b[path] if path else [""] * len(b)):
                found = (functions_of(p or "", t) if path else functions_in(t)) if t else []
                parts = t.split("\n") if found else []
                rows += [(k, *f, "\n".join(parts[f[2] - 1 : f[3]])) for f in found]
            yield pd.DataFrame(rows, columns=[key, "symbol", "kind", "start_line", "end_line", "code"])

    return df.select(*used).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, symbol string, kind string, start_line int, end_line int, code string")


def brace_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """The first balanced JSON object in prose that parses, else null."""
    import json

    ship(df.sparkSession)

    def scan(t: str | None) -> str | None:
        dec, at = json.JSONDecoder(), (t or "").find("{")
        while at >= 0:
            try:
                got, end = dec.raw_decode(t, at)
                if isinstance(got, dict):
                    return t[at:end]
            except ValueError:
                pass
            at = t.find("{", at + 1)
        return None

    @F.pandas_udf("string")
    def found(s: pd.Series) -> pd.Series:
        return s.map(scan)

    return df.withColumn(out, found(text))
