"""Masks over identifiers of code and prose: all but key words, those that look like symbols, and those that are no API shape.

The first two are expressions. The third depends on what stands around an
identifier (the signs before and after it, the line so far, the identifier
before), which one pass over the text carries along, so it runs on Arrow
batches; a text costs time in proportion to its length however long its lines are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rankwright.session import ship

# fixed values: key words of Java and of C and C++, which no mask touches, and the patterns of what is masked first
JAVA_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
    "instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient "
    "true try void volatile while"
).split()
C_WORDS = (
    "alignas alignof and asm auto bitand bitor bool break case catch char class const constexpr continue decltype default delete do double else enum explicit extern "
    "false float for friend goto if inline int long mutable namespace new noexcept not nullptr operator or override private protected public register return short "
    "signed sizeof static struct switch template this throw true try typedef typename union unsigned using virtual void volatile while xor"
).split()
KEEP = sorted(set(JAVA_WORDS) | set(C_WORDS))
IDENTIFIER = r"\b[A-Za-z_$][A-Za-z0-9_$]*\b"
PATH = r"\b(?:[A-Za-z0-9_.+-]+/)+[A-Za-z0-9_.+-]+\b"
URL = r"https?://\S+"
WEAKNESS = r"\b(?:CVE|CWE)-\d+(?:-\d+)?\b"
LITERAL = r"(?:\b[rRuUbBfF]*)(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
DECLARE = frozenset("def function class interface struct enum".split())
OPERATES = re.compile(r"[=(\[.]|->|return|if|while|for")

#: Java's word boundaries know other letters than ASCII's only under this flag.
_U = "(?U)"


def mask_symbols(t: Column, keep: list[str] = KEEP) -> Column:
    """Every identifier but those of ``keep`` becomes ID."""
    held = rf"(?!(?:{'|'.join(map(re.escape, keep))})\$*(?![\w$]))" if keep else ""
    return F.regexp_replace(t, rf"{_U}\b{held}{IDENTIFIER[2:]}", "ID")


def mask_query_symbols(t: Column) -> Column:
    """URL, vulnerability ids and paths first; then identifiers with a digit, _, $ or a change from lower to upper case become ID."""
    for pattern, name in ((URL, "URL"), ("(?i)" + WEAKNESS, "ID"), (PATH, "PATH")):
        t = F.regexp_replace(t, _U + pattern, name)
    looks = r"(?=[A-Za-z0-9_$]*(?:[_0-9]|\$(?=\w)|[a-z][A-Z]))"
    return F.regexp_replace(t, rf"{_U}\b{looks}{IDENTIFIER[2:]}", "ID")


_IDENTIFIER, _FIRST = re.compile(IDENTIFIER), [(re.compile(URL), "URL"), (re.compile(PATH), "PATH"), (re.compile(LITERAL), "STR")]
_KEEP, _FILLED = frozenset(KEEP), re.compile(r"\S")


def api_shape(text: str) -> str:
    """One text: URL, PATH and STR first; then members, calls and commands stay, and any other identifier becomes ID.

    A member stands next to a dot. A call stands before a bracket and is no
    declared name: the identifier before it declares nothing, and its line is
    empty so far, holds an operator or a control word, or no identifier. A
    command is the first thing of its line, with something else after it than
    the end, =, :, . or a bracket.
    """
    for pattern, name in _FIRST:
        text = pattern.sub(name, text)
    out, done, before = [], 0, ""
    line, seen, operates, named = 0, 0, False, False  # of the line so far: its start, how far it was looked at, an operator, an identifier
    for m in _IDENTIFIER.finditer(text):
        start, end = m.span()
        first = text.rfind("\n", seen, start) + 1
        if first:
            line, seen, operates, named = first, first, False, False
        operates = operates or OPERATES.search(text, max(line, seen - 6), start) is not None  # the longest word has six signs
        seen = start
        token = m[0]
        if token not in _KEEP:
            after = _FILLED.search(text, end)
            after = after[0] if after else ""
            blank = _FILLED.search(text, line, start) is None
            declared = before in DECLARE or (named and not operates)
            if not ("." in (_last(text, start), after) or (after == "(" and not declared) or (blank and after not in ("", "=", ":", ".", "("))):
                out += [text[done:start], "ID"]
                done = end
        before, named = token, True
    return "".join(out) + text[done:]


def _last(text: str, at: int) -> str:
    """The last sign before ``at`` that is no white space."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return text[at - 1] if at else ""


def mask_api_shape(t: Column | str) -> Column:
    """``api_shape`` of a column; null stays null."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(api_shape, na_action="ignore")

    return run(t)
