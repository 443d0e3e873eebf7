"""Terms counted inside a task against plain Python."""

import re
from collections import Counter

import pytest

from rankwright.llm import divergence as dv
from tests.llm.test_divergence import UPPER

ROWS = [
    ("en", "a", "Ab aB AB cd\x00cd ÉTÉ été 日本x日本"), ("en", "b", None), ("en", "a", "ab [ab] `ab{ @ 12"), (None, "a", "x y İI ẞ ß"),
    ("en", None, "w " * 3000), ("de", "é", "\u0080\x7fÿ"), ("en", "a", "Ab aB AB cd\x00cd ÉTÉ été 日本x日本"),
]


@pytest.mark.parametrize("entries", [1, 4, 200_000])
def test_counts_over_any_number_of_flushes(spark, monkeypatch, entries):
    monkeypatch.setattr(dv, "ENTRIES", entries)
    n, d = Counter(), Counter()
    for lang, source, text in ROWS:
        words = [(lang or "", source or "", w) for w in re.findall(dv.WORD, (text or "").translate(UPPER))]
        n.update(words)
        d.update(set(words))
    batch = dv.pa.RecordBatch.from_pydict({k: [(r[i] or "").encode() for r in ROWS] for i, k in enumerate(("lang", "source", "text"))})
    got_n, got_d = Counter(), Counter()
    for out in dv.counted(iter([batch, batch.slice(0, 0)])):
        for r in out.to_pylist():
            key = tuple(r[c].decode() for c in ("lang", "source", "term"))
            got_n[key] += r["n"]
            got_d[key] += r["d"]
    assert got_n == n and got_d == d
    rows = dv.term_counts(spark.createDataFrame(ROWS, "lang string, source string, text string"), 1).collect()
    assert {(r.lang, r.source, r.term): r.n for r in rows} == n


def test_texts_leave_no_row_for_each_word(spark, monkeypatch):
    """Terms are summed in the task: a generated row for each occurrence took most of the operator's time."""
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string")
    assert "Generate" not in dv.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
