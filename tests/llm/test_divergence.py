"""The divergence audit against plain Python and against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from rankwright.llm import divergence as dv

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top, least):
    """(lang, source, part, item, value, rank) straight from the definition."""
    docs, groups, n = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        groups.add((lang, source))
        docs[lang].update(set(words))
        n[lang, source].update(words)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {x for x, _ in groups}:
        kept = {t for t, d in docs[lang].items() if d >= least}
        own = sorted((s for x, s in groups if x == lang), key=str.encode)
        p = {}
        for s in [None, *own]:
            count = {t: sum(n[lang, x][t] for x in own) if s is None else n[lang, s][t] for t in kept}
            total = sum(count.values()) + 2 * len(kept)
            p[s] = {t: 1 + 10**9 * (c + 2) // total for t, c in count.items()}
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if n[lang, s][t] > 0 and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["Été", "ÉTÉ", "été", "日本", "Ab", "aB"]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "d", "e", "f", "g", "é", None])
        bias = sum(map(ord, source or "x")) % 50
        text = " ".join(rng.choice(words[bias : bias + 40] if rng.random() < 0.7 else words) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, lang, source))
    return [*rows, *rows[:5], (900, None, "en", "silent"), (901, "", "fr", "alone"), (902, "12 34", "it", "x"), (903, "rare", "it", "y"), (904, None, "it", None)]


@pytest.mark.parametrize("tile, top, least", [(dv.TILE, 10, 3), (3, 4, 5), (1, 1, 1)])
def test_audit_agrees_with_the_definition(spark, corpus, tile, top, least, monkeypatch):
    monkeypatch.setattr(dv, "FIRST", 1)
    monkeypatch.setattr(dv, "GROWTH", 2)
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(5)
    assert rows_of(dv.audit(docs, top, least, tile)) == plain(corpus, top, least)


def test_odd_and_empty_tables(spark, odd, empty):
    want = plain([tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()], 10, 1)
    assert rows_of(dv.audit(odd, least=1)) == want
    assert rows_of(dv.audit(empty)) == []


def test_search_opens_no_more_than_it_must(spark, monkeypatch):
    """A group with one term far ahead of hundreds: the first round decides, and the others' rows are never evaluated."""
    rows = [("en", "s", f"t{i:03d}", 0, 1, 0, 1_000_000 if i == 0 else 2_000 + i, 1_000, 40 if i == 0 else i % 7) for i in range(300)]
    postings = spark.createDataFrame(rows, "lang string, source string, term string, i int, sources int, b long, p long, q long, bucket int")
    monkeypatch.setattr(dv, "FIRST", 1)
    met = []
    plain_attach = dv.attach_groups
    monkeypatch.setattr(dv, "attach_groups", lambda r, g, k, s, n: met.append(sum(x[s] for x in g.collect())) or plain_attach(r, g, k, s, n))
    assert [(r.term, r["rank"]) for r in dv.top_terms(postings, 1).collect()] == [("t000", 1)]
    assert met == [1]


def test_ties_at_the_last_rank_go_by_name(spark, monkeypatch):
    rows = [("en", "s", t, 0, 1, 0, 5_000, 1_000, b) for t, b in (("z", 9), ("a", 2), ("m", 5))]
    postings = spark.createDataFrame(rows, "lang string, source string, term string, i int, sources int, b long, p long, q long, bucket int")
    monkeypatch.setattr(dv, "FIRST", 1)
    assert [r.term for r in dv.top_terms(postings, 1).collect()] == ["a"]


def test_probability_is_exact_for_large_counts(spark):
    n, total, v = 4 * 10**12, 9 * 10**14, 10**7
    df = spark.range(1).select(dv.probability(*(dv.F.lit(x).cast("long") for x in (n, total, v))).alias("p"))
    assert df.first().p == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_query_agrees_with_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(c.sql(dv.SQL["op11_source_divergence"]).select("lang, source, part, item, value, rank").fetchall())
    assert rows_of(dv.op11_source_divergence(spark, sf)) == want
