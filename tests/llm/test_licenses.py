"""Rules against a plain matcher: every rule, and texts where detections touch, nest and overlap."""

import random
import re
from re import _parser

from pyspark.sql import functions as F
from test_whole_job import _spelled

from rankwright.llm import licenses


def normal(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", low).strip() + " "


def standing(words, rules):
    """Labels and score of the detections that stand, one after another."""
    found = sorted((m.start(), -m.end(), p, label, w) for label, _, regex, p, w in rules for m in re.finditer(regex, words))
    out, now = [], None
    for s, e, p, label, w in found:
        e = -e
        if now is None or s >= now[0]:
            if now:
                out.append(now)
            now = (e, p, label, w)
        elif e > now[0] and p < now[1]:
            now = (e, p, label, w)
    if now:
        out.append(now)
    return {x[2] for x in out}, max((x[3] for x in out), default=0.0)


def check(spark, texts):
    rules = licenses.rules()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    for r in licenses.scan(df).collect():
        words = normal(r.text)
        labels, score = standing(words, rules)
        base = [m[1] for m in re.finditer(r" (mit|apache|general public)(?= license )", words)]
        names = {"mit": "mit", "apache": "apache", "general public": "gpl"}
        assert r.n_base == len(base) and set(filter(None, r.base_labels.split(","))) == {names[b] for b in base}, r.text
        assert set(filter(None, r.labels.split(","))) == labels | {names[b] for b in base}, r.text
        assert r.score == max(score, 0.7 if base else 0.0)


def test_there_are_hundreds_of_written_rules():
    assert len(licenses.SENTENCES) > 200 and len({x for *_, x in licenses.SENTENCES}) == len(licenses.SENTENCES)


def test_every_rule_alone(spark):
    texts = [_spelled(_parser.parse(regex)) for _, _, regex, *_ in licenses.rules()]
    check(spark, [t for ways in texts for t in {ways[0], ways[-1]}])


def test_mixtures(spark):
    r = random.Random(7)
    words = [_spelled(_parser.parse(regex))[-1].split() for _, _, regex, *_ in licenses.rules()]
    texts = []
    for _ in range(300):
        parts = []
        for w in r.choices(words, k=r.randrange(1, 6)):
            a = r.choice([0, 0, 0, r.randrange(len(w))])
            parts += w[a : r.choice([len(w), len(w), r.randrange(len(w) + 1)])] + r.choices(["filler", "the", "license", "2 0"], k=r.randrange(3))
        texts.append(r.choice([" ", "\n", " -- "]).join(w.upper() if r.random() < 0.3 else w for w in parts))
    check(spark, [*texts, "", "MIT License. " * 700])


def test_partial_overlap_goes_by_priority(spark):
    # the sentence ends in the middle of a tag; the tag has the better priority and stands
    text = "You may not use this file except in compliance with the license. SPDX-License-Identifier: MIT"
    assert "mit" in licenses.scan(spark.createDataFrame([(text,)], "text string")).first().labels.split(",")
    rules = [("long", "a", " a b c(?= )", 2, 0.5), ("tag", "c", " c d(?= )", 0, 0.9), ("low", "d", " d e f(?= )", 3, 0.4)]
    assert standing(" a b c d e f ", rules)[0] == {"tag"}
    found = "array<struct<s:int,e:int,p:int,label:string,weight:double>>"
    spans = [(m.start(), -m.end(), p, label, w) for label, _, regex, p, w in rules for m in re.finditer(regex, " a b c d e f ")]
    got = spark.createDataFrame([(spans,)], f"x {found}").select(licenses._resolve(F.col("x")).alias("r")).first().r
    assert got.labels == ["tag"] and got.score == 0.9


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("MIT License", 1, 2, 3, 4, 5, 6)], "text string, _w int, _rules int, _gaps int, _hits int, _base int, _doc int")
    r = licenses.scan(df).first()
    assert (r._w, r._rules, r._gaps, r._hits, r._base, r._doc, r.labels) == (1, 2, 3, 4, 5, 6, "mit")


def test_many_hits_in_one_text(spark):
    r = licenses.scan(spark.createDataFrame([("see the MIT license and " * 20000,)], "text string")).first()
    assert (r.n_base, r.first_word, r.last_word, r.labels) == (20000, 2, 5 * 20000 - 3, "mit")
