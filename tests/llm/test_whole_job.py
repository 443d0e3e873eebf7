"""What a shorter way would leave out, held against brute force."""

import itertools
import re
from re import _constants as c
from re import _parser

from rankwright.llm import licenses, near_dedup, pii


def _spelled(tree):
    """Every way a rule's regex can be spelled out; open-ended parts once."""
    ways = [""]
    for op, arg in tree:
        if op is c.LITERAL:
            here = [chr(arg)]
        elif op is c.IN:
            here = [chr(v) if o is c.LITERAL else chr(v[0]) for o, v in arg]  # one of a range
        elif op is c.ANY:
            here = ["x"]
        elif op is c.BRANCH:
            here = [w for b in arg[1] for w in _spelled(b)]
        elif op is c.SUBPATTERN:
            here = _spelled(arg[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            here = sorted({"".join(w) for n in {arg[0], max(arg[0], 1)} for w in itertools.product(_spelled(arg[2]), repeat=n)})
        else:
            assert op is c.ASSERT, op
            here = [""]
        ways = [a + b for a in ways for b in here]
    return ways


def test_license_keywords_stand_in_every_alternative():
    lost = set()
    for label, keywords, regex, *_ in licenses.rules():
        for text in map(str.strip, _spelled(_parser.parse(regex))):
            assert re.search(regex, f" {text} ")
            if not set(keywords.split("|")) & set(text.split()):
                lost.add((label, keywords, text))
    assert not lost, sorted(lost)[:20]


def test_license_names_stand_alone(spark):
    texts = {
        "Do What The Fuck You Want To Public License": "wtfpl", "MPL 2.0 license": "mpl-2.0", "licensed under the MPL 1.1": "mpl-1.1",
        "Common Development and Distribution License": "cddl-1.0", "Creative Commons Zero license": "cc0-1.0",
        "Public Domain Dedication and License": "pddl-1.0", "Q Public License": "qpl-1.0", "0BSD license": "0bsd",
        "GNU General Public License as published by the Free Software Foundation, version 2": "gpl-2.0",
    }
    df = spark.createDataFrame([(f"Notice: {t}.", v) for t, v in texts.items()], "text string, want string")
    for r in licenses.scan(df).collect():
        assert r.want in r.labels.split(","), r


def test_pii_terms_go_wherever_they_stand(spark):
    fill = "the text about some item and filler that people wrote over and over again "
    rows = [(i, f"É Zorblatt{i}: {fill * 3} mail ref {'abcdefgh'[i]} zed@corp.example.com {fill} ZORBLATT") for i in range(6)]
    rows += [(10 + i, f"{fill} case {i}") for i in range(40)] + [(60, f"{fill} zorblatt, {fill}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("zorblatt" not in t.lower() for t in out.values())
    assert out[60] in (f"{fill} [TERM], {fill}", f"{fill} , {fill}") and all(out[i] == t for i, t in rows[6:46])
    spans = {r.doc_id: [(x.s, x.e) for x in r._term] for r in pii.find(df).collect()}
    for i, t in rows:
        assert [m.span() for m in re.finditer("(?i)zorblatt", t)] == [x for x in spans[i] if t[slice(*x)].lower() == "zorblatt"]


def test_near_dedup_keeps_rows_of_one_id_by_their_texts(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2).upper()), (None, text(3)), (3, text(3)), (7, text(4)), (7, text(5)), (7, text(6)), (5, text(6)), (8, text(7)), (9, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.text.lower()) for r in near_dedup.keep_one(docs).collect())
    assert got == sorted((str(i), text(k)) for i, k in [(None, 1), (None, 2), (3, 3), (7, 4), (7, 5), (5, 6), (8, 7)])
