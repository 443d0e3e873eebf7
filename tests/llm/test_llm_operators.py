"""Each operator against brute force, on odd rows and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwright.llm import chat, exact_dedup, fingerprints, ftrl, language_id, licenses, mixing, near_dedup, packing, pii, quality
from rankwright.llm.tokens import WordEncoder
from rankwright.session import table


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# exact dedup


def test_exact_dedup_brute_force(odd):
    groups = defaultdict(list)
    for r in odd.collect():
        groups[low(r.text)].append(r.doc_id)
    got = defaultdict(list)
    for r in rows_of(exact_dedup.copy_groups(odd)):
        got[r["text_sha256"]].append(r)
    assert len(got) == len(groups)
    for text, ids in groups.items():
        g = got[hashlib.sha256(text.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert len(g) == len(ids) and {r["group_size"] for r in g} == {len(ids)} and {r["keep_id"] for r in g} == {best}
        assert sum(r["kept"] for r in g) == 1 and next(r["doc_id"] for r in g if r["kept"]) == best


def test_exact_dedup_stage(odd, empty):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [low(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({low(r.text) for r in odd.collect()})
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.copy_groups(empty).count() == 0


# mixing


def test_mixing(spark, odd, empty, sf):
    got = rows_of(mixing.mix_sizes(odd))
    assert len(got) == odd.count()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
    assert mixing.mix(odd).columns == odd.columns and mixing.mix_sizes(empty).count() == 0
    docs = table(spark, sf, "documents")
    a, b = rows_of(mixing.mix_sizes(docs)), rows_of(mixing.mix_sizes(docs.repartition(5)))
    key = lambda r: r["doc_id"]
    assert sorted(a, key=key) == sorted(b, key=key)
    taken, target, largest, size = Counter(), {}, Counter(), Counter()
    for r in a:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for s in taken:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 and target[s] <= 2 * size[s]
    assert mixing.mix(docs).count() == sum(r["copies"] for r in a)


def test_mixing_targets_fill_up(spark):
    src = spark.createDataFrame([("a", 10), ("b", 100), (None, 30), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(src).collect()}
    # by weight 5, 2, 1 (c), 5 (null): a is full at 20, c at 0, null at 60, the rest goes to b
    assert got == {"a": 20.0, "c": 0.0, None: 60.0, "b": 210.0 - 80.0}


# near-dedup


def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_alignment_is_edit_distance():
    r = random.Random(3)
    for _ in range(400):
        a = [r.randrange(4) for _ in range(r.randrange(14))]
        b = [x if r.random() < 0.8 else r.randrange(4) for x in a] if r.random() < 0.5 else [r.randrange(4) for _ in range(r.randrange(14))]
        d, most = _distance(a, b), r.randrange(12)
        assert near_dedup.distance(np.array(a, "u4"), np.array(b, "u4"), most) == (d if d <= most else None)


def test_near_dedup_finds_edited_copies(spark, empty):
    r = random.Random(5)
    rows, family = [], {}
    for k in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(120)]
        for c in range(1 + k % 6):
            w = list(words)
            for _ in range(c and 3):
                w[r.randrange(120)] = f"new{r.randrange(10**6)}"
            family[len(rows)] = k
            rows.append((len(rows), " ".join(w), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(4)
    found, _ = near_dedup.classes(docs)
    got = {x.doc_id: x.class_id for x in found.collect()}
    assert all((got[a] == got[b]) == (family[a] == family[b]) for a in got for b in got)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 40


def test_near_dedup_odd_rows(odd, empty):
    found, _ = near_dedup.classes(odd)
    got = rows_of(found)
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[1] == by[2] == by[11] == 1 and by[5] == by[6] == 5 and by[3] == by[4] == 3 and by[9] == 9
    assert near_dedup.keep_one(odd).count() == 9
    assert near_dedup.classes(empty)[0].count() == 0 and near_dedup.keep_one(empty).count() == 0


def test_occurrences_tell_repeated_kmers_apart():
    h = np.array([1, 2, 3, 4, 5] * 3, "u4")
    assert len(set(near_dedup.kmers(h).tolist())) == 11


# quality and language


@pytest.fixture(scope="session")
def scored(spark):
    d = "/root/testdata/sf0.01"
    return quality.op4_quality(spark, d).join(table(spark, d, "labels"), "doc_id").toPandas()


def test_quality_held_out_accuracy(scored):
    fold = scored["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (fold == scored["held_out"]).all() and scored["score"].between(0, 1).all()
    held = scored[scored["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, None), (7, None, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(odd, labels).columns == odd.columns
    w, b = quality.train(odd, labels)
    assert quality.score(odd, w, b).count() == odd.count() and quality.score(empty, w, b).count() == 0
    w, b = quality.train(empty, labels.limit(0))
    assert not w.any() and b == 0.0 and {r.score for r in quality.score(odd, w, b).collect()} == {0.5}


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.op1_language_id(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_odd_rows(odd, empty):
    model = language_id.train(odd, fold=None)
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[12].lang_pred == "und" and got[12].score == 0
    assert got[1].lang_pred in {"en", "de", "fr"}
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_ftrl_is_sparse_and_temperature_calibrates():
    g = np.random.default_rng(0)
    rows = [(np.array([y, 5 + g.integers(50)]), np.ones(2), int(y)) for y in g.integers(0, 2, 400)]
    m = ftrl.Ftrl(64, 2, alpha=0.5, l1=2.0).fit(rows, 3)
    w = m.weights()
    assert (w[5:55] == 0).mean() > 0.5 and w[1, 1] > 0 > w[0, 1]
    y = g.integers(0, 3, 900)
    raw = np.eye(3)[np.where(g.random(900) < 0.2, g.integers(0, 3, 900), y)]
    a, b = ftrl.temperature(raw, y), ftrl.temperature(raw * 5, y)
    assert abs(b / a - 5) < 0.05 and ftrl.temperature(raw[:0], y[:0]) == 1.0


# packing


def test_packing_round_trip(odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(tuple([*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in odd.collect())
    pieces = sorted(rows_of(packing.pack(odd, window=64)), key=lambda p: (p["sequence_id"], p["offset"]))
    stream, at = [], 0
    for p in pieces:
        assert p["sequence_id"] * 64 + p["offset"] == at and p["offset"] + p["length"] <= 64
        at += p["length"]
        stream.append((p["doc_id"], p["start"], p["doc_tokens"], np.frombuffer(bytes(p["ids"]), "<u4").tolist()))
    docs, ids = Counter(), []
    for _, start, n, part in stream:
        assert start == len(ids)
        ids += part
        if len(ids) == n:
            docs[tuple(ids)] += 1
            ids = []
    assert docs == want and not ids
    assert packing.digest(packing.pack(empty)).count() == 0


def test_words_encode_as_whole_texts(spark, sf):
    coder = WordEncoder()
    texts = [r.text for r in table(spark, sf, "documents").select("text").limit(60).collect()]
    texts += ["it's a 'SAB'\t''s  12 3.5e--x ÀÉ ß ÿ×÷", "İstanbul ́é ﬁ", "a\x1cb\x85c\xa0d", "<|endoftext|> <|startoftext|>x"]
    for t in texts:
        want = coder._tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(t), "<u2").tolist() == want


# fingerprints


def test_fingerprints(spark, odd, empty):
    got = {(r.doc_id, r._sha): r for r in fingerprints.fingerprints(odd).collect()}
    spelled = {k: r._entries for k, r in got.items()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    text = {r.doc_id: r.text for r in odd.collect()}
    assert spelled[3, sha("")] is None and got[11, sha(text[11])]._copies == 2
    assert spelled[1, sha(text[1])] == spelled[11, sha(text[11])] != spelled[2, sha(text[2])]
    assert spelled[5, sha(text[5])] == spelled[6, sha(text[6])]
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprint_kmers_against_brute_force(spark):
    texts = ["a b c d e f g a b c d e f g a b c d e f g", "x y", "q " * 40, "one two three four five six seven"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r._kmers for r in fingerprints.add_kmers(df, F.col("text")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))]
        assert len(got[i]) == len(grams) and len({k >> 24 for k in got[i]}) == len(grams)
        assert sorted(k & 0xFFFFFF for k in got[i]) == list(range(len(grams)))


def test_fingerprint_query_edits(spark, tmp_path):
    texts = [" ".join(f"w{(i * 7 + j * (i % 3 + 1)) % 50}" for j in range(20 + 9 * i)) for i in range(12)] + ["", None, "é"]
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted((100 - i, t or "") for i, t in enumerate(texts))
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(order):
        h = len(t) // 2
        edited = t[: len(t) - h] + order[(k + 1) % len(order)][1][:h]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and (edited != t or got[i].near_edited == 1)


# PII

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def base(t):
    def ok(k, v):
        digits = re.sub("[^0-9]", "", v)
        if k == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if k == "card":
            return 16 <= len(digits) <= 19 and _luhn(digits)
        return k == "email" or 8 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, r in RX.items() for m in re.finditer(r, t or "") if ok(k, m[0])]


def test_pii_base_spans(spark, odd, empty):
    r = random.Random(2)
    alphabet = "0123456789.@+-() abcZ_%é\n"
    texts = ["".join(r.choice(alphabet) for _ in range(60)) for _ in range(300)]
    texts += ["a.b%c@d.e%f@g.h.i 1.2.3.4.5.6.7.8 00.001.1.255 1.2.3.256 +1 2 3 4 5 6 7 8", "4539 1488 0343 6467 4539-1488-0343-6467-1", "x@y", "9" * 400, ".".join("1" * 300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for frame in (df, odd):
        want = Counter((x.doc_id, ",".join(base(x.text))) for x in frame.select("doc_id", "text").collect())
        out = pii.digest(pii.find(frame)).collect()
        got = Counter((x.doc_id, ",".join(s for s in x.spans.split(",") if s and not s.startswith("term"))) for x in out)
        assert got == want
        assert all(hashlib.sha256(w.encode()).hexdigest() in {x.base_sha256 for x in out if x.doc_id == i} for i, w in want)
    assert pii.digest(pii.find(empty)).count() == 0


def test_pii_sanitises_what_gives_an_entity_away(spark):
    who = "zorblatt"
    rows = [(i, f"filler{i} text {i} {who} wrote from zed@corp.example.com about item {i} thing{i}", "k") for i in range(6)]
    rows += [(10 + i, f"the text about item {i} and filler from other people who wrote things", "k") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(who not in out[i] and "[EMAIL]" in out[i] and "about item" in out[i] for i in range(6))
    assert all(out[r[0]] == r[1] for r in rows[6:])


# chat


def test_escape_round_trip():
    r = random.Random(4)
    parts = [*chat.CONTROLS, chat.ESC, "0", "1", "2", "\n", "a", "<", "[", "|>"]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and chat.unescape_role(chat.escape_role(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROLS)


def test_chat_reads_back(spark):
    r = random.Random(6)
    rows = []
    for c in range(12):
        for k in range(r.randrange(1, 60 if c else 300)):
            role = "system" if k == 0 and c % 2 else r.choice(["user", "assistant"])
            rows.append((c, k, role, None if r.random() < 0.05 else " ".join(r.choice(["<s>", "[INST]", "word", "\n", chat.ESC]) for _ in range(r.randrange(90)))))
    rows += [(None, 0, "user", "hello"), (None, 1, "assistant", "hi"), (99, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    windows = chat.format_chat(df, budget=200, history=60).cache()
    got = {x.conv_id: x for x in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k if k is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    many = windows.where("conv_id = 1 AND window > 0").collect()
    assert many and all(w.formatted.startswith("<|im_start|>system\n") and w.repeats >= 1 for w in many)
    assert chat.format_chat(df.limit(0)).count() == 0


# licenses


def scan_base(t):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    at = [i for p in (["mit", "license"], ["apache", "license"], ["general", "public", "license"]) for i in range(len(words)) if words[i : i + len(p)] == p]
    labels = {a for a, p in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) if f" {p} " in f" {' '.join(words)} "}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses_base_brute_force(spark, odd, empty):
    r = random.Random(8)
    bits = ["mit", "license", "MIT", "License,", "apache", "general", "public", "é", "x-y", "\n", "licence", "", "12"]
    df = spark.createDataFrame([(i, " ".join(r.choice(bits) for _ in range(r.randrange(25)))) for i in range(300)], "doc_id long, text string")
    for frame in (df, odd):
        want = Counter((x.doc_id, *scan_base(x.text)) for x in frame.select("doc_id", "text").collect())
        got = Counter((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in licenses.scan(frame).collect())
        assert got == want
    assert licenses.scan(empty).count() == 0


def test_license_rules_and_suppression(spark):
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and",
        "apache,apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause\n", "mpl-2.0": "see Mozilla Public License v2.0 ", "": "a plain text about people",
    }
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "want string, text string")
    for r in licenses.scan(df).collect():
        assert r.labels == r.want and (r.score > 0) == (r.want != "")
    assert len(licenses.rules()) >= 200
    for label, keyword, regex, *_ in licenses.rules():
        re.compile(regex)
