"""Operators against plain versions of what they compute."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwright.llm import chat, exact_dedup, fingerprints, language_id, mixing, pii, quality
from rankwright.llm.ftrl import softmax


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    words = ["the", "of", "Été", "straße", "and", "x1", "don't", "aa", "b", "naïve", "Ω", "zz9"]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(0, 40))), r.choice(["en", "fr", None])) for i in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), rows


# exact dedup


@pytest.mark.parametrize("bits", [1 << 15, 1 << 28])
def test_exact_dedup_in_parts(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BITS", bits)
    r = random.Random(1)
    rows = [(i, f"Text {r.randrange(9000)}") for i in range(9000)] + [(9000 + i, "hot") for i in range(4000)] + [(None, "hot"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert exact_dedup.parts_of(len(rows)) == (8 if bits < 1 << 20 else 1)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").lower()].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, best[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    found = exact_dedup.copy_groups(docs)
    got = found.collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == want and sum(x.kept for x in got) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert sorted((x.text or "").lower() for x in kept.collect()) == sorted(groups)
    # whole rows meet the filter by broadcast only: what shuffles is the aggregation of possible repeats
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") >= exact_dedup.K and "Join Inner" not in plan
    assert "SortMergeJoin" not in kept._jdf.queryExecution().sparkPlan().toString()


# mixing


def test_newton_meets_every_constraint(spark):
    rows = [("a", 1000, 2000.0), ("b", 10, 0.001), ("c", 5, 0.0), (None, 7, 9.5), ("d", 0, 0.0)]
    got = {r.source: r for r in mixing.tilt(spark.createDataFrame(rows, "source string, source_size long, target double")).collect()}
    for s, n, t in rows:
        assert got[s].rate * n == pytest.approx(t, rel=1e-8, abs=1e-12)
        assert (got[s]["lambda"] is None) == (not n or not t)


def test_an_unmet_constraint_is_no_answer(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NEWTON_STEPS", 3)
    with pytest.raises(Exception, match="off by"):
        mixing.tilt(spark.createDataFrame([("a", 1000, 0.001)], "source string, source_size long, target double")).collect()


def test_targets_of_many_sources_take_linear_time(spark):
    import time

    spent = []
    for n in (20_000, 80_000):
        src = spark.range(n).selectExpr("CAST(id AS STRING) AS source", "id * 37 % 1009 AS source_size")
        began = time.perf_counter()
        total = src.agg({"source_size": "sum"}).first()[0]
        assert mixing.targets(src).agg({"target": "sum"}).first()[0] == pytest.approx(1.5 * total)
        spent.append(time.perf_counter() - began)
    assert spent[1] < 8 * spent[0] + 3


# chat


def test_windows_keep_to_their_budgets(spark):
    r = random.Random(8)
    rows = []
    for c in [*range(30), None]:
        n = r.randrange(1, 40)
        for k in range(n):
            role = "system" if k == 0 and r.random() < 0.5 else r.choice(["user", "assistant"])
            rows.append((c, k, role, " ".join(["cat"] * r.choice([0, 1, 5, 20, 60, 100, 400]))))
    rows += [(99, k, "assistant", " ".join(["dog"] * n)) for k, n in enumerate([1, 1014, 994, 3, 5000, 2, 2])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    budget, history = 128, 40
    size = {t: len(chat.encoder().encode(t)) // 2 + 4 for _, _, _, t in rows}
    want = defaultdict(list)
    for c, k, role, t in sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1])):
        want[c].append((role, t))
    by = defaultdict(list)
    for w in chat.format_chat(turns, budget, history).collect():
        found = [(m[1], chat.unescape(m[2])) for m in chat._TURN.finditer(w.formatted)]
        by[w.conv_id].append((w.window, found[: w.repeats], found[w.repeats :], [w.formatted[s.start : s.end] for s in w.loss]))
    for c, all_ in want.items():
        windows, at = sorted(by[c]), 0
        for _, again, own, loss in windows:
            assert own and own == all_[at : at + len(own)] and [t for r_, t in own if r_ == "assistant"] == loss
            assert len(own) == 1 or sum(size[t] for _, t in own) <= budget
            start = 1 if all_[0][0] == "system" else 0
            past, left = [], history
            for turn in reversed(all_[start:at]):
                if (left := left - size[turn[1]]) < 0:
                    break
                past.insert(0, turn)
            assert again == ([all_[0]] if start and at else []) + past
            at += len(own)
        assert at == len(all_)


# language


def grams(text):
    out = Counter()
    for word in re.split(r"[\W\d_]+", text.lower()):
        if word:
            marked = f"\x02{word}\x02"
            for n in (1, 2, 3, 4):
                for i in range(len(marked) - n + 1):
                    if n > 1 or marked[i] != "\x02":
                        out[marked[i : i + n]] += 1
    return out


def mix(h):
    h ^= h >> 16
    h = h * 0x85EBCA6B & 0xFFFFFFFF
    h ^= h >> 13
    h = h * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def bucket(gram):
    h = 0
    for ch in gram:
        h = (h * 0x01000193 + ord(ch)) & 0xFFFFFFFF
    return mix(h ^ (len(gram) * 0x9E3779B1 & 0xFFFFFFFF)) >> 32 - language_id.BITS


def test_language_features_idf_and_scores(spark, corpus):
    df, rows = corpus
    want = []
    for _, text, _ in rows:
        idx, count = language_id.features(text)
        mine = Counter()
        for g, n in grams(text).items():
            mine[bucket(g)] += n
        assert dict(zip(idx.tolist(), count.tolist())) == mine
        want.append(mine)
    freq, n = language_id._document_frequencies(df)
    seen = Counter(f for m in want for f in m)
    assert n == len(rows) and {int(f): int(freq[f]) for f in np.flatnonzero(freq)} == seen
    idf = np.log((1 + n) / (1 + freq)) + 1
    g = np.random.default_rng(0)
    w, b = g.normal(size=(1 << language_id.BITS, 2)).astype(np.float32), np.array([0.1, -0.2])
    got = {r.doc_id: r for r in language_id.identify(df.withColumn("_p", F.lit(5)), language_id.Model(["en", "fr"], w, b, 0.7, idf)).collect()}
    for (i, text, _), m in zip(rows, want):
        if not re.search(r"[^\W\d_]", text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = {f: (1 + math.log(c)) * idf[f] for f, c in m.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        p = softmax(np.array([[sum(v / norm * float(w[f, k]) for f, v in x.items()) / 0.7 + b[k] / 0.7 for k in (0, 1)]]))[0]
        assert got[i].lang_pred == ["en", "fr"][p.argmax()] and got[i].score == pytest.approx(p.max(), rel=1e-5) and got[i]._p == 5


# quality


def test_quality_features_and_scores(spark, corpus):
    df, rows = corpus
    g = np.random.default_rng(0)
    w = g.normal(size=1 << quality.BITS).astype(np.float32)
    got = {r.doc_id: r.score for r in quality.score(df, w, 0.3).collect()}
    for i, text, _ in rows:
        h = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text.lower())]
        feats = Counter(mix(x) >> 32 - quality.BITS for x in h)
        for a, b in zip(h, h[1:]):
            pair = 0x2545F491 if a == b else (a * 0x9E3779B1 + (b ^ 0x5BD1E995)) & 0xFFFFFFFF
            feats[mix(pair) >> 32 - quality.BITS] += 1
        x = {f: 1 + math.log(n) for f, n in feats.items()}
        norm = math.sqrt(sum(v * v for v in x.values()) + quality.SMOOTH)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-0.3 - sum(v / norm * float(w[f]) for f, v in x.items()))), rel=1e-5)


# fingerprints


def test_fingerprint_entries_likeness_and_order(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(400)}" for _ in range(300)]
    edit = lambda n: [x if k % (300 // n) else f"e{k}" for k, x in enumerate(base)] if n else base
    texts = {"base": base, "few": edit(6), "some": edit(30), "swapped": base[150:] + base[:150], "short": base[:3], "twice": base[:40] * 3, "other": [f"o{k}" for k in range(300)]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, t string")
    low = (1 << fingerprints.POSITION_BITS) - 1
    kmers = {x.k: x._kmers for x in fingerprints.add_kmers(df, F.col("t")).collect()}
    want = []
    for k, xs in kmers.items():
        for j, c in enumerate(fingerprints._permutations(fingerprints.ENTRIES)):
            bit = 1 << (fingerprints.POSITION_BITS + 2 + j % 38)
            a, b = (min((x ^ c for x in xs if (x & bit == 0) == side), default=None) for side in (True, False))
            first = None not in (a, b) and a & low < b & low
            cut = lambda v: None if v is None else v >> fingerprints.POSITION_BITS
            want.append((k, j, cut(a), cut(b), 1 if first else 2))
    want = spark.createDataFrame(want, "k string, j int, a long, b long, o int").select("k", "j", F.hash("a", "b", "o").alias("e"))
    want = {(x.k, x.j): x.e for x in want.collect()}
    got = {x.k: x._entries for x in fingerprints.sketch(df, F.col("t"), ["k"]).collect()}
    assert {(k, j): e for k, v in got.items() for j, e in enumerate(v)} == want
    near = {k: sum(a == b for a, b in zip(got["base"], v)) / len(v) for k, v in got.items()}
    assert near["base"] == 1 and near["few"] > near["some"] > near["other"] == 0 and near["few"] > 0.6
    # nearly the same runs in another order: far likelier to lose an entry than by the runs alone
    assert near["swapped"] < 0.75


def test_fingerprints_of_repeated_rows(spark, tmp_path):
    rows = [(1, "a b c d e f g")] * 40 + [(2, "h i j k l m")] * 30 + [(3, "n o p")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == {1: 40, 2: 30, 3: 1} and len({r.edited_sha256 for r in got}) == 3


# personal data


def test_disclosure_against_counts(spark):
    r = random.Random(12)
    people = [("zed", "zed@corp.example.org"), ("amy", "amy@site.example.net"), ("bob", "10.1.2.3"), ("kit", "+1 555 123 4567")]
    fill = ["the", "of", "mail", "note", "item", "from", "case", "road", "tree"]
    rows = []
    for i in range(120):
        words = r.choices(fill, k=r.randrange(3, 25))
        for name, value in r.sample(people, r.choice([0, 0, 1, 1, 2])):
            words.insert(r.randrange(len(words) + 1), value)
            if r.random() < 0.8:
                words.insert(r.randrange(len(words) + 1), name.title())
        if r.random() < 0.03:
            words.append("amy")
        rows.append((i, " ".join(words)))
    rows += rows[:5]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _text int, _key int").repartition(3)
    found = pii.find(docs).collect()
    assert all((x._text, x._key) == (1, 2) for x in found) and len(found) == len(rows)
    value = {"email": str.lower, "ip": str, "card": lambda v: re.sub("[^0-9]", "", v), "phone": lambda v: re.sub("[^0-9]", "", v)}
    text, seen = dict(rows), defaultdict(list)
    bags = [(i, t, set(re.findall(r"[^\W\d_]+", t.lower()))) for i, t in rows]
    base = {x.doc_id: {k: [(s.s, s.e, s.v) for s in x[f"_{k}"]] for k in pii.KINDS} for x in found}
    for i, t, bag in bags:
        here = defaultdict(set)
        for kind, spans in base[i].items():
            for s, e, v in spans:
                here[f"{kind}:{value[kind](v)}"].add((t[max(0, s - pii.CONTEXT) : s], t[e : e + pii.CONTEXT]))
        for entity, contexts in here.items():
            seen[entity].append((t, bag, contexts))
    told = {}
    several = lambda docs_: len({t for t, _, _ in docs_}) > 1 and len(set().union(*(c for _, _, c in docs_))) > 1
    for docs_ in seen.values():
        if several(docs_):
            content = max(1e-9, -math.log(min(1.0, len(docs_) / len(rows))))
            for word in set().union(*(b for _, b, _ in docs_)):
                both = [d for d in docs_ if word in d[1]]
                if several(both):
                    share = 1 + math.log(len(both) / sum(word in b for _, _, b in bags)) / content
                    if share >= pii.GENERALISE:
                        told[word] = max(told.get(word, ""), "remove" if share >= pii.REMOVE else "generalise")
    assert {"zed", "bob"} & set(told) and "the" not in told
    for x in found:
        taken = [(s, e) for spans in base[x.doc_id].values() for s, e, _ in spans]
        want = {(m.start(), m.end(), told[m[0].lower()]) for m in re.finditer(r"[^\W\d_]+", text[x.doc_id]) if m[0].lower() in told}
        want = {w for w in want if not any(s < w[1] and w[0] < e for s, e in taken)}
        assert {(s.s, s.e, s.v) for s in x._term} == want


# fingerprints


def test_likeness_falls_with_edits(spark):
    """Words replaced at random from none to half of them: the mean likeness falls at every step, from one to next to nothing."""
    r = random.Random(21)
    rows = []
    for k in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        for share in (0, 2, 5, 10, 20, 50):
            edited = list(words)
            for i in r.sample(range(200), 2 * share):
                edited[i] = f"e{r.randrange(10**6)}"
            rows.append((k, share, " ".join(words), " ".join(edited)))
    df = spark.createDataFrame(rows, "k int, share int, a string, b string")
    one = fingerprints.sketch(df, F.col("a"), ["k", "share"]).select("k", "share", F.col("_entries").alias("x"))
    two = fingerprints.sketch(df, F.col("b"), ["k", "share"]).select("k", "share", F.col("_entries").alias("y"))
    got = one.join(two, ["k", "share"]).groupBy("share").agg(F.avg(fingerprints.likeness(F.col("x"), F.col("y"))).alias("n")).orderBy("share").collect()
    means = [x.n for x in got]
    assert means[0] == 1.0 and all(a > b + 0.03 for a, b in zip(means, means[1:])) and means[-1] < 0.05


def test_order_counts_and_not_only_the_sets(spark):
    """Two texts of the same k-mers in another order: blocks of words swapped keep almost all k-mers, and lose entries."""
    r = random.Random(22)
    words = [f"w{r.randrange(10**6)}" for _ in range(300)]
    swapped = words[150:] + words[:150]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(swapped))], "k int, t string")
    e = {x.k: x._entries for x in fingerprints.sketch(df, F.col("t"), ["k"]).collect()}
    same = sum(a == b for a, b in zip(e[1], e[2])) / len(e[1])
    assert 0.2 < same < 0.8
