"""Phrase lexicons against plain Python."""

import random
import re

import pytest

from rankwright.operators import lexicon as P


def present(phrase, text):
    phrase = phrase.lower().strip(" ")
    if not phrase:
        return False
    if re.search("[^a-z0-9]", phrase):
        return phrase in text.lower()
    return phrase in P.text_tokens(text.lower(), frozenset(P.STOP_WORDS))


def plain(items, lexicon):
    out = []
    for i, text in items:
        if text is None:
            continue
        for m, family, keywords, aliases, required in lexicon:
            if not all(any(present(k, text) for k in g) for g in required or [] if any(k.strip() for k in g)):
                continue
            words, names = [k for k in keywords or [] if present(k, text)], [a for a in aliases or [] if present(a, text)]
            kin = {t for t in P.text_tokens((family or "").replace("_", " ").lower(), frozenset(P.STOP_WORDS)) if present(t, text)}
            score = sum(3.0 if " " in k or "." in k else 1.0 for k in words) + 4.0 * len(names) + 0.25 * len(kin)
            groups = any(k.strip() for g in required or [] for k in g)
            if words or names or kin or groups:
                out.append((i, m, score, tuple(sorted(set(words + names)))))
    return sorted(out)


@pytest.mark.parametrize("block", [P.BLOCK, 7])
def test_scores_of_random_lexicons(spark, block):
    rng = random.Random(block)
    words = ["lock", "file", "race", "toctou", "open", "path.join", "check-then-use", "été", "a", "os", "the", "buffer", "over", "flow", "x86_64"]
    phrase = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3])))
    lexicon = [(f"m{i}", rng.choice(["lock_race", "the_open", None, "buffer overflow_x86"]), [phrase() for _ in range(rng.randint(0, 4))], rng.choice([None, [phrase()], [phrase(), " Lock "]]),
                rng.choice([None, [], [[phrase(), phrase()]], [[phrase()], [phrase(), ""]], [[""], [phrase()]]])) for i in range(25)]
    lexicon[0] = ("m0", "x", ["lock", "lock", "open path"], ["race"], [])
    items = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "locks racetrack reopen pathXjoin"), (103, "open pathology")]
    df = spark.createDataFrame(items, "k long, t string").repartition(4)
    got = P.mechanism_scores(df, "k", "t", P.lexicon_of(spark, lexicon), block=block).collect()
    assert sorted((r.k, r.mechanism_id, r.score, tuple(r.matches)) for r in got) == plain(items, lexicon)


def test_empty_tables_and_ranks(spark):
    lexicon = P.lexicon_of(spark, [("b", "", ["lock"], [], []), ("a", "", ["lock"], [], []), ("c", "", [], ["lock"], [["gone", "lock"]])])
    df = spark.createDataFrame([(1, "a lock"), (2, "none")], "k long, t string")
    s = P.mechanism_scores(df, "k", "t", lexicon)
    assert [(r.mechanism_id, r.place) for r in P.ranked_mechanisms(s, "k", 1.0).orderBy("place").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert P.mechanism_scores(df.where("k < 0"), "k", "t", lexicon).count() == 0
    assert P.mechanism_scores(df, "k", "t", lexicon.where("mechanism_id = 'z'")).count() == 0
