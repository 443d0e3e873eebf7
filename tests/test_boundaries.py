"""Sidecars against plain Python, and how many rows their joins make."""

import random

from rankwright.operators import boundaries as B


def rows_made(plan):
    """The largest number of rows that an operator of a plan gave, once it has run."""
    name, metrics = plan.nodeName(), plan.metrics()
    most = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
    if name == "AdaptiveSparkPlan":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStage"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    return max([most, *map(rows_made, below)])


def test_sidecar_of_identities_in_several_groups(spark):
    rng = random.Random(3)
    p = [(i, rng.choice([1, 2, 3, 4, None]), f"b{i % 17}", rng.choice(["ready", "ready", "blocked"])) for i in range(60)]
    t = [(g, f"b{k}", rng.choice(["", None, "x", "y", f"t{k % 4}"])) for g in (1, 2, 3) for k in range(17)]
    a = [(rng.randint(0, 30), rng.choice([1, 2, 3, 4, 9])) for _ in range(70)]
    cases = [(i,) for i in range(25)] * 2
    want = {}
    for i in {i for i, _ in a if i < 25}:
        own = {g for k, g in a if k == i}
        hits = [(o, g, b, text) for o, g, b, s in p if s == "ready" and g in own for h, c, text in t if (h, c) == (g, b) and text]
        first = {}
        for o, _, _, text in hits:
            first[text] = min(o, first.get(text, o))
        if hits:
            want[i] = ("\n\n".join(x for _, x in sorted((o, x) for x, o in first.items())), len({(g, b) for _, g, b, _ in hits}))
    frames = [spark.createDataFrame(*x) for x in ((p, "ord long, g int, label string, status string"), (t, "g int, label string, text string"), (a, "identity long, g int"), (cases, "identity long"))]
    got = B.sidecar(*frames, "g", "label", ["ready"]).collect()
    assert len(got) == len(want) > 10 and {r.identity: (r.guideline, r.boundaries) for r in got} == want


def test_sidecar_texts_meet_groups_only(spark):
    """2,000 boundaries and 3,000 identities of one group: no operator makes their six million pairs."""
    b = spark.range(2000).selectExpr("id AS ord", "1 AS g", "concat('b', id) AS label", "'ready' AS status", "concat('t', id % 7) AS text")
    c = spark.range(3000).selectExpr("id AS identity", "1 AS g")
    df = B.sidecar(b.drop("text"), b.select("g", "label", "text"), c, c, "g", "label", ["ready"])
    got = df.collect()
    assert len(got) == 3000 and {(r.guideline, r.boundaries) for r in got} == {("\n\n".join(f"t{k}" for k in range(7)), 2000)}
    assert 3000 <= rows_made(df._jdf.queryExecution().executedPlan()) < 10_000
