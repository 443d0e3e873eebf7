"""The pipeline's stages against what each one is to keep, and its guard."""

from collections import Counter

import corpus_pipeline
from rankwright.llm import mixing, quality
from rankwright.session import cut, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf), name)
        seen.append((name, before, docs))
    assert [n for n, *_ in seen] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(after.columns == columns for _, _, after in seen[:-1])
    (_, raw, good), (_, _, exact), (_, _, near), (_, unmixed, mixed), (_, _, packed) = seen
    model = quality.train(raw, table(spark, sf, "labels"))
    want = {r.doc_id for r in quality.score(raw, *model).collect() if r.score >= 0.7}
    assert {r.doc_id for r in good.collect()} == want
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    keep = {}
    for r in good.collect():
        keep[lower(r.text)] = max(r.doc_id, keep.get(lower(r.text), -1))
    assert {r.doc_id for r in exact.collect()} == set(keep.values())
    assert near.count() <= exact.count() and {r.doc_id for r in near.collect()} <= set(keep.values())
    copies = {r.doc_id: r.copies for r in mixing.mix_sizes(unmixed).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    n = packed.selectExpr("sum(length) AS n", "sum(if(start = 0, doc_tokens, 0)) AS m", "count(if(start = 0, 1, null)) AS d").first()
    assert n.n == n.m and n.d == mixed.count()


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()}
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_on_odd_and_empty_tables(spark, sf, odd, empty):
    for docs in (odd, empty):
        start = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = cut(stage(spark, docs, sf), name)
            assert out.columns == docs.columns
            n = out.count()
            assert n <= start * (2 if name == "mixing" else 1)
            # the classifier may refuse all odd rows: each later stage also sees them all
            docs = out if n else docs
        pieces = cut(corpus_pipeline.STAGES[-1][1](spark, docs, sf), "packing")
        assert pieces.where("start = 0").count() == docs.count() and (start > 0 or pieces.count() == 0)


def test_a_stage_clears_what_the_one_before_wrote_for_itself(spark, sf):
    docs = table(spark, sf, "documents")
    near = dict(corpus_pipeline.STAGES)["near_dedup"]
    mixed = dict(corpus_pipeline.STAGES)["mixing"]
    kept = cut(near(spark, docs, sf), "kept")
    left = list(corpus_pipeline._left)
    assert left
    n = cut(mixed(spark, kept, sf), "mixed").count()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert n and not any(hadoop(p).getFileSystem(conf).exists(hadoop(p)) for p in left) and kept.count()
