"""Receipts, one a file or in batches."""

from rankwright.plans import connectors
from rankwright.sources import readers


def test_receipts_one_a_file_or_in_batches(spark, tmp_path):
    for i, (run, name) in enumerate([("b", "2"), ("a", "9"), ("a", "1")]):
        (tmp_path / "one" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "one" / run / f"{name}.json").write_text('{\n "key": 1,\n "v": %d\n}' % i)
    got = readers.first_receipts(spark, f"file://{tmp_path}/one/*/*.json", "key int, v long", "key").collect()
    assert [(r.key, r.v, r.found, r.path.endswith("a/1.json")) for r in got] == [(1, 2, 3, True)]
    for batch, first in (("b1", 0), ("b2", 5000)):
        (tmp_path / "many" / batch).mkdir(parents=True)
        (tmp_path / "many" / batch / "x.json").write_text("".join('{"key": %d, "v": %d}\n\n' % (i % 3, i) for i in range(first + 4999, first - 1, -1)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # a batch in many splits
    try:
        got = readers.first_receipts(spark, f"file://{tmp_path}/many/*/*.json", "key int, v long", "key", lines=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted((r.key, r.v, r.found) for r in got) == [(0, 4998, 3334), (1, 4999, 3333), (2, 4997, 3333)]
    for lines in (False, True):
        assert readers.first_receipts(spark, f"file://{tmp_path}/none/*/*.json", "key int, v long", "key", lines).collect() == []


def test_receipts_take_few_files(spark, sf, tmp_path, monkeypatch):
    """A file for each customer made the query's time that of its files."""
    monkeypatch.setattr(connectors, "place", lambda s, name: f"file://{tmp_path}/{name}")
    assert sum(r.found for r in connectors.receipts(spark, sf).collect()) == spark.read.parquet(f"{sf}/customer.parquet").count()
    assert 0 < len(list(tmp_path.glob("receipts/*/*.json"))) < 10
