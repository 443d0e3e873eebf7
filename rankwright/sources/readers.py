"""Scans: JSON lines, documents, CSV, key=value, SARIF, trees of files, archives, SQLite."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwright.operators.spans import suffixes as path_ends
from rankwright.session import ship


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _kind(spark: SparkSession, schema) -> str:
    """A schema, given as a type or as column definitions, as one struct type."""
    return (schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema).simpleString()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), ord (over all files in path order) and value of every line, blank ones included.

    Files are read by splits, so one large file spreads over many tasks. A
    line's place in its split comes from the order in which the task reads it;
    the splits' sizes, one row each, are summed up along the files.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    parts = rows.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "_block", "_first", before(Window.partitionBy("file")).alias("_base"), before(Window.partitionBy()).alias("_all"))  # one row a split
    place = F.col("_at") - F.col("_first")
    rows = rows.join(F.broadcast(parts), ["file", "_block"])
    return rows.select("file", (place + F.col("_base") + 1).alias("line_no"), (place + F.col("_all")).alias("ord"), "value")


def read_jsonl(spark: SparkSession, path: str, schema, missing_ok: bool = False, strict: bool = False) -> DataFrame:
    """One object a line, with ``ord`` in path and file order. ``strict``: a bad line is fatal. ``missing_ok``: no path, no rows."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("ord", F.lit(None).cast("long"))
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    row = F.from_json("value", _kind(spark, schema), {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return lines.select(row.alias("row"), "ord").select("row.*", "ord")


def read_jsonl_numbered(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows with ``file`` and the true ``line_no``."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    return rows.select("file", "line_no", F.from_json("value", _kind(spark, schema)).alias("row")).select("file", "line_no", "row.*")


def strict_json(spark: SparkSession, path: str) -> DataFrame:
    """line_no, ok, reason: repeated keys, NaN or Infinity, blank rows and non-objects are refused."""
    ship(spark)
    rows = numbered_lines(spark, path).select("line_no", F.col("value").alias("text"))

    def check(text: str) -> str | None:
        def pairs(items):
            keys = [k for k, _ in items]
            if len(keys) != len(set(keys)):
                raise ValueError("repeated key")
            return dict(items)

        def constant(name):
            raise ValueError(name)

        if not text.strip():
            return "blank"
        try:
            return None if isinstance(json.loads(text, object_pairs_hook=pairs, parse_constant=constant), dict) else "not an object"
        except ValueError as e:
            return str(e).split(":")[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reason = [check(t) for t in b["text"]]
            yield pd.DataFrame({"line_no": b["line_no"].astype("int32"), "ok": [r is None for r in reason], "reason": reason})

    return rows.mapInPandas(run, "line_no int, ok boolean, reason string")


def read_document(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """file and doc (VARIANT); null where a file isn't JSON."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON array, an envelope with records / cases / queue, or JSON lines: told by the first character and key."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    first = head[0][0].strip() if head else ""
    kind = _kind(spark, schema)
    if first.startswith("["):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if re.match(r'^\{\s*("(records|cases|queue)"\s*:.*)?$', first, re.S):
        envelope = ", ".join(f"{k} array<{kind}>" for k in ("records", "cases", "queue"))
        whole = spark.read.schema(envelope).option("multiLine", True).json(path)
        return whole.select(F.explode(F.coalesce("records", "cases", "queue")).alias("r")).select("r.*")
    return spark.read.schema(schema).json(path)


def read_csv_text(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """All strings; an empty field is an empty string, never null."""
    df = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("sep", sep).csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """KEY=value lines of each file as rows; the last value of a key wins."""
    rows = numbered_lines(spark, path).select("file", F.col("line_no").alias("n"), F.col("value").alias("line"))
    rows = rows.where(F.col("line").rlike("^[A-Z_]+=")).select("file", "n", F.regexp_extract("line", "^([A-Z_]+)=(.*)$", 1).alias("key"), F.regexp_extract("line", "^([A-Z_]+)=(.*)$", 2).alias("value"))
    return rows.groupBy("file", "key").agg(F.max_by("value", "n").alias("value"))


_LOC = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>"
SARIF = (
    f"runs array<struct<results:array<struct<ruleId:string,message:struct<text:string>,locations:array<{_LOC}>,relatedLocations:array<{_LOC}>,"
    f"codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:{_LOC}>>>>>>>>>>"
)


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """One row for each distinct location of each result: file, result, rule, source, uri, start, end; files that don't parse give a status row."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", SARIF).alias("d"))
    docs = docs.withColumn("status", F.when(F.col("d.runs").isNull(), "invalid").otherwise("ok"))
    res = docs.select("file", "status", F.posexplode_outer(F.flatten(F.transform("d.runs", lambda r: r["results"]))).alias("result", "r"))
    tag = lambda c, s: F.transform(F.coalesce(c, F.array().cast(f"array<{_LOC}>")), lambda x: F.struct(F.lit(s).alias("source"), x["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), x["physicalLocation"]["region"]["startLine"].alias("start"), F.coalesce(x["physicalLocation"]["region"]["endLine"], x["physicalLocation"]["region"]["startLine"]).alias("end")))
    flows = F.flatten(F.transform("r.codeFlows", lambda c: F.flatten(F.transform(c["threadFlows"], lambda t: F.transform(t["locations"], lambda x: x["location"])))))
    places = F.array_distinct(F.concat(tag(F.col("r.locations"), "primary"), tag(F.col("r.relatedLocations"), "related"), tag(flows, "flow")))
    return res.select("file", "status", "result", F.col("r.ruleId").alias("rule"), F.explode_outer(places).alias("l")).select("file", "status", "result", "rule", "l.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND line NOT LIKE '#%'")


def source_tree(spark: SparkSession, root: str, suffixes: list[str], max_bytes: int, exclude: list[str] = (), max_files: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """Files of a tree: suffix allow-list, excluded directories, byte cap; a file cap cuts in path order.

    ``first`` (column ``suffix``): files whose path ends in one of these, by whole components, come first: an equi-join on the ends of a path.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    low = F.lower("path")
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.endswith(low, F.lit(s.lower()))
    for e in exclude:
        keep = keep & ~F.contains("path", F.lit(f"/{e}/"))
    df = df.where(keep & (F.col("length") <= max_bytes)).select("path", "length", F.decode("content", "UTF-8").alias("text"))
    df = df.withColumn("prio", F.lit(1))
    if first is not None:
        ends = df.select("path", F.explode(path_ends(F.col("path"))).alias("suffix"))
        hit = ends.join(first, "suffix", "left_semi").select("path").distinct().withColumn("_hit", F.lit(0))
        df = df.join(hit, "path", "left").withColumn("prio", F.coalesce("_hit", "prio")).drop("_hit")
    return df.orderBy("prio", "path").limit(max_files) if max_files else df


def first_receipts(spark: SparkSession, glob: str, schema, key: str, lines: bool = False) -> DataFrame:
    """First receipt of each identity in path order, with the number found; no file that matches, no rows.

    A file is one receipt, or with ``lines`` a batch of them, one a line, in
    the order of its lines. Many receipts belong into batches: a file for each
    costs more to open than to read.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(glob)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = spark.createDataFrame([], kind).withColumns({"path": F.lit(None).cast("string"), "_at": F.lit(0)})
    elif lines:
        rows = spark.read.text(glob).where(F.trim("value") != "")
        # a split is read in order by one task, so the ids that grow there are the order of its lines
        at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        df = rows.select(F.from_json("value", _kind(spark, schema)).alias("_r"), at.alias("_at")).select("_r.*", F.col("_at.path").alias("path"), "_at")
    else:
        df = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("path", F.col("_metadata.file_path")).withColumn("_at", F.col("path"))
    rest = [c for c in df.columns if c not in (key, "_at")]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), "_at").alias("_r"), F.count(F.lit(1)).alias("found")).select(key, "_r.*", "found")


def read_shards(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """root/*/name, with the shard's directory as ``_merge_source``."""
    df = spark.read.schema(schema).json(f"{root}/*/{name}")
    return df.withColumn("_merge_source", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_sidecar(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Key of the first column that has one; ``conflict`` where a key has several texts."""
    k = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in keys])
    return df.groupBy(k.alias("key")).agg(F.min(text).alias(text), (F.countDistinct(text) > 1).alias("conflict"))


def read_archive(spark: SparkSession, glob: str, allowed: str, max_bytes: int) -> DataFrame:
    """Members of tar archives whose name matches ``allowed``: archive, member, size, sha256, text."""
    import hashlib

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.size <= max_bytes and re.search(allowed, m.name):
                            raw = tar.extractfile(m).read()
                            out.append((path, m.name, m.size, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["archive", "member", "size", "sha256", "text"])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "archive string, member string, size long, sha256 string, text string")


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a read-only SQLite file, shipped through Spark as bytes and opened on the task that has them."""
    ship(spark)
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                yield pd.DataFrame(db.execute(query).fetchall(), columns=names)
                db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def cached_lookup(keys: DataFrame, cache: DataFrame, key: str, value: str, fetch=None) -> DataFrame:
    """Values from the cache; misses go to ``fetch(list) -> list`` in batches, or stay unresolved offline."""
    hit = keys.join(cache, key).select(key, value, F.lit("cache").alias("origin"))
    miss = keys.join(cache, key, "left_anti").select(key)
    if fetch is None:
        return hit.unionByName(miss.select(key, F.lit(None).cast("string").alias(value), F.lit("unresolved").alias("origin")))
    ship(keys.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = fetch(b[key].tolist())
            yield pd.DataFrame({key: b[key], value: got, "origin": ["fetched" if v is not None else "unresolved" for v in got]})

    return hit.unionByName(miss.mapInPandas(run, f"{key} {dict(keys.dtypes)[key]}, {value} string, origin string"))


def parse_budgets(value: str) -> list[int]:
    """Comma or line separated positive numbers, sorted, distinct."""
    return sorted({int(x) for x in re.split(r"[,\s]+", value.strip()) if x and int(x) > 0})


def nested(doc: str, *paths: str, kind: str = "string") -> Column:
    """First value that is neither null nor empty among VARIANT paths."""
    return F.coalesce(*[F.nullif(F.try_variant_get(doc, p, kind), F.lit("")) for p in paths])


def named_files(rows: DataFrame, root: str) -> str:
    """Write one file a row (name, text) below ``root`` through Hadoop's file systems, from the driver: for a few small files; returns ``root``."""
    spark = rows.sparkSession
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for r in rows.toLocalIterator():
        at = path(f"{root}/{r['name']}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(r["text"].encode()))
        out.close()
    return root


def query_catalog(spark: SparkSession, root: str, suffix: str, fields: dict[str, str], tag: str, require: str | None = None, exclude: str | None = None) -> DataFrame:
    """Files of a tree below a language's directory with metadata by regex: path, language, a column for each of ``fields``, and ``tags``, sorted.

    A file without a tag is no entry; ``require`` and ``exclude`` are parts of a path.
    """
    files = source_tree(spark, root, [suffix], 1 << 62)
    rest = F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(tag), F.lit(1))))
    out = files.select("path", F.get(F.split(rest, "/"), F.lit(0)).alias("language"), *[F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias(k) for k, p in fields.items()], tags.alias("tags"))
    out = out.where(F.size("tags") > 0)
    out = out.where(F.contains("path", F.lit(require))) if require else out
    return out.where(~F.contains("path", F.lit(exclude))) if exclude else out


def read_tracks(spark: SparkSession, path: str, stop: list[str]) -> DataFrame:
    """track and text of a line-based YAML file: items ``track_id: x`` with a folded ``text_key: >-`` scalar.

    Lines after the text's key belong to it until a blank line or one that
    begins with a key of ``stop``. A repeated track counts by its last text.
    """
    rows = numbered_lines(spark, path).withColumn("_s", F.trim("value"))
    item, key = r'^(?:- )?track_id:\s*"?(.*?)"?$', r'^guideline_text:\s*(.*)$'
    end = F.col("_s") == ""
    for word in stop:
        end = end | F.startswith("_s", F.lit(word))
    w = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("_track", F.last(F.when(F.col("_s").rlike(item), F.struct("line_no", F.regexp_extract("_s", item, 1).alias("id"))), ignorenulls=True).over(w))
    # what was seen last of: a text's key (1) or an end (0) says whether a line belongs to a text
    mark = F.when(F.col("_s").rlike(key), 1).when(end | F.col("_s").rlike(item), 0)
    rows = rows.withColumn("_on", F.last(mark, ignorenulls=True).over(w))
    text = F.when(F.col("_s").rlike(key), F.regexp_extract("_s", key, 1)).otherwise(F.col("_s"))
    rows = rows.where("_on = 1 AND _track IS NOT NULL").withColumn("_t", F.trim(F.regexp_replace(text, '^"|"$', ""))).where("NOT _t IN ('', '>-', '>', '|-', '|')")
    texts = rows.groupBy("file", "_track").agg(F.array_sort(F.collect_list(F.struct("line_no", "_t"))).alias("_l"))
    texts = texts.select(F.col("_track.id").alias("track"), F.struct("file", "_track.line_no").alias("_o"), F.array_join(F.transform("_l", lambda x: x["_t"]), " ").alias("text"))
    return texts.groupBy("track").agg(F.max_by("text", "_o").alias("text"))


def read_outputs(expected: DataFrame, path: str, item: str, schema) -> DataFrame:
    """Model outputs ``<item>.json`` below ``path`` as data: item, state (parsed, missing_output, parse_error) and doc.

    A fenced or prose-wrapped object counts from its first brace to its last.
    """
    spark = expected.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    body = F.regexp_extract(F.decode("content", "UTF-8"), r"(?s)(\{.*\})", 1)
    doc = F.from_json(body, _kind(spark, schema))
    ok = F.try_parse_json(body).isNotNull() & (body != "")
    found = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("_item"), F.when(ok, doc).alias("doc"), ok.alias("_ok"))
    rows = expected.join(found, F.col(item).cast("string") == F.col("_item"), "left")
    state = F.when(F.col("_item").isNull(), "missing_output").when(F.coalesce("_ok", F.lit(False)), "parsed").otherwise("parse_error")
    return rows.select(*expected.columns, state.alias("state"), "doc")


def read_release(spark: SparkSession, root: str, payload, queue=None) -> DataFrame:
    """Payloads that ``root/index.json`` lists (items with file_name), from ``root/guidelines``; a missing file is an error when read.

    ``queue``: the schema of ``root/review_queue.jsonl``, whose rows follow as review_only.
    """
    index = spark.read.schema("items array<struct<file_name:string>>").option("multiLine", True).json(f"{root}/index.json")
    listed = index.select(F.explode("items.file_name").alias("file_name")).where("coalesce(file_name, '') <> ''")
    files = spark.read.schema(payload).option("multiLine", True).json(f"{root}/guidelines").withColumn("_file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    rows = listed.join(files, F.col("file_name") == F.col("_file"), "left")
    message = F.concat(F.lit("missing guideline payload: "), F.col("file_name"))
    rows = rows.withColumn("_file", F.when(F.col("_file").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("_file"))).where("_file IS NOT NULL")
    rows = rows.drop("_file").withColumn("status", F.lit("released"))
    if queue is None:
        return rows
    more = spark.read.schema(queue).json(f"{root}/review_queue.jsonl")
    return rows.unionByName(more.withColumn("status", F.lit("review_only")), allowMissingColumns=True)


def result_statistics(runs: DataFrame, root: str, key: str, counters: dict[str, str]) -> DataFrame:
    """Counters of optional files ``<key>/results.json`` and the validity of its label responses.

    ``counters``: column -> JSON path. Label responses are ``<key>/labels/*.txt``, valid if they hold a JSON list, plain or in one fence.
    """
    spark = runs.sparkSession
    at = lambda k: F.element_at(F.split("path", "/"), k)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.decode("content", "UTF-8").alias("text"))
    doc = files.where(at(-1) == "results.json").select(at(-2).alias("_k"), F.try_parse_json("text").alias("_d"))
    body = F.regexp_replace(F.trim("text"), r"(?s)^```json\n(.*)\n```$", "$1")
    labels = files.where((at(-2) == "labels") & F.endswith("path", F.lit(".txt"))).select(at(-3).alias("_l"), F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("ARRAY"), F.lit(False)).alias("_v"))
    labels = labels.groupBy("_l").agg(F.count(F.lit(1)).alias("labels"), F.count_if(~F.col("_v")).alias("invalid_labels"))
    k = F.col(key).cast("string")
    rows = runs.join(doc, k == F.col("_k"), "left").join(labels, k == F.col("_l"), "left")
    return rows.select(*runs.columns, *[F.try_variant_get("_d", p, "bigint").alias(c) for c, p in counters.items()], F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("invalid_labels", F.lit(0)).alias("invalid_labels"))
