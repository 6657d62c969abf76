"""Bucketed document tables: merges and deletes touch their buckets alone and keep a log."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from relayloom.operators import corpus, tables

ROW = "id string, title string, text string, category string, metadata map<string,string>, created_at timestamp, updated_at timestamp"


def documents(spark, rows, year):
    at = F.lit(f"{year}-01-01").cast("timestamp")
    return spark.createDataFrame([(i, f"t{i}", t, "c", {"k": "v"}, None, None) for i, t in rows], ROW).withColumns({"created_at": at, "updated_at": at})


def contents(df):
    return {(r.id, r.title, r.text, r.content_hash, r.created_at, r.updated_at, tuple(r.metadata.items()), r.word_count) for r in df.collect()}


def test_merge_and_delete_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "docs")
    base = corpus.upsert(documents(spark, [], 2024), documents(spark, [(f"d{i}", f"text {i}") for i in range(40)], 2024).withColumn("seq", F.lit(1)))
    tables.create_table(base, path, buckets=16)
    assert contents(tables.read_table(spark, path)) == contents(base)
    files = lambda: {f: f.stat().st_mtime_ns for f in Path(path, "rows").rglob("*.parquet")}
    old = files()
    patch = documents(spark, [("d3", "new text"), ("d5", "text 5"), ("x", "more")], 2025).withColumn("seq", F.lit(1))
    want = contents(corpus.upsert(base, patch))
    assert tables.merge_into(patch, path) == 1 and contents(tables.read_table(spark, path)) == want
    number = lambda ids: {r.b for r in spark.createDataFrame([(i,) for i in ids], "id string").select(tables.bucket_of(F.col("id"), 16).alias("b")).collect()}
    of = lambda found: {int(f.parent.name.removeprefix("bucket=")) for f in found}
    new = files()
    assert of(set(old.items()) ^ set(new.items()) and {f for f, _ in set(old.items()) ^ set(new.items())}) == number(["d3", "d5", "x"])
    log = lambda: {(r.version, r.id, r.change) for r in tables.read_log(spark, path).collect()}
    assert log() == {(1, "d3", "changed"), (1, "x", "added")}
    gone = spark.createDataFrame([(f"d{i}",) for i in range(40)] + [("x",), ("never",)], "id string")
    assert tables.delete_from(gone.where("id in ('d1', 'never')"), path) == 2 and log() >= {(2, "d1", "removed")} and len(log()) == 3
    assert {r.id for r in tables.read_table(spark, path).collect()} == {f"d{i}" for i in range(40)} - {"d1"} | {"x"}
    tables.delete_from(gone.where("id <> 'd7'"), path)
    assert [r.id for r in tables.read_table(spark, path).collect()] == ["d7"]  # emptied buckets go as well


def test_some_buckets_alone_are_read(spark, tmp_path):
    path = str(tmp_path / "docs")
    tables.create_table(corpus.upsert(documents(spark, [], 2024), documents(spark, [(f"d{i}", "t") for i in range(20)], 2024).withColumn("seq", F.lit(1))), path, buckets=8)
    plan = tables.read_table(spark, path, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
